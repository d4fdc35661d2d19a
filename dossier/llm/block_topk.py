"""Exact top-k inner products by block-at-a-time pruning.

The rows of a shard are put in an order that keeps like vectors together and cut into ranges, the blocks. A block
keeps the largest and least value of every term (dimension) and a forward index of its rows. For a query, the
term maxima (times the query's weight; the minima where that is negative) sum to a bound on every score in the
block. Blocks are scored in descending order of their bound, until the bound falls below the k-th score found.
Blocks whose bound equals it are still scored, as ties go to the smaller id.

Each query first meets the one shard that its own row is in. The k-th score it finds there is a floor for the final one, so
in every shard only blocks with a bound at or above that floor are scored at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .storage import saved
from .vectors import RESULT, best, matrix, met, parted, smallest, usable

SHARD_ROWS = 8192
BLOCK_ROWS = 64
#: Queries scored together.
BATCH = 512
INDEX = "shard int, dim int, ids binary, rows binary, top binary, low binary"


def ordered(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which like rows are neighbours: two rounds of nearest of a few spread-out rows."""
    centres = x[np.linspace(0, len(x) - 1, max(1, min(len(x), len(x) // BLOCK_ROWS))).astype(int)].astype(float)
    for _ in range(3):
        near = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return np.argsort(near, kind="stable")


def _index(group: pd.DataFrame) -> pd.DataFrame:
    dim = int(group["vector"].map(len).max())
    x = matrix(group["vector"], max(1, dim), np.int64)
    order = ordered(x.astype(np.float64))
    x, ids = x[order], group["vec_id"].to_numpy(np.int64)[order]
    cut = np.arange(0, len(x), BLOCK_ROWS)
    top, low = np.maximum.reduceat(x, cut), np.minimum.reduceat(x, cut)
    return pd.DataFrame({"shard": [group["shard"].iloc[0]], "dim": [x.shape[1]], "ids": [ids.tobytes()], "rows": [x.tobytes()], "top": [top.tobytes()], "low": [low.tobytes()]})


MOST = np.iinfo(np.int64).max


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles hold the sums exactly while they stay below 2**53, longs below 2**63; Python's integers beyond."""
    most = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
    largest = most(q) * most(x) * max(1, x.shape[1])
    return np.float64 if largest < 2.0**53 else np.int64 if largest < 2.0**62 else object


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b; what a long can't hold is the nearest that it can. That keeps the order of bounds and scores."""
    out = a @ b
    return np.clip(out, -MOST, MOST).astype(np.int64) if out.dtype == object else out


def block_search(
    q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, top: np.ndarray, low: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[pd.DataFrame, int]:
    """The k best rows of one shard for each query, and how many pairs of query and block were scored.

    Rows with the query's own id are left out. floor: a score that k rows of any shard are known to reach; rows below it are left out too.
    """
    kind = _kind(q, x)
    q, x, top, low = (a.astype(kind) for a in (q, x, top, low))
    bound = _product(np.concatenate((np.maximum(q, 0), np.minimum(q, 0)), axis=1), np.concatenate((top, low), axis=1).T)
    turn = np.argsort(-bound, axis=1, kind="stable")
    kth = np.full(len(q), -np.inf if kind is np.float64 else -MOST, bound.dtype)
    if floor is not None:
        kth = np.maximum(kth, floor.astype(bound.dtype))
    held = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, bound.dtype)})
    open_, scored = np.arange(len(q)), 0
    for step in range(turn.shape[1]):
        block = turn[open_, step]
        still = bound[open_, block] >= kth[open_]
        open_, block = open_[still], block[still]
        if not len(open_):
            break
        scored += len(open_)
        parts = [held]
        for b in np.unique(block):
            who = open_[block == b]
            rows = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
            scores = _product(q[who], x[rows].T)
            keep = (scores >= kth[who, None]) & (ids[rows][None, :] != own[who, None])
            i, j = np.nonzero(keep)
            parts.append(pd.DataFrame({"query_id": who[i], "vec_id": ids[rows][j], "score": -scores[i, j]}))
        held = pd.concat(parts, ignore_index=True)
        held = smallest(held["query_id"].to_numpy(), held["vec_id"].to_numpy(), held["score"].to_numpy(), k)
        full = held.groupby("query_id")["score"].agg(["size", "max"])
        full = full[full["size"] >= k]
        kth[full.index.to_numpy()] = np.maximum(kth[full.index.to_numpy()], -full["max"].to_numpy())
    return pd.DataFrame({"query_id": own[held["query_id"].to_numpy()], "vec_id": held["vec_id"], "score": (-held["score"]).astype(np.int64)}), scored


def top_products(rows: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of floor(scale * x) vectors for every query row.

    Queries are the rows whose id is divisible by every; candidates all rows with another id. Vectors that are null
    or hold null or non-finite components take no part, nor do null ids; a shorter vector counts as filled with 0, an empty
    one as all 0. Components and scores beyond a long are the long nearest to them.
    A query id that is repeated is asked once, with the least of its vectors; repeated candidate rows all count.
    Returns query_id, rank (from 1), vec_id, score, ties to the smaller id; fewer than k where candidates are fewer. An empty table gives
    no rows; other columns may have any name.
    """
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-float(MOST))), F.lit(float(MOST)))
    clean = rows.where(F.col(id_col).isNotNull() & usable(vector_col, zero=True)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector_col, lambda x: whole(x).cast("bigint")).alias("vector")
    )
    parts, queries, shards, waves = parted(clean, SHARD_ROWS, every)
    index = saved(parts.groupBy("shard").applyInPandas(_index, INDEX), "block-index")

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in own.itertuples():
            dim = max(r.dim, int(asked["vector"].map(len).max() if len(asked) else 0))
            ids = np.frombuffer(r.ids, np.int64)
            x, top, low = (np.pad(np.frombuffer(b, np.int64).reshape(-1, r.dim), ((0, 0), (0, dim - r.dim))) for b in (r.rows, r.top, r.low))
            for at in range(0, len(asked), BATCH):
                part = asked.iloc[at : at + BATCH]
                floor = part["floor"].to_numpy(np.int64) if "floor" in part else None
                found.append(block_search(matrix(part["vector"], dim, np.int64), part["vec_id"].to_numpy(np.int64), x, ids, top, low, k, floor)[0])
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    if shards > 1:
        at_home = queries.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard")
        seed = index.groupBy("shard").cogroup(at_home).applyInPandas(search, RESULT.format("bigint"))
        reached = seed.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        floors = saved(reached, "block-floors")
        queries = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-MOST)))
    return best(met(index, queries, shards, waves, search, RESULT.format("bigint")), k, descending=True)
