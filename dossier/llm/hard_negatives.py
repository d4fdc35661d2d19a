"""Hard negatives by inverted lists with centroids and radii.

1. K-means on a bounded sample gives the lists' centroids; every row goes to the list of its nearest centroid. A list is cut
   into parts of bounded size by a hash of the id, so that a hot list is many tasks. A part holds finer lists in turn, each of
   rows of one label, with centroid and radius.
2. By Cauchy and Schwarz, a query q meets in a list of centroid c and radius r only scores from q.c - |q| r to q.c + |q| r.
   Lists are visited in descending order of the upper end. One that is wholly outside the asked window of scores is skipped, and
   a query stops once the upper end falls strictly below its k-th score (lists that reach it are still visited: ties go to the
   smaller id).
3. A query first meets one part of the list of its own centroid. The k-th score there is a floor for the final one: after that,
   a query is sent only to the lists whose upper end reaches its floor and its window.

Two such searches follow one another: an anchor's best rows of its own label (its positives), then, for each of them, the best rows
of other labels in the window that the positive's score sets. All scores are integers and exact; bounds get a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .block_topk import MOST, _kind, _product
from .storage import saved
from .vectors import WAVE_QUERIES, matrix, usable

#: Rows that the centroids are fitted on, about, and rounds of fitting.
SAMPLE_ROWS = 16_384
ROUNDS = 8
#: Rows of a list on average, lists at most (their centroids are on the driver), rows of a part and of a finer list, about.
LIST_ROWS = 1024
MOST_LISTS = 1024
PART_ROWS = 2048
FINE_ROWS = 64
INDEX = "list int, part int, dim int, ids binary, labels binary, rows binary, cut binary, centres binary, radii binary"
FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids, or as many as x has rows, from evenly spread first ones; an empty one stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, max(1, min(k, len(x)))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin((centres**2).sum(1) - 2 * (x[at : at + 4096] @ centres.T), axis=1)
    return out


def _wide(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, filled with 0 or cut to dim. For bounds of what is cut there is the rest of the radius."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), dim)] = v[:dim]
    return out


def _assigned(centres: np.ndarray):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _wide(batch["vector"], centres.shape[1])
            near = nearest_centre(x, centres)
            whole = np.array([float((np.asarray(v, np.float64) ** 2).sum()) for v in batch["vector"]])
            rest = np.maximum(0, whole - (x**2).sum(1))  # components beyond the centroids' length
            gap = np.sqrt(((x - centres[near]) ** 2).sum(1) + rest)
            yield batch.assign(list=near.astype(np.int32), gap=gap)

    return fn


def _index(group: pd.DataFrame) -> pd.DataFrame:
    x = matrix(group["vector"], max(1, int(group["vector"].map(len).max())), np.int64)
    ids, labels = group["vec_id"].to_numpy(np.int64), group["label"].to_numpy(np.int64)
    wide, fine = x.astype(np.float64), np.zeros(len(x), np.int64)
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        fine[own] = nearest_centre(wide[own], k_means(wide[own], len(own) // FINE_ROWS, 4))
    order = np.lexsort((ids, fine, labels))
    x, wide, ids, labels, fine = x[order], wide[order], ids[order], labels[order], fine[order]
    cut = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (fine[1:] != fine[:-1])])
    size = np.diff(np.r_[cut, len(x)])
    centres = np.add.reduceat(wide, cut) / size[:, None]
    radii = np.maximum.reduceat(np.sqrt(((wide - np.repeat(centres, size, axis=0)) ** 2).sum(1)), cut)
    parts = {"ids": ids, "labels": labels, "rows": x, "cut": cut.astype(np.int64), "centres": centres, "radii": radii}
    return pd.DataFrame({"list": [group["list"].iloc[0]], "part": [group["part"].iloc[0]], "dim": [x.shape[1]]} | {k: [v.tobytes()] for k, v in parts.items()})


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of each query with any row of each list, with a margin for rounding."""
    q = q.astype(np.float64)
    length = np.sqrt((q**2).sum(1))[:, None]
    middle, reach = q @ centres.T, length * radii[None, :]
    margin = 1 + 1e-9 * (length * (np.sqrt((centres**2).sum(1)) + radii)[None, :])
    return middle - reach - margin, middle + reach + margin


def _first(q: np.ndarray, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query and slot by score, descending, then id; longs throughout."""
    order = np.lexsort((ids, -scores, slot, q))
    q, slot, ids, scores = q[order], slot[order], ids[order], scores[order]
    at = np.arange(len(q))
    new = np.r_[True, (q[1:] != q[:-1]) | (slot[1:] != slot[:-1])] if len(q) else np.zeros(0, bool)
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return q[keep], slot[keep], ids[keep], scores[keep]


def list_search(q: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, index: dict, k: int) -> tuple[pd.DataFrame, int]:
    """The k best rows of a part for each query and slot, and how many pairs of query and list were scored.

    same: rows of the query's own label count, else those of other labels. low, high (queries x slots): the window of scores, floors
    included; low > high where a query has no such slot. Rows with the query's own id are left out.
    """
    x, ids, labels, cut, centres, radii = (index[c] for c in ("rows", "ids", "labels", "cut", "centres", "radii"))
    end = np.r_[cut[1:], len(x)]
    least, most = bounds(q, centres, radii)
    fits = (labels[cut][None, :] == label[:, None]) == same
    kth = low.astype(np.float64)  # compared with bounds that have a margin
    exact = low.copy()
    turn = np.argsort(-np.where(fits, most, -np.inf), axis=1, kind="stable")
    kind = _kind(q, x)
    q, x = q.astype(kind), x.astype(kind)
    held = tuple(np.zeros(0, np.int64) for _ in range(4))
    open_, at, width, scored = np.arange(len(q)), 0, 1, 0
    while len(open_) and at < turn.shape[1]:
        lists = turn[open_, at : at + width]
        who, where = np.repeat(open_, lists.shape[1]), lists.ravel()
        reach = fits[who, where]
        wanted = reach & ((most[who, where][:, None] >= kth[who]) & (least[who, where][:, None] <= high[who]) & (low[who] <= high[who])).any(1)
        # a query stops where no slot can still win from the bound of its next list on
        ahead = most[open_, lists[:, -1]]
        who, where = who[wanted], where[wanted]
        scored += len(who)
        order = np.argsort(where, kind="stable")
        who, where = who[order], where[order]
        parts = [held]
        for a, b in _runs(where):
            rows = slice(cut[where[a]], end[where[a]])
            some = who[a:b]
            scores = _product(q[some], x[rows].T).astype(np.int64)
            other = ids[rows][None, :] != own[some, None]
            for s in range(low.shape[1]):
                i, j = np.nonzero(other & (scores >= exact[some, s, None]) & (scores <= high[some, s, None]))
                parts.append((some[i], np.full(len(i), s), ids[rows][j], scores[i, j]))
        held = _first(*(np.concatenate(p) for p in zip(*parts, strict=True)), k)
        if len(held[0]):
            key = held[0] * low.shape[1] + held[1]
            last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
            count = np.diff(np.r_[-1, last])
            full = last[count >= k]
            exact[held[0][full], held[1][full]] = np.maximum(exact[held[0][full], held[1][full]], held[3][full])
            kth = exact.astype(np.float64)
        open_ = open_[((ahead[:, None] >= kth[open_]) & (low[open_] <= high[open_])).any(1)]
        at, width = at + width, width * 2
    return pd.DataFrame({"anchor_id": own[held[0]], "slot": held[1].astype(np.int32), "vec_id": held[2], "score": held[3]}), scored


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edge = [*np.flatnonzero(np.diff(values, prepend=-1)).tolist(), len(values)]
    return zip(edge[:-1], edge[1:], strict=True)


def _lists_reached(centres: np.ndarray, radii: np.ndarray, parts: np.ndarray):
    """For each query, the parts of all lists in which one of its slots can still find a row."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dim = max(centres.shape[1], int(batch["vector"].map(len).max()) if len(batch) else 0)
            wide = np.pad(centres, ((0, 0), (0, dim - centres.shape[1])))
            least, most = bounds(matrix(batch["vector"], dim, np.int64), wide, radii)
            low, high = _slots(batch["low"], MOST), _slots(batch["high"], -MOST)
            meets = ((most[:, :, None] >= low[:, None, :]) & (least[:, :, None] <= high[:, None, :]) & (low <= high)[:, None, :]).any(2)
            yield pd.DataFrame({"anchor_id": batch["anchor_id"], "reached": [[int(c) for c in np.flatnonzero(m)] for m in meets]}).assign(
                sizes=lambda d: [[int(parts[c]) for c in r] for r in d["reached"]]
            )

    return fn


def _slots(values: pd.Series, fill: int) -> np.ndarray:
    out = np.full((len(values), max([1, *map(len, values)])), fill, np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _task(same: bool, k: int):
    def fn(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "slot", "vec_id", "score")})]
        for r in own.itertuples() if len(asked) else ():
            dim = max(r.dim, int(asked["vector"].map(len).max()))
            plain = {c: np.frombuffer(getattr(r, c), np.int64) for c in ("ids", "labels", "cut")} | {"radii": np.frombuffer(r.radii, np.float64)}
            wide = {c: np.pad(np.frombuffer(getattr(r, c), kind).reshape(-1, r.dim), ((0, 0), (0, dim - r.dim))) for c, kind in (("rows", np.int64), ("centres", np.float64))}
            q = matrix(asked["vector"], dim, np.int64)
            ids, labels = asked["anchor_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
            found.append(list_search(q, ids, labels, same, _slots(asked["low"], MOST), _slots(asked["high"], -MOST), plain | wide, k)[0])
        return pd.concat(found, ignore_index=True)

    return fn


class _Lists:
    """The saved index, and of its lists the centroids, radii and numbers of parts: MOST_LISTS of each at most."""

    def __init__(self, clean: DataFrame) -> None:
        n, self.anchors = clean.agg(F.count("*"), F.count_if("anchor")).first()
        lists, share = max(1, min(MOST_LISTS, n // LIST_ROWS)), int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 30))
        drawn = clean.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id")
        first = drawn.select("vector").toPandas()["vector"]
        points = matrix(first, max([1, *map(len, first)]), np.float64)
        self.centres = k_means(points, lists) if len(points) else np.zeros((1, 1))
        schema = "vec_id bigint, label bigint, anchor boolean, vector array<bigint>, list int, gap double"
        rows = clean.mapInPandas(_assigned(self.centres), schema).withColumn("row", F.monotonically_increasing_id())
        self.rows = rows = saved(rows, "listed-rows")
        self.radii, self.parts = np.zeros(len(self.centres)), np.zeros(len(self.centres), np.int64)
        for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect():  # a row for each list
            self.radii[r["list"]], self.parts[r["list"]] = r["radius"], -(-r["n"] // PART_ROWS)
        of = F.create_map(*[F.lit(int(v)) for i, p in enumerate(self.parts) for v in (i, max(1, p))])[F.col("list")]
        self.home = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "row"), of).cast("int"))
        self.index = saved(self.home.groupBy("list", "part").applyInPandas(_index, INDEX), "list-index")
        self.waves = max(1, -(-self.anchors // WAVE_QUERIES))

    def _met(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """What the parts that queries name find for them; queries: list, part, anchor_id, label, vector, low, high."""
        keys = ["list", "part", "wave"]
        left = self.index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(self.waves - 1))))
        right = queries.withColumn("wave", F.pmod(F.xxhash64("anchor_id"), F.lit(self.waves)).cast("int"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_task(same, k), FOUND)

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor_id, slot, rank, vec_id, score: the k best of each slot. queries: anchor_id, label, vector, list, part, low, high."""
        seed = self._met(queries, same, k).groupBy("anchor_id", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).where("floor IS NOT NULL")
        floors = seed.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), x)))
        asked = queries.join(floors, "anchor_id", "left").withColumn("low", raised).drop("floors", "list", "part")
        asked = saved(asked, "asked")
        reached = asked.select("anchor_id", "vector", "low", "high").mapInPandas(_lists_reached(self.centres, self.radii, self.parts), "anchor_id bigint, reached array<int>, sizes array<int>")
        pairs = reached.select("anchor_id", F.explode(F.arrays_zip("reached", "sizes")).alias("r")).where("r.sizes > 0")
        pairs = pairs.select("anchor_id", F.col("r.reached").alias("list"), F.explode(F.sequence(F.lit(0), F.col("r.sizes") - 1)).alias("part"))
        found = self._met(asked.join(pairs, "anchor_id"), same, k)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels with low to high percent of the positive's score.

    A score is the integer inner product of floor(scale * x) vectors. Anchors are the rows whose id is divisible by every; an
    anchor's positives are the best other rows of its label, its negatives rows of other labels with low * positive <=
    100 * negative <= high * positive; all ties go to the smaller id. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. An anchor without positives, or a positive with an empty window (all of a negative score
    have one), gives no rows.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector counts as filled with
    0, an empty one as all 0. An anchor id that is repeated is asked once, with the least of its labels and vectors, and rows of its
    own id are never found; other repeated rows all count, each in a rank of its own, and a positive that is repeated gives rows for
    each. Other columns of rows may have any name. An empty table gives no rows. Components and scores beyond a long are the long
    nearest to them.
    """
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-float(MOST))), F.lit(float(MOST)))
    used = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col, zero=True)
    clean = rows.where(used).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("bigint").alias("label"),
        (F.col(id_col) % every == 0).alias("anchor"),
        F.transform(vector_col, lambda x: whole(x).cast("bigint")).alias("vector"),
    )
    lists = _Lists(clean)
    least = lists.home.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "list", "part")).alias("a"))
    anchors = saved(least.select(F.col("vec_id").alias("anchor_id"), "a.*"), "anchors")
    open_ = [F.array(F.lit(v)).alias(c) for c, v in (("low", -MOST), ("high", MOST))]
    first = lists.best(anchors.select("*", *open_), True, positives)
    first = saved(first.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    edge = lambda percent, to: percent * F.expr("positive_score div 100") + to(percent * F.expr("positive_score % 100") / 100)
    ends = F.struct("slot", edge(low, F.ceil).cast("bigint").alias("low"), edge(high, F.floor).cast("bigint").alias("high"))
    windows = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(ends)).alias("w"))  # one entry for each positive
    asked = anchors.join(windows, "anchor_id").select("*", F.col("w.low").alias("low"), F.col("w.high").alias("high")).drop("w")
    found = lists.best(asked, False, negatives).join(first, ["anchor_id", "slot"])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
