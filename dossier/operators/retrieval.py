"""Hybrid retrieval: vector, word and reference paths, union, pooling, quotas and thresholds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Fixed values that results depend on: candidates of a path, least score, units of a category, least passage score.
CANDIDATES = 30
LEAST_SCORE = 0.219
UNITS_OF_CATEGORY = 3
RECITALS = 2


#: Rows of a block and queries of a wave: what one task of a vector search holds.
BLOCK_ROWS = 16_384
WAVE_QUERIES = 4096
#: Scores that a task has at a time.
SCORES = 1 << 21


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def met_in_blocks(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, reduce_: Callable[[np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, keep: list[str] | None = None) -> DataFrame:
    """reduce_(scores, rows, query ids) of the cosines of some queries (down) with the rows of a block (across); what leaves a task is what it returns.

    A stated set of queries meets all rows in blocks: rows are dealt to blocks by a hash of their id and queries to waves; a task makes
    the matrix products of a block and a wave. Vectors that are null, of another length than the query or without direction have no
    cosine (nan). keep: columns of rows that reduce_ sees beside id.
    """
    n, q = rows.count(), queries.count()
    blocks, waves = max(1, -(-n // BLOCK_ROWS)), max(1, -(-q // WAVE_QUERIES))
    part = lambda df, name, many, more: df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more).withColumn(name, F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))
    left = part(rows, "block", blocks, keep or []).withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    right = part(queries, "wave", waves, []).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def fn(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        sizes, wanted = own["v"].map(len), asked["v"].map(len)
        for size in set(sizes) & set(wanted):
            x, y = np.stack(own.loc[sizes == size, "v"]), np.stack(asked.loc[wanted == size, "v"])
            rest, asks = own.loc[sizes == size].drop(columns="v").reset_index(drop=True), asked.loc[wanted == size, "id"].to_numpy()
            step = max(1, SCORES // len(x))
            for at in range(0, len(y), step):
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = y[at : at + step] @ x.T / (np.linalg.norm(y[at : at + step], axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                scores[~np.isfinite(scores)] = np.nan
                found.append(reduce_(scores, rest, asks[at : at + step]))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return left.groupBy("block", "wave").cogroup(right.groupBy("block", "wave")).applyInPandas(fn, schema)


def cosine_distances(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = CANDIDATES) -> DataFrame:
    """query_id, id, distance (six decimals), score (the cosine itself) and place of each query's k nearest rows, ties to the smaller id."""

    def nearest(scores: np.ndarray, own: pd.DataFrame, asks: np.ndarray) -> pd.DataFrame:
        d = np.where(np.isnan(scores), np.inf, np.round(1 - scores, 6) + 0.0)
        # all rows at the k-th distance stay, as ties go by id
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.full((len(d), 1), np.inf)
        i, j = np.nonzero((d <= bound) & np.isfinite(d))
        found = pd.DataFrame({"query_id": asks[i], "id": own["id"].to_numpy()[j], "distance": d[i, j], "score": scores[i, j]})
        return found.sort_values(["query_id", "distance", "id"]).groupby("query_id").head(k)

    out = met_in_blocks(rows, queries, id_col, vector, nearest, "query_id bigint, id bigint, distance double, score double")
    return best_of_each(out, "query_id", [F.col("distance"), F.col("id")], k)


def passing(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, least: float = LEAST_SCORE) -> DataFrame:
    """query_id, kept and best: how many other rows have a cosine of at least that with each query, and the largest. One row leaves a block for a query."""

    def sums(scores: np.ndarray, own: pd.DataFrame, asks: np.ndarray) -> pd.DataFrame:
        s = np.where(np.isnan(scores) | (own["id"].to_numpy()[None, :] == asks[:, None]), -np.inf, scores)
        best = s.max(axis=1)
        return pd.DataFrame({"query_id": asks, "kept": (s >= least).sum(axis=1), "best": best})[np.isfinite(best)]

    out = met_in_blocks(rows, queries, id_col, vector, sums, "query_id bigint, kept bigint, best double")
    return out.groupBy("query_id").agg(F.sum("kept").alias("kept"), F.max("best").alias("best"))


def best_of_groups(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, by: list[str]) -> DataFrame:
    """query_id, the columns by (longs) and score: the largest cosine (six decimals) of each query with the rows of a group; one row leaves a block for each."""

    def tops(scores: np.ndarray, own: pd.DataFrame, asks: np.ndarray) -> pd.DataFrame:
        group = own.groupby(by, sort=False).ngroup().to_numpy()
        firsts = own[by].iloc[np.unique(group, return_index=True)[1]]
        out = []
        for g, key in enumerate(firsts.itertuples(index=False)):
            s = scores[:, group == g]
            top = np.where(np.isnan(s), -np.inf, s).max(axis=1)
            out.append(pd.DataFrame({"query_id": asks, **dict(zip(by, key, strict=True)), "score": top})[np.isfinite(top)])
        return pd.concat(out, ignore_index=True)

    schema = ", ".join(["query_id bigint", *[f"{c} bigint" for c in by], "score double"])
    out = met_in_blocks(rows.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in by))), queries, id_col, vector, tops, schema, by)
    return out.groupBy("query_id", *by).agg(F.round(F.max("score"), 6).alias("score"))


def best_of_each(df: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("place") <= k)


def first_arrival(paths: list[DataFrame], query: str, id_col: str, rank: str) -> DataFrame:
    """Union of a query's paths: each id once, at its first path and place there, with the paths that found it."""
    tagged = [p.select(query, id_col, rank, F.lit(i).alias("path")) for i, p in enumerate(paths)]
    both = reduce(DataFrame.unionByName, tagged)
    out = both.groupBy(query, id_col).agg(F.min(F.struct("path", rank)).alias("first"), F.sort_array(F.collect_set("path")).alias("paths"))
    return out.select(query, id_col, F.col("first.path").alias("path"), F.col(f"first.{rank}").alias("place"), F.array_join("paths", ",").alias("paths"))


def pooled(df: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """Each unit's best score, the item that has it (ties to the smaller) and how many items it has; the items stay rows of df."""
    top = F.max_by(item, F.struct(F.col(score), -F.col(item)))
    return df.groupBy(*by).agg(F.max(score).alias("best"), top.alias("item"), F.count("*").alias("items"))


def barrier(sums: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """kept and best (six decimals) of each query, and reason: below_threshold if nothing reaches it, no_candidates if nothing was found, else null."""
    out = queries.join(sums, query, "left").withColumns({"kept": F.coalesce("kept", F.lit(0).cast("bigint")), "best": F.round("best", 6)})
    return out.withColumn("reason", F.when(F.col("best").isNull(), "no_candidates").when(F.col("kept") == 0, "below_threshold"))


def merged_results(results: DataFrame, by: str, unit: str, item: str, score: str, least: float = LEAST_SCORE) -> DataFrame:
    """Several results as one: each unit with the best score of its items over all, the items it has, and whether any result selected it."""
    items = results.groupBy(by, unit, item).agg(F.max(score).alias("__s"))
    units = items.groupBy(by, unit).agg(F.max("__s").alias("best"), F.count("*").alias("items"))
    return units.withColumns({"selected": F.col("best") >= least, "best": F.round("best", 6)})  # the threshold is for the score itself


def quota(df: DataFrame, category: str, order: list[Column], k: int = UNITS_OF_CATEGORY) -> DataFrame:
    """The first k of each category."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= k)


def neighbours(df: DataFrame, group: list[str], order: str, seeds: Column) -> DataFrame:
    """Rows next to a seed (place one before or after in the same group), seeds left out."""
    place = Window.partitionBy(*group).orderBy(order)
    near = lambda f, seed: F.coalesce(f("__seed").over(place) & (f(order).over(place) == F.col(order) + seed), F.lit(False))
    out = df.withColumn("__seed", F.coalesce(seeds, F.lit(False)))
    out = out.withColumn("__near", near(F.lag, -1) | near(F.lead, 1))
    return out.where("__near AND NOT __seed").drop("__seed", "__near")
