"""What the two vector searches share: valid rows, shards, query blocks, and merging.

A shard holds a bounded number of rows, chosen by a hash of the id. Queries are packed into blocks, and a wave
of blocks meets a shard in one task: both sides are repeated for the other's number, and a task holds one shard
and one wave, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Queries of a wave: what one task holds beside its shard. The index is sent out once for each wave.
WAVE_QUERIES = 16_384
RESULT = "query_id bigint, vec_id bigint, score {}"


def usable(vector: str, zero: bool) -> Column:
    """The vector is there, no component null or non-finite; zero: one without components, or all of them 0, will do."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = F.col(vector).isNotNull() & finite
    return kept if zero else kept & F.exists(vector, lambda x: x != 0)


def parted(rows: DataFrame, shard_rows: int, every: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows with their shard, queries with their wave, and the numbers of both. rows: vec_id, vector."""
    n, q = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, waves = max(1, -(-n // shard_rows)), max(1, -(-q // WAVE_QUERIES))
    parts = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = queries.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves)).cast("int"))
    return parts, queries, shards, waves


def met(index: DataFrame, queries: DataFrame, shards: int, waves: int, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """search(the shard's index rows, the wave's queries) for each shard and wave."""
    left = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "wave").cogroup(right.groupBy("shard", "wave")).applyInPandas(search, schema)


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best of each query over all shards, ties to the smaller id."""
    order = F.desc("score") if descending else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(vectors: pd.Series, dim: int, kind: type = np.float64) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with 0."""
    out = np.zeros((len(vectors), dim), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def smallest(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k first of each query's rows by score, then id. Rows may come in any order."""
    order = np.lexsort((ids, scores, query_ids))
    query_ids, ids, scores = query_ids[order], ids[order], scores[order]
    first = np.r_[True, query_ids[1:] != query_ids[:-1]] if len(query_ids) else np.zeros(0, bool)
    rank = np.arange(len(query_ids)) - np.maximum.accumulate(np.where(first, np.arange(len(query_ids)), 0))
    keep = rank < k
    return pd.DataFrame({"query_id": query_ids[keep], "vec_id": ids[keep], "score": scores[keep]})
