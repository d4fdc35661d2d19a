from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm.sharding import minimax_cuts, shard_documents

SCHEMA = "doc_id long, text string, size string, shard int"  # names that clash with the result's


def brute(sizes, shards):
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("blocks", [4, 16, 8192])
def test_smallest_capacity_for_any_summary(spark, blocks):
    sizes = np.random.default_rng(blocks).integers(1, 60, 200).tolist()
    prefix = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "high long")
    capacity, cuts = minimax_cuts(prefix, sum(sizes), 7, max(sizes), blocks)
    assert capacity == brute(sizes, 7)
    edges = [0, *cuts, sum(sizes)]
    assert set(cuts) <= set(np.cumsum(sizes).tolist()) and max(np.diff(edges)) <= capacity


def test_documents(spark):
    texts = ["hot"] * 40 + [None, None, ""] + ["x" * n for n in range(60)] + ["é" * 30, "y" * 5000]
    rows = [(i if i else None, t, "a", 9) for i, t in enumerate(texts)] + [(7, "hot", "a", 9)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 8).toPandas()
    assert len(out) == len(rows)
    for shard, own in out.groupby("shard"):
        assert 0 <= shard < 8 and sorted(own["slot"]) == list(range(len(own)))
    own = out.merge(__import__("pandas").DataFrame({"doc_id": [r[0] for r in rows[1:-1]], "text": [r[1] for r in rows[1:-1]]}), on="doc_id")
    for text, group in own.groupby(own["text"].fillna("")):
        assert group["shard"].nunique() == 1 and set(group["size"]) == {len(text.encode()) + 1} and set(group["text_crc32"]) == {zlib.crc32(text.encode())}
    again = shard_documents(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), 8).toPandas()
    assert out.groupby("shard")["size"].sum().to_dict() == again.groupby("shard")["size"].sum().to_dict()


def test_capacity_is_the_least_for_the_order(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(20, 400, 150)] + ["long " * 200_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    out = shard_documents(docs, 6).toPandas()
    key = F.unhex(F.sha2("text", 256))
    order = docs.groupBy(key.alias("k")).agg(F.sum(F.octet_length("text") + 1).alias("n"), F.min("doc_id").alias("i"))
    order = order.orderBy(F.pmod(F.xxhash64("k"), F.lit(256)), "k").toPandas()
    sizes = order[order["n"] < 10_000]["n"].tolist()
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() == 1_000_001 and sorted(loads)[-2] == brute(sizes, 5) and len(loads) == 6
    place = out.drop_duplicates("doc_id").set_index("doc_id")["shard"]
    assert place.loc[order[order["n"] < 10_000]["i"]].is_monotonic_increasing  # shards are runs of the order


def test_repeats_of_one_row_and_one_id(spark):
    rows = [(1, "hot")] * 25_000 + [(1, f"t{i}") for i in range(50)] + [(None, "hot")] * 30
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3).toPandas()
    assert len(out) == len(rows) and out[out["text_crc32"] == zlib.crc32(b"hot")]["shard"].nunique() == 1
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_many_shards_end(spark):
    prefix = spark.createDataFrame([(int(x),) for x in np.cumsum([3] * 500)], "high long")
    assert minimax_cuts(prefix, 1500, 200, 3, 16)[0] == 9


def test_few_and_none(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA), 8).count() == 0
    one = shard_documents(spark.createDataFrame([(1, "a", "", 0)], SCHEMA), 8).first()
    assert (one["size"], one["slot"]) == (2, 0)
    same = shard_documents(spark.createDataFrame([(i, "a", "", 0) for i in range(9)], SCHEMA), 8)
    assert same.select("shard").distinct().count() == 1
    assert same.agg(F.max("slot")).first()[0] == 8
