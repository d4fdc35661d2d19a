from __future__ import annotations

import numpy as np
import pytest

from dossier.llm.mixing import mix_sources, pivot, source_targets


def test_targets():
    t = source_targets({"a": 100, "b": 100, "c": 10, None: 50})
    assert t["c"] == 20 and abs(sum(t.values()) - 390) < 1e-9 and all(t[s] <= 2 * n for s, n in {"a": 100, "b": 100, "c": 10, None: 50}.items())
    assert source_targets({}) == {} and source_targets({"a": 0}) == {"a": 0.0}


def test_pivot_keeps_words_and_chances():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 40), rng.random(40)
    total = np.zeros(40)
    for _ in range(4000):
        out, held = pivot(size, p, rng.random(40))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert sum((out > 0) & (out < 1)) <= 1 and (held < 0 or 0 < out[held] < 1)
        total += out
    assert np.abs(total / 4000 - p).max() < 0.05


@pytest.mark.parametrize("seed", [0, 1])
def test_documents(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join("w" * int(rng.integers(1, 60))), ["a", "b", "hot", "hot", None][i % 5], 1.0) for i in range(600)]
    rows += [(5, None, "a", 1.0), (None, "x y", "b", 1.0), (9, "", "zero", 1.0), (3, rows[3][1], "hot", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = mix_sources(docs, seed=seed).toPandas()
    assert len(out) == len(rows)
    assert ((out["taken"] <= 2 * out["size"]) & (out["taken"] == out["copies"] * out["size"])).all()
    for _, own in out.groupby(out["source"].fillna("")):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= max(60, 0.01 * own["target"].iloc[0])
    again = mix_sources(docs.repartition(5), seed=seed).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() or out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_one_id_in_many_rows_and_a_long_text(spark):
    rows = [(7, f"w{i} " * (i % 5 + 1), "hot") for i in range(3000)] + [(None, f"x{i}", "hot") for i in range(500)] + [(1, "long " * 200_000, "b")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == len(rows)
    for _, own in out.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() / 2 + 1


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
