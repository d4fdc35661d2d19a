from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import near_dup
from dossier.llm.components import components
from dossier.llm.shingles import shingle_sets


def reference(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


def brute(rows, words, percent):
    sets = [(i, reference(t, words)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def test_shingles_equal_strings():
    texts = ["", " \t", "a", "A b", "a b c d", "a  b\nC D e a b c d", "x" * 20, " lead", "a b a b a b a b a", "é\x0bÉ é ñ Ñ", "a\xa0b c d e"]
    for words in (1, 3, 4, 5):
        for t, s in zip(texts, shingle_sets([t.encode() for t in texts], words), strict=True):
            assert len(s) == len(reference(t, words)), (t, words)


def corpus(seed, edits):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows = []
    for size in (30, 90, 400, 700):
        base = rng.choice(vocabulary, size)
        for _ in range(40):  # near copies on both sides of the threshold, in chains
            own = base.copy()
            for _ in range(int(rng.integers(0, max(2, size * edits // 100)))):
                own[rng.integers(0, size)] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [f"{passage} {' '.join(rng.choice(vocabulary, int(rng.integers(2, 60))))}" for _ in range(60)]
    rows += ["same text here again"] * 30 + ["", None, "  ", "one", "ONE", "two words"] + [" ".join(rng.choice(vocabulary, 50)) for _ in range(40)]
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 1, rows[i]) for i in order]


@pytest.mark.parametrize(("seed", "edits", "short"), [(0, 4, 24), (1, 6, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, edits, short):
    monkeypatch.setattr(near_dup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = corpus(seed, edits)
    docs = spark.createDataFrame([(i, t, "n", True) for i, t in rows], "doc_id long, text string, n string, kept boolean").repartition(3)
    out = near_dup.near_duplicates(docs, words=4, percent=80).toPandas()
    component, size = brute(rows, 4, 80)
    assert len(out) == len(rows)
    for r in out.itertuples():
        assert (r.component_id, r.n_shingles, r.kept) == (component[r.doc_id], size[r.doc_id], component[r.doc_id] == r.doc_id)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (9, None)], "doc_id long, text string")
    out = sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())))
    assert out == sorted(map(str, [(None, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]))


def test_ids_with_several_texts(spark, monkeypatch):
    for short in (24, 2):
        monkeypatch.setattr(near_dup, "SHORT_LIST", short)
        a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcde")
        rows = [(3, b), (5, a), (5, b), (5, None), (7, a + " more"), (7, None), (8, d), (9, c), (9, e), (9, ""), (10, a + " and more"), (11, e + " more")]
        rows += [(13, ""), (13, d + " more"), (14, ""), (15, None), (17, " "), (17, c), (18, a), (18, e + " x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = near_dup.near_duplicates(docs, words=4, percent=80).collect()
        component, _ = brute(rows, 4, 80)
        assert len(out) == len(rows) and {component[i] for i in (5, 7, 9, 17, 18)} == {3}
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(i, k, i == k) for i, k in component.items()}
        assert sorted((r["doc_id"], r["n_shingles"]) for r in out) == sorted((i, len(reference(t, 4))) for i, t in rows)


def test_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components(links).collect()} == {(i, 0) for i in range(1, 61)} | {(100, 99)}


def test_one_id_with_different_texts_is_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(2, a), (5, a), (5, b), (9, b), (9, None), (7, "w " * 300_000), (8, "w " * 300_000), (1, None), (1, "")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(2, 2, True), (5, 2, False), (9, 2, False), (7, 7, True), (8, 7, False), (1, 1, True)}


def test_frequent_values_stand_out(spark):
    values = spark.range(2000).select((F.col("id") * 7919).alias("v")).unionByName(spark.range(5000).select(F.lit(11).cast("long").alias("v")))
    cells = near_dup.counted_cells(values)
    assert len(cells) == near_dup.LEAST_CELLS and cells.argmax() == 11 and cells.sum() == 7000
    assert near_dup.counted_cells(values.limit(0)).sum() == 0
