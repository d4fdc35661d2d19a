from __future__ import annotations

import pytest

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.saved(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    out = P.STAGES[-1][1](spark, docs, FOLDER)
    assert out.where("not round_trip").count() == 0 and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(100))
    rows = [(3, base), (1, base), (2, base + " more"), (2, base + " more"), (9, "something else entirely in this one"), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in P.keep_one_of_near_duplicates(spark, docs, FOLDER).collect()) == ["1", "9", "None"]


def test_near_duplicate_stage_keeps_all_texts_of_an_id(spark):
    rows = [(4, "one text of the id, of its own"), (4, "another text of it, with other words"), (4, "one text of the id, of its own"), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["text"]) for r in P.keep_one_of_near_duplicates(spark, docs, FOLDER).collect()) == sorted(map(str, {t for _, t in rows}))


def test_mixing_stage_repeats_rows(spark):
    rows = [(i % 40, f"w{i} " * (i % 9 + 1), "en", ["a", "b", None][i % 3], 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.mix(spark, docs, FOLDER)
    words = lambda d: sum(len(r["text"].split()) for r in d.collect())
    assert out.columns == docs.columns and abs(words(out) / words(docs) - 1.5) < 0.15


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_clashing_columns(spark, k):
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 300 AND 900").orderBy("doc_id").first()["text"]
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text + " tail"), (4, (text[::-1] + " ") * 1500), (5, "12 34"), (6, text)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, kept boolean, size int, copies int, taken int, bucket int, n int"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, True, 1, 1, 1, 1, 1) for i, t in rows], extra)
    out = P.STAGES[k][1](spark, docs, FOLDER)
    found = out.collect()
    ids = sorted(str(r["doc_id"]) for r in found)
    if k < 4:
        assert out.columns == docs.columns
    if k == 1:  # no letters: no language; repeated rows stay, as does a null id
        assert set(ids) <= {"1", "4", "6", "None"} and ids.count("1") == 2 and "6" in ids
    if k == 2:  # copies go, texts without words stay
        assert ids == ["1", "2", "3", "4", "5", "None"]
    if k == 3:
        assert {"1", "4", "6"} & set(ids)
    if k == 4:
        assert set(ids) == {"1", "2", "3", "4", "5", "6", "None"} and all(r["round_trip"] for r in found)


@pytest.mark.parametrize("k", range(5))
def test_empty_documents(spark, k, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert P.STAGES[k][1](spark, docs, FOLDER).count() == 0
