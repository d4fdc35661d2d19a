"""Cases of a review: ties, distances, late rows, pairs of a key, and what a task holds."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import matching, quotes, retrieval, selection, spans
from dossier.plans import FUNCTIONS


def test_greedy_pairs_walk_sorted_rows(spark):
    rows = [(k, left, right, 10 * left + right) for k in range(300) for left in (1, 2) for right in (1, 2)]
    out = spans.greedy_pairs(spark.createDataFrame(rows, "k long, l_id int, r_id int, common int").repartition(3), "k")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("k", "l_id", "r_id").collect())) == [(k, i, i) for k in range(300) for i in (1, 2)]


def test_levels_by_distance_of_doubles(spark):
    # 29.37 - 17.37 is a little over 12, 27.63 - 15.63 a little under, as doubles
    rows = [(1, 0, 17.37), (1, 1, 29.37), (2, 0, 15.63), (2, 1, 27.63)]
    out = selection.levels(spark.createDataFrame(rows, "k int, i int, place double"), ["k"], ["i"], "place", 12)
    expected = {(k, i): 0 if i == 0 or own - {1: 17.37, 2: 15.63}[k] >= 12 else 1 for k, i, own in rows}
    assert {(r["k"], r["i"]): r["level"] for r in out.collect()} == expected
    assert len(set(expected.values())) == 2


def test_noisy_text_is_searched_by_characters(spark):
    rows = spark.createDataFrame([("x brightly shyly myth end",)], "text string")
    got = rows.select(*[quotes.located(F.col("text"), F.lit("brightly shyly myth"), noisy=n).alias(a) for n, a in ((False, "f"), (True, "n"))]).first()
    assert (got["f"]["way"], got["n"]["way"]) == ("literal", "folded")
    assert (got["f"]["start"], got["f"]["end"]) == (got["n"]["start"], got["n"]["end"])


def test_windows_count_events_of_both_lots(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    # ids and times run in opposite order
    rows = [(i, at + datetime.timedelta(hours=6 * (40 - i)), 0.0, "click") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    out = FUNCTIONS["Z4_windows"](spark, str(tmp_path)).collect()
    assert {r["start"]: r["n"] for r in out} == {at + datetime.timedelta(hours=6 * k): 1 for k in range(1, 28)}


def test_first_read_explanation_wins_a_tie(spark, tmp_path):
    # line 1 of part 200001 and line 2 of part 100001 have one place in the order
    row = (0.0, 0.0, 0.0, 0.0, "N", "F", datetime.datetime(2024, 1, 1))
    rows = [(k, *own, *row) for k in range(50) for own in ((200001, 1, 1), (100001, 1, 2))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r["explanation"] for r in FUNCTIONS["A19_combined"](spark, str(tmp_path)).collect()} == {"part 200001"}


def test_all_pairs_of_a_key(spark):
    rows = spark.createDataFrame([(i, "q") for i in range(4)] + [(9, None)], "id int, q string")
    assert sorted(map(tuple, matching.pairs_within(rows, "q", "id").collect())) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_all_pairs_of_same_documents(spark):
    rows = [(1, "x", 1, "p"), (2, "x", 1, "p"), (3, "x", 2, None), (4, "y", 1, "p"), (5, None, 1, "p"), (6, None, 7, "p")]
    out = matching.same_documents(spark.createDataFrame(rows, "doc int, digest string, norm int, part string"), "doc", {"text": ["digest"], "norm and part": ["norm", "part"]})
    both = {(1, 2): "norm and part,text", (1, 3): "text", (2, 3): "text"} | {p: "norm and part" for p in ((1, 4), (2, 4), (1, 5), (2, 5), (4, 5))}
    assert {(r["doc"], r["other"]): r["kinds"] for r in out.collect()} == both


def test_cells_come_packed(spark):
    near_dup = pytest.importorskip("dossier.llm.near_dup")
    values = spark.range(0, 70_000).select((F.col("id") * 65_537).alias("v")).unionByName(spark.range(5).select(F.lit(3).cast("long").alias("v")))
    own = np.array([r["v"] for r in values.collect()]) & (near_dup.LEAST_CELLS - 1)
    assert (near_dup.counted_cells(values) == np.bincount(own, minlength=near_dup.LEAST_CELLS)).all()


def test_vector_tasks_hold_a_bounded_matrix(spark):
    sizes = []

    def seen(scores, own, asks):
        import pandas as pd

        return pd.DataFrame({"query_id": [int(scores.size)], "id": [len(own)]})

    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    for r in retrieval.met_in_blocks(rows, rows.where("vec_id % 20 = 0"), "vec_id", "v", seen, "query_id bigint, id bigint").collect():
        sizes.append((r["query_id"], r["id"]))
    assert max(s for s, _ in sizes) <= retrieval.SCORES and max(n for _, n in sizes) < 20_000
    assert sum(s for s, _ in sizes) == 20_000 * 1_000


@pytest.mark.parametrize("name", ["K1_search_functions", "X24_passages", "X25_bid_passages"])
def test_documents_reach_python_in_short_batches(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    FUNCTIONS[name](spark, "/root/testdata/sf0.001")
    found = int(spark.conf.get(key))
    spark.conf.set(key, before)
    assert found <= 500


def test_equal_answers_are_read_once(spark):
    plan = FUNCTIONS["X13_missing_data"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Join" in plan


def test_workers_forget_the_lattices_of_a_task(spark):
    pieces = pytest.importorskip("dossier.llm.piece_sampling")
    import pandas as pd
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, f"word{i} and others") for i in range(40)], "doc_id long, text string").repartition(4)
    assert pieces.sample_pieces(docs, path).where("round_trip").count() == 80

    def kept(batches):
        from dossier.llm.piece_sampling import _lattices

        for batch in batches:
            yield pd.DataFrame({"n": [sum(len(x.known) + len(x.code) for x in _lattices.values())] * len(batch)})

    assert docs.select("doc_id").mapInPandas(kept, "n long").groupBy().max("n").first()[0] == 0


def test_similar_sets_shuffle_hashes_alone(spark):
    rows = [(i, [f"{i % 3} {j}" for j in range(20 + i // 3 % 2)]) for i in range(12)]
    out = matching.similar_sets(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s", 0.9)
    assert sorted((r["id"], r["other"]) for r in out.collect()) == [(i, i + 3) for i in range(3)]
    # the sets met by the candidates are read from their own table, and equal sets are told without an aggregate that carries them
    assert "min_by" not in out._jdf.queryExecution().executedPlan().toString()


def test_comparisons_are_shuffled_once(spark):
    for name, later in (("S11_comparative_quotes", 0), ("S11_comparative_issues", 1)):
        plan = FUNCTIONS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 + later
        assert "MapInArrow" in plan and "PythonUDTF" not in plan


def test_comparison_of_lines_without_a_price(spark, tmp_path):
    rows = [(1, 1, 11, 2.0, None), (1, 1, 12, 3.9, 1234.5), (1, 1, 12, 4.0, 1234.6), (1, 2, 15, 1.0, 7.0), (1, 2, 16, 1.0, 8.0), (1, None, 17, 1.0, 9.0), (2, 3, None, 1.0, 9.0), (2, 4, 18, 5.0, 1.0)]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    quotes = FUNCTIONS["S11_comparative_quotes"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["line"], r["alternative"], r["price"], r["quantity"]) for r in quotes) == [(1, 1, 1, 1234.5, 3.0), (1, 2, 2, 8.0, 1.0), (2, 4, 2, 1.0, 5.0)]
    assert [tuple(r) for r in FUNCTIONS["S11_comparative_issues"](spark, str(tmp_path)).collect()] == [(1, "no price or quantity", 1)]


def test_issues_of_comparisons_carry_no_quotes(spark):
    plan = FUNCTIONS["S11_comparative_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    read = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "issue#" in read and "tax_id#" not in read and "price#" not in read


def test_similar_sets_are_made_once_for_all_rows(spark, tmp_path):
    # the rows of close pairs alone have their sets made again: what is made is counted by an accumulator
    made = spark.sparkContext.accumulator(0)

    def words(text):
        made.add(1)
        return text.split()

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(198)] + [(300, " ".join(f"z{j}" for j in range(40))), (301, " ".join(f"z{j}" for j in range(1, 41)))]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    out = matching.similar_sets(df, "id", F.udf(words, "array<string>")("text"), 0.9)
    assert [tuple(r) for r in out.collect()] == [(300, 301, round(39 / 41, 6))]
    assert made.value <= len(rows) + 2


def test_kinds_of_pairs_need_no_lambda(spark):
    plan = FUNCTIONS["G3_same_norm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" in plan and "lambda" not in plan
