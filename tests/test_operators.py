"""Operators on small invented rows: bounds, ties, nulls and traps."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.functions import values as V
from dossier.operators import latest, matching, measures, ranking, retrieval, selection, spans, validity
from dossier.sources import html
from dossier.streaming import changes

D = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_validity_bounds_and_repeals(spark):
    units = spark.createDataFrame(
        [
            (1, 1, "art-1", D(2020, 1, 1), None),
            (1, 2, "art-1/inc-a", D(2020, 1, 1), None),
            (1, 3, "art-10", D(2020, 1, 1), D(2021, 1, 1)),
            (2, 4, "art-1", D(2020, 6, 1), None),
        ],
        "norm_id long, unit_id long, key string, effective_from date, effective_to date",
    )
    relations = spark.createDataFrame(
        [(1, "deroga", 1, "art-1", 9, D(2020, 5, 1)), (2, "deroga", 1, "art-1", 8, D(2020, 3, 1)), (3, "deroga", 2, None, 7, D(2020, 7, 1)), (4, "modifica", 1, "art-1/inc-a", 6, D(2020, 2, 1))],
        "relation_id long, relation_type string, target_norm_id long, target_unit_key string, source_norm_id long, effective_date date",
    )
    at = lambda y, m, d: F.lit(D(y, m, d))
    rows = {r["unit_id"]: r for r in validity.consultable_units(units, relations, at(2020, 6, 1)).collect()}
    assert rows[1]["repealed_by"] == 8 and rows[2]["repealed"] and not rows[3]["repealed"]  # art-10 is not inside art-1
    assert not rows[4]["repealed"]  # starts that day, repealed later
    assert 3 not in {r["unit_id"] for r in validity.consultable_units(units, relations, at(2021, 1, 1)).collect()}  # the end is exclusive
    changed = {r["unit_id"] for r in validity.unit_changes(units, relations, at(2020, 6, 1)).collect()}
    assert changed == {1, 2}  # the unit itself and the one it is inside of


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y")], "k string, t int, v string")
    assert {r["id"]: r["last_v"] for r in validity.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: "x", 2: None, 3: None}


def test_ranking_ties_nulls_and_currencies(spark):
    bids = spark.createDataFrame(
        [(1, 1, 10, "A"), (1, 2, 10, "A"), (1, 3, 20, "A"), (1, 4, None, "B"), (2, 5, 1, "A"), (2, 6, 2, None)], "p int, id int, amount int, cur string"
    )
    out = {r["id"]: (r["position"], r["mixed"]) for r in ranking.competition_rank(bids, ["p"], "amount", "cur").collect()}
    assert out == {1: (1, False), 2: (1, False), 3: (3, False), 4: (None, False), 5: (None, True), 6: (None, True)}
    gaps = ranking.gap_to_lowest(spark.createDataFrame([(1, 1, "200.00"), (1, 2, "300.30")], "p int, id int, a string").withColumn("a", F.col("a").cast("decimal(10,2)")), ["p"], "a")
    assert [(str(r["gap_pct"]), r["is_lowest"], r["is_highest"]) for r in gaps.orderBy("id").collect()] == [("0.0", True, False), ("50.2", False, True)]


def test_latest_and_overlay(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in latest.latest(rows, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}
    assert latest.latest_if(rows, ["k"], ["t"], F.col("v") == "a").count() == 0  # the latest is chosen before the filter
    results = spark.createDataFrame([(1,), (3,)], "k int")
    assert {(r["k"], r["v"]) for r in latest.overlay(results, rows, "k", ["t"], "v").collect()} == {(1, "b"), (3, None)}


def test_selection(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([4, 5, 3, 9, 1])], "k int, i int, c int")
    assert [r["taken"] for r in selection.budget_fill(rows, ["k"], ["i"], "c", 8).orderBy("i").collect()] == [True, False, True, False, True]
    assert [r["part"] for r in selection.packed_groups(rows, ["k"], ["i"], "c", 8).orderBy("i").collect()] == [1, 2, 2, 3, 4]
    places = spark.createDataFrame([(1, i, c) for i, c in enumerate([0, 5, 12, 13, 40])], "k int, i int, c int")
    assert [r["level"] for r in selection.levels(places, ["k"], ["i"], "c", 12).orderBy("i").collect()] == [0, 1, 0, 2, 0]
    assert [r["i"] for r in selection.systematic(rows, ["k"], ["i"], 2).orderBy("i").collect()] == [0, 2]
    assert [r["part"] for r in selection.even_parts(rows, ["k"], ["i"], 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_spans(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 11, 15)], "k int, start int, end int")
    assert {tuple(r) for r in spans.merged(rows, ["k"], "start", "end").collect()} == {(1, 0, 8, 2), (1, 10, 15, 2)}
    assert {tuple(r) for r in spans.coverage_faults(rows, ["k"], "start", "end").collect()} == {(1, "hole", 8, 10), (1, "overlap", 11, 12)}
    pairs = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 9), (1, 2, 2, 9), (1, 2, 1, 3)], "k int, l_id int, r_id int, common int")
    assert {(r["l_id"], r["r_id"]) for r in spans.greedy_pairs(pairs, "k").collect()} == {(1, 2), (2, 1)}


def test_measures(spark):
    rows = spark.createDataFrame([("a", True)] * 16 + [("a", False)], "g string, ok boolean")
    r = measures.proportion(rows, ["g"], F.col("ok")).first()
    assert (round(r["low"], 3), round(r["high"], 3)) == (0.730, 0.990)
    empty = spark.createDataFrame([], "g string, ok boolean")
    assert measures.proportion(empty, ["g"], F.col("ok")).count() == 0
    old = spark.createDataFrame([(1, True), (2, False), (3, True)], "k int, p boolean")
    new = spark.createDataFrame([(1, False), (2, True), (4, True)], "k int, p boolean")
    assert {tuple(r) for r in measures.compare_runs(old, new, "k", "p").collect()} == {(1, "regression"), (2, "improvement"), (3, "removed"), (4, "added")}
    scores = spark.createDataFrame([(0.9, True), (0.5, True), (0.3, False)], "s double, y boolean")
    assert measures.gap_threshold(scores, "s", F.col("y")).first()["threshold"] == 0.4
    assert measures.gap_threshold(scores, "s", ~F.col("y")).first()["threshold"] is None


@pytest.mark.parametrize(
    ("column", "value"),
    [
        (lambda: X.search_normalized(F.lit("LICITACIÓN año evaluacion")), "LICITAción año evaluación"),
        (lambda: X.plain(F.lit("Ñandú Ç")), "nandu c"),
        (lambda: X.compared(F.lit("a)  El Ítem, -5 %.")), "el item menos_5 %"),
        (lambda: X.canonical_line(F.lit("ﬁrma digital ")), "firma digital "),
        (lambda: X.repaired(F.lit("licitaciÃ³n")), "licitación"),
        (lambda: X.repaired(F.lit("Ã sola")), "Ã sola"),
        (lambda: X.nth_occurrence(F.lit("x. y. z"), ". ", 2), 4),
        (lambda: V.amount(F.lit("USD 178376.50")), Decimal("178376.50")),
        (lambda: V.amount(F.lit("178.376 pesos")), Decimal("178376.00")),
        (lambda: V.amount(F.lit("sin monto")), None),
        (lambda: V.only_percent(F.lit("cinco por ciento (5%)")), Decimal("5.0000")),
        (lambda: V.only_percent(F.lit("5% o 10%")), None),
        (lambda: V.amount(F.lit("$ 1.234.567,891")), Decimal("1234567.89")),
        (lambda: V.tax_id_valid(F.lit("20-12345678-6")), True),
        (lambda: V.tax_id_valid(F.lit("20-12345678-5")), False),
        (lambda: V.day_first(F.lit("31/02/2024")), None),
        (lambda: V.day_first(F.lit("1/2/2024")), D(2024, 2, 1)),
        (lambda: V.elapsed(F.lit(125)), "2:05"),
        (lambda: V.progress(F.lit(10), F.lit(10)), 99),
        (lambda: F.size(X.shingles(F.lit("a b c"))), 0),
        (lambda: X.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), 0.5),
    ],
)
def test_functions(spark, column, value):
    found = one(spark, column())
    assert found == value


def test_matching(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "l int, k string")
    right = spark.createDataFrame([(7, "a"), (8, "b"), (9, "b")], "r int, k string")
    assert {(r["l"], r["r"]) for r in matching.unique_match(left, right, ["k"], "l", "r").collect()} == {(1, 7), (2, None)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    assert {(r["node"], r["chain"]) for r in matching.chains(chain).collect()} == {(i, 0) for i in range(21)} | {(30, 30), (31, 30)}


def test_neighbours_and_first_arrival(spark):
    rows = spark.createDataFrame([(1, i, i in (2, 3, 7)) for i in (0, 1, 2, 3, 4, 6, 7, 9)], "k int, i int, seed boolean")
    assert {r["i"] for r in retrieval.neighbours(rows, ["k"], "i", F.col("seed")).collect()} == {1, 4, 6}
    paths = [spark.createDataFrame([(9, 1, 1), (9, 2, 2)], "q int, id int, place int"), spark.createDataFrame([(9, 2, 1), (9, 3, 2)], "q int, id int, place int")]
    assert {tuple(r) for r in retrieval.first_arrival(paths, "q", "id", "place").collect()} == {(9, 1, 0, 1, "0"), (9, 2, 0, 2, "0,1"), (9, 3, 1, 2, "1")}


def test_vector_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)] + [(30, None), (31, [0.0, 0.0]), (32, [1.0])], "id long, v array<double>")
    out = retrieval.cosine_distances(rows, rows.where("id IN (0, 6, 32)"), "id", "v", 4).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["id"]) for r in out] == [(0, 0), (0, 5), (0, 10), (0, 15), (6, 1), (6, 6), (6, 11), (6, 16), (32, 32)]
    few = rows.where("id < 3")
    assert [(r["kept"], round(r["best"], 6)) for r in retrieval.passing(few, few.where("id = 1"), "id", "v", 0.8).collect()] == [(1, 0.948683)]
    tops = retrieval.best_of_groups(rows.withColumn("g", F.col("id") % 2), rows.where("id = 6"), "id", "v", ["g"]).collect()
    assert {(r["g"], r["score"]) for r in tops} == {(0, 1.0), (1, 1.0)}
    assert retrieval.cosine_distances(rows.limit(0), few, "id", "v", 4).count() == 0


def test_similar_sets_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.sample(range(60), 20) for _ in range(12)]
    sets = [(i, sorted(set(base[i % 12]) ^ set(rng.sample(range(60), rng.randint(0, 2))))) for i in range(60)] + [(60, [])]
    out = {(r["id"], r["other"]) for r in matching.similar_sets(spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets], "id long, s array<string>"), "id", "s", 0.9).collect()}
    first = {}
    for i, s in sets:
        first.setdefault(tuple(s), i)
    reps = [(i, set(s)) for i, s in sets if s and first[tuple(s)] == i]
    assert out == {(i, j) for i, a in reps for j, b in reps if i < j and 10 * len(a & b) >= 9 * len(a | b)}


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<b> c</b><p>d &amp; e<script>no</script></div>"), (2, None), (3, "")], "id long, html string")
    assert [tuple(r) for r in html.page_lines(pages, "id", "html").orderBy("id", "line").collect()] == [(1, 1, "p", "a c"), (1, 2, "p", "d & e")]


def test_stream_of_changes(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "k string, seq int, digest string"
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "x"), ("a", 3, "z"), ("b", 2, None)], [("b", 3, "y"), ("a", 4, "x")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        run = changes.append_log(changes.changed_content(stream, ["k"], "digest", "seq"), str(out), str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert {(r["k"], r["seq"]) for r in spark.read.parquet(str(out)).collect()} == {("a", 1), ("b", 1), ("a", 3), ("a", 4)}


def test_keyed_windows_keep_late_rows_out_and_state_small(spark, tmp_path):
    from dossier.streaming import windows

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, at timestamp"
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)  # noqa: E731, UP017
    lots = [[("a", at(5)), ("a", at(25)), ("b", at(3)), ("a", None)], [("a", at(8)), ("a", at(21)), ("a", at(60)), ("b", at(4))], [("a", at(40)), ("b", at(200))]]
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        stream = windows.keyed_windows(spark.readStream.schema(schema).parquet(source), ["k"], "at", 10, 10)
        changes.append_log(stream, out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    found = sorted((r["k"], r["kind"], r["start"], r["n"]) for r in spark.read.parquet(out).collect())
    # a: 5 is over by 25 - 10; 8 comes too late for it, 21 doesn't; 60 ends the window of 20; 40 is late. b: two rows of one window, ended by 200
    assert found == [("a", "late", None, 1), ("a", "late", None, 1), ("a", "window", 0, 1), ("a", "window", 20, 2), ("b", "window", 0, 2)]
