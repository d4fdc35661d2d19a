"""Quality measures over labels, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from .registry import Tables, query



def _wilson_sql(hits: str, total: str) -> str:
    p, n = f"(CAST({hits} AS DOUBLE) / {total})", f"CAST({total} AS DOUBLE)"
    mid = f"({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n})) / (1 + 3.8416 / {n})"
    return f"round(greatest({mid} - {half}, 0), 9) AS low, round(least({mid} + {half}, 1), 9) AS high"


@query("A14_wilson", f"WITH g AS (SELECT toxic, count(*) FILTER (quality = 1) AS hits, count(*) AS total FROM labels GROUP BY 1) SELECT toxic, hits, total, round(hits / total, 9) AS share, {_wilson_sql('hits', 'total')} FROM g")
def a14(t: Tables):
    return M.proportion(t.labels, ["toxic"], F.col("quality") == 1)


@query("A13_totals", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS clean FROM labels")
def a13(t: Tables):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    return t.labels.agg(F.count("*").alias("n"), F.count_if(q).alias("good"), F.count_if(x).alias("toxic"), F.count_if(q & ~x).alias("clean"))


@query("A15_median", "SELECT event_type, round(median(value), 6) AS middle, max(value) AS longest FROM events GROUP BY 1")
def a15(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("middle"), F.max("value").alias("longest"))


@query(
    "A17_confusion",
    """SELECT CASE WHEN p IS NULL THEN 'abstained' WHEN p = quality THEN 'exact' ELSE 'wrong' END AS outcome, count(*) AS n FROM labels
LEFT JOIN (SELECT doc_id, CASE WHEN n_chars > 200 THEN 1 WHEN n_chars > 60 THEN 0 END AS p FROM documents) d USING (doc_id) GROUP BY 1""",
)
def a17(t: Tables):
    # a very short text gives no guess
    guess = t.documents.select("doc_id", F.when(F.col("n_chars") > 200, 1).when(F.col("n_chars") > 60, 0).alias("p"))
    return M.confusion(guess, t.labels, "doc_id", "p", "quality")


@query(
    "A18_hits",
    """WITH e AS (SELECT o_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, bool_and(place IS NOT NULL) AS all_found, CASE WHEN bool_and(place IS NOT NULL) THEN max(place) END AS worst FROM e GROUP BY 1""",
)
def a18(t: Tables):
    place = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))
    rows = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", place.alias("place")), F.col("l_orderkey") == F.col("o_orderkey"))
    found = F.bool_and(F.col("place").isNotNull())
    return rows.groupBy("o_orderkey").agg(found.alias("all_found"), F.when(found, F.max("place")).alias("worst"))


RUNS = """
a AS (SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) || '-' || hour(ts) AS k, bool_and(value > 5) AS p FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1),
b AS (SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) || '-' || hour(ts) AS k, bool_and(value < 90) AS p FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1)
"""
CHANGE = "CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN a.p AND NOT b.p THEN 'regression' WHEN NOT a.p AND b.p THEN 'improvement' ELSE 'same' END"


def _runs(t: Tables):
    """Two runs over the same cases (a user's hour): what was seen, and what was done; errors are in both."""
    case = F.concat_ws("-", "user_id", F.to_date("ts"), F.hour("ts")).alias("k")
    run = lambda kinds, ok: t.events.where(F.col("event_type").isin(*kinds)).groupBy(case).agg(F.bool_and(F.expr(ok)).alias("p"))
    return run(["view", "click", "error"], "value > 5"), run(["signup", "purchase", "error"], "value < 90")


@query("J24_compare_runs", f"WITH {RUNS} SELECT k, {CHANGE} AS change FROM a FULL JOIN b USING (k)")
def j24(t: Tables):
    return M.compare_runs(*_runs(t), "k", "p")


@query("U6_change_counts", f"WITH {RUNS} SELECT {CHANGE} AS change, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1")
def u6(t: Tables):
    return M.compare_runs(*_runs(t), "k", "p").groupBy("change").agg(F.count("*").alias("n"))


@query(
    "M6_gap_threshold",
    """WITH x AS (SELECT min(n_chars) FILTER (quality = 1) AS p, max(n_chars) FILTER (quality = 0) AS n FROM labels JOIN documents USING (doc_id))
SELECT round(p / 1000, 6) AS worst_positive, round(n / 1000, 6) AS best_negative, CASE WHEN p > n THEN floor((round(p / 1000, 6) + round(n / 1000, 6)) / 2 * 1000) / 1000 END AS threshold FROM x""",
)
def m6(t: Tables):
    """The threshold between all good and all poor documents; null where they overlap."""
    both = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return M.gap_threshold(both.withColumn("s", F.round(F.col("n_chars") / 1000, 6)), "s", F.col("quality") == 1)


@query("M5_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 10)), 9) AS p, round(ln(least(greatest(value / 100, 1e-9), 1 - 1e-9) / (1 - least(greatest(value / 100, 1e-9), 1 - 1e-9))), 6) AS x FROM events")
def m5(t: Tables):
    return t.events.select("event_id", F.round(M.sigmoid(F.col("value") / 10), 9).alias("p"), F.round(M.logit(F.col("value") / 100), 6).alias("x"))


@query(
    "M11_regression_flags",
    """WITH m AS (SELECT event_type, median(value) FILTER (event_id % 2 = 0) AS old, median(value) FILTER (event_id % 2 = 1) AS new, max(value) AS top FROM events GROUP BY 1)
SELECT event_type, new > old * 1.25 AS slower, top > 30 AS over_limit FROM m""",
)
def m11(t: Tables):
    half = lambda r: F.median(F.when(F.col("event_id") % 2 == r, F.col("value")))
    return t.events.groupBy("event_type").agg(half(0).alias("old"), half(1).alias("new"), F.max("value").alias("top")).select("event_type", (F.col("new") > F.col("old") * 1.25).alias("slower"), (F.col("top") > 30).alias("over_limit"))
