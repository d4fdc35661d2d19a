"""The evaluation matrix: grids, current states, decisions, rules, ranking, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import latest as L
from ..operators import ranking as R
from ..operators import selection as S
from .registry import Tables, money, query

BIDS = """
bids AS (SELECT s_nationkey AS procedure_id, s_suppkey AS bid_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
         FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
"""


def _bids(t: Tables):
    bids = t.lineitem.groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).cast("decimal(28,2)").alias("total"))
    return bids.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("procedure_id"), F.col("s_suppkey").alias("bid_id"), "total"
    )


@query("W1_rank", f"WITH {BIDS} SELECT procedure_id, bid_id, CAST(total AS DOUBLE) AS total, CAST(rank() OVER (PARTITION BY procedure_id ORDER BY total) AS INTEGER) AS position FROM bids")
def w1(t: Tables):
    out = R.competition_rank(_bids(t), ["procedure_id"], "total")
    return out.select("procedure_id", "bid_id", F.col("total").cast("double").alias("total"), "position")


@query(
    "W2_mixed_currency",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT o_custkey, o_orderkey, CAST(CASE WHEN NOT mixed THEN r END AS INTEGER) AS position, mixed FROM (
  SECT
) x""".replace("SECT", "SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY amount) AS r, min(o_orderstatus) OVER (PARTITION BY o_custkey) <> max(o_orderstatus) OVER (PARTITION BY o_custkey) AS mixed FROM o"),
)
def w2(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", money("o_totalprice").alias("amount"))
    return R.competition_rank(orders, ["o_custkey"], "amount", "o_orderstatus").select("o_custkey", "o_orderkey", "position", "mixed")


@query(
    "W3_line_rank",
    """SELECT l_partkey, l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag <> 'R' THEN rank() OVER (PARTITION BY l_partkey, l_returnflag <> 'R'
  ORDER BY CAST(l_extendedprice AS DECIMAL(18,2)) * coalesce(CAST(l_quantity AS DECIMAL(18,2)), 1)) END AS INTEGER) AS position FROM lineitem""",
)
def w3(t: Tables):
    lines = t.lineitem.withColumns({"p": money("l_extendedprice"), "q": money("l_quantity")})
    lines = lines.withColumn("amount", R.line_amount("p", "q"))
    return R.competition_rank(lines, ["l_partkey"], "amount", discarded=F.col("l_returnflag") == "R").select("l_partkey", "l_orderkey", "l_linenumber", "position")


@query(
    "W4_gap",
    f"""WITH {BIDS}, g AS (SELECT *, min(total) OVER (PARTITION BY procedure_id) AS low, max(total) OVER (PARTITION BY procedure_id) AS high FROM bids)
SELECT procedure_id, bid_id, CAST(floor(CAST(2000 * (total - low) AS HUGEINT) / CAST(2 * low AS HUGEINT) + 0.5) / 10 AS DOUBLE) AS gap_pct, total = low AS is_lowest, total = high AND high > low AS is_highest FROM g""",
)
def w4(t: Tables):
    out = R.gap_to_lowest(_bids(t), ["procedure_id"], "total")
    return out.select("procedure_id", "bid_id", F.col("gap_pct").cast("double").alias("gap_pct"), "is_lowest", "is_highest")


@query(
    "W5_latest",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def w5(t: Tables):
    return L.latest(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


DECIDED = """
d AS (SELECT l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1)
"""


def _decided(t: Tables):
    results = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return L.overlay(results, t.lineitem, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_returnflag")


@query("W6_decision_overlay", f"WITH {DECIDED} SELECT o_orderkey, coalesce(l_returnflag, o_orderstatus) AS outcome, l_returnflag IS NOT NULL AS decided FROM orders LEFT JOIN d ON l_orderkey = o_orderkey")
def w6(t: Tables):
    return _decided(t).select(F.col("l_orderkey").alias("o_orderkey"), F.coalesce("l_returnflag", "o_orderstatus").alias("outcome"), F.col("l_returnflag").isNotNull().alias("decided"))


@query("W7_document_state", f"WITH {DECIDED} SELECT o_orderkey, CASE l_returnflag WHEN 'A' THEN 'replaced' WHEN 'R' THEN 'withdrawn' ELSE 'in force' END AS state FROM orders LEFT JOIN d ON l_orderkey = o_orderkey")
def w7(t: Tables):
    state = F.when(F.col("l_returnflag") == "A", "replaced").when(F.col("l_returnflag") == "R", "withdrawn").otherwise("in force")
    return _decided(t).select(F.col("l_orderkey").alias("o_orderkey"), state.alias("state"))


@query(
    "W8_latest_then_filter",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type IN ('click', 'purchase')",
)
def w8(t: Tables):
    return L.latest_if(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "purchase")).select("user_id", "event_id")


@query(
    "J11_grid",
    """SELECT n_nationkey, m AS c_mktsegment, count(c_custkey) AS cells FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer)
LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = m GROUP BY 1, 2""",
)
def j11(t: Tables):
    # both sides are dimensions of fixed size: nations and market segments
    grid = t.nation.select("n_nationkey").crossJoin(t.customer.select("c_mktsegment").distinct())
    cells = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("cells"))
    return grid.join(cells, ["n_nationkey", "c_mktsegment"], "left").fillna(0, ["cells"])


@query("A3_next_number", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a3(t: Tables):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next_number"))


@query("A4_filtered_counts", "SELECT l_suppkey, max(l_shipdate) AS last_ship, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def a4(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_ship"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("A5_open_count", "SELECT o_custkey, count(*) FILTER (o_orderstatus NOT IN ('F')) AS open_orders FROM orders GROUP BY 1")
def a5(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count_if(~F.col("o_orderstatus").isin("F")).alias("open_orders"))


@query(
    "A9_bid_status",
    "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS total FROM lineitem GROUP BY 1",
)
def a9(t: Tables):
    flags = {k.lower(): F.count_if(F.col("l_returnflag") == k) for k in "ANR"}
    return t.lineitem.groupBy("l_suppkey").agg(*[c.alias(k) for k, c in flags.items()], F.count("*").alias("total"))


@query("A10_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a10(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "A11_heat",
    """SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'), 0) AS building_ok, nullif(count(*) FILTER (c_mktsegment = 'BUILDING'), 0) AS building_n,
nullif(count(*) FILTER (o_orderstatus = 'F' AND c_mktsegment = 'MACHINERY'), 0) AS machinery_ok, nullif(count(*) FILTER (c_mktsegment = 'MACHINERY'), 0) AS machinery_n
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def a11(t: Tables):
    both = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cell = lambda s, ok: F.nullif(F.count_if((F.col("c_mktsegment") == s) & (F.col("o_orderstatus") == "F" if ok else F.lit(True))), F.lit(0))
    return both.groupBy("o_orderpriority").agg(*[cell(s.upper(), ok).alias(f"{s}_{'ok' if ok else 'n'}") for s in ("building", "machinery") for ok in (True, False)])


@query(
    "A12_spend",
    "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS result, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM events GROUP BY ROLLUP (event_type, result)",
)
def a12(t: Tables):
    rows = t.events.select("event_type", (F.get_json_object("props", "$.k").cast("int") % 5).alias("result"), money("value").alias("v"))
    return rows.rollup("event_type", "result").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("spent"))


@query("A16_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a16(t: Tables):
    return t.orders.withColumn("v", money("o_totalprice")).cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


@query(
    "A20_weighted_vote",
    """WITH v AS (SELECT o_custkey, o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END) AS weight, min(o_orderkey) AS first_seen FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority AS chosen, CAST(weight AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, first_seen) AS rn FROM v) WHERE rn = 1""",
)
def a20(t: Tables):
    votes = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("chosen")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 3).otherwise(1)).alias("weight"), F.min("o_orderkey").alias("first_seen"))
    best = votes.groupBy("o_custkey").agg(F.max_by(F.struct("chosen", "weight"), F.struct("weight", -F.col("first_seen"))).alias("b"))
    return best.select("o_custkey", "b.chosen", "b.weight")


@query(
    "A25_run_counters",
    "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
)
def a25(t: Tables):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pair = F.concat("event_type", F.lit("="), F.col("n").cast("string"))
    return n.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", pair.alias("p")))), lambda x: x["p"]), ",").alias("counters"))


@query("A26_pending", "SELECT n_nationkey, count(*) FILTER (s_suppkey IS NULL) AS pending FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def a26(t: Tables):
    rich = t.supplier.where("s_acctbal > 5000")
    return t.nation.join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count_if(F.col("s_suppkey").isNull()).alias("pending"))


@query(
    "P12_bucket",
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'nd' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'pe' WHEN l_discount = 0 THEN 'na' ELSE 'ok' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
)
def p12(t: Tables):
    bucket = F.when(F.col("l_returnflag") == "R", "nd").when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "pe").when(F.col("l_discount") == 0, "na").otherwise("ok")
    return t.lineitem.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "G6_ranking_after_discards",
    f"""WITH {BIDS} SELECT procedure_id, bid_id, CAST(rank() OVER (PARTITION BY procedure_id ORDER BY total) AS INTEGER) AS position FROM bids
WHERE bid_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
)
def g6(t: Tables):
    left = L.unanswered(_bids(t), t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("bid_id")), ["bid_id"])
    return R.competition_rank(left, ["procedure_id"], "total").select("procedure_id", "bid_id", "position")


@query(
    "G10_fold",
    """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'fail' WHEN bool_and(l_returnflag = 'A') THEN 'pass' WHEN bool_and(l_returnflag = 'N') THEN 'silent' ELSE 'undetermined' END AS outcome
FROM lineitem GROUP BY 1""",
)
def g10(t: Tables):
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy("l_orderkey").agg(S.fold_conditions(flag == "R", flag == "A", flag == "N").alias("outcome"))


@query(
    "W11_budget_fill",
    """WITH o AS (SELECT o_custkey, list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_orderdate, o_orderkey) AS c FROM orders GROUP BY 1)
SELECT o_custkey, list_reduce(list_concat([CAST(0 AS BIGINT)], c), lambda a, x: CASE WHEN a + x <= 50000000 THEN a + x ELSE a END) AS used FROM o""",
)
def w11(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    taken = S.budget_fill(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", 50_000_000)
    return taken.groupBy("o_custkey").agg(F.sum(F.when(F.col("taken"), F.col("cents")).otherwise(0)).alias("used"))


@query(
    "W12_packed_groups",
    """WITH o AS (SELECT o_custkey, list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_orderdate, o_orderkey) AS c FROM orders GROUP BY 1)
SELECT o_custkey, CAST(list_reduce(list_concat([CAST(50000000 AS BIGINT)], c), lambda a, x: CASE WHEN a % 1000000000000 + x <= 50000000 THEN a + x ELSE a - a % 1000000000000 + 1000000000000 + x END) // 1000000000000 AS BIGINT) AS groups FROM o""",
)
def w12(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    packed = S.packed_groups(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", 50_000_000)
    return packed.groupBy("o_custkey").agg(F.max("part").alias("groups"))


@query(
    "G15_batches",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT conv_id, i, turn, n, 1 AS part, n AS used FROM c WHERE i = 1 UNION ALL
SELECT c.conv_id, c.i, c.turn, c.n, CASE WHEN used + c.n > 1500 THEN part + 1 ELSE part END, CASE WHEN used + c.n > 1500 THEN c.n ELSE used + c.n END FROM b JOIN c ON c.conv_id = b.conv_id AND c.i = b.i + 1)
SELECT conv_id, turn, CAST(part AS BIGINT) AS part FROM b""",
)
def g15(t: Tables):
    """Consecutive turns in batches within a budget of characters."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return S.packed_groups(rows, ["conv_id"], ["turn"], "n", 1500).select("conv_id", "turn", "part")


@query(
    "W15_systematic",
    """WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey FROM p WHERE n <= 7 OR i IN (0, n // 7, 2 * n // 7, 3 * n // 7, 4 * n // 7, 5 * n // 7, 6 * n // 7)""",
)
def w15(t: Tables):
    return S.systematic(t.part.select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 7)


@query(
    "G16_even_parts",
    """WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, CAST(i // CAST(ceil(n / ceil(n / 30)) AS BIGINT) AS INTEGER) AS part FROM p""",
)
def g16(t: Tables):
    return S.even_parts(t.part.select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 30)




@query(
    "T9_actions",
    """WITH a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN CAST(o_orderdate AS DATE) + 60 < DATE '1998-06-01' THEN 'overdue' WHEN CAST(o_orderdate AS DATE) + 60 = DATE '1998-06-01' THEN 'today' WHEN CAST(o_orderdate AS DATE) + 60 < DATE '1998-06-08' THEN 'closing' ELSE 'pending' END AS mark,
CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS step FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE mark WHEN 'overdue' THEN 0 WHEN 'today' THEN 1 WHEN 'pending' THEN 2 WHEN 'closing' THEN 3 ELSE 4 END, step, o_orderkey) AS turn, count(*) OVER (PARTITION BY o_custkey) AS n FROM a)
SELECT o_custkey, o_orderkey, mark, step, CAST(turn AS INTEGER) AS turn, greatest(n - 6, 0) AS rest FROM r WHERE turn <= 6""",
)
def t9(t: Tables):
    """The first six things to do of each procedure: overdue, today, pending, closing, missing; then by step; and how many are left."""
    due, today = F.date_add(F.to_date("o_orderdate"), 60), F.lit("1998-06-01").cast("date")
    mark = F.when(F.col("o_orderstatus") == "P", "missing").when(due < today, "overdue").when(due == today, "today").when(due < F.date_add(today, 7), "closing").otherwise("pending")
    rows = t.orders.select("o_custkey", "o_orderkey", mark.alias("mark"), F.substring("o_orderpriority", 1, 1).cast("int").alias("step"))
    rank = F.array_position(F.array(*[F.lit(m) for m in ("overdue", "today", "pending", "closing", "missing")]), F.col("mark"))
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "step", "o_orderkey"))
    left = F.greatest(F.count("*").over(Window.partitionBy("o_custkey")) - 6, F.lit(0))
    return rows.withColumns({"turn": turn, "rest": left}).where("turn <= 6")
