"""Entity matching, semi and anti joins, edges and pairings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest as L
from ..operators import matching as X
from .registry import Tables, query


@query("J9_edges", "SELECT l_orderkey AS node, l_suppkey AS other, 'out' AS way FROM lineitem UNION SELECT l_suppkey, l_orderkey, 'in' FROM lineitem")
def j9(t: Tables):
    return X.both_ways(t.lineitem.select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey").distinct()


@query("J12_qualified", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j12(t: Tables):
    lines = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(lines, "o_orderkey", "left_semi").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("J13_no_later_row", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events l WHERE l.user_id = e.user_id AND l.event_type = e.event_type AND l.event_id > e.event_id)")
def j13(t: Tables):
    last = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return last.select("event_id")


@query("J14_unanswered", "SELECT conv_id, turn FROM conversations q WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant')")
def j14(t: Tables):
    answers = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return L.unanswered(t.conversations.where("role = 'user'").select("conv_id", "turn"), answers, ["conv_id", "turn"])


@query(
    "J20_carry_over",
    """WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, event_type, event_id AS earlier, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1)
SELECT event_id, earlier FROM a LEFT JOIN b USING (user_id, event_type, k)""",
)
def j20(t: Tables):
    side = lambda r: t.events.where(F.col("event_id") % 2 == r).select("user_id", "event_type", "event_id")
    return X.carry_over(side(0), side(1).withColumnRenamed("event_id", "earlier"), ["user_id", "event_type"], "event_id", "earlier").select("event_id", "earlier")


@query("J21_compared_values", "SELECT o_orderkey, CASE WHEN t IS NULL THEN 'missing' WHEN t > CAST(o_totalprice AS DECIMAL(18,2)) THEN 'over' ELSE 'within' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS t FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def j21(t: Tables):
    total = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t"))
    state = F.when(F.col("t").isNull(), "missing").when(F.col("t") > F.col("o_totalprice").cast("decimal(18,2)"), "over").otherwise("within")
    return t.orders.join(total, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("U1_open_closed", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS is_open FROM customer")
def u1(t: Tables):
    ids = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    opened = ids("O").union(ids("P")).distinct().withColumn("o", F.lit(True))
    return t.customer.select("c_custkey").join(opened, "c_custkey", "left").select("c_custkey", F.col("o").isNotNull().alias("is_open"))


@query("U5_new_kinds", "WITH m AS (SELECT date_trunc('day', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) AS half FROM events) SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS band FROM events, m WHERE ts >= half EXCEPT SELECT user_id, event_type, CAST(floor(value) AS BIGINT) FROM events, m WHERE ts < half")
def u5(t: Tables):
    """What a user did in the second half of the time that the events span and never in the first."""
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = t.events.agg(F.min(moment), F.max(moment)).first()
    day = 86_400_000_000
    half = ((first or 0) + (last or 0)) // 2 // day * day
    kinds = lambda keep: t.events.where(keep).select("user_id", "event_type", F.floor("value").alias("band")).distinct()
    late = moment >= half
    return L.unanswered(kinds(late), kinds(~late), ["user_id", "event_type", "band"])


@query(
    "W16_chain_closure",
    """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderpriority LIKE '1%'), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen) SELECT node, min(seen) AS chain FROM r GROUP BY 1""",
)
def w16(t: Tables):
    edges = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return X.chains(edges)
