"""Overviews: pooled scores, totals, exclusive buckets, windows over pages, containment of keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import Tables, query

#: Pages of a window; neighbouring windows share one.
WINDOW = 4
STEP = WINDOW - 1


@query(
    "A22_confidence",
    "SELECT l_orderkey, min(CAST(l_quantity AS BIGINT)) AS least, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(l_quantity) AS average FROM lineitem GROUP BY l_orderkey",
)
def a22(t: Tables):
    quantity = F.col("l_quantity").cast("bigint")
    average = F.sum(quantity).cast("double") / F.count("l_quantity")
    return t.lineitem.groupBy("l_orderkey").agg(F.min(quantity).alias("least"), average.alias("average"))


@query("A23_state_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a23(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "G8_exclusive_counts",
    """SELECT lang, count(*) FILTER (state = 0) AS unlabelled, count(*) FILTER (state = 1) AS toxic, count(*) FILTER (state = 2) AS poor, count(*) FILTER (state = 3) AS good
    FROM (SELECT lang, CASE WHEN l.doc_id IS NULL THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END AS state
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang""",
)
def g8(t: Tables):
    """Each document counts in the first bucket that holds for it."""
    labels = t.labels.select(F.col("doc_id").alias("labelled"), "toxic", "quality")
    rows = t.documents.select("doc_id", "lang").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    state = F.when(F.col("labelled").isNull(), 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(3)
    buckets = [F.count_if(state == i).alias(name) for i, name in enumerate(("unlabelled", "toxic", "poor", "good"))]
    return rows.groupBy("lang").agg(*buckets)


@query(
    "P3_under",
    """SELECT prefix, count(*) AS n FROM (
      SELECT array_to_string(parts[1:d], '/') AS prefix
      FROM (SELECT parts, unnest(range(1, len(parts))) AS d FROM (SELECT string_split(url, '/') AS parts FROM pages))
    ) GROUP BY prefix""",
)
def p3(t: Tables):
    """How many pages lie below each path: keys are spread to their ancestors, so no pair of keys is compared."""
    parts = t.pages.select(F.split("url", "/").alias("parts")).where(F.size("parts") > 1)
    above = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("d"))
    return above.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("d")), "/").alias("prefix")).agg(F.count("*").alias("n"))


@query(
    "T7_body_first",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderstatus, o_orderdate, o_orderkey) AS place FROM orders",
)
def t7(t: Tables):
    """The main part of each file first, then its other parts by name."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", "o_orderstatus", "o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(order).cast("bigint").alias("place"))


@query(
    "W13_windows",
    f"""WITH p AS (
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
    ), w AS (
      SELECT conv_id, turn, r // {STEP} AS part FROM p WHERE r = 0 OR r <> n - 1 OR r % {STEP} <> 0
      UNION ALL SELECT conv_id, turn, r // {STEP} - 1 FROM p WHERE r > 0 AND r % {STEP} = 0
    )
    SELECT conv_id, part, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM w GROUP BY conv_id, part""",
)
def w13(t: Tables):
    """Windows of WINDOW pages, each beginning with the last page of the one before; a last page never stands alone twice."""
    by = Window.partitionBy("conv_id")
    r, n = F.col("r"), F.col("n")
    pages = t.conversations.select("conv_id", "turn", (F.row_number().over(by.orderBy("turn", "text")) - 1).alias("r"), F.count("*").over(by).alias("n"))
    part = F.floor(r / STEP).cast("bigint")
    shared = (r > 0) & (r % STEP == 0)
    parts = F.when(shared & (r == n - 1), F.array(part - 1)).when(shared, F.array(part - 1, part)).otherwise(F.array(part))
    rows = pages.select("conv_id", "turn", F.explode(parts).alias("part"))
    return rows.groupBy("conv_id", "part").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query(
    "R4_record",
    """SELECT o_orderkey, CAST(to_json({'id': o_orderkey, 'reason': CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'units': list({'line': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey)}) AS VARCHAR) AS record
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority""",
)
def r4(t: Tables):
    """A result as one record: its id, its reason (written where null) and its units in order."""
    units = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("units"))
    reason = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    record = F.struct(F.col("o_orderkey").alias("id"), reason.alias("reason"), "units")
    return t.orders.join(units, "o_orderkey").select("o_orderkey", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
