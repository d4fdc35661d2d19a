"""Pages, amounts, identifiers and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import latest as L
from ..sources import html as H
from .registry import Tables, money, query


@query("S12_page_fields", """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""".replace("len(regexp", "CAST(len(regexp").replace("1)) AS links", "1)) AS INTEGER) AS links"))
def s12(t: Tables):
    html = F.col("html")
    return t.pages.select("page_id", H.title(html).alias("title"), H.language(html).alias("lang"), F.size(H.links(html)).alias("links"))


@query("S7_page_lines")
def s7(t: Tables):
    return H.page_lines(t.pages, "page_id", "html")


@query("S13_numbered_links", """WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_replace(html, '(?s)<nav>.*?</nav>', '') AS rest FROM pages),
l AS (SELECT page_id, 'menu' AS class, unnest(regexp_extract_all(nav, '<a href="([^"]*)"', 1)) AS name, generate_subscripts(regexp_extract_all(nav, '<a href="([^"]*)"', 1), 1) AS i FROM p
UNION ALL SELECT page_id, 'document', unnest(regexp_extract_all(rest, '<a href="([^"]*)"', 1)), 10000 + generate_subscripts(regexp_extract_all(rest, '<a href="([^"]*)"', 1), 1) FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, class, name ORDER BY i) AS turn FROM l) SELECT page_id, class, class || ':' || name || CASE WHEN turn = 1 THEN '' ELSE '#' || turn END AS key FROM n""")
def s13(t: Tables):
    """The links of each page with the class of their section; a key that stands again in a page gets a number."""
    html = F.col("html")
    part = lambda name, text: t.pages.select("page_id", F.lit(name).alias("class"), F.posexplode(H.links(text)).alias("i", "link"))
    links = part("menu", F.regexp_extract(html, "(?s)<nav>(.*?)</nav>", 1)).unionByName(part("document", F.regexp_replace(html, "(?s)<nav>.*?</nav>", "")))
    named = links.select("page_id", "class", "i", F.concat("class", F.lit(":"), "link").alias("name"))
    return H.numbered(named, ["page_id"], "name", ["i"]).select("page_id", "class", "key")


@query("S8_repaired", "SELECT doc_id, md5(text) AS digest FROM documents")
def s8(t: Tables):
    """Texts read once too often as Latin-1 come back as they were."""
    broken = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", F.md5(X.repaired(broken)).alias("digest"))


AMOUNT_SQL = "translate(format('{:,.2f}', o_totalprice), ',.', '.,')"


@query("M8_amount_text", "SELECT o_orderkey, translate(format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)), ',.', '.,') AS amount, CASE WHEN o_custkey % 2 = 0 OR o_custkey % 50 * 10 + o_orderkey % 10 = 0 THEN '+' ELSE '-' END || CAST(o_custkey % 50 AS VARCHAR) || ',' || CAST(o_orderkey % 10 AS VARCHAR) || ' %' AS percent FROM orders")
def m8(t: Tables):
    share = (F.col("o_custkey") % 50 + (F.col("o_orderkey") % 10).cast("decimal(3,0)") / 10) * F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1)
    return t.orders.select("o_orderkey", V.amount_text(money("o_totalprice")).alias("amount"), V.percent_text(share.cast("decimal(9,1)")).alias("percent"))


TAX = " + ".join(f"CAST(d[{i + 1}] AS INTEGER) * {w}" for i, w in enumerate(V.TAX_WEIGHTS))


@query("M4_tax_ids", f"WITH x AS (SELECT c_custkey, '20' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') || CAST(c_custkey % 10 AS VARCHAR) AS d FROM customer) SELECT c_custkey, (11 - ({TAX}) % 11) % 11 = CAST(d[11] AS INTEGER) AS valid FROM x")
def m4(t: Tables):
    text = F.concat(F.lit("20-"), F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0"), F.lit("-"), (F.col("c_custkey") % 10).cast("string"))
    return t.customer.select("c_custkey", V.tax_id_valid(text).alias("valid"))


@query("D1_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def d1(t: Tables):
    text = F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.concat(F.lit("31/02/"), F.year("o_orderdate")))
    return t.orders.select("o_orderkey", V.day_first(text).alias("day"))


@query("D7_elapsed", "SELECT event_id, CAST(CAST(floor(value * 10) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value * 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS elapsed FROM events")
def d7(t: Tables):
    return t.events.select("event_id", V.elapsed(F.floor(F.col("value") * 10)).alias("elapsed"))


@query("M9_progress", "SELECT l_orderkey, least(99, CAST(round(count(*) FILTER (l_linestatus = 'F') * 100 / count(*)) AS INTEGER)) AS percent FROM lineitem GROUP BY 1")
def m9(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(V.progress(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("percent"))


@query("P9_json_filter", "SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50 GROUP BY 1")
def p9(t: Tables):
    return t.events.where(F.get_json_object("props", "$.k").cast("int") > 50).groupBy("event_type").agg(F.count("*").alias("n"))


RECORD = """concat('{"c_mktsegment": "', c_mktsegment, '", "c_name": "', replace(c_name, '#', '\\"#'), '", "c_nationkey": ', c_nationkey, ', "none": null}')"""


@query("R3_record_digest", f"SELECT c_custkey, sha256({RECORD}) AS digest FROM customer")
def r3(t: Tables):
    """A digest of each record's canonical JSON: fields by name, texts escaped, nulls written."""
    quoted = t.customer.withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit('"#'))).withColumn("none", F.lit(None).cast("string"))
    return quoted.select("c_custkey", F.sha2(V.canonical_json("c_name", "c_nationkey", "none", "c_mktsegment"), 256).alias("digest"))


@query(
    "J15_changed_content",
    """WITH o AS (SELECT user_id, event_type, floor(value) AS d, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 0)
SELECT e.event_id FROM events e LEFT JOIN (SELECT * FROM o WHERE rn = 1) o USING (user_id, event_type) WHERE e.event_id % 2 = 1 AND (o.d IS NULL OR o.d <> floor(e.value))""",
)
def j15(t: Tables):
    rows = t.events.withColumn("d", F.floor("value"))
    return L.changed(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"], "d").select("event_id")


