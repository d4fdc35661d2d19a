"""Portal pages, value readers and matching of bidders, on pages built from the star schema and on the crawled ones.

A built page is made of a nation's suppliers (its bidders); the SQL states what the reader has to give back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import names as N
from ..sources import json_values as J
from ..sources import page_tables as R
from ..sources import portal as P
from .registry import Tables, money, query

TAX = "concat('20', lpad(CAST(s_suppkey * 7919 % 100000000 AS {}), 8, '0'), s_suppkey % 10)"
AMOUNT = "translate(format_number(CAST(s_acctbal AS DECIMAL(18,2)), 2), ',.', '.,')"


def _html(t: Tables):
    """An opening record and a comparative table for each nation: page_id, html."""
    row = """concat('<tr><td> ', s_name, ' &amp; C&iacute;a</td><td>', substr(tax, 1, 2), '-', substr(tax, 3, 8), '-', substr(tax, 11, 1), '</td><td>Confirmada 5/3/2024 10:00</td><td>Pesos</td><td>$ ', amount,
        '</td><td></td><td>', kind, '</td><td>poliza</td><td>', s_suppkey, ',50</td></tr>')"""
    s = t.supplier.selectExpr("s_nationkey AS page_id", "s_suppkey", "s_name", TAX.format("STRING") + " AS tax", AMOUNT + " AS amount", "explode(array('mantenimiento', 'cumplimiento', 'cumplimiento')) AS kind")
    rows = s.selectExpr("page_id", "s_suppkey", "kind", row + " AS html")
    body = F.array_join(F.sort_array(F.collect_list(F.struct("s_suppkey", F.col("kind") == "cumplimiento", "html")))["html"], "\n")
    short = F.lit("<table id='x_gvOtras'><tr><td>1</td></tr></table><table id='ctl_gvOfertas'><tr><th>Oferente</th></tr><tr><td>sin datos</td></tr>")
    return rows.groupBy("page_id").agg(F.concat(short, body, F.lit("<tr><td>Nadie</td><td>123</td><td></td><td></td><td></td><td></td><td></td><td></td><td></td></tr></table>")).alias("html"))


BIDDERS = f"b AS (SELECT s_nationkey AS page_id, s_suppkey, {TAX.format('VARCHAR')} AS tax_id, s_name || ' & Cía' AS bidder, abs(CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE)) AS total FROM supplier)"


@query("S10_opening_offers", f"WITH {BIDDERS} SELECT page_id, tax_id, bidder, DATE '2024-03-05' AS confirmed_on, 'Pesos' AS currency, total, 2 AS guarantees, s_suppkey + 0.5 AS amount FROM b")
def s10(t: Tables):
    """Offers and guarantees of opening records; repeated guarantee rows count once, a sign is no part of an amount."""
    offers = R.read_pages(_html(t), "page_id", "html", "opening").where("issue IS NULL")
    kept = ["page_id", "tax_id", "bidder", "confirmed_on", "currency", F.col("total").cast("double").alias("total")]
    return offers.select(*kept, F.size("guarantees").alias("guarantees"), F.col("guarantees")[0]["amount"].cast("double").alias("amount"))


@query("S10_opening_issues", f"WITH {BIDDERS} SELECT page_id, 'no tax id' AS issue, 1 AS n FROM b GROUP BY 1")
def s10_issues(t: Tables):
    """What is wrong with opening records: here, one row a page without a tax id."""
    issues = R.read_pages(_html(t), "page_id", "html", "opening").where("issue IS NOT NULL")
    return issues.groupBy("page_id", "issue").agg(F.count("*").cast("int").alias("n"))


def _comparison(t: Tables):
    """A comparative table for each part: its order lines as lines, suppliers as bidders, the last quote twice. The order lines are shuffled once,
    by part; a page's html is made of its sorted quotes where they meet."""
    line = t.lineitem.select("l_partkey", "l_linenumber", "l_suppkey", "l_quantity", money("l_extendedprice").alias("p")).repartition("l_partkey")
    line = line.groupBy("l_partkey", "l_linenumber", "l_suppkey").agg(F.min("l_quantity").alias("q"), F.min("p").alias("p"))
    pages = line.groupBy(F.col("l_partkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "q", "p"))).alias("quotes"))
    tax = TAX.replace("s_suppkey", "x.l_suppkey").format("STRING")
    key = "'<span id=\"g_rptLineas_ctl0', x.l_linenumber, '_"
    own = key + "rptLineasOfertas_ctl', x.l_suppkey, '_"
    quote = f"""{own}lblNombre">Prov ', x.l_suppkey, ' (', {tax}, ')</span>', {own}txtPrecioUnitario">', translate(format_number(x.p, 2), ',.', '.,'), '</span>',
        {own}lblCantidadOfertada">', CASE WHEN x.l_suppkey % 5 = 0 THEN 'n/d' ELSE CAST(CAST(x.q AS INT) AS STRING) END, '</span>'"""
    head = f"""'<div>', {key}lblRenglon">', x.l_linenumber, '</span>', {key}lblOpcion">', CASE WHEN x.l_linenumber % 2 = 0 THEN '2' ELSE '' END, '</span>'"""
    first = f"CASE WHEN i = 0 THEN concat({head}) WHEN NOT quotes[i - 1].l_linenumber <=> x.l_linenumber THEN concat('</div><br>', {head}) ELSE '' END"
    # a quote without a supplier or price isn't told, but its line is
    told = f"concat(coalesce({first}, ''), coalesce(concat({quote}), ''))"
    return pages.selectExpr("page_id", f"concat(array_join(transform(quotes, (x, i) -> {told}), ''), '</div>') AS html")


@query(
    "S11_comparative_quotes",
    f"""SELECT l_partkey AS page_id, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS alternative, {TAX.replace('s_suppkey', 'l_suppkey').format('VARCHAR')} AS tax_id,
CAST(min(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(floor(min(l_quantity)) AS DOUBLE) AS quantity FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY l_partkey, l_linenumber, l_suppkey""",
)
def s11(t: Tables):
    """Quotes of comparative tables; those without a readable quantity are left out."""
    out = R.read_pages(_comparison(t), "page_id", "html", "comparative", "part", "line", "alternative", "tax_id", "price", "quantity").where("part = 'quote'")
    return out.select("page_id", "line", "alternative", "tax_id", F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"))


@query("S11_comparative_issues", "SELECT l_partkey AS page_id, 'no price or quantity' AS issue, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey % 5 = 0) GROUP BY 1")
def s11_issues(t: Tables):
    """What can't be read in comparative tables."""
    return R.read_pages(_comparison(t), "page_id", "html", "comparative", "part", "issue").where("part = 'issue'").groupBy("page_id", "issue").agg(F.count("*").alias("n"))


def _process(t: Tables):
    """A process page for each customer: its orders are the lines, its first order dates the schedule and the acts."""
    frame = "ctl00_CPH1_UCVistaPreviaPliego_"
    span = lambda key, value: f"'<span id=\"{frame}{key}\">', {value}, '</span>'"
    line = """concat('<tr><td> ', o_orderkey, '</td><td>2.1</td><td>', o_custkey, '-', o_orderkey, '</td><td>', o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN ' a¿os' ELSE '' END, '</td><td>', CASE WHEN o_orderstatus = 'F' THEN 'sin dato'
        ELSE concat(translate(format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2), ',.', '.,'), ' kg') END, '<td><table><tr><td>9<td>no line</table></tr>')"""
    lines = t.orders.selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_orderdate", line + " AS html").groupBy("c_custkey")
    lines = lines.agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", "html")))["html"], "\n").alias("lines"), F.date_format(F.min("o_orderdate"), "d/M/yyyy").alias("day"))
    head = ["'<html><body><div>'", span("usrCabeceraPliego_lblNumExpediente", "'EX-', c_custkey"), span("usrCabeceraPliego_lblNomPliego", "'otro nombre'"), span("UC_InformacionBasica_lblNumeroProceso", "' ', c_custkey, ' '")]
    head += [span("UC_InformacionBasica_lblNombreProceso", "CASE WHEN c_custkey % 3 > 0 THEN concat(c_name, ' y C&iacute;a') ELSE '' END"), span("UC_InformacionBasica_lblProcedimientoSeleccion", "c_mktsegment")]
    head += ["CASE WHEN c_custkey % 4 > 0 THEN concat(" + span("UC_InformacionBasica_lblMoneda", "'Peso', CASE WHEN c_custkey % 5 = 0 THEN '¿a' ELSE 's' END") + ") ELSE '' END"]
    head += [span("UC_InformacionBasica_lblTipoCotizacionCantidad", "'parcial'"), span("UC_InformacionBasica_lblTipoCotizacionLinea", "'por renglón'"), "'</div>'"]
    timed = ["'<div><label>Acto de <b>apertura</b></label>'", span("UC_Cronograma_lblTitulo", "'no'"), span("UC_Cronograma_lblApertura", "day, ' 10:00'"), "'</div><div>'", span("UC_Garantias_lblA", "'cinco por ciento'"), span("UC_Garantias_lblB", "' '"), span("UC_OfertasProceso_lblOfertasPresentadas", "'5'"), "'</div>'"]
    table = ["'<table id=\"x_' || 'UC_DetalleProductos_gvLineaPliego\"><thead><tr><th>N</th></tr></thead><tbody>'", "lines", "'</tbody></table>'"]
    acts = ["'<table id=\"x_UC_ActosAdministrativos_gvActosAdministrativos\"><tr><td>'", span("d_lblDocumento", "'Autorización de llamado'"), span("d_lblFechaVinculacion", "day"), span("d_lblNumeroSade", "'N-', c_custkey")]
    acts += ["'<a id=\"d_btnVer\" href=\"javascript:__doPostBack(&#39;t$', c_custkey, '&#39;,&#39;v&#39;)\">ver</a></td></tr><tr><td>'", span("e_lblDocumento", "'Dictamen'"), "'</td></tr></table>'"]
    circulars = ["'<table id=\"x_UC_Circulares_gvCirculares\"><tr><td>'", span("f_lblNumero", "'7'"), span("f_lblFechaCreacion", "day"), "'<a id=\"f_btnVerCircular\" onclick=\"VerCircularCiudadano(&#39;q', c_custkey, '&#39;)\">ver</a></table></body></html>'"]
    page = f"concat({', '.join(head)}, CASE WHEN lines IS NULL THEN '' ELSE concat({', '.join(timed + table + acts + circulars)}) END)"
    return t.customer.join(lines, "c_custkey", "left").selectExpr("c_custkey", page + " AS html")


@query(
    "S12_process_page",
    """WITH o AS (SELECT o_custkey AS c_custkey, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1), c AS (SELECT customer.*, day, c_custkey % 4 > 0 AS paid FROM customer LEFT JOIN o USING (c_custkey)),
r AS (
SELECT c_custkey, 'field' AS section, 1 AS i, 'file' AS name, 'EX-' || c_custkey AS value, NULL::DATE AS day, NULL::VARCHAR AS quantity, '' AS details, false AS damaged FROM c
UNION ALL SELECT c_custkey, 'field', 2, 'name', c_name || ' y Cía', NULL, NULL, '', false FROM c WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'field', 3, 'number', CAST(c_custkey AS VARCHAR), NULL, NULL, '', false FROM c
UNION ALL SELECT c_custkey, 'field', 4, 'kind', c_mktsegment, NULL, NULL, '', false FROM c UNION ALL SELECT c_custkey, 'field', 5, 'currency', CASE WHEN c_custkey % 5 = 0 THEN 'Peso¿a' ELSE 'Pesos' END, NULL, NULL, '', c_custkey % 5 = 0 FROM c WHERE paid
UNION ALL SELECT c_custkey, 'missing', 1, 'name', NULL, NULL, NULL, '', false FROM c WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'list', i, 'quote_kinds', v, NULL, NULL, '', false FROM c, (VALUES (1, 'parcial'), (2, 'por renglón')) x(i, v)
UNION ALL SELECT c_custkey, 'schedule', 1, 'Acto de apertura', strftime(day, '%-d/%-m/%Y') || ' 10:00', day, NULL, '', false FROM c WHERE day IS NOT NULL
UNION ALL SELECT c_custkey, 'guarantee', 1, NULL, 'cinco por ciento', NULL, NULL, '', false FROM c WHERE day IS NOT NULL UNION ALL SELECT c_custkey, 'count', 1, 'bidders', '5', NULL, NULL, '', false FROM c WHERE day IS NOT NULL
UNION ALL SELECT o_custkey, 'line', o_orderkey, CAST(o_orderkey AS VARCHAR), o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN ' a¿os' ELSE '' END, NULL, CASE WHEN o_orderstatus <> 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END,
  'item=' || o_custkey || '-' || o_orderkey || ',object=2.1,unit=' || CASE WHEN o_orderstatus = 'F' THEN 'sin dato' ELSE 'kg' END, o_orderkey % 7 = 0 FROM orders
UNION ALL SELECT o_custkey, 'issue', o_orderkey, 'lines', 'line ' || o_orderkey || ' has no quantity', NULL, NULL, '', false FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT c_custkey, 'document', 1, 'acts', 'Autorización de llamado', day, NULL, 'argument=v,number=N-' || c_custkey || ',opens=form,target=t$' || c_custkey, false FROM c WHERE day IS NOT NULL
UNION ALL SELECT c_custkey, 'document', 2, 'acts', 'Dictamen', NULL, NULL, '', false FROM c WHERE day IS NOT NULL UNION ALL SELECT c_custkey, 'issue', 1::BIGINT << 60, 'documents', 'nothing opens Dictamen', NULL, NULL, '', false FROM c WHERE day IS NOT NULL
UNION ALL SELECT c_custkey, 'circular', 1, '7', '/PLIEGO/VistaPreviaCircularCiudadano.aspx?qs=q' || c_custkey, day, NULL, '', false FROM c WHERE day IS NOT NULL
UNION ALL SELECT c_custkey, 'candidate', 1, 'authorised_on', NULL, day, NULL, '', false FROM c WHERE day IS NOT NULL
UNION ALL SELECT c_custkey, 'issue', i, v, 'not found', NULL, NULL, '', false FROM c, (VALUES (1, 'schedule'), (2, 'guarantees'), (3, 'lines')) x(i, v) WHERE day IS NULL)
SELECT c_custkey, section, count(*) AS n, count(*) FILTER (damaged) AS damaged, md5(string_agg(concat_ws('|', coalesce(name, ''), coalesce(value, ''), coalesce(CAST(day AS VARCHAR), ''), coalesce(quantity, ''), details), chr(10) ORDER BY i)) AS digest FROM r GROUP BY 1, 2""",
)
def s12_page(t: Tables):
    """All that process pages say, by section: fields, lists, schedule, guarantees, lines, documents, circulars, and what is missing or wrong."""
    rows = R.read_pages(_process(t), "c_custkey", "html", "process")
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    said = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (F.col("name"), F.col("value"), F.col("day").cast("string"), F.col("quantity").cast("decimal(18,2)").cast("string"))], details)
    return rows.groupBy("c_custkey", "section").agg(
        F.count("*").alias("n"), F.count_if("damaged").alias("damaged"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"]), "\n")).alias("digest")
    )


@query("X31_portal_text", r"SELECT c_custkey, c_name || ' & Cía «' || c_mktsegment || '»' AS text, c_custkey % 2 = 0 AS damaged FROM customer")
def x31(t: Tables):
    raw = F.expr("concat('  ', c_name, ' &amp; C&iacute;a ', chr(7), '&laquo;', c_mktsegment, '&raquo; \n ')")
    damaged = F.when(F.col("c_custkey") % 2 == 0, F.concat(raw, F.lit("a¿os"))).otherwise(raw)
    return t.customer.select("c_custkey", P.portal_text(raw).alias("text"), P.damaged(damaged).alias("damaged"))


@query("S3_formats", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'unknown' ELSE 'html' END AS format FROM pages")
def s3(t: Tables):
    """The format of each document's bytes; a fifth of them get a PDF's first bytes, a fifth none that say anything."""
    body = F.encode("html", "UTF-8")
    content = F.when(F.col("page_id") % 5 == 0, F.concat(F.encode(F.lit("%PDF-1.7\n"), "UTF-8"), body)).when(F.col("page_id") % 5 == 1, F.encode(F.lit("no page"), "UTF-8"))
    content = F.coalesce(content, F.when(F.col("page_id") % 5 == 2, F.concat(F.unhex(F.lit("EFBBBF")), body)), body)
    return t.pages.select("page_id", P.format_of(content).alias("format"))


@query("S8_decoded", r'''SELECT page_id, md5(CASE WHEN page_id % 3 = 1 THEN regexp_replace(replace(html, 'charset="utf-8"', 'charset="iso-8859-1"'), '[^\x00-\xFF]', '', 'g') ELSE html END) AS digest FROM pages''')
def s8_decoded(t: Tables):
    """Pages in UTF-8, in a declared Latin-1, and in UTF-8 with a byte order mark, all read as they were."""
    latin = F.regexp_replace(F.replace("html", F.lit('charset="utf-8"'), F.lit('charset="iso-8859-1"')), r"[^\x00-\xFF]", "")
    utf8 = F.encode("html", "UTF-8")
    content = F.when(F.col("page_id") % 3 == 1, F.encode(latin, "ISO-8859-1")).when(F.col("page_id") % 3 == 2, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    return t.pages.select("page_id", F.md5(P.decoded(content)).alias("digest"))


KIND = "CASE WHEN l_tax * 12 >= 0.9 THEN 'scanned' WHEN l_quantity >= 10 AND l_suppkey % 20 / l_quantity >= 0.1 THEN 'unusable text' WHEN l_quantity >= 10 THEN 'text' WHEN l_returnflag = 'R' THEN 'scanned' WHEN l_partkey % 3 > 0 THEN 'fields only' ELSE 'blank' END"


@query("S5_page_kind", f"SELECT {KIND} AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def s5_kind(t: Tables):
    """Pages by what was seen of them; an order line's numbers stand for those."""
    chars = F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).otherwise(0)
    kind = P.page_kind(chars, F.col("l_suppkey") % 20, F.col("l_tax") * 12, F.col("l_returnflag") == "R", F.col("l_partkey") % 3)
    return t.lineitem.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "S6_recognised_pages",
    """SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag <> 'R') < 3 THEN 'illegible' WHEN avg(l_quantity * 2) >= 80 THEN 'read' WHEN avg(l_quantity * 2) >= 50 THEN 'doubtful' ELSE 'illegible' END AS state FROM lineitem GROUP BY 1""",
)
def s6(t: Tables):
    words = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "R", "--").otherwise("ok").alias("w"), (F.col("l_quantity") * 2).alias("c"))
    return P.recognised_state(words, ["l_orderkey"], "w", "c").select("l_orderkey", "state")


@query(
    "M1_amounts",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 3 THEN floor(CAST(o_totalprice AS DECIMAL(18,2))) WHEN 4 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount FROM orders",
)
def m1(t: Tables):
    """Amounts as pages write them: with points or without, with a currency before or after, whole, or none at all."""
    price = money("o_totalprice")
    dotted, plain = V.amount_text(price), price.cast("string")
    whole = F.translate(F.format_number(F.floor(price), 0), ",", ".")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("$ "), dotted)).when(F.col("o_orderkey") % 6 == 1, plain).when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("USD "), dotted))
        .when(F.col("o_orderkey") % 6 == 3, F.concat(whole, F.lit(" pesos"))).when(F.col("o_orderkey") % 6 == 4, "sin monto").otherwise(F.replace(plain, F.lit("."), F.lit(",")))
    )
    return t.orders.select("o_orderkey", V.amount(text).cast("double").alias("amount"))


@query("M3_only_percent", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN NULL WHEN 3 THEN 10 ELSE NULL END AS DOUBLE) AS percent FROM part")
def m3(t: Tables):
    text = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('garantía del ', p_size, '%, o sea ', p_size, ' %') WHEN 1 THEN concat('un ', p_size, ',5 por ciento') WHEN 2 THEN concat('del ', p_size, '% al ', p_size + 1, '%') WHEN 3 THEN 'Diez por ciento (10%)' ELSE 'sin porcentaje' END")
    return t.part.select("p_partkey", V.only_percent(text).cast("double").alias("percent"))


@query("M10_quantities", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 + 0.5 WHEN 2 THEN p_size * 1000 END AS DOUBLE) AS value, CASE p_partkey % 4 WHEN 0 THEN 'UNIDADES' WHEN 1 THEN 'kg' WHEN 2 THEN '' END AS unit FROM part")
def m10(t: Tables):
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' UNIDADES') WHEN 1 THEN concat(' ', p_size, '.000,50 kg ') WHEN 2 THEN concat(p_size, '.000') ELSE 'n/d' END")
    return t.part.select("p_partkey", V.quantity(text).alias("q")).select("p_partkey", F.col("q.value").cast("double").alias("value"), "q.unit")


@query("D2_terms", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS days, CASE p_partkey % 3 WHEN 0 THEN 'calendar' WHEN 1 THEN 'business' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 = 0 END AS from_opening FROM part")
def d2(t: Tables):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_size, ' días corridos desde la Apertura') WHEN 1 THEN concat(' ', p_size, ' DIAS HÁBILES ') ELSE 'a convenir' END")
    return t.part.select("p_partkey", V.term(text).alias("t")).select("p_partkey", "t.days", "t.kind", "t.from_opening")


@query("D5_reference_dates", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN CAST(o_orderdate AS DATE) > DATE '1998-06-01' THEN 'future' ELSE 'ok' END AS state, count(*) AS n FROM orders GROUP BY 1")
def d5(t: Tables):
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    return t.orders.groupBy(V.reference_date(day, F.lit("1998-06-01").cast("date")).alias("state")).agg(F.count("*").alias("n"))


#: A record with strings at several depths, in quotes, with escapes of both kinds, as names, and odd spacing; from the texts of conversations.
NESTED = r"""concat('{"a" : {"said":', {json}, ' , "tags": [["x \\"y\\"", {"deep": ', {json}, '}], "caf\\u00e9"]}, "n":', CAST(turn AS {text}), ', "ok" : true, "role\\t" :"', role, '", "none": null}')"""


@query(
    "R2_json_strings",
    f"""SELECT conv_id, turn, md5(array_to_string(list_sort([text, text, role, 'x "y"', 'café', 'a', 'said', 'tags', 'deep', 'n', 'ok', 'role' || chr(9), 'none']), chr(30))) AS digest, 13 AS n FROM conversations
WHERE text IS NOT NULL""",
)
def r2(t: Tables):
    """Every string of a JSON record at any depth, names too, decoded; sorted, as a set has no order."""
    body = NESTED.replace("{json}", "substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)").replace("{text}", "STRING")
    rows = t.conversations.where("text IS NOT NULL").select(F.struct("conv_id", "turn").alias("k"), F.expr(body).alias("record"))
    found = J.json_strings(rows, "k", "record").groupBy("k").agg(F.sort_array(F.collect_list("string")).alias("s"))
    return found.select("k.conv_id", "k.turn", F.md5(F.array_join("s", "\u001e")).alias("digest"), F.size("s").alias("n"))


@query("M2_amounts_in_text", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS first, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders")
def m2(t: Tables):
    """Amounts of free text: numbers of clauses, percentages and amounts of taxes don't count."""
    text = F.concat(F.lit("Según los puntos 3.10, 3.11 y 11.10 la oferta cotiza $ "), V.amount_text(money("o_totalprice")), F.lit(" con IVA del 21%; impuesto de $ 99,00. "), F.when(F.col("o_orderkey") % 2 == 0, "Monto de garantía 5.000 pesos, 30 días.").otherwise("Plazo de 30 días."))
    found = V.amounts_in(text)
    return t.orders.select("o_orderkey", found[0].cast("double").alias("first"), F.size(found).alias("n"))


WHO = "CASE WHEN l.s_suppkey % 4 = 0 THEN {tax} END"


@query(
    "J17_matched_offers",
    f"""SELECT s_nationkey, s_suppkey AS portal_id, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey * 10 END AS offer_id, CASE s_suppkey % 4 WHEN 0 THEN 'tax_id' WHEN 3 THEN CASE WHEN s_suppkey % 8 = 3 THEN 'other_tax_id' ELSE 'ambiguous' END ELSE 'name' END AS how FROM supplier""",
)
def j17(t: Tables):
    """The portal's bidders among the bids loaded: by tax id, by equal or contained names, never on a guess."""
    tax = TAX.format("STRING")
    portal = t.supplier.selectExpr("s_nationkey", "s_suppkey AS portal_id", f"{tax} AS tax_id", "concat('Compañía ', translate(substr(s_name, 10), '0123456789', 'abcdefghij'), ' Norte S.R.L.') AS name")
    loaded = t.supplier.selectExpr(
        "s_nationkey", "s_suppkey * 10 AS offer_id", f"CASE s_suppkey % 8 WHEN 0 THEN {tax} WHEN 4 THEN {tax} WHEN 3 THEN concat('30', substr({tax}, 3)) END AS tax_id",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Otra' WHEN 1 THEN concat(upper(translate(substr(s_name, 10), '0123456789', 'abcdefghij')), ' norte, compañía') ELSE concat(translate(substr(s_name, 10), '0123456789', 'abcdefghij'), ' SRL') END AS name",
    )
    twice = loaded.where("offer_id div 10 % 8 = 7").withColumn("offer_id", F.col("offer_id") + 1)
    return N.matched_offers(portal, loaded.unionByName(twice), "s_nationkey")


TABLE = "CASE WHEN p_partkey % 4 = 0 THEN concat('sin tabla ', p_name) ELSE concat('Renglón Descripción', chr(10), '1 ', p_name, ' ', p_size, ' kilos', chr(10), 'nota', chr(10), '2 ', p_brand, chr(10), '1 repetido') END"


@query("X36_item_rows", "SELECT p_partkey, r.n AS number, CASE r.n WHEN 1 THEN p_name ELSE p_brand END AS what, CASE r.n WHEN 1 THEN p_size || ' kilos' ELSE '' END AS amount FROM part, (VALUES (1), (2)) r(n) WHERE p_partkey % 4 > 0")
def x36(t: Tables):
    """The rows of item tables in texts: number, what it is, quantity and unit."""
    return X.item_rows(t.part.selectExpr("p_partkey", TABLE + " AS text"), "p_partkey", "text")
