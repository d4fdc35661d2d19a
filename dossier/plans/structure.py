"""The structure of norms built from order lines, and passages, signatures and classes of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import headings as H
from ..functions import text as X
from ..operators import lines as N
from ..operators import passages as G
from ..operators import points as O
from ..operators import structure as S
from .registry import Tables, query
from .text import LINES, PLAIN

#: A paragraph of a norm for each order line, in SQL that both engines read.
PARAGRAPH = """CASE l_partkey % 18 WHEN 0 THEN concat('ARTÍCULO ', l_linenumber, '°.- OBJETO. El régimen alcanza a ', l_suppkey, '.') WHEN 1 THEN concat('Artículo ', l_linenumber, ' bis.- Sin efecto.')
WHEN 2 THEN 'TÍTULO II' WHEN 3 THEN 'CAPÍTULO IV - DISPOSICIONES' WHEN 4 THEN 'CLÁUSULA TRANSITORIA' WHEN 5 THEN 'ANEXO I' WHEN 6 THEN 'VISTO el expediente' WHEN 7 THEN 'CONSIDERANDO:'
WHEN 8 THEN 'Que corresponde dictar la medida' WHEN 9 THEN 'Por ello,' WHEN 10 THEN 'Firmado digitalmente por la Directora' WHEN 11 THEN concat('a) muestra de ', l_partkey) WHEN 12 THEN concat(l_linenumber, '. Notificación')
WHEN 13 THEN 'ÍNDICE' WHEN 14 THEN 'DISPOSICIONES GENERALES' WHEN 15 THEN 'e. 12/03/2024 N° 1234/24 v. 12/03/2024' WHEN 16 THEN 'Inciso 2)Muestras' ELSE concat('El oferente presentará ', l_suppkey, ' unidades.') END"""
UPPER = rf"(NOT regexp_matches(LINE, '{H.LOWER}') AND length(regexp_replace(LINE, '[^\p{{L}}]', '', 'g')) >= 3)"


def _ladder(column: str) -> str:
    up = UPPER.replace("LINE", column)
    rows = [f"WHEN regexp_matches({column}, '{p}'){f' AND {up}' if only else ''} THEN '{kind}'" for kind, p, only in H.LADDER]
    return f"CASE {' '.join(rows)} WHEN {up} AND regexp_matches({column}, '^\\p{{L}}') THEN 'upper' ELSE 'text' END"


def _paragraphs(t: Tables):
    """doc (the order), at (a number that orders its paragraphs), text."""
    return t.lineitem.selectExpr("l_orderkey AS doc", "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS at", PARAGRAPH + " AS text").dropDuplicates(["doc", "at"])


@query("X20_headings", f"WITH {LINES}, a AS (SELECT trim(line) AS line FROM lines UNION ALL SELECT {PARAGRAPH} FROM lineitem) SELECT {_ladder('line')} AS kind, count(*) AS n FROM a GROUP BY 1")
def x20(t: Tables):
    """What the lines of all documents and the paragraphs of all norms open with."""
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line"))
    both = lines.unionByName(t.lineitem.selectExpr(PARAGRAPH + " AS line"))
    return both.groupBy(H.heading(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query("X21_units")
def x21(t: Tables):
    """The unit that each paragraph of a norm belongs to."""
    return S.units_of(_paragraphs(t), "doc", "at", "text")


@query(
    "X21_first_articles",
    f"""WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS pos, l_linenumber AS n FROM lineitem WHERE l_partkey % 18 = 0), f AS (SELECT doc, arg_min(n, pos) FILTER (n <= 4) AS n FROM p GROUP BY 1) SELECT doc, 'art-' || n AS key FROM f
WHERE n IS NOT NULL AND doc NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 18 = 5)""",
)
def x21_first(t: Tables):
    """The first article that each norm without annexes has accepted: the first whose number its sequence allows."""
    units = S.units_of(_paragraphs(t), "doc", "at", "text", ("kind", "unit_type", "key"))
    plain = units.groupBy("doc").agg(F.min_by("key", F.when(F.col("unit_type") == "article", F.col("at"))).alias("key"), F.bool_or(F.col("kind") == "annex").alias("annex"))
    return plain.where("key IS NOT NULL AND NOT annex").select("doc", "key")


#: The paragraphs of a norm with a cover and an index, by place; k is a number that decides which of them it has.
WITH_INDEX = (
    "CASE WHEN k % 5 = 0 THEN 'prosa antes' ELSE 'Número: DI-1-APN' END", "'Ciudad de la norma'", "CASE WHEN k % 2 = 0 THEN 'Referencia: régimen' ELSE 'más prosa' END", "'ÍNDICE'", "'TÍTULO I'", "'ARTÍCULO 1°.- OBJETO'",
    "'DE LA MEDIDA'", "'ARTÍCULO 2°.- PLAZOS'", "'a) lista del índice'", "'TÍTULO I'", "'ARTÍCULO 1°.- OBJETO. El régimen alcanza a todos.'", "'texto del primero'",
    "CASE WHEN k % 3 = 0 THEN 'ARTÍCULO 2°.- PLAZOS. Rigen.' ELSE 'más texto' END", "'ANEXO I'", "'ARTÍCULO 2°.- PLAZOS. Los del anexo.'",
)
WITH_INDEX_SQL = f"(SELECT doc, k, at, CASE at {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(WITH_INDEX, 1))} END AS text FROM n, r)".replace(" at", " pos")


@query(
    "X21_index",
    f"""WITH n AS (SELECT o_orderkey AS doc, o_custkey AS k FROM orders), r AS (SELECT unnest(range(1, {len(WITH_INDEX) + 1})) AS pos), p AS (SELECT *, k % 2 = 0 AND k % 5 > 0 AS cover, k % 3 = 0 AS listed FROM {WITH_INDEX_SQL})
SELECT doc, pos AS at, CASE WHEN pos <= 3 AND cover THEN 'discarded' WHEN pos <= 3 THEN 'unlocated' WHEN pos IN (14) THEN 'annex' WHEN pos = 15 THEN 'article' WHEN listed AND pos <= 9 THEN 'discarded' WHEN pos = 4 THEN 'discarded' WHEN pos IN (5, 10) THEN 'title'
  WHEN listed THEN 'article' WHEN pos = 9 THEN 'item' WHEN pos >= 11 THEN 'title' ELSE 'article' END AS unit_type,
CASE WHEN pos <= 5 OR pos = 10 THEN NULL WHEN pos = 14 THEN 'anexo-i' WHEN pos = 15 THEN 'anexo-i/art-2' WHEN listed THEN CASE WHEN pos <= 9 THEN NULL WHEN pos = 13 THEN 'art-2' ELSE 'art-1' END
  WHEN pos IN (6, 7) THEN 'art-1' WHEN pos = 8 THEN 'art-2' WHEN pos = 9 THEN 'art-2/inc-a' END AS key FROM p""",
)
def x21_index(t: Tables):
    """Norms with a cover and an index: articles that the index names are no units, unless their headings don't come again in the same part."""
    cases = "CASE at " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(WITH_INDEX, 1)) + " END AS text"
    rows = t.orders.selectExpr("o_orderkey AS doc", "o_custkey AS k", f"explode(sequence(1, {len(WITH_INDEX)})) AS at").selectExpr("doc", "at", cases)
    return S.units_of(rows, "doc", "at", "text", ("unit_type", "key"))


#: The paragraphs of an article with lists, and the items that they belong to: key, first and last paragraph.
WITH_ITEMS = (
    "'Artículo 1°.- Requisitos:'", "'a) uno:'", "concat('1) uno uno, ', k)", "'2) uno dos:'", "CASE WHEN k % 2 = 0 THEN 'lo que el punto dos presenta' ELSE 'd) salta la letra' END", "'b) dos'", "'1) dos uno'", "'2) dos dos'",
    "'Además se presenta:'", "'1. nueva lista'", "'2. otra:'", "concat('lo último para ', k)", "'ARTÍCULO 2°.- Sin lista.'", "'b) no empieza una lista'",
)
ITEMS_OF = "(2, 'inc-a', 2, 5), (3, 'inc-a/inc-1', 3, 3), (4, 'inc-a/inc-2', 4, 5), (5, 'inc-a/inc-2', 4, 5), (6, 'inc-b', 6, 8), (7, 'inc-b/inc-1', 7, 7), (8, 'inc-b/inc-2', 8, 8), (10, 'inc-1', 10, 10), (11, 'inc-2', 11, 12), (12, 'inc-2', 11, 12)"


@query("X22_items", f"SELECT o_orderkey AS doc, pos AS at, 'art-1/' || key AS key, CASE WHEN contains(key, '/') THEN 'art-1/' || split_part(key, '/', 1) ELSE 'art-1' END AS parent, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last FROM orders, (VALUES {ITEMS_OF}) AS v(pos, key, a, b)")
def x22(t: Tables):
    """The items of two levels of an article: what they are inside of, where they begin and end; a paragraph that presents a list begins a new one."""
    cases = "CASE at " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(WITH_ITEMS, 1)) + " END AS text"
    rows = t.orders.selectExpr("o_orderkey AS doc", "o_custkey AS k", f"explode(sequence(1, {len(WITH_ITEMS)})) AS at").selectExpr("doc", "at", cases)
    return S.units_of(rows, "doc", "at", "text", ("unit_type", "key", "parent", "first", "last")).where("unit_type = 'item'").drop("unit_type")


@query("X23_points")
def x23(t: Tables):
    """The numbered point of each paragraph of an opinion."""
    text = "CASE l_partkey % 6 WHEN 0 THEN concat(l_linenumber, '. Antecedentes') WHEN 1 THEN '1.1 Detalle' WHEN 2 THEN 'I. HECHOS' WHEN 3 THEN 'II. DERECHO' WHEN 4 THEN 'Firmado digitalmente por X' ELSE 'sigue el texto' END AS text"
    rows = t.lineitem.selectExpr("l_orderkey AS doc", "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS at", text).dropDuplicates(["doc", "at"])
    return O.points_of(rows, "doc", "at", "text")


@query(
    "X19_paragraphs",
    rf"""WITH {LINES.replace("lines AS", "raw AS")}, l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM (SELECT doc_id, replace(replace(text, '. ', '.' || chr(10)), 'en ', 'e-' || chr(10) || 'n ') AS text FROM documents)),
k AS (SELECT doc_id, i, line FROM l WHERE trim(line) <> ''), o AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL OR regexp_matches(lag(line) OVER w, '[.:;]\s*$') THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM o), c AS (SELECT *, regexp_matches(line, '\p{{L}}[-‐]$') AND coalesce(regexp_matches(lead(line) OVER v, '^[a-záéíóúüñ]'), false) AS cut FROM p WINDOW v AS (PARTITION BY doc_id, p ORDER BY i)),
j AS (SELECT *, lag(cut) OVER v AS after, lag(line) OVER v AS before FROM c WINDOW v AS (PARTITION BY doc_id, p ORDER BY i))
SELECT doc_id, CAST(p AS INTEGER) AS paragraph, md5(string_agg(CASE WHEN after IS NULL OR after OR ends_with(before, ' ') THEN '' ELSE ' ' END || CASE WHEN after IS NULL THEN CASE WHEN cut THEN regexp_replace(line, '[-‐]$', '') ELSE line END ELSE ltrim(CASE WHEN cut THEN regexp_replace(line, '[-‐]$', '') ELSE line END) END, '' ORDER BY i)) AS digest, count(*) AS lines, CAST(count(*) FILTER (cut) AS BIGINT) AS joins FROM j GROUP BY 1, 2""",
)
def x19(t: Tables):
    """Lines joined to paragraphs; a paragraph ends with a line that ends a sentence; cut words are put together."""
    broken = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("en "), F.lit("e-\nn "))
    lines = t.documents.select("doc_id", F.posexplode(F.split(broken, "\n")).alias("i", "line")).where(F.trim("line") != "")
    from pyspark.sql.window import Window

    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("i"))
    lines = lines.withColumn("opens", F.coalesce(before.rlike(r"[.:;]\s*$"), F.lit(True)))
    out = N.paragraphs(lines, "doc_id", "i", "line", F.col("opens"))
    return out.select("doc_id", "paragraph", F.md5("text").alias("digest"), "lines", "joins")


#: What a canonical line has instead of each character or pair, in SQL: the fixed values, one after the other.
CANONICAL = "line"
for _old, _new in (X.COMPOSED | X.LIGATURES).items():
    CANONICAL = f"replace({CANONICAL}, '{_old}', '{_new}')"


@query("X18_canonical_lines", f"WITH {LINES} SELECT doc_id, md5(string_agg(regexp_replace({CANONICAL}, ' {{2,}}', ' ', 'g'), chr(10) ORDER BY regexp_replace({CANONICAL}, ' {{2,}}', ' ', 'g'))) AS digest FROM lines GROUP BY 1")
def x18(t: Tables):
    """Lines that were set with ligatures, hard spaces, soft hyphens and accents of their own come back as they are written; any that were there before too."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    set_ = F.col("line")
    for old, new in (("fi", "\ufb01"), (" ", "\u00a0"), ("\u00e9", "e\u0301"), ("\u00f1", "n\u0303"), ("\u00fc", "u\u0308")):
        set_ = F.replace(set_, F.lit(old), F.lit(new))
    rows = lines.select("doc_id", X.canonical_line(F.concat(set_, F.lit("\u00ad"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("digest"))


def _cut_documents(t: Tables):
    """Passages of all documents of 120 tokens at most, the header's among them; an item begins at every line with a figure."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("n"), x.rlike(r"^\s*\d").alias("item")))
    places = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("items")), lambda s, x: F.struct((s["at"] + x["n"] + 1).alias("at"), F.when(x["item"], F.concat(s["items"], F.array(s["at"]))).otherwise(s["items"]).alias("items")))
    rows = t.documents.select("doc_id", "text", F.concat_ws(", ", "source", "lang").alias("header"), places["items"].alias("items"))
    return G.cut(rows, "doc_id", "text", most=120, overlap=20, header="header", items="items", tokens=G.word_pieces)


@query("X24_passages")
def x24(t: Tables):
    """Passages of all documents with their header, by a tokeniser of one's own."""
    return _cut_documents(t).select("doc_id", "place", "start", "end", "header", F.md5("text").alias("digest"))


SEEN = r"length(regexp_replace(text, '\s', '', 'g'))"


def _covered(passages, t: Tables, limit):
    """Characters other than white space that the passages of each text cover, once each, and whether all keep to the limit."""
    from pyspark.sql.window import Window

    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = passages.withColumn("begin", F.greatest("start", F.coalesce(before, F.lit(0)))).withColumn("kept", limit)
    rest = F.when(F.col("begin") < F.col("end"), F.substring("text", F.col("begin") - F.col("start") + 1, F.col("end") - F.col("begin"))).otherwise("")
    sums = rows.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(rest, r"(?U)\s", ""))).alias("chars"), F.bool_and("kept").alias("kept"))
    return t.documents.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"), F.coalesce("kept", F.lit(True)).alias("kept"))


@query("X24_coverage", f"SELECT doc_id, {SEEN} AS chars, true AS kept FROM documents".replace("AS chars", "AS chars"))
def x24_coverage(t: Tables):
    """Every character of a document is in a passage, and no passage has more than 120 tokens with its header, unless it is one word."""
    pieces = F.transform(F.regexp_extract_all(F.concat_ws(" ", "header", "text"), F.lit(r"(?U)(\w+|[^\w\s])"), 1), lambda w: F.ceil(F.length(w) / 4))
    size = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _covered(_cut_documents(t), t, (size <= 120) | ~F.col("text").rlike(r"(?U)\s"))


def _paged(t: Tables):
    """The documents with a page break for every blank line."""
    text = F.regexp_replace(F.col("text"), "\n\\s*\n", "\f\n")
    return t.documents.select("doc_id", text.alias("text"))


@query("X25_bid_passages")
def x25(t: Tables):
    """Passages of all documents of 200 to 1200 characters, page by page."""
    return G.cut_bids(_paged(t), "doc_id", "text").select("doc_id", "place", "key", "start", "end", F.md5("text").alias("digest"))


@query("X25_coverage", f"SELECT doc_id, {SEEN} AS chars, true AS kept FROM documents")
def x25_coverage(t: Tables):
    """Every character of a document is in one of its passages, and none is longer than 1200 characters."""
    return _covered(G.cut_bids(_paged(t), "doc_id", "text"), t, (F.length("text") <= G.MOST_CHARS) & ~F.col("text").contains("\f"))


TOKENS = f"regexp_extract_all({PLAIN}, '([a-z0-9_%]+)', 1)"
FIGURE = "(regexp_matches({0}, '[0-9]') OR {0} = '%' OR list_contains({1}, {0}))"


def _has(words, x: str = "x") -> str:
    return f"list_contains({list(words)}, {x})"


@query(
    "X15_signatures",
    f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents) SELECT doc_id, md5(array_to_string([w[i] || ' ' || coalesce(w[i + 1], '') FOR i IN range(1, len(w) + 1) IF {FIGURE.format('w[i]', list(C.NUMBER_WORDS))}], '|')) AS figures,
md5(array_to_string([x FOR x IN w IF {_has(C.CONJUNCTIONS)}], ' ')) AS conjunctions, md5(array_to_string([x FOR x IN w IF {_has(C.SENSE_WORDS)}], ' ')) AS senses, md5(array_to_string([x FOR x IN w IF {_has(C.MODAL_WORDS)}], ' ')) AS modals FROM w""",
)
def x15(t: Tables):
    """What two statements of one condition have to share: figures with their units, conjunctions, negations, modals."""
    s = C.signature(F.regexp_extract_all(X.plain(F.col("text")), F.lit("([a-z0-9_%]+)"), 1))
    rows = t.documents.select("doc_id", s.alias("s"))
    return rows.select("doc_id", *[F.md5(F.array_join(f"s.{k}", "|" if k == "figures" else " ")).alias(k) for k in ("figures", "conjunctions", "senses", "modals")])


SHEET = "concat(CASE WHEN c_custkey % 2 = 0 THEN 'Consulta REPSAL: sin sanciones. ' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN 'Deuda: no registra deuda. ' ELSE '' END, CASE WHEN c_custkey % 5 > 0 THEN 'Resultado: habilitado. ' ELSE '' END, CASE WHEN c_custkey % 7 > 0 THEN 'Fecha de emisión: 1/2/2024' ELSE '' END)"


@query("X33_marks", "SELECT c_custkey, CAST(c_custkey % 2 = 0 AS INTEGER) + CAST(c_custkey % 3 = 0 AS INTEGER) AS marks, c_custkey % 6 = 0 AND c_custkey % 7 > 0 AS suggested FROM customer")
def x33(t: Tables):
    """Whether a text is the sheet of an external check: two of its marks, a result and an issuer."""
    text = F.expr(SHEET)
    return t.customer.select("c_custkey", C.compliance_marks(text).alias("marks"), C.compliance_sheet(text).alias("suggested"))


ACTS = "CASE c_custkey % 6 WHEN 0 THEN 'El oferente deberá presentar' WHEN 1 THEN 'Debe decir: otra cosa' WHEN 2 THEN 'Queda sin efecto el punto 3' WHEN 3 THEN 'Será causal de desestimación' WHEN 4 THEN 'Es obligatoria la visita' ELSE 'Sin novedad' END"


@query("X35_markers", "SELECT c_custkey, c_custkey % 6 IN (0, 4) AS obligation, c_custkey % 6 = 2 AS suppression, c_custkey % 6 = 3 AS consequence FROM customer")
def x35(t: Tables):
    text = F.expr(ACTS)
    return t.customer.select("c_custkey", C.obligation(text).alias("obligation"), C.suppression(text).alias("suppression"), C.consequence(text).alias("consequence"))


ASKS = "CASE c_custkey % 6 WHEN 0 THEN '¿Puede el oferente aclarar el plazo?' WHEN 1 THEN '¿El oferente presentó la garantía?' WHEN 2 THEN 'Se solicita la constancia.' WHEN 3 THEN '¿La Comisión confirma el monto?' WHEN 4 THEN 'Según «el oferente deberá…», ¿consta la firma?' ELSE 'Aclare el domicilio' END"


@query("X37_question_forms", "SELECT c_custkey, c_custkey % 6 IN (0, 2, 5) AS to_offeror FROM customer")
def x37(t: Tables):
    """Whether a question is put to the bidder instead of the committee; what it quotes doesn't count."""
    return t.customer.select("c_custkey", C.asks_the_offeror(F.expr(ASKS)).alias("to_offeror"))


FILES = "CASE p_partkey % 6 WHEN 0 THEN 'Oferta_Economica.pdf' WHEN 1 THEN 'scan-01.pdf' WHEN 2 THEN 'POLIZA-caucion.pdf' WHEN 3 THEN 'espec1f-prod.pdf' WHEN 4 THEN 'x.pdf' ELSE 'nada.pdf' END"
HEADS = "CASE p_partkey % 6 WHEN 1 THEN 'Planilla de precios del renglón' WHEN 4 THEN 'FICHA TÉCNICA del producto' ELSE 'texto' END"


@query("X32_document_kinds", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'economic' WHEN 1 THEN 'economic' WHEN 2 THEN 'guarantee' WHEN 3 THEN 'technical' WHEN 4 THEN 'technical' ELSE '' END AS kind FROM part")
def x32(t: Tables):
    """The kind of a document by its name, else by how its text begins."""
    return t.part.select("p_partkey", C.document_kind(F.expr(FILES), F.expr(HEADS)).alias("kind"))


HEAD_LINE = "CASE o_orderkey % 4 WHEN 0 THEN concat('Disposición ONC N° ', o_custkey, '/', year(o_orderdate)) WHEN 1 THEN concat('RESOLUCIÓN GENERAL ', o_custkey, '/98') WHEN 2 THEN concat('rige: entrará en vigencia a partir del ', day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate)) ELSE 'Apruébase el “RÉGIMEN X”' END"


@query(
    "G31_header_fields",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Disposición' WHEN 1 THEN 'Resolución General' END AS norm_type, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey AS VARCHAR) END AS number, CAST(CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 1998 END AS INTEGER) AS year, CASE WHEN o_orderkey % 4 = 2 THEN CAST(o_orderdate AS DATE) END AS effective_from, CASE WHEN o_orderkey % 4 = 3 THEN 'RÉGIMEN X' END AS title FROM orders",
)
def g31(t: Tables):
    """What the lines of a header propose: type, number, year, date of effect, title."""
    return t.orders.select("o_orderkey", C.header_fields(F.expr(HEAD_LINE)).alias("h")).select("o_orderkey", "h.*")
