"""The language of searches over documents and over questions built from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search as S
from ..functions import text as X
from ..operators import postings as I
from .registry import Tables, query
from .text import PLAIN, UNACC

# -- stems in SQL: the same published algorithm as S.stem, written with regular expressions -----------------------------------

NORMAL = rf"lower(regexp_replace({UNACC}, '([au])cion([^\p{{L}}\p{{N}}_]|$)', '\1ción\2', 'gi'))"
STOP = "(" + ", ".join(f"'{w}'" for w in sorted(S.STOP_WORDS)) + ")"
VOWEL, OTHER = f"[{S.VOWELS}]", f"[^{S.VOWELS}]"


def _ending(text: str, endings: list[str]) -> str:
    return f"regexp_extract({text}, '({'|'.join(endings)})$')"


def _drop(text: str, *endings: str) -> str:
    """The text without the first of the endings that it has in R2."""
    return "CASE " + " ".join(f"WHEN {text} LIKE '%{e}' AND length({text}) - {len(e)} >= r2 THEN left({text}, length({text}) - {len(e)})" for e in endings) + f" ELSE {text} END"


def _one_of(endings: list[str]) -> str:
    return "s1 IN (" + ", ".join(f"'{e}'" for e in endings) + ")"


def stems_sql(words: str) -> str:
    """Common table expressions that end in stems (word, stem) of the distinct words of a table with a column word."""
    match = lambda text, pattern, otherwise: f"coalesce(nullif(length(regexp_extract({text}, '{pattern}')), 0), {otherwise})"
    kinds = S.STANDARD
    every = [e for own in kinds.values() for e in own]
    return f"""
z0 AS (SELECT DISTINCT word, length(word) AS n FROM {words} WHERE word NOT IN {STOP}),
z1 AS (SELECT *, {match('word', f'^.*?{VOWEL}{OTHER}', 'n')} AS r1, CASE WHEN n <= 2 THEN n WHEN NOT regexp_matches(substr(word, 2, 1), '{VOWEL}') THEN {match('word', f'^..{OTHER}*{VOWEL}', 'n')}
  WHEN regexp_matches(left(word, 1), '{VOWEL}') THEN {match('word', f'^..{VOWEL}*{OTHER}', 'n')} ELSE 3 END AS rv FROM z0),
z2 AS (SELECT *, r1 + {match('substr(word, r1 + 1)', f'^.*?{VOWEL}{OTHER}', 'n - r1')} AS r2, {_ending('word', S.PRONOUNS)} AS p FROM z1),
z3 AS (SELECT *, left(word, n - length(p)) AS body FROM z2),
z4 AS (SELECT *, {_ending('body', S.BEFORE_PRONOUN)} AS b FROM z3),
z5 AS (SELECT word, rv, r1, r2, CASE WHEN p = '' OR length(body) < rv THEN word WHEN b <> '' AND length(body) - length(b) >= rv
  THEN left(body, length(body) - length(b)) || CASE WHEN regexp_matches(b, '^[aeiou]') THEN b ELSE translate(b, 'áéíóú', 'aeiou') END WHEN body LIKE '%uyendo' AND length(body) - 5 >= rv THEN body ELSE word END AS w FROM z4),
z6 AS (SELECT *, {_ending('w', every)} AS s1 FROM z5),
z7 AS (SELECT *, left(w, length(w) - length(s1)) AS c, s1 <> '' AND length(w) - length(s1) >= CASE WHEN s1 = 'amente' THEN r1 ELSE r2 END AS cut FROM z6),
z8 AS (SELECT word, rv, cut, CASE WHEN NOT cut THEN w WHEN {_one_of(kinds['delete'])} THEN c WHEN {_one_of(kinds['ic'])} THEN {_drop('c', 'ic')} WHEN {_one_of(kinds['log'])} THEN c || 'log' WHEN {_one_of(kinds['u'])} THEN c || 'u'
  WHEN {_one_of(kinds['ente'])} THEN c || 'ente' WHEN s1 = 'amente' THEN CASE WHEN c LIKE '%iv' AND length(c) - 2 >= r2 THEN {_drop('left(c, length(c) - 2)', 'at')} ELSE {_drop('c', 'os', 'ic', 'ad')} END
  WHEN s1 = 'mente' THEN {_drop('c', 'ante', 'able', 'ible')} WHEN {_one_of(kinds['abil'])} THEN {_drop('c', 'abil', 'ic', 'iv')} ELSE {_drop('c', 'at')} END AS w FROM z7),
z9 AS (SELECT *, {_ending('substr(w, rv + 1)', S.Y_VERBS)} AS y, {_ending('substr(w, rv + 1)', [*S.VERBS, *S.VERBS_GU])} AS v FROM z8),
z10 AS (SELECT word, rv, CASE WHEN cut THEN w WHEN y <> '' AND left(w, length(w) - length(y)) LIKE '%u' THEN left(w, length(w) - length(y))
  WHEN v IN ({', '.join(f"'{x}'" for x in S.VERBS_GU)}) AND left(w, length(w) - length(v)) LIKE '%gu' THEN left(w, length(w) - length(v) - 1) ELSE left(w, length(w) - length(v)) END AS w FROM z9),
z11 AS (SELECT *, {_ending('substr(w, rv + 1)', S.RESIDUAL)} AS s3, left(w, length(w) - 1) AS e FROM z10),
stems AS (SELECT word, translate(CASE WHEN s3 <> '' THEN left(w, length(w) - length(s3)) WHEN NOT regexp_matches(substr(w, rv + 1), '[eé]$') THEN w WHEN e LIKE '%gu' AND length(e) - 1 >= rv THEN left(e, length(e) - 1) ELSE e END, 'áéíóú', 'aeiou') AS stem FROM z11)"""


WORDS_AT = f"SELECT {{id}}, unnest(regexp_extract_all({NORMAL}, '{S.WORD}', 1)) AS word, generate_subscripts(regexp_extract_all({NORMAL}, '{S.WORD}', 1), 1) AS pos FROM {{table}}"
LEXEMES = f"words AS ({WORDS_AT.replace('{id}', 'doc_id').replace('{table}', 'documents')})"


@query(
    "X2_lexemes",
    f"""WITH {LEXEMES}, {stems_sql('words')}, l AS (SELECT doc_id, stem, pos FROM words JOIN stems USING (word))
SELECT doc_id, count(stem) AS n, count(DISTINCT stem) AS "distinct", md5(coalesce(string_agg(stem, ' ' ORDER BY pos), '')) AS digest FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1""",
)
def x2(t: Tables):
    """The stems of each document: how many, how many distinct, and a digest of them in order."""
    rows = t.documents.select("doc_id", S.lexemes(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n"), F.size(F.array_distinct("l")).alias("distinct"), F.md5(F.array_join("l", " ")).alias("digest"))


@query(
    "K1_search_functions",
    f"""WITH {LEXEMES}, {stems_sql('words')}, l AS (SELECT doc_id, count(DISTINCT stem) AS stems, CAST(sum(pos) AS BIGINT) AS places FROM words JOIN stems USING (word) GROUP BY 1)
SELECT doc_id, md5({NORMAL}) AS digest, coalesce(stems, 0) AS stems, coalesce(places, 0) AS places FROM documents LEFT JOIN l USING (doc_id)""",
)
def k1(t: Tables):
    """The three search functions as SQL functions of the session: the normal form, and a document's stems with their places."""
    S.register_functions(t.spark)
    sql = "WITH d AS (SELECT doc_id, search_normalize(text) AS form, search_document(text) AS stems FROM {documents})"
    sql += " SELECT doc_id, md5(lower(form)) AS digest, size(stems) AS stems, aggregate(flatten(map_values(stems)), 0L, (a, x) -> a + x) AS places FROM d"
    return t.spark.sql(sql, documents=t.documents)


ITEM_WORDS = f"[w FOR w IN regexp_extract_all({NORMAL}, '{S.WORD}', 1) IF w <> 'or']"
POSTED = f"words AS (SELECT *, 0 AS item FROM ({WORDS_AT.replace('{id}', 'doc_id').replace('{table}', 'documents')})), own AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark), every AS (SELECT word FROM words UNION ALL SELECT unnest(w) FROM own), {stems_sql('every')}, posts AS (SELECT doc_id, stem, pos FROM words JOIN stems USING (word))"


def _asked(clauses: list[tuple[int, int, bool, list[int]]]) -> str:
    """SQL of the queries of the benchmark items: alternative, clause, is it excluded, and which of an item's words it has in order."""
    rows = ", ".join(f"({a}, {c}, {str(no).lower()}, {i}, {n})" for a, c, no, own in clauses for i, n in enumerate(own))
    return f"""t AS (SELECT item_id, a, c, x, i, stem FROM own, (VALUES {rows}) AS v(a, c, x, i, n) JOIN stems ON stems.word = own.w[n]),
need AS (SELECT item_id, a, c, x, count(*) AS n FROM t GROUP BY ALL),
hit AS (SELECT DISTINCT item_id, doc_id, a, c, x FROM (SELECT item_id, doc_id, a, c, x, pos - i AS s, count(DISTINCT i) AS n FROM t JOIN posts USING (stem) GROUP BY ALL) JOIN need USING (item_id, a, c, x, n)),
found AS (SELECT DISTINCT h.item_id, h.doc_id FROM (SELECT item_id, doc_id, a, count(*) FILTER (NOT x) AS n, count(*) FILTER (x) AS bad FROM hit GROUP BY ALL) h JOIN (SELECT item_id, a, count(*) FILTER (NOT x) AS n FROM need GROUP BY ALL) USING (item_id, a, n) WHERE bad = 0)"""


def _item_queries(t: Tables, *parts):
    """A web-style query of each benchmark item from its words; a number stands for that word, or stays out."""
    words = F.filter(I.words_of(F.col("text")), lambda w: w != "or")
    pick = lambda n: F.coalesce(F.try_element_at("w", F.lit(n)), F.lit(""))
    return t.benchmark.select("item_id", words.alias("w")).select("item_id", F.concat(*[pick(p) if isinstance(p, int) else F.lit(p) for p in parts]).alias("text"))


@query(
    "X3_web_search",
    f"WITH {POSTED}, {_asked([(0, 0, False, [1]), (0, 1, False, [2, 3]), (1, 0, False, [4]), (1, 1, False, [5]), (1, 2, True, [6])])} SELECT item_id, doc_id FROM found",
)
def x3(t: Tables):
    """Documents that answer each item's web-style query, by their stems: alternatives, a phrase and an exclusion."""
    asked = I.asked_terms(_item_queries(t, 1, ' "', 2, " ", 3, '" or ', 4, " ", 5, " -", 6), "item_id", "text")
    return I.answers(I.text_index(t.documents, "doc_id", "text", asked), asked).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("U7_any_variant", f"WITH {POSTED}, {_asked([(0, 0, False, [1]), (0, 1, False, [2]), (1, 0, False, [3, 4, 5]), (2, 0, False, [6])])} SELECT item_id, doc_id FROM found")
def u7(t: Tables):
    """Documents that any of several queries of an item finds: the queries' alternatives as one."""
    variants = [_item_queries(t, *parts) for parts in ((1, " ", 2), ('"', 3, " ", 4, " ", 5, '"'), (6,))]
    asked = [I.asked_terms(q, "item_id", "text").withColumn("alternative", F.col("alternative") * 3 + i) for i, q in enumerate(variants)]
    every = asked[0].unionByName(asked[1]).unionByName(asked[2])
    found = I.answers(I.text_index(t.documents, "doc_id", "text", every), every)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("A1_matching_units", f"WITH {POSTED}, {_asked([(0, 0, False, [7]), (1, 0, False, [8, 9])])} SELECT DISTINCT item_id, source, lang FROM found JOIN documents USING (doc_id)")
def a1(t: Tables):
    """The distinct units of the passages that each item's query finds."""
    asked = I.asked_terms(_item_queries(t, 7, ' or "', 8, " ", 9, '"'), "item_id", "text")
    found = I.answers(I.text_index(t.documents, "doc_id", "text", asked), asked)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id")).join(t.documents.select("doc_id", "source", "lang"), "doc_id").select("item_id", "source", "lang").distinct()


QUESTION = "concat(c_name, ' or ', c_mktsegment, ' y ', c_name, CASE WHEN c_custkey % 2 = 0 THEN ' según la afip' ELSE '' END)"


@query(
    "X4_or_query",
    f"""WITH q AS (SELECT c_custkey, regexp_extract_all({QUESTION}, '([\\p{{L}}\\p{{N}}_]+(?:/[\\p{{L}}\\p{{N}}_]+)*)', 1) AS w FROM customer), u AS (SELECT c_custkey, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
d AS (SELECT c_custkey, w, min(i) AS i FROM u WHERE lower(w) <> 'or' GROUP BY 1, 2)
SELECT c_custkey, string_agg(w, ' or ' ORDER BY i) || CASE WHEN c_custkey % 2 = 0 THEN ' or AFIP or ARCA or "Administración Federal de Ingresos Públicos" or "Agencia de Recaudación y Control Aduanero"' ELSE '' END AS asked FROM d GROUP BY 1""",
)
def x4(t: Tables):
    return t.customer.select("c_custkey", S.or_query(F.expr(QUESTION)).alias("asked"))


NAMED = "CASE c_custkey % 3 WHEN 0 THEN concat('Norma de la AFIP ', c_custkey) WHEN 1 THEN concat('Ante la administracion  federal de ingresos publicos, ', c_name) ELSE concat('AFIPA ', c_name) END"


@query(
    "X5_issuer_variants",
    r"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN array_to_string(['Norma de la AFIP ' || c_custkey, 'Norma de la ARCA ' || c_custkey, 'Norma de la Administración Federal de Ingresos Públicos ' || c_custkey, 'Norma de la Agencia de Recaudación y Control Aduanero ' || c_custkey], '|')
WHEN 1 THEN array_to_string(['Ante la administracion  federal de ingresos publicos, ' || c_name, 'Ante la AFIP, ' || c_name, 'Ante la ARCA, ' || c_name, 'Ante la Administración Federal de Ingresos Públicos, ' || c_name, 'Ante la Agencia de Recaudación y Control Aduanero, ' || c_name], '|')
ELSE 'AFIPA ' || c_name END AS variants FROM customer""",
)
def x5(t: Tables):
    return t.customer.select("c_custkey", F.array_join(S.issuer_variants(F.expr(NAMED)), "|").alias("variants"))


@query("X6_identity", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'afip' WHEN 1 THEN 'afip' WHEN 2 THEN 'disposicion año ' || lower(c_name) ELSE 'afip - dgi' END AS form FROM customer")
def x6(t: Tables):
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' ARCA ' WHEN 1 THEN 'Agencia de Recaudación  y Control Aduanero' WHEN 2 THEN concat(' DISPOSICIÓN  año ', c_name) ELSE 'AFIP - DGI' END")
    return t.customer.select("c_custkey", S.identity(text).alias("form"))


ASKED = "concat('¿El artículo ', o_custkey % 90 + 1, CASE WHEN o_orderkey % 3 = 0 THEN ' bis' ELSE '' END, ' de la Disposición 13.', lpad(o_custkey % 1000, 3, '0'), '/', CASE WHEN o_orderkey % 2 = 0 THEN '47' ELSE '2022' END, ' rige al 15/03/2021 según art. 7 y el 247/2022?')"
ASKED_DUCK = ASKED.replace("lpad(o_custkey % 1000,", "lpad(CAST(o_custkey % 1000 AS VARCHAR),")


@query(
    "X8_references",
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct([CAST(o_custkey % 90 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' bis' ELSE '' END, '7'])), ',') AS articles,
array_to_string(list_sort(list_distinct(['13' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '/47' ELSE '/2022' END, '247/2022'])), ',') AS norms FROM orders""",
)
def x8(t: Tables):
    """Articles and norms that a question names; dates are no norms."""
    text = F.expr(ASKED.replace("lpad(o_custkey % 1000,", "lpad(CAST(o_custkey % 1000 AS STRING),"))
    return t.orders.select("o_orderkey", F.array_join(S.article_references(text), ",").alias("articles"), F.array_join(S.norm_references(text), ",").alias("norms"))


@query("X9_folded", rf"SELECT doc_id, md5(trim(regexp_replace(replace({PLAIN}, 'ß', 'ss'), '\s+', ' ', 'g'))) AS digest FROM documents")
def x9(t: Tables):
    return t.documents.select("doc_id", F.md5(X.folded(F.col("text"))).alias("digest"))


TENS = "['treinta', 'cuarenta', 'cincuenta', 'sesenta', 'setenta', 'ochenta', 'noventa']"
ONES = "['uno', 'dos', 'tres', 'cuatro', 'cinco', 'seis', 'siete', 'ocho', 'nueve']"
HUNDREDS = "['doscientos', 'trescientos', 'cuatrocientos', 'quinientos', 'seiscientos', 'setecientos', 'ochocientos', 'novecientos']"


def _spelt(column: str) -> str:
    """SQL for both engines: a number below a million in words, from the digits of a column."""
    pick = lambda words, i: f"element_at(array({words[1:-1]}), CAST({i} AS INT))"
    return f"concat('plazo de ', {pick(ONES, f'{column} % 8 + 2')}, ' mil ', {pick(HUNDREDS, f'{column} % 8 + 1')}, ' ', {pick(TENS, f'{column} % 7 + 1')}, ' y ', {pick(ONES, f'{column} % 9 + 1')}, ' días, cinco por ciento, dos tres')"


@query("X10_figures", "SELECT p_partkey, 'plazo de ' || CAST((p_partkey % 8 + 2) * 1000 + (p_partkey % 8 + 2) * 100 + (p_partkey % 7 + 3) * 10 + p_partkey % 9 + 1 AS VARCHAR) || ' dias, 5 por ciento, 2 3' AS text FROM part")
def x10(t: Tables):
    """Numbers in words as figures."""
    return t.part.select("p_partkey", S._figures(X.folded(F.expr(_spelt("p_partkey")))).alias("text"))


@query("X11_compared_answers", "SELECT p_partkey, 'garantia del 5 % o 60 dias, ' || CAST(p_size * 1000000 + 500 AS VARCHAR) || ' pesos y ' || p_size || ',5 %; 7 por mil, 1 vez' AS text FROM part")
def x11(t: Tables):
    """Answers in the form in which they are searched."""
    text = F.expr("concat('Garantía del cinco por  ciento (5%) o sesenta (60) días, ', p_size, '.000.500 pesos y ', p_size, ',5%; siete por mil, una vez')")
    return t.part.select("p_partkey", S.compared_answer(text).alias("text"))


SAID = "concat('Sí: la garantía y las pólizas de ', p_size, ' días; luces, 0,1 % y 21.000 pesos')"


@query("X12_phrases", "SELECT p_partkey, true AS plural, true AS spelt, false AS part_of_figure, p_size = 7 AS figure FROM part")
def x12(t: Tables):
    """Phrases found in the singular or the plural, but not within a larger figure."""
    text = X.folded(F.expr(SAID))
    has = lambda p: text.rlike(S.phrase_pattern(p))
    return t.part.select("p_partkey", has("poliza").alias("plural"), has("luz").alias("spelt"), has("1 %").alias("part_of_figure"), has("7 dias").alias("figure"))


@query("X13_missing_data", "SELECT p_partkey, CASE p_size WHEN 7 THEN '1,3' WHEN 30 THEN '1,2' ELSE '1,2,3' END AS missing FROM part")
def x13(t: Tables):
    """Key data of which no variant is in the answer."""
    data = [["si"], ["no"], ["7 dias", "siete dias"], ["30 dias", "1 %"], ["garantias", "caucion"]]
    answers = t.part.select("p_partkey", F.expr(SAID).alias("said"))
    # an answer that many give is read once
    read = answers.select(F.col("said").alias("text")).distinct()
    read = read.select("text", F.array_join(S.missing_data(X.folded(F.col("text")), S.compared_answer(F.col("text")), data), ",").alias("missing"))
    return answers.join(read, F.col("said").eqNullSafe(F.col("text")), "left").select("p_partkey", "missing")


@query("P4_folded_numbers", "SELECT p_partkey FROM part WHERE lower(trim(' ' || upper(p_brand) || ' ')) = 'brand#2'")
def p4(t: Tables):
    """Numbers compared without capitals or outer space."""
    shown = F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  "))
    return t.part.where(F.lower(F.trim(F.regexp_replace(shown, r"\s+", " "))) == "brand#2").select("p_partkey")


@query("P5_member_of", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p5(t: Tables):
    """Membership in a short list and in a list that is a table."""
    own = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(own, "o_custkey", "left_semi").select("o_orderkey")


@query("P6_named_norms", "SELECT o_orderkey, year(o_orderdate) % 2 = 0 AS four_digits FROM orders WHERE CASE WHEN year(o_orderdate) % 2 = 0 THEN year(o_orderdate) = 1998 ELSE year(o_orderdate) % 100 = 97 END AND o_orderkey % 10 = 3")
def p6(t: Tables):
    """Norms that a reference names by number and by a year of four or of two digits."""
    year = F.year("o_orderdate")
    number = F.concat(F.lit("1."), F.lpad((F.col("o_orderkey") % 10).cast("string"), 3, "0"))
    even = year % 2 == 0
    return t.orders.where(S.names_norm(number, year, F.when(even, "1003/1998").otherwise("1003/97"))).select("o_orderkey", even.alias("four_digits"))


@query("P7_optional_parameter", "SELECT o_orderkey, 'one' AS asked FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey, 'all' FROM orders WHERE o_orderpriority LIKE '1%'")
def p7(t: Tables):
    """One parameterised query, with the parameter and without."""
    sql = "SELECT o_orderkey, :name AS asked FROM {orders} WHERE (:customer IS NULL OR o_custkey = :customer) AND (:customer IS NOT NULL OR o_orderpriority LIKE '1%')"
    ask = lambda name, customer: t.spark.sql(sql, args={"name": name, "customer": customer}, orders=t.orders)
    return ask("one", 7).unionByName(ask("all", None))


@query("T3_reference_path", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (2, 3) AND o_custkey % 10 = 7")
def t3(t: Tables):
    """Everything that a reference names, in the order of its document; no limit."""
    own = t.orders.where("o_custkey % 10 = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.where("l_linenumber IN (2, 3)").join(own, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("T4_reranked", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY greatest(value, CASE WHEN event_id % 4 = 0 THEN value * 1.5 ELSE 0 END) DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 8")
def t4(t: Tables):
    """Candidates by the better of two scores, equal ones in order of arrival; the first eight of each question."""
    from ..operators.retrieval import best_of_each

    score = F.greatest(F.col("value"), F.when(F.col("event_id") % 4 == 0, F.col("value") * 1.5).otherwise(0.0))
    return best_of_each(t.events.select("user_id", "event_id", score.alias("s")), "user_id", [F.desc("s"), F.col("event_id")], 8).select("user_id", "event_id", "place")


CATEGORY = "CASE p_brand WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 3 END"


@query("T6_category_order", f"SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size > 40, {CATEGORY}, p_partkey) AS place FROM part")
def t6(t: Tables):
    """Units by category, in a set order of categories, recitals last."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("p_type").orderBy(F.col("p_size") > 40, F.expr(CATEGORY), "p_partkey")
    return t.part.select("p_type", "p_partkey", F.row_number().over(order).cast("bigint").alias("place"))


@query("T8_latest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def t8(t: Tables):
    """The latest 25."""
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(25).select("o_orderkey")


@query("T10_links", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_custkey % 5 = 0 OR o_orderkey % 7 = 0")
def t10(t: Tables):
    """The links of some norms, seen from either end, by date."""
    return t.orders.where("o_custkey % 5 = 0 OR o_orderkey % 7 = 0").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day")).orderBy("day", "o_orderkey")


@query("M7_cosine", "SELECT a.vec_id, round(1 - list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) + 0.0 AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m7(t: Tables):
    """The cosine distance of each vector to the next one, as a column expression."""
    from ..operators.retrieval import cosine_distance

    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(after, "vec_id").select("vec_id", (F.round(cosine_distance(F.col("embedding"), F.col("other")), 6) + 0.0).alias("distance"))
