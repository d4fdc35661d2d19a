"""Text normalisation, shingles, similarity, spans and chunks over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines as N
from ..operators import matching as M
from ..operators import selection as L
from ..operators import spans as P
from ..operators import statements as T
from .registry import Tables, query

FOLD = f"translate({{}}, '{X.ACCENTED}', '{X.PLAIN}')"
UNACC = FOLD.format("text")
PLAIN = f"translate({FOLD.format('lower(text)')}, 'ñ', 'n')"
WS = r"string_split_regex(text, '\s+')"


@query("X1_normalized", rf"SELECT doc_id, md5(regexp_replace({UNACC}, '([au])cion([^\p{{L}}\p{{N}}_]|$)', '\1ción\2', 'gi')) AS digest FROM documents")
def x1(t: Tables):
    return t.documents.select("doc_id", F.md5(X.search_normalized(F.col("text"))).alias("digest"))


@query("X7_plain", f"SELECT doc_id, md5({PLAIN}) AS digest FROM documents")
def x7(t: Tables):
    return t.documents.select("doc_id", F.md5(X.plain(F.col("text"))).alias("digest"))


COMPARED = rf"regexp_replace({PLAIN}, '^\s*\(?[a-z0-9]{{1,3}}\)\s+', '')"
for _sign, _word in X.SIGNS.items():
    COMPARED = rf"regexp_replace({COMPARED}, '(^|[^\p{{L}}\p{{N}}_]){_sign}([0-9])', '\1{_word}_\2', 'g')"
COMPARED = rf"trim(regexp_replace(regexp_replace({COMPARED}, '[^\p{{L}}\p{{N}}_%]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("X14_compared", f"SELECT doc_id, md5({COMPARED}) AS digest FROM documents")
def x14(t: Tables):
    return t.documents.select("doc_id", F.md5(X.compared(F.col("text"))).alias("digest"))


@query(
    "X17_unified",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
c AS (SELECT doc_id, line, length(text) > 400 AS wide, {COMPARED} AS c FROM l WHERE trim(text) <> ''),
k AS (SELECT doc_id, line, wide, CASE WHEN wide OR c = '' THEN line ELSE min(line) FILTER (NOT wide) OVER (PARTITION BY doc_id, c) END AS kept FROM c)
SELECT doc_id, CAST(kept AS INTEGER) AS kept, count(*) AS n FROM k GROUP BY 1, 2""",
)
def x17(t: Tables):
    """Lines of a document that say the same go to the first of them; wide ones stay by themselves."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "").withColumn("line", F.col("line") + 1)
    out = N.unified(lines, "doc_id", "line", X.compared(F.col("text")), F.length("text") > 400)
    return out.groupBy("doc_id", "kept").agg(F.count("*").alias("n"))


@query("X17_similar")
def x17_similar(t: Tables):
    """Sentences of a document that say the same in other words (four fifths of the words in matching runs, or one contained in the other) go to the first of them, however long they are."""
    pieces = F.posexplode(F.split("text", r"[.\n]")).alias("place", "text")
    rows = t.documents.select("doc_id", pieces).where(F.trim("text") != "")
    out = T.unified_like(rows, "doc_id", "place", X.compared(F.col("text")), F.lit(False), share=0.8, containment=True)
    return out.groupBy("doc_id", "kept").agg(F.count("*").alias("n"))


@query("X34_stems", rf"SELECT doc_id, array_to_string(list_sort(list_distinct([left(w, 5) FOR w IN regexp_extract_all({PLAIN}, '([a-z]+)', 1) IF length(w) >= 6])), ' ') AS stems FROM documents")
def x34(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.stems(F.col("text")), " ").alias("stems"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


PIECES = r"""pieces AS (SELECT split_part(url, '/', 3) AS host, page_id, trim(regexp_replace(unnest(regexp_extract_all(html, '>([^<>]+)<', 1)), '\s+', ' ', 'g')) AS line FROM pages)"""


@query(
    "A21_boilerplate",
    rf"""WITH {PIECES}, k AS (SELECT split_part(url, '/', 3) AS host, count(DISTINCT page_id) AS pages FROM pages GROUP BY 1),
f AS (SELECT host, regexp_replace(line, '\d+', '#', 'g') AS form, count(DISTINCT page_id) AS n FROM pieces WHERE line <> '' GROUP BY 1, 2)
SELECT host, form, n, pages FROM f JOIN k USING (host) WHERE n >= 2 AND 2 * n > pages""",
)
def a21(t: Tables):
    """Lines, digits apart, that stand on more than half of a host's pages, and on two at least."""
    host = F.split_part("url", F.lit("/"), F.lit(3)).alias("host")
    pieces = t.pages.select(host, "page_id", F.explode(F.regexp_extract_all("html", F.lit(">([^<>]+)<"), 1)).alias("piece"))
    lines = pieces.select("host", "page_id", X.collapsed(F.col("piece")).alias("line")).where("line <> ''")
    return N.boilerplate(lines, "host", "page_id", X.digitless(F.col("line")), t.pages.select(host, "page_id"))


SHINGLES = rf"""
w AS (SELECT doc_id, [x FOR x IN {WS} IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 20 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) ELSE [] END AS s FROM w)
"""


@query("R1_shingles", f"WITH {SHINGLES} SELECT doc_id, CAST(len(s) AS INTEGER) AS n FROM s")
def r1(t: Tables):
    return t.documents.select("doc_id", F.size(X.shingles(F.col("text"))).alias("n"))


@query(
    "U2_jaccard",
    f"""WITH {SHINGLES}, b AS (SELECT min(doc_id) AS doc_id, v FROM (SELECT doc_id, list_sort(s) AS v FROM s WHERE len(s) > 0) GROUP BY v), e AS (SELECT doc_id, len(v) AS n, unnest(v) AS g FROM b), r AS (SELECT doc_id, n, dense_rank() OVER (ORDER BY g) AS g FROM e),
x AS (SELECT a.doc_id AS doc_id, b.doc_id AS other, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_id, other, round(common / (na + nb - common), 6) AS jaccard FROM x WHERE 10 * common >= 9 * (na + nb - common)""",
)
def u2(t: Tables):
    """Pairs of documents with nine tenths of their shingles in common; of documents with equal sets, the first stands for all."""
    return M.similar_sets(t.documents.select("doc_id", "text"), "doc_id", X.shingles(F.col("text")), X.COPY_SHARE)


def _eight(table: str, *ids: str) -> str:
    """SQL of the distinct windows of eight words; the word list is bound once a row."""
    keys = "".join(f"{i}, " for i in ids)
    words = f"(SELECT {keys}[x FOR x IN string_split_regex(lower(text), '\\s+') IF x <> ''] AS w FROM {table})"
    return f"SELECT DISTINCT {keys}array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {keys}w, unnest(range(1, len(w) - 6)) AS i FROM {words} WHERE len(w) >= 8)"


@query(
    "U4_leaks",
    f"""WITH p AS MATERIALIZED ({_eight('benchmark')}), d AS ({_eight('documents', 'doc_id')})
SELECT doc_id, count(*) AS windows FROM d WHERE g IN (SELECT g FROM p) GROUP BY 1""",
)
def u4(t: Tables):
    """How many windows of eight words of each document stand in a benchmark passage too.

    The passages' windows are met by hash, and by text where that is equal; only windows that are found are grouped.
    """
    windows = lambda d, *c: d.select(*c, F.explode(X.shingles(F.lower("text"), 8, 8)).alias("g")).withColumn("h", F.xxhash64("g"))
    found = windows(t.documents, "doc_id").join(windows(t.benchmark).distinct(), ["h", "g"], "left_semi")
    return found.distinct().groupBy("doc_id").agg(F.count("*").alias("windows"))


@query("X30_nth_anchor", "SELECT doc_id, CASE WHEN len(p) > 3 THEN length(array_to_string(p[1:3], '. ')) ELSE -1 END AS place FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)".replace("length(", "CAST(length(").replace("'. '))", "'. ')) AS INTEGER)"))
def x30(t: Tables):
    return t.documents.select("doc_id", X.nth_occurrence(F.col("text"), ". ", 3).alias("place"))


@query("P1_slice", "SELECT doc_id, substr(text, 11, 20) AS piece FROM documents")
def p1(t: Tables):
    return t.documents.select("doc_id", P.sliced("text", F.lit(10), F.lit(30)).alias("piece"))


@query("S5_unusable_share", rf"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\p{{L}}\p{{N}}\s.,;:()\-/%$°º''\"]', '', 'g')) / length(text) ELSE 0 END, 6) AS share FROM documents")
def s5(t: Tables):
    return t.documents.select("doc_id", F.round(X.unusable_share(F.col("text")), 6).alias("share"))


@query("R6_text_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def r6(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "A27_sizes",
    """WITH o AS (SELECT source, text, min(doc_id) AS doc_id, min(n_chars) AS n, count(*) AS copies FROM documents GROUP BY 1, 2), w AS (SELECT *, len([x FOR x IN string_split_regex(text, '\\s+') IF x <> '']) AS tokens FROM o),
g AS (SELECT source, list_reduce(list_concat([CAST(1000 AS BIGINT)], list(CAST(tokens AS BIGINT) ORDER BY doc_id)), lambda a, x: CASE WHEN a % 1000000 + x <= 1000 THEN a + x ELSE a - a % 1000000 + 1000000 + x END) // 1000000 AS groups FROM w GROUP BY 1)
SELECT source, CAST(sum(copies) AS BIGINT) AS documents, count(*) AS distinct, CAST(sum(ceil(n / 1800)) AS BIGINT) AS pages, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(any_value(groups) AS BIGINT) AS groups FROM w JOIN g USING (source) GROUP BY 1""",
)
def a27(t: Tables):
    """How large each source is: documents, distinct ones, and of these the pages, tokens and groups within a budget of tokens."""
    once = t.documents.groupBy("source", F.sha2("text", 256).alias("d")).agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n"), F.count("*").alias("copies"))
    sized = once.join(t.documents.select("doc_id", F.size(X.split_words(F.col("text"))).cast("bigint").alias("tokens")), "doc_id")
    packed = L.packed_groups(sized.select("source", "doc_id", "n", "copies", "tokens"), ["source"], ["doc_id"], "tokens", 1000)
    pages = F.ceil(F.col("n") / 1800)
    return packed.groupBy("source").agg(F.sum("copies").alias("documents"), F.count("*").alias("distinct"), F.sum(pages).alias("pages"), F.sum("tokens").alias("tokens"), F.max("part").alias("groups"))


SPANS = "SELECT l_orderkey AS k, l_linenumber AS id, CAST(l_partkey % 500 AS INTEGER) AS s, CAST(l_partkey % 500 + l_quantity * 2 AS INTEGER) AS e FROM lineitem"


def _spans(t: Tables):
    s = (F.col("l_partkey") % 500).cast("int")
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), s.alias("start"), (s + F.col("l_quantity") * 2).cast("int").alias("end"))


@query("G14_merged_spans", f"""WITH x AS ({SPANS}), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM n) SELECT k, min(s) AS "start", max(e) AS "end", count(*) AS parts FROM i GROUP BY k, i""")
def g14(t: Tables):
    return P.merged(_spans(t), ["k"], "start", "end")


@query("A24_coverage", f"""WITH x AS ({SPANS}), r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM x)
SELECT k, CASE WHEN s > reach THEN 'hole' ELSE 'overlap' END AS kind, least(s, reach) AS from_char, CASE WHEN s > reach THEN s ELSE least(e, reach) END AS to_char FROM r WHERE s <> reach""")
def a24(t: Tables):
    return P.coverage_faults(_spans(t), ["k"], "start", "end")


@query("J18_overlapping", f"""WITH x AS ({SPANS}), a AS (SELECT * FROM x WHERE id % 2 = 0), b AS (SELECT * FROM x WHERE id % 2 = 1)
SELECT DISTINCT a.k, a.id AS l_id, b.id AS r_id, least(a.e, b.e) - greatest(a.s, b.s) AS common FROM a JOIN b ON a.k = b.k WHERE least(a.e, b.e) > greatest(a.s, b.s) AND 2 * (least(a.e, b.e) - greatest(a.s, b.s)) >= a.e - a.s""")
def j18(t: Tables):
    s = _spans(t)
    return P.overlapping(s.where("id % 2 = 0"), s.where("id % 2 = 1"), "k", 64)


@query(
    "J19_greedy_pairs",
    f"""WITH RECURSIVE x AS ({SPANS}), a AS (SELECT * FROM x WHERE id % 2 = 0), b AS (SELECT * FROM x WHERE id % 2 = 1),
p AS (SELECT DISTINCT a.k, a.id AS l_id, b.id AS r_id, least(a.e, b.e) - greatest(a.s, b.s) AS common FROM a JOIN b ON a.k = b.k AND least(a.e, b.e) > greatest(a.s, b.s) AND 2 * (least(a.e, b.e) - greatest(a.s, b.s)) >= a.e - a.s),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY common DESC, l_id, r_id) AS rn FROM p),
g AS (SELECT k, 0 AS rn, CAST(NULL AS INTEGER) AS l_id, CAST(NULL AS INTEGER) AS r_id, 0 AS common, CAST([] AS INTEGER[]) AS ls, CAST([] AS INTEGER[]) AS rs, false AS kept FROM (SELECT DISTINCT k FROM p)
  UNION ALL SELECT o.k, o.rn, o.l_id, o.r_id, o.common, CASE WHEN list_contains(ls, o.l_id) OR list_contains(rs, o.r_id) THEN ls ELSE list_append(ls, o.l_id) END, CASE WHEN list_contains(ls, o.l_id) OR list_contains(rs, o.r_id) THEN rs ELSE list_append(rs, o.r_id) END,
  NOT (list_contains(ls, o.l_id) OR list_contains(rs, o.r_id)) FROM g JOIN o ON o.k = g.k AND o.rn = g.rn + 1)
SELECT k, l_id, r_id, common FROM g WHERE kept""",
)
def j19(t: Tables):
    s = _spans(t)
    return P.greedy_pairs(P.overlapping(s.where("id % 2 = 0"), s.where("id % 2 = 1"), "k", 64), "k")


@query(
    "A24_covered",
    f"""WITH x AS ({SPANS}), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM n), m AS (SELECT k, max(e) - min(s) AS c FROM i GROUP BY k, i), t AS (SELECT k, sum(e - s) AS given FROM x GROUP BY 1)
SELECT k, CAST(sum(c) AS BIGINT) AS covered, CAST(any_value(given) AS BIGINT) AS given FROM m JOIN t USING (k) GROUP BY 1""",
)
def a24_covered(t: Tables):
    """The characters that a document's spans cover, and those that they would if none overlapped."""
    s = _spans(t)
    covered = P.merged(s, ["k"], "start", "end").groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return covered.join(s.groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("given")), "k")
