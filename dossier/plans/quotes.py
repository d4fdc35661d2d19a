"""Quotes, sentences and shared runs over documents, benchmark passages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines as N
from ..operators import quotes as Q
from ..operators import spans as P
from .registry import Tables, query

TURNS = """t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
p AS (SELECT a.conv_id * 1000 + a.turn AS pair, a.text AS a, b.text AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
WORDS = "regexp_extract_all(lower({}), '([a-z0-9ß-öø-ÿ]+)', 1)"


def _turns(t: Tables):
    """A turn and the next one of each conversation: pair, a, b."""
    turns = t.conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return turns.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), F.col("text").alias("a"), "b")


def _words(c: str):
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9ß-öø-ÿ]+)"), 1)


NOISY = "regexp_replace({}, '([aeiou]) ', '{}* ')"


@query(
    "X27_located",
    rf"""WITH m AS (SELECT doc_id, item_id, b.text AS q, d.text AS text, strpos(d.text, b.text) AS p FROM documents d, benchmark b WHERE contains(d.text, b.text) AND length(b.text) >= 12)
SELECT doc_id, item_id, CAST(p - 1 AS INTEGER) AS "start", CAST(p - 1 + length(q) AS INTEGER) AS "end", 'literal' AS way,
CAST(length({NOISY.format("substr(text, 1, p - 1)", chr(92) + "1").replace("* ')", "* ', 'g')")}) AS INTEGER) AS noisy_start, 'folded' AS noisy_way FROM m""",
)
def x27(t: Tables):
    """Where each passage stands in each document that has its first eight words, in the text and in one with scan noise."""
    eight = lambda c: F.array_join(F.slice(X.split_words(F.lower(c)), 1, 8), " ")
    items = t.benchmark.where("length(text) >= 12").select("item_id", F.col("text").alias("q"), eight("text").alias("g"))
    # only windows that a passage begins with are grouped
    windows = t.documents.select("doc_id", F.explode(X.shingles(F.lower("text"), 8, 8)).alias("g")).withColumn("h", F.xxhash64("g"))
    met = windows.join(items.withColumn("h", F.xxhash64("g")), ["h", "g"]).select("doc_id", "item_id", "q").distinct().join(t.documents.select("doc_id", "text"), "doc_id")
    noisy = F.regexp_replace("text", "([aeiou]) ", "$1* ")
    spaced = F.replace(F.col("q"), F.lit(" "), F.lit(" \n "))
    found = met.select("doc_id", "item_id", Q.located(F.col("text"), spaced).alias("f"), Q.located(noisy, spaced, noisy=True).alias("n")).where("f IS NOT NULL")
    return found.select("doc_id", "item_id", "f.start", "f.end", "f.way", F.col("n.start").alias("noisy_start"), F.col("n.way").alias("noisy_way"))


def _marks(text: str) -> str:
    """SQL that marks the ends of sentences."""
    short = "|".join(a.replace(".", "[.]") for a in N.ABBREVIATIONS)
    out = rf"regexp_replace({text}, '([.!?]\s+)', '\1' || chr(1), 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '(^|[^\p{{L}}.])((?:{short}|\p{{L}}(?:\.\p{{L}})*)\.\s+)\x01', '\1\2', 'gi')"
    return out


SENTENCES = rf"""
m AS (SELECT doc_id, string_split({_marks("text")}, chr(1)) AS parts, length(regexp_extract(text, '{N.LABEL}', 1)) AS lab, text FROM documents),
l AS (SELECT doc_id, parts, CASE WHEN lab > 0 THEN lab + length(regexp_extract(substr(text, lab + 1), '^\s*')) ELSE 0 END AS lab FROM m),
e AS (SELECT doc_id, lab, unnest(parts) AS part, generate_subscripts(parts, 1) AS sentence FROM l),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
s AS (SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(greatest(pos + length(part) - length(regexp_replace(part, '^\s+', '')), lab) AS INTEGER) AS s, CAST(pos + length(regexp_replace(part, '\s+$', '')) AS INTEGER) AS e FROM o)
"""


@query("X26_sentences", f'WITH {SENTENCES} SELECT doc_id, sentence, s AS "start", e AS "end" FROM s WHERE s < e')
def x26(t: Tables):
    return N.sentence_spans(t.documents, "doc_id", "text")


@query(
    "X26_expanded",
    f"""WITH {SENTENCES}, q AS (SELECT doc_id, i AS id, CAST(i * 97 AS INTEGER) AS a, CAST(least(i * 97 + 30, length(text)) AS INTEGER) AS b FROM documents, unnest([0, 1, 2, 3]) u(i) WHERE length(text) > i * 97)
SELECT q.doc_id, id, least(a, coalesce(min(s), a)) AS "start", greatest(b, coalesce(max(e), b)) AS "end" FROM q LEFT JOIN s ON q.doc_id = s.doc_id AND s.s < s.e AND s < b AND e > a GROUP BY q.doc_id, id, a, b""",
)
def x26_expanded(t: Tables):
    """Spans of a document widened to whole sentences."""
    at = F.col("id") * 97
    spans = t.documents.select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("id")).where(F.length("text") > at)
    spans = spans.select("doc_id", "id", at.alias("start"), F.least(at + 30, F.length("text")).alias("end"))
    return N.expanded(spans, N.sentence_spans(t.documents, "doc_id", "text"), "doc_id")


@query(
    "X28_common_run",
    f"""WITH {TURNS}, x AS (SELECT pair, unnest({WORDS.format('a')}) AS w, generate_subscripts({WORDS.format('a')}, 1) AS i FROM p), y AS (SELECT pair, unnest({WORDS.format('b')}) AS w, generate_subscripts({WORDS.format('b')}, 1) AS j FROM p),
m AS (SELECT pair, w, i, i - j AS d, i - row_number() OVER (PARTITION BY pair, i - j ORDER BY i) AS n FROM x JOIN y USING (pair, w)),
r AS (SELECT pair, count(*) AS run FROM m GROUP BY pair, d, n HAVING bool_or(w NOT IN {tuple(Q.STOP_WORDS)}))
SELECT p.pair, coalesce(max(run), 0) AS run FROM p LEFT JOIN r USING (pair) GROUP BY 1""",
)
def x28(t: Tables):
    return Q.common_run(_turns(t), "pair", _words("a"), _words("b"))


FLAT = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(
    "X29_covers",
    f"""WITH {TURNS}, f AS (SELECT pair, {FLAT.format('b')} AS h, {FLAT.format('a')} AS n FROM p), k AS (SELECT *, CAST(ceil(length(n) / 2) AS INTEGER) AS k FROM f)
SELECT pair, CASE WHEN n = '' THEN true WHEN h = '' THEN false ELSE len([i FOR i IN range(1, greatest(length(n) - k + 2, 2)) IF contains(h, substr(n, i, k))]) > 0 END AS covered FROM k""",
)
def x29(t: Tables):
    """Whether a turn repeats half of the turn before it."""
    return _turns(t).select("pair", Q.covers(F.col("b"), F.col("a")).alias("covered"))


@query("X16_contained", f"WITH {TURNS}, f AS (SELECT pair, array_to_string({WORDS.format('a')}, ' ') AS x, array_to_string({WORDS.format('b')}, ' ') AS y FROM p) SELECT pair, contains(' ' || y || ' ', ' ' || x || ' ') AS in_next, contains(' ' || x || ' ', ' ' || y || ' ') AS in_last FROM f")
def x16(t: Tables):
    """Whether one statement is a run of whole words of the other."""
    framed = lambda c: F.concat(F.lit(" "), F.array_join(_words(c), " "), F.lit(" "))
    return _turns(t).select("pair", F.contains(framed("b"), framed("a")).alias("in_next"), F.contains(framed("a"), framed("b")).alias("in_last"))


@query("X16_order_similarity")
def x16_order(t: Tables):
    """How alike two statements are word by word, in order, common words left out."""
    said = lambda c: F.filter(_words(c), lambda w: ~w.isin(Q.STOP_WORDS))
    return _turns(t).select("pair", F.round(Q.sequence_ratio(said("a"), said("b")), 6).alias("ratio"))


@query("U3_word_similarity")
def u3(t: Tables):
    """The larger of the ratio in order and the share of common words."""
    return _turns(t).select("pair", F.round(Q.alike(_words("a"), _words("b")), 6).alias("similarity"))


SPANS = "SELECT l_orderkey AS k, l_linenumber AS id, l_partkey AS p, CAST(l_partkey % 500 AS INTEGER) AS s, CAST(l_partkey % 500 + l_quantity * 2 AS INTEGER) AS e FROM lineitem"


def _spans(t: Tables):
    s = (F.col("l_partkey") % 500).cast("int")
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("p"), s.alias("s"), (s + F.col("l_quantity") * 2).cast("int").alias("e"), "l_returnflag", "l_linestatus")


@query(
    "G13_held_share",
    f"""WITH x AS ({SPANS}), j AS (SELECT a.k, a.p, b.p AS other, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) AS c, a.e - a.s AS n FROM x a JOIN x b ON a.k = b.k AND a.p <> b.p)
SELECT DISTINCT k, p, other, round(CASE WHEN n > 0 THEN c / n ELSE 0 END, 6) AS held, 2 * c >= n AS duplicate FROM j WHERE c > 0""",
)
def g13(t: Tables):
    """Spans of a document that lie in another of its spans, and how far; half of a span makes it a duplicate."""
    a = _spans(t).select("k", "p", "s", "e")
    b = a.select("k", F.col("p").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    held = Q.held_share(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))
    out = a.join(b, "k").where("p <> other").withColumn("held", held).where("held > 0")
    return out.select("k", "p", "other", F.round("held", 6).alias("held"), (F.col("held") >= 0.5).alias("duplicate")).distinct()


@query(
    "G12_shared_sentence",
    f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS id, l_partkey AS p, l_partkey % 9 AS a, l_partkey % 9 + l_suppkey % 2 AS b, l_returnflag AS f FROM lineitem)
SELECT DISTINCT k, id, p, CASE WHEN f <> 'R' THEN 'kept' WHEN EXISTS (SELECT 1 FROM x y WHERE y.k = x.k AND y.f = 'A' AND x.a <= y.b AND y.a <= x.b) THEN 'suggested' ELSE 'discarded' END AS destination FROM x""",
)
def g12(t: Tables):
    """A discarded row that shares a sentence with a firm one of its passage becomes a suggestion. The sentences of a row are a few numbers."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("p"), (F.col("l_partkey") % 9).alias("a"), (F.col("l_partkey") % 9 + F.col("l_suppkey") % 2).alias("b"), F.col("l_returnflag").alias("f"))
    return P.guarded(rows, "k", "a", "b", F.col("f") == "A", F.col("f") == "R").select("k", "id", "p", F.when(F.col("f") != "R", "kept").when(F.col("guarded"), "suggested").otherwise("discarded").alias("destination")).distinct()


@query("G29_reanchored")
def g29(t: Tables):
    """The second sentence's worth of each passage, found again in a reading that dropped its first words and broke its lines anew."""
    new = F.regexp_replace(F.regexp_replace("text", r"^\S+\s+\S+\s+", ""), " ", "\n")
    rows = t.benchmark.select("item_id", F.col("text").alias("old"), new.alias("new"), F.lit(20).alias("start"), F.lit(60).alias("end"))
    out = Q.reanchored(rows, "item_id", "old", "new", "start", "end")
    return out.select("item_id", "start", "end", F.round("share", 6).alias("share"))


#: Two readings of a text that says its passage three times: the new one has words before and between, and lost the third one's first word.
OLD_READING, NEW_READING = "concat(p, ' uno ', p, ' dos ', p)", "concat('nuevo comienzo ', p, ' uno y medio ', p, ' dos ', substring(p, position(' ' IN p) + 1))"


@query(
    "G29_repeated_anchors",
    r"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM benchmark), k AS (SELECT item_id, length(regexp_extract(p, '^[^\p{L}\p{N}_]*')) AS lead, length(regexp_extract(p, '[^\p{L}\p{N}_]*$')) AS trail, length(p) AS n FROM b)
SELECT item_id, a AS anchor, CASE a WHEN 1 THEN 15 + lead WHEN 2 THEN 15 + n + 13 + lead END AS start, CASE a WHEN 1 THEN 15 + n - trail WHEN 2 THEN 15 + n + 13 + n - trail END AS "end", 2 AS places FROM k, (VALUES (1), (2), (3)) v(a)""",
)
def g29_repeated(t: Tables):
    """Passages that stand several times in a document, found again in another reading, each in its own place; the one that lost a word is in none."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = t.benchmark.select("item_id", flat.alias("p")).selectExpr("item_id", f"{OLD_READING} AS old", f"{NEW_READING} AS new", "length(p) AS n")
    spans = rows.selectExpr("item_id", "explode(array(named_struct('anchor', 1, 'start', 0), named_struct('anchor', 2, 'start', n + 5), named_struct('anchor', 3, 'start', 2 * n + 10))) AS a", "n")
    spans = spans.selectExpr("item_id", "a.anchor", "a.start", "a.start + n AS end")
    return Q.reanchored_together(spans, rows, "item_id", "old", "new")
