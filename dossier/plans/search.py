"""Hybrid retrieval over embeddings, documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.search import WORD
from ..operators import postings as I
from ..operators import retrieval as Q
from .language import NORMAL, POSTED
from .registry import Tables, query


def _asked(t: Tables):
    """The stated queries of a vector search: every row whose id is divisible by 20."""
    return t.embeddings.where("vec_id % 20 = 0")


def _near(t: Tables):
    return Q.cosine_distances(t.embeddings, _asked(t), "vec_id", "embedding").drop("score")


V = "CAST(embedding AS DOUBLE[])"
COSINE = f"""
e AS (SELECT vec_id, label, {V} AS v, sqrt(list_inner_product({V}, {V})) AS n FROM embeddings),
c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_inner_product(e.v, q.v) / (e.n * q.n) AS score FROM e JOIN e q ON q.vec_id % 20 = 0),
d AS (SELECT *, round(1 - score, 6) + 0.0 AS distance FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS place FROM d)
"""


@query("T1_cosine_topk", f"WITH {COSINE} SELECT query_id, id, distance, place FROM r WHERE place <= 30")
def t1(t: Tables):
    return _near(t)


HITS = f"""{POSTED}, i AS (SELECT stem, doc_id AS id, count(*) AS tf FROM posts GROUP BY 1, 2), z AS (SELECT id, sum(tf) AS size FROM i GROUP BY 1),
m AS (SELECT avg(size) AS mean, (SELECT count(*) FROM documents) AS docs FROM z), f AS (SELECT stem, count(*) AS df FROM i GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, stem FROM (SELECT item_id, unnest(regexp_extract_all({NORMAL}, '{WORD}', 1)) AS word FROM benchmark) JOIN stems USING (word)),
s AS (SELECT query_id, id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN i USING (stem) JOIN f USING (stem) JOIN z USING (id), m GROUP BY 1, 2)
"""


@query("T2_words_topk", f"WITH {HITS} SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM s) WHERE place <= 30")
def t2(t: Tables):
    """The best documents for each benchmark passage by its stems (BM25, a documented stand-in for another ranking formula)."""
    asked = I.ranked_terms(t.benchmark, "item_id", "text")
    return I.ranked(I.text_index(t.documents, "doc_id", "text", asked), t.benchmark, "item_id", "text", Q.CANDIDATES).scores


@query(
    "T5_threshold",
    f"WITH {COSINE} SELECT query_id, count(*) FILTER (score >= 0.219) AS kept, round(max(score), 6) AS best, CASE WHEN count(*) FILTER (score >= 0.219) = 0 THEN 'below_threshold' END AS reason FROM d WHERE id <> query_id GROUP BY 1",
)
def t5(t: Tables):
    """How many rows pass the barrier for each query; none is an abstention with its reason."""
    sums = Q.passing(t.embeddings, _asked(t), "vec_id", "embedding")
    return Q.barrier(sums, _asked(t).select(F.col("vec_id").alias("query_id")), "query_id")


def _labelled(t: Tables, found):
    return found.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")


@query("A6_pooled", f"WITH {COSINE} SELECT query_id, label, -min(distance) AS best, arg_min(id, (distance, id)) AS item, count(*) AS items FROM r WHERE place <= 30 GROUP BY 1, 2")
def a6(t: Tables):
    """Candidates pooled to their units for each query: the best score, the passage that has it, how many there are."""
    rows = _labelled(t, _near(t)).withColumn("score", -F.col("distance"))
    return Q.pooled(rows, ["query_id", "label"], "id", "score")


@query(
    "A7_pooled_score",
    f"""WITH {COSINE}, u AS (SELECT query_id, label, id % 10 AS unit, round(max(score), 6) AS score FROM d GROUP BY 1, 2, 3)
SELECT query_id, label, max(score) AS score, arg_max(unit, (score, -unit)) AS unit, count(*) AS units FROM u GROUP BY 1, 2""",
)
def a7(t: Tables):
    """Passages to units to documents: each level keeps the best score of the one below, and the unit that has it."""
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"), (F.col("vec_id") % 10).alias("unit"))
    units = Q.best_of_groups(rows, _asked(t), "vec_id", "embedding", ["label", "unit"])
    out = Q.pooled(units, ["query_id", "label"], "unit", "score")
    return out.select("query_id", F.col("label").cast("int").alias("label"), F.col("best").alias("score"), F.col("item").alias("unit"), F.col("items").alias("units"))


PATHS = f"""{COSINE}, l AS (SELECT q.query_id, e.vec_id AS id, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY e.vec_id) AS INTEGER) AS place FROM (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings e ON e.label = q.label QUALIFY place <= 30),
u AS (SELECT query_id, id, 0 AS path, place FROM r WHERE place <= 30 UNION ALL SELECT query_id, id, 1, place FROM l)"""


def _paths(t: Tables):
    """Two ways to candidates: the nearest, and those of the query's label in order of id (a report of thirty a label)."""
    first = Q.best_of_each(t.embeddings.select("label", F.col("vec_id").alias("id")), "label", [F.col("id")], Q.CANDIDATES)
    same = _asked(t).select(F.col("vec_id").alias("query_id"), "label").join(first, "label").select("query_id", "id", "place")
    return [_near(t).select("query_id", "id", "place"), same]


@query("A8_path_counts", f"WITH {PATHS} SELECT query_id, path, count(*) AS passages, count(DISTINCT id % 10) AS units FROM u GROUP BY 1, 2")
def a8(t: Tables):
    near, same = _paths(t)
    both = near.withColumn("path", F.lit(0)).unionByName(same.withColumn("path", F.lit(1)))
    return both.groupBy("query_id", "path").agg(F.count("*").alias("passages"), F.countDistinct(F.col("id") % 10).alias("units"))


@query(
    "W17_first_arrival",
    f"""WITH {PATHS} SELECT query_id, id, CAST(min(path) AS INTEGER) AS path, CAST(min(place) FILTER (path = p) AS INTEGER) AS place, string_agg(CAST(path AS VARCHAR), ',' ORDER BY path) AS paths
FROM (SELECT *, min(path) OVER (PARTITION BY query_id, id) AS p FROM u) GROUP BY 1, 2""",
)
def w17(t: Tables):
    return Q.first_arrival(_paths(t), "query_id", "id", "place")


@query(
    "G17_merged_results",
    f"""WITH {COSINE}, i AS (SELECT query_id // 100 AS question, label, id, max(score) AS s FROM r WHERE place <= 30 GROUP BY 1, 2, 3)
SELECT question, label, round(max(s), 6) AS best, count(*) AS items, max(s) >= 0.219 AS selected FROM i GROUP BY 1, 2""",
)
def g17(t: Tables):
    """The results of several fixed questions as one: best scores of passages and units, and which units any of them selected."""
    near = Q.cosine_distances(t.embeddings, _asked(t), "vec_id", "embedding")
    rows = _labelled(t, near).selectExpr("query_id div 100 AS question", "label", "id", "score AS s")
    return Q.merged_results(rows, "question", "label", "id", "s")


@query("W9_quota", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS turn FROM part QUALIFY turn <= 3")
def w9(t: Tables):
    return Q.quota(t.part, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "turn")


@query(
    "W10_interleaved",
    """WITH q AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part QUALIFY turn <= 3)
SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_brand = 'Brand#1', turn, p_brand) AS INTEGER) AS place FROM q""",
)
def w10(t: Tables):
    rows = Q.quota(t.part, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")])
    # a few rows a brand are left: their order is a small report
    return rows.select("p_partkey", F.row_number().over(Window.orderBy(F.col("p_brand") == "Brand#1", "turn", "p_brand")).alias("place"))


@query(
    "J10_neighbours",
    """SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS r1, lag(turn) OVER w AS t1, lead(role) OVER w AS r2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role <> 'system' AND ((r1 = 'system' AND t1 = turn - 1) OR (r2 = 'system' AND t2 = turn + 1))""",
)
def j10(t: Tables):
    return Q.neighbours(t.conversations, ["conv_id"], "turn", F.col("role") == "system").select("conv_id", "turn")
