"""A positional inverted index over texts: stored postings, web-style queries answered by joins, ranked search with bounds.

The index has one row for each term and block of documents. A block is a bounded number of documents that one task read together, so the
rows are made where the texts are, without a shuffle, and the list of a word that every document has is many rows in many tasks: no key
grows with the corpus. A row has the documents that hold the term, how often each does, their sizes and the term's positions in them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.search import STOP_WORDS, WORD, parse_search, stem
from ..functions.text import search_normalized
from ..sources.files import scratch

#: Documents of a block, about.
BLOCK_DOCS = 64
#: Fixed values of the BM25 formula.
K1, B = 1.2, 0.75
#: Times k, the postings that a query's rarest words have to have before its first bound is taken.
FIRST = 2
#: Scores are rounded to six decimals: a bound has to be farther off than that.
MARGIN = 2e-6
#: Terms that the index is made for alone; if queries ask for more, it has all terms.
ONLY_TERMS = 65_536
#: Stands for the stems that the index leaves out.
OTHER = "\u0001"
#: A block's documents and their sizes have a row with an empty term.
POSTINGS = "term string, block bigint, id array<bigint>, times array<int>, size array<int>, at array<array<int>>"
ASKED = "query_id bigint, alternative int, clause int, excluded boolean, terms int, offset int, term string"


class _Stems:
    """Stems of words, kept for a task's next texts; with only, no others than those."""

    def __init__(self, only: frozenset[str] | None = None) -> None:
        self.known: dict[str, str] = {}
        self.only = only

    def _learn(self, word: str) -> str:
        if len(self.known) > 500_000:
            self.known.clear()
        own = "" if word in STOP_WORDS else stem(word)
        if own and self.only is not None and own not in self.only:
            own = OTHER
        self.known[word] = own
        return own

    def places(self, words: list[str] | None) -> tuple[dict[str, list[int]], int]:
        """The stems of a text with their positions from 1, and how many words have one; common words only count as positions."""
        out: dict[str, list[int]] = {}
        size, known = 0, self.known
        for i, w in enumerate(words if words is not None else (), 1):
            own = known.get(w)
            if own is None:
                own = self._learn(w)
            if own:
                size += 1
                if own is not OTHER:
                    out.setdefault(own, []).append(i)
        return out, size


def _blocks(most: int, only: frozenset[str] | None):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stems = _Stems(only)
        for batch in batches:
            for at in range(0, len(batch), most):
                own, lists = batch.iloc[at : at + most], {"": ([], [], [], [])}
                for i, words in zip(own["id"].tolist(), own["words"], strict=True):
                    places, size = stems.places(words)
                    for term, found in (("", []), *places.items()):
                        row = lists.setdefault(term, ([], [], [], []))
                        for column, value in zip(row, (i, len(found), size, found), strict=True):
                            column.append(value)
                block = uuid.uuid4().int >> 65
                yield pd.DataFrame([(term, block, *row) for term, row in lists.items()], columns=["term", "block", "id", "times", "size", "at"])

    return fn


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stems = _Stems()
    for batch in batches:
        yield pd.DataFrame({"query_id": batch["id"], "terms": [list(stems.places(words)[0]) for words in batch["words"]]})


def words_of(text: Column) -> Column:
    """The words of a text in the form that is stemmed."""
    return F.regexp_extract_all(F.lower(search_normalized(text)), F.lit(WORD), 1)


@dataclass
class TextIndex:
    """postings: term, block, and arrays of id, times, size and at; terms: term, df, top (the largest weight); docs, and the mean size of those with terms."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    mean: float


def weight(times: Column, size: Column, mean: float) -> Column:
    """What BM25 gives a term of a document, but for the term's own rarity."""
    return times * (K1 + 1) / (times + K1 * (1 - B + B * size / F.lit(mean)))


def rarity(df: Column, docs: int) -> Column:
    return F.ln((F.lit(docs) - df + 0.5) / (df + 0.5) + 1)


def postings_of(*ids: Column) -> Column:
    """The postings of a row as structs; with ids, only those of the documents in that array."""
    every = F.arrays_zip("id", "times", "size", "at")
    return F.filter(every, lambda p: F.array_contains(ids[0], p["id"])) if ids else every


def largest(mean: float) -> Column:
    """The largest weight of a row's postings."""
    return F.array_max(F.zip_with("times", "size", lambda t, s: weight(t, s, mean)))


def text_index(docs: DataFrame, id_col: str, text: str, asked: DataFrame | None = None) -> TextIndex:
    """Builds and stores the index of all documents; rows without an id are left out, of repeated ids any is found. Nothing is shuffled.

    asked: the terms (column term) that queries will ask for. All words are read and counted in the sizes, but the index has no other lists; with
    more than ONLY_TERMS of them it has all.
    """
    spark = docs.sparkSession
    only = None
    if asked is not None:
        terms = [r["term"] for r in asked.select("term").where("term IS NOT NULL").distinct().limit(ONLY_TERMS + 1).collect()]
        only = frozenset(terms) if len(terms) <= ONLY_TERMS else None
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), words_of(F.col(text)).alias("words"))
    path = scratch(spark, "postings")
    rows.mapInPandas(_blocks(BLOCK_DOCS, only), POSTINGS).write.parquet(path)
    both = spark.read.schema(POSTINGS).parquet(path)
    sizes = both.where("term = ''").select(F.explode("size").alias("size"))
    n, mean = sizes.agg(F.count("*"), F.avg(F.when(F.col("size") > 0, F.col("size")))).first()
    postings, mean = both.where("term <> ''"), float(mean or 1)
    path = scratch(spark, "terms")
    postings.groupBy("term").agg(F.sum(F.size("id")).alias("df"), F.max(largest(mean)).alias("top")).write.parquet(path)
    return TextIndex(postings, spark.read.parquet(path), n, mean)


# -- boolean and phrase queries -----------------------------------------------------------------------------------------------


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for query, text in zip(batch["query_id"], batch["text"], strict=True):
            for a, clauses in enumerate(parse_search(text or "")):
                for c, (excluded, terms) in enumerate(clauses):
                    out += [(query, a, c, excluded, len(terms), offset, term) for offset, term in terms]
        yield pd.DataFrame(out, columns=["query_id", "alternative", "clause", "excluded", "terms", "offset", "term"])


def asked_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """The terms that web-style queries ask for: a row for each term of a clause of an alternative. Null ids and texts ask nothing."""
    rows = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("bigint").alias("query_id"), search_normalized(F.col(text)).alias("text"))
    return rows.mapInPandas(_parsed, ASKED)


def answers(index: TextIndex, asked: DataFrame) -> DataFrame:
    """query_id and id of the documents that answer each query; asked as :func:`asked_terms` gives it.

    Each alternative begins at its rarest term: only that list is read whole. Of the other lists only the rows of the blocks, and of those
    only the postings of the documents, that are left then. A phrase's terms stand at their distances, common words between them counted. An
    alternative that asks for a term that no document has, or that only excludes, finds nothing.
    """
    by = ["query_id", "alternative"]
    spark = asked.sparkSession
    path = scratch(spark, "asked")
    asked.join(index.terms.select("term", "df"), "term", "left").write.parquet(path)
    asked = spark.read.parquet(path)
    able = asked.where("NOT excluded").groupBy(*by).agg(F.countDistinct("clause").alias("wanted"), F.count_if(F.col("df").isNull()).alias("lacking"), F.min_by("term", F.struct("df", "term")).alias("first"))
    able = able.where("lacking = 0").drop("lacking")
    left = able.join(index.postings.select(F.col("term").alias("first"), "block", F.col("id").alias("ids")), "first").select(*by, "wanted", "block", "ids")
    # one row for an alternative and block: what its other lists are met with
    tests = left.join(asked.where("df IS NOT NULL"), by)
    met = tests.join(index.postings, ["term", "block"])
    hits = met.select(*by, "wanted", "clause", "excluded", "terms", "offset", F.explode(postings_of(F.col("ids"))).alias("p"))
    # where a phrase would start; a clause of one term holds wherever that stands
    starts = F.when(F.col("terms") > 1, F.transform("p.at", lambda x: x - F.col("offset"))).otherwise(F.array(F.lit(0)))
    clause = ["query_id", "id", "alternative", "wanted", "clause", "excluded"]
    hits = hits.select("query_id", F.col("p.id").alias("id"), *clause[2:], "terms", "offset", starts.alias("starts"))
    # all that follows is by query and document, so it is dealt out once, and groups hold counts only
    hits = hits.repartition("query_id", "id").withColumn("start", F.explode("starts"))
    held = hits.groupBy(*clause, "terms", "start").agg(F.countDistinct("offset").alias("n")).where("n = terms").select(*clause).distinct()
    whole = held.groupBy("query_id", "id", "alternative", "wanted").agg(F.count_if(~F.col("excluded")).alias("n"), F.count_if("excluded").alias("bad"))
    return whole.where("n = wanted AND bad = 0").groupBy("query_id", "id").agg(F.lit(True).alias("x")).drop("x")


# -- ranked search ----------------------------------------------------------------------------------------------------------------


@dataclass
class Ranked:
    """scores: query_id, id, score, place; read: query_id, lists and postings that were read for it, and all of its terms."""

    scores: DataFrame
    read: DataFrame


def ranked_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """The distinct terms that each query is ranked by: query_id, term."""
    rows = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("bigint").alias("id"), words_of(F.col(text)).alias("words"))
    return rows.mapInPandas(_terms, "query_id bigint, terms array<string>").select("query_id", F.explode("terms").alias("term")).distinct()


def ranked(index: TextIndex, queries: DataFrame, query_id: str, text: str, k: int) -> Ranked:
    """Each query's k documents with the highest BM25 score of its distinct terms (six decimals), ties to the smaller id.

    1. The lists of a query's rarest terms give documents a part of their score. The whole scores of the k best of these are a bound that the
    k-th score can't be below. 2. Terms whose largest scores together stay below the bound bring in no document by themselves: their
    lists are not read for candidates. 3. A candidate goes on if its part and the block's largest scores of those terms reach the
    bound; for the ones that are left, and in their blocks only, the other lists are looked up. Results are those of reading everything.
    """
    spark = queries.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    gives = F.col("idf") * weight(F.col("p.times"), F.col("p.size"), index.mean)

    def parts(own: DataFrame) -> DataFrame:
        lists = own.join(index.postings.drop("at"), "term").select("query_id", "block", "idf", F.explode(F.arrays_zip("id", "times", "size")).alias("p"))
        return lists.groupBy("query_id", "block", F.col("p.id").alias("id")).agg(F.sum(gives).alias("part"))

    def completed(found: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The scores of found (query_id, block, id, part) with what own terms add, and the lists that were looked up for it."""
        wanted = found.groupBy("query_id", "block").agg(F.collect_list("id").alias("ids"))  # a block's documents at most
        touched = wanted.join(own.select("query_id", "term", "idf"), "query_id").join(index.postings.drop("at"), ["term", "block"])
        inside = F.filter(F.arrays_zip("id", "times", "size"), lambda p: F.array_contains("ids", p["id"]))
        more = touched.select("query_id", "idf", F.explode(inside).alias("p"))
        both = found.select("query_id", "id", "part").unionByName(more.select("query_id", F.col("p.id").alias("id"), gives.alias("part")))
        return both.groupBy("query_id", "id").agg(F.sum("part").alias("score")), touched.select("query_id", F.size("id").cast("bigint").alias("read"))

    terms = ranked_terms(queries, query_id, text).join(index.terms, "term")
    idf = rarity(F.col("df"), index.docs)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("ub"), "term")
    before = F.coalesce(F.sum("df").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("ub").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing))  # this term and all with a lower bound
    terms = terms.select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("top")).alias("ub"))
    terms = stored(terms.withColumns({"seed": before < FIRST * k, "below": below}), "query-terms")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "id"))
    first = stored(parts(terms.where("seed")).withColumn("place", place).where(F.col("place") <= k).drop("place"), "first-found")
    whole, looked = completed(first, terms.where("NOT seed"))
    bound = whole.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - MARGIN).alias("bound"))
    split = terms.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    split = stored(split.withColumn("leads", F.col("below") >= F.col("bound")), "split-terms")

    rest = split.where("NOT leads")
    tops = rest.drop("top").join(index.postings.select("term", "block", largest(index.mean).alias("top")), "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("reach"))
    found = parts(split.where("leads")).join(split.select("query_id", "bound").distinct(), "query_id").join(tops, ["query_id", "block"], "left")
    found = found.where(F.col("part") + F.coalesce("reach", F.lit(0.0)) >= F.col("bound")).select("query_id", "block", "id", "part")
    scores, more = completed(stored(found, "candidates"), rest)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    scores = scores.withColumn("score", F.round("score", 6)).withColumn("place", place).where(F.col("place") <= k).select("query_id", "id", "score", "place")
    lead = split.select("query_id", F.when(F.col("seed"), F.col("df")).otherwise(0).alias("a"), F.when(F.col("leads"), F.col("df")).otherwise(0).alias("b"), F.col("df").alias("all"))
    listed = lead.select("query_id", (F.col("a") + F.col("b")).alias("read"), "all")
    both = looked.unionByName(more).withColumn("all", F.lit(0).cast("bigint"))
    return Ranked(scores, listed.unionByName(both).groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("all").alias("all")))
