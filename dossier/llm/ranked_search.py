"""Ranked lexical search over documents reordered by recursive graph bisection, in a clustered index with exact stopping.

1. One pass over the texts counts terms: a document's forward entry has its length and how often it holds each term that the queries
   ask for. Corpus counts (documents, their terms, documents of a term) come from all entries.
2. Recursive graph bisection of a bounded sample gives a tree: at each node, halves swap documents as long as that lowers the cost of
   coding the gaps of the terms' lists. A document goes down the tree to the side that its terms weigh for. A leaf is cut into shards of
   bounded size by a hash (so a group of copies is many tasks), and in each shard the bisection goes on over the shard's own documents
   down to clusters of like documents.
3. A shard's index has its documents in that order, each term's list, and for each cluster the largest impact of every term. The sum of
   a query's largest impacts bounds all scores in the cluster: clusters are visited in descending order of that bound, until it falls
   strictly below the k-th score found (clusters that reach it are still visited, as ties go to the smaller id; positions in the
   reordered index are mapped back to ids for that).
4. A query first meets one shard, that of its own terms. The k-th score there is a floor for all the other shards.

Queries are asked in waves of a bounded number of terms; a wave's terms and weights are what is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .storage import forget, saved, short_batches

#: Terms (with repeats between queries) of a wave of queries, about; one query is never split.
WAVE_TERMS = 1 << 16
#: Documents of the sample that the tree is fitted on, about; leaves of the tree at most; documents of a leaf aimed at.
SAMPLE_DOCS = 8192
MOST_LEAVES = 64
LEAF_DOCS = 8192
#: Documents of a shard and of a cluster, about; rounds of swaps at a node.
SHARD_DOCS = 8192
CLUSTER_DOCS = 64
ROUNDS = 8
#: A term is a run of these bytes: all but ASCII other than letters and digits; capitals A to Z count as small.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
ENTRY = "id bigint, n bigint, terms array<int>, counts array<int>"
INDEX = "leaf int, part int, cluster int, ids binary, docs binary, impacts binary, offsets binary, terms binary, top binary"
FOUND = "item bigint, id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; none of a null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _entries(places: dict[bytes, int]):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                found = terms_of(text)
                if not found:
                    continue
                own = sorted((places[t], c) for t, c in Counter(found).items() if t in places)
                ids.append(i)
                lengths.append(len(found))
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            if ids:
                yield pd.DataFrame({"id": ids, "n": lengths, "terms": terms, "counts": counts})

    return fn


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All values of all lists, and the number of the list of each."""
    size = np.array([len(x) for x in lists], np.int64)
    values = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
    return values, np.repeat(np.arange(len(lists)), size)


def _gap_bits(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits that a list of this many documents of so many takes, gaps being even."""
    return degree * np.log2(size / (degree + 1.0))


def term_weights(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Bits saved for each term when one of its documents is on the left rather than on the right."""
    to_right = _gap_bits(np.maximum(left - 1, 0), n_left) + _gap_bits(right + 1, n_right)
    to_left = _gap_bits(left + 1, n_left) + _gap_bits(np.maximum(right - 1, 0), n_right)
    return to_right - to_left


def bisected(terms: np.ndarray, rows: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n documents are on the left of a bisection, and each term's weight for the left. terms, rows: postings of a graph of width terms."""
    left = np.arange(n) < n // 2
    weight = np.zeros(width)
    for _ in range(ROUNDS):
        on_left = left[rows]
        a = np.bincount(terms[on_left], minlength=width).astype(float)
        b = np.bincount(terms[~on_left], minlength=width).astype(float)
        weight = term_weights(a, b, max(1, int(left.sum())), max(1, int((~left).sum())))
        pull = np.bincount(rows, weights=weight[terms], minlength=n)
        out, into = np.flatnonzero(left), np.flatnonzero(~left)
        out, into = out[np.argsort(pull[out], kind="stable")], into[np.argsort(-pull[into], kind="stable")]
        m = min(len(out), len(into))
        swap = pull[into[:m]] - pull[out[:m]] > 1e-9
        if not swap.any():
            break
        left[out[:m][swap]], left[into[:m][swap]] = False, True
    return left, weight


def ordered(terms: np.ndarray, rows: np.ndarray, n: int, width: int, least: int = CLUSTER_DOCS) -> np.ndarray:
    """The documents in the order of the whole bisection, down to ranges of that many."""
    out, todo = np.zeros(n, np.int64), [(0, np.arange(n), terms, rows)]
    while todo:
        at, own, t, r = todo.pop()
        if len(own) <= least:
            out[at : at + len(own)] = own
            continue
        used, small = np.unique(t, return_inverse=True)
        left, _ = bisected(small, r, len(own), len(used))
        place = np.where(left, np.cumsum(left) - 1, np.cumsum(~left) - 1)
        side = left[r]
        todo.append((at, own[left], t[side], place[r[side]]))
        todo.append((at + int(left.sum()), own[~left], t[~side], place[r[~side]]))
    return out


class Tree:
    """The upper levels of the bisection, fitted on a sample: a weight for each term at each node, in heap order."""

    def __init__(self, sample: list, width: int, leaves: int) -> None:
        self.depth = max(0, int(math.log2(leaves)))
        self.weights = np.zeros(((1 << self.depth) - 1, width), np.float32)
        terms, rows = _flat(sample)
        todo = [(0, terms, rows, len(sample))]
        while todo:
            node, t, r, n = todo.pop()
            if node >= len(self.weights) or n < 2:
                continue
            left, weight = bisected(t, r, n, width)
            self.weights[node] = weight
            place, side = np.where(left, np.cumsum(left) - 1, np.cumsum(~left) - 1), left[r]
            todo += [(2 * node + 1, t[side], place[r[side]], int(left.sum())), (2 * node + 2, t[~side], place[r[~side]], int((~left).sum()))]

    def leaves(self, lists: list) -> np.ndarray:
        """The leaf of each document."""
        terms, rows = _flat(lists)
        node = np.zeros(len(lists), np.int64)
        for _ in range(self.depth):
            pull = np.bincount(rows, weights=self.weights[node[rows], terms], minlength=len(lists))
            node = 2 * node + np.where(pull >= 0, 1, 2)
        return node - len(self.weights)


def _placed(tree: Tree):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.leaves(list(batch["terms"])).astype(np.int32))

    return fn


def impact(counts: np.ndarray, lengths: np.ndarray, docs: int, total: int, b: int) -> np.ndarray:
    """What a term gives a document, times its weight: all in longs. b: how far length counts, in hundredths."""
    m = 100 - b + (b * lengths * docs) // total
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _index(docs: int, total: int, width: int, b: int):
    def fn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        terms, rows = _flat(list(group["terms"]))
        counts, _ = _flat(list(group["counts"]))
        order = ordered(terms, rows, len(group), width)
        place = np.empty(len(group), np.int64)
        place[order] = np.arange(len(group))
        gives = impact(counts, group["n"].to_numpy(np.int64)[rows], docs, total, b)
        used, small = np.unique(terms, return_inverse=True)
        turn = np.lexsort((place[rows], small))
        at, gives, small = place[rows][turn], gives[turn], small[turn]
        offsets = np.searchsorted(small, np.arange(len(used) + 1))
        clusters = -(-len(group) // CLUSTER_DOCS)
        top = np.zeros((len(used), clusters), np.int64)
        np.maximum.at(top, (small, at // CLUSTER_DOCS), gives)
        arrays = {"ids": group["id"].to_numpy(np.int64)[order], "docs": at.astype(np.int32), "impacts": gives, "offsets": offsets.astype(np.int64), "terms": used, "top": top}
        return pd.DataFrame({"leaf": [group["leaf"].iloc[0]], "part": [group["part"].iloc[0]], "cluster": [CLUSTER_DOCS]} | {k: [v.tobytes()] for k, v in arrays.items()})

    return fn


def shard_search(asked: np.ndarray, weights: np.ndarray, index: dict, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best documents of a shard with a score of floor at least, and how many clusters were visited.

    asked: the query's terms, ascending; weights: their weights. Scores are exact; equal ones by ascending id.
    """
    ids, docs, gives, offsets, terms, top, size = (index[c] for c in ("ids", "docs", "impacts", "offsets", "terms", "top", "cluster"))
    where = np.searchsorted(terms, asked)
    there = np.flatnonzero((where < len(terms)) & (terms[np.minimum(where, len(terms) - 1)] == asked)) if len(terms) else np.zeros(0, int)
    none = np.zeros(0, np.int64)
    if not len(there):
        return none, none, 0
    where, w = where[there], weights[there]
    bound = w @ top[where]
    turn = np.argsort(-bound, kind="stable")
    turn = turn[bound[turn] >= floor]
    best_ids, best, kth, at, step = none, none, floor, 0, 1
    starts = [docs[offsets[t] : offsets[t + 1]] for t in where]
    while at < len(turn) and bound[turn[at]] >= kth:
        some = np.sort(turn[at : at + step][bound[turn[at : at + step]] >= kth])
        at, step = at + step, min(2 * step, 64)
        slot = np.full(-(-len(ids) // size), -1, np.int64)
        slot[some] = np.arange(len(some))
        scores = np.zeros(len(some) * size, np.int64)
        for t, own, x in zip(where, starts, w, strict=True):
            a, e = np.searchsorted(own, some * size), np.searchsorted(own, (some + 1) * size)
            many = e - a
            take = np.repeat(a - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            d = own[take]
            scores[slot[d // size] * size + d % size] += x * gives[offsets[t] + take]
        hit = np.flatnonzero(scores >= kth)
        found = ids[some[hit // size] * size + hit % size]
        best_ids, best = np.r_[best_ids, found], np.r_[best, scores[hit]]
        keep = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[keep], best[keep]
        if len(best) == k:
            kth = max(kth, int(best[-1]))
    return best_ids, best, at


def _searched(items: list, weights: np.ndarray, k: int, floors: dict[int, int], homes: dict[int, int] | None = None):
    """For each shard's index: what the queries find in it. homes: the leaf that each query is asked in, in its first shard only."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                kinds = {"docs": np.int32}
                index = {c: np.frombuffer(getattr(r, c), kinds.get(c, np.int64)) for c in ("ids", "docs", "impacts", "offsets", "terms", "top")}
                index |= {"top": index["top"].reshape(len(index["terms"]), -1), "cluster": r.cluster}
                out = [(np.zeros(0, np.int64),) * 3]
                for item, terms in items:
                    if homes is not None and homes[item] != r.leaf:
                        continue
                    ids, scores, _ = shard_search(terms, weights[terms], index, k, floors.get(item, 1))
                    out.append((np.full(len(ids), item), ids, scores))
                item, ids, scores = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"item": item, "id": ids, "score": scores})

    return fn


def _wave(docs: DataFrame, items: list[tuple[int, str]], k: int, b: int) -> DataFrame:
    """The k best documents of each query of a wave: item, rank, id, score."""
    asked = [(item, sorted(set(terms_of(text)))) for item, text in items]
    places = {t: i for i, t in enumerate(sorted({t for _, own in asked for t in own}))}
    asked = [(item, np.array([places[t] for t in own], np.int64)) for item, own in asked]
    entries = saved(docs.mapInPandas(_entries(places), ENTRY), "term-entries")
    n, total = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(places), np.int64)
    for t, c in entries.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the wave at most
        holding[t] = c
    # a term that no document holds meets no list; its weight is never used
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in holding.tolist()], np.int64)

    held = entries.where(F.size("terms") > 0)
    share = int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30))
    drawn = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).groupBy("id").agg(F.min("terms").alias("terms")).orderBy("id").select("terms")
    tree = Tree(list(drawn.toPandas()["terms"]), len(places), 1 << max(0, min(MOST_LEAVES, n // LEAF_DOCS).bit_length() - 1))
    placed = saved(held.mapInPandas(_placed(tree), ENTRY + ", leaf int").withColumn("row", F.monotonically_increasing_id()), "placed-entries")
    forget(entries)
    sizes = {r["leaf"]: -(-r["count"] // SHARD_DOCS) for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf
    parts = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[F.col("leaf")] if sizes else F.lit(1)
    sharded = placed.withColumn("part", F.pmod(F.xxhash64("id", "row"), parts).cast("int")).drop("row")
    index = saved(sharded.groupBy("leaf", "part").applyInPandas(_index(n, max(1, total), len(places), b), INDEX), "cluster-index")
    forget(placed)

    homes = dict(zip([i for i, _ in asked], tree.leaves([t for _, t in asked]).tolist(), strict=True))
    floors = {}
    if sum(sizes.values()) > 1:
        seed = index.where("part = 0").mapInPandas(_searched(asked, weights, k, {}, homes), FOUND)
        floors = {r["item"]: r["floor"] for r in seed.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).collect() if r["floor"]}
    found = index.mapInPandas(_searched(asked, weights, k, floors), FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, b: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: item_id, rank (from 1), doc_id, score; ties by ascending doc_id.

    Terms are maximal runs of letters, digits and characters beyond ASCII, A to Z made small, over the whole text. A document's
    score sums w * (10**9 * tf div (1000 * tf + 20 * m)) over the item's terms, each once, where w is floor(1000 * ln((2 N + 2) /
    (2 df + 1))) and m is 100 - b + (b * n * N div L): N documents hold a term at all, L terms in all, n in this one.

    A null, empty or termless text has no terms: such a document counts nowhere, such an item finds nothing. Rows with a null id (of
    either table) take no part. Rows that repeat a doc_id are documents of their own and each has a rank; an item id that is
    repeated is asked once, with the least of its texts. Very long texts are read whole, one at a time. Empty tables give no rows. Other
    columns may have any names.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("bigint").alias("item")).agg(F.min(F.col(item_text_col).cast("string")).alias("text"))
    asked = saved(asked.where(F.length("text") > 0).withColumn("weight", F.size(F.split("text", r"\W+"))), "asked-items")
    total = asked.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    waves = max(1, -(-total // WAVE_TERMS))
    out = None
    for wave in range(waves):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(waves)) == wave).orderBy("item").select("item", "text").collect()  # bounded by WAVE_TERMS
        found = _wave(texts, [(r["item"], r["text"]) for r in own], k, b)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
