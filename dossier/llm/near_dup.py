"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's shingles are hashed once; its sketch is the SKETCH smallest hashes. Documents with equal sets are one
   node from here on, found by a digest of the whole set.
2. Inverted lists of retained values: a node is listed under the values of its sketch that are rarest over all sketches,
   as many as needed for two documents of the asked similarity to meet in a list (prefix filtering; sketches that hold
   a whole set make this exact; of sets larger than a sketch, SLACK standard deviations are allowed for, so a link of exactly
   the threshold is missed with a chance of some 2e-8). Passages that many documents share come last in that order and bring
   together only documents that they dominate.
3. In each list every member meets the list's pivot. The union sketch of a pair (the smallest values of both sketches
   together) estimates its similarity; pairs far below the threshold go. The rest are confirmed on the full sets.
4. Links make components. Lists whose members are in one component are done. In the others, members of different
   components still have to meet: short lists give those pairs to step 3; nodes of long lists, clustered by the lists
   they share, are compared whole in blocks of bounded size, and only links leave the task. So no pair that meets is
   left out, and a large group of near copies costs one pair a member and not all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shingles import shingle_sets
from .storage import bucketed, forget, saved, short_batches

SKETCH = 160
#: Cells of the table of how often sketch values occur, at least and at most, and the values that fall in one on average, about.
#: The table is what is broadcast: a few megabytes at most, whatever the corpus.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 20
VALUES_OF_CELL = 256
#: Cells that come to the driver as one value, their counts packed.
RUN = 1 << 14
#: Lists up to this length give pairs; longer ones are compared in blocks of BLOCK nodes.
SHORT_LIST = 24
BLOCK = 512
#: Values of a block's product that are held at a time.
VALUES = 4096
SLACK = 5.5


def least_overlap(size: int, percent: int) -> int:
    """Values that the sketches of two documents of this similarity share, of sketches of this size."""
    t = percent / 100
    return max(1, math.floor(t * size - SLACK * math.sqrt(size * t * (1 - t))))


def list_values(n: int, size: int, percent: int) -> int:
    """Under how many of its size retained values a set of n shingles is listed."""
    if n <= SKETCH * percent // 100:  # any partner's sketch is its whole set
        return n - -(-n * percent // 100) + 1
    return size - least_overlap(SKETCH, percent) + 1


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard similarity of two sets from their sketches (sorted); exact where both sketches are whole sets."""
    both = np.union1d(a, b)
    if na > len(a) or nb > len(b):
        both = both[: min(SKETCH, len(both))]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, both[-1], side="right")) / len(both) if len(both) else 0.0


def alike(shared, na, nb, percent: int):
    """The link test on whole sets, in integers."""
    return 100 * shared >= percent * (na + nb - shared)


def _sketches(words: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch["text"]], words)
            yield pd.DataFrame(
                {
                    "id": batch["id"].array,
                    "n": [len(s) for s in sets],
                    "sig": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                    "sketch": [s[:SKETCH].view(np.int64) for s in sets],
                }
            )

    return fn


def _listed(cells: np.ndarray, percent: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for n, sketch in zip(batch["n"], batch["sketch"], strict=True):
                order = np.lexsort((sketch, cells[sketch & (len(cells) - 1)]))
                keys.append(sketch[order[: list_values(n, len(sketch), percent)]])
            yield pd.DataFrame({"id": batch["id"], "keys": keys})

    return fn


def counted_cells(values: DataFrame) -> np.ndarray:
    """How many values (a column v) fall in each cell. Cells get more as the corpus grows, so that frequent values stand out from the rest.

    Which values rank last decides how long lists get, never which links are found.
    """
    total, cells = values.count(), LEAST_CELLS
    while cells < MOST_CELLS and cells * VALUES_OF_CELL < total:
        cells *= 2
    counts = values.groupBy(F.col("v").bitwiseAND(cells - 1).alias("cell")).count()
    runs = counts.groupBy(F.floor(F.col("cell") / RUN).alias("run")).applyInPandas(_packed, "run bigint, counts binary")
    out = np.zeros(cells, np.int32)
    for run, packed in runs.collect():  # four bytes a cell
        out[run * RUN : (run + 1) * RUN] = np.frombuffer(packed, np.int32)
    return out


def _packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(RUN, np.int32)
    out[group["cell"].to_numpy(np.int64) % RUN] = np.minimum(group["count"], np.iinfo(np.int32).max)
    return pd.DataFrame({"run": [key[0]], "counts": [out.tobytes()]})


def _passing(percent: int):
    bound = least_overlap(SKETCH, percent) / SKETCH

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                estimate(x.view(np.uint64), y.view(np.uint64), m, n) >= (percent / 100 - 1e-9 if m == len(x) and n == len(y) else bound)
                for x, y, m, n in zip(batch["sketch_a"], batch["sketch_b"], batch["na"], batch["nb"], strict=True)
            ]
            yield batch.loc[keep, ["a", "b"]]

    return fn


def _confirmed(words: int, percent: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, known = [], {}
            for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if (b, y) not in known:  # pairs with one pivot come together
                    known = {(b, y): shingle_sets([y.encode()], words)[0]}
                s, t = shingle_sets([x.encode()], words)[0], known[b, y]
                keep.append(len(s) > 0 and alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent))
            yield batch.loc[keep, ["a", "b"]]

    return fn


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right."""
    values, place = np.unique(np.concatenate(left + right), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    half = rows < len(left)
    used = np.zeros((2, len(values)), bool)
    used[0, place[half]] = used[1, place[~half]] = True
    number = np.cumsum(used.all(axis=0)) - 1
    keep = used.all(axis=0)[place]
    rows, cols = rows[keep], number[place[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(cols[-1]) + 1 if len(cols) else 0, VALUES):
        a, b = np.searchsorted(cols, (at, at + VALUES))
        m = np.zeros((len(left) + len(right), VALUES), np.float32)
        m[rows[a:b], cols[a:b] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _block_links(words: int, percent: int):
    def fn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = group[group["block"] == i], group[group["block"] == j]
        s = shingle_sets([t.encode() for t in left["text"]], words)
        t = s if i == j else shingle_sets([t.encode() for t in right["text"]], words)
        if not s or not t:
            return pd.DataFrame({"a": [], "b": []})
        nl, nr = np.array([len(x) for x in s]), np.array([len(x) for x in t])
        ok = alike(overlaps(s, t).astype(np.int64), nl[:, None], nr[None, :], percent) & (nl[:, None] > 0)
        cl, cr = left["component"].to_numpy(), right["component"].to_numpy()
        x, y = np.nonzero(ok & (cl[:, None] != cr[None, :]))
        return pd.DataFrame({"a": cl[x], "b": cr[y]}).drop_duplicates()

    return fn


def _named(pairs: DataFrame, name: str) -> DataFrame:
    """The ids that pairs (a, b) name, as a table: a small one is broadcast by Spark, whose size it then knows, a large one is not."""
    return saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name)


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, as a table: by size and union sketch first, then on the full sets.

    sets: the digest and size of each node's set. Sketches stay where they are, bucketed by digest, for one side of a pair; those of b, of which
    there may be few, are carried to those of a. Only texts of documents that a pair names are shuffled.
    """
    pairs = saved(pairs, "pairs")
    own = lambda c: sets.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n{c}"))
    sized = pairs.join(own("b"), "b").join(own("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    sketch = lambda c: nodes.select(F.col("sig").alias(f"sig_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    # pairs grow with the corpus: they are not broadcast, so small tables run the plan of large ones
    near = sized.hint("merge").join(sketch("b"), "sig_b").hint("merge").join(sketch("a"), "sig_a")
    near = saved(near.mapInPandas(_passing(percent), "a bigint, b bigint").distinct(), "near-pairs")
    forget(pairs)
    named = _named(near, "near-ids")
    whole = texts.where(F.col("text").isNotNull()).join(named, "id", "left_semi")
    text = lambda c: whole.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    links = saved(near.join(text("a"), "a").join(text("b"), "b").mapInPandas(_confirmed(words, percent), "a bigint, b bigint"), "confirmed")
    forget(near)
    forget(named)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of each document in the graph of documents whose shingle sets are that similar.

    Returns doc_id, n_shingles (size of the set), component_id (the least id reachable, itself included) and kept
    (doc_id = component_id). ASCII capitals count as small; words are runs without ASCII white space; a text of fewer
    words is one shingle; null, empty and blank texts have none and link with nothing. Rows that repeat an id are
    one document with several texts: it links by any. Null ids take no part: component null, kept true. Ids are longs.
    Very long texts are read whole. An empty table gives no rows; other columns may have any name.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    full = saved(texts.mapInPandas(_sketches(words), "id bigint, n bigint, sig binary, sketch array<bigint>"), "sketches")
    # one shuffle of sketches in all: copies meet after a part of them has on each task, and each set stays in its bucket
    sets_of = full.where(F.col("sig").isNotNull() & F.col("id").isNotNull()).groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = bucketed(sets_of, "nodes", "sig")
    # a table of its own, and never broadcast, as it grows with the corpus: the join's sides are both shuffled for it, and Spark can
    # split a hot set of copies
    sets = saved(nodes.select("sig", F.col("id").alias("rep"), "n"), "sets")
    members = saved(full.select("id", "n", "sig").join(sets.select("sig", "rep").hint("merge"), "sig", "left").select("id", "n", "rep"), "members")
    forget(full)

    cells = counted_cells(nodes.select(F.explode("sketch").alias("v")))
    listed = nodes.mapInPandas(_listed(cells, percent), "id bigint, keys array<bigint>").select("id", F.explode("keys").alias("v"))
    listed = saved(listed, "listed")
    # a table of its own, as with reps: a value that very many nodes are listed under can be split; it grows with the corpus, so it
    # is never broadcast
    lists = saved(listed.groupBy("v").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where(F.col("size") > 1), "lists")
    shared = saved(listed.join(lists.hint("merge"), "v"), "shared")
    forget(listed)
    forget(lists)

    stars = shared.where(F.col("id") != F.col("pivot")).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _verified(stars, nodes, sets, texts, words, percent)
    first = components(links, "star-components")

    # what is left: lists whose members are in several components
    left = shared.join(first, "id", "left").select("v", "id", "size", "pivot", F.coalesce("component", "id").alias("component"))
    open_lists = left.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = saved(left.join(open_lists.select("v"), "v"), "open-lists")
    forget(shared)

    short = left.where(F.col("size") <= SHORT_LIST).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "component", "pivot"))).alias("m"))
    short = short.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    met = (F.col("x.component") != F.col("y.component")) & (F.col("x.id") != F.col("x.pivot")) & (F.col("y.id") != F.col("y.pivot"))
    pairs = short.where(met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = _verified(pairs, nodes, sets, texts, words, percent)

    long = left.where(F.col("size") > SHORT_LIST)
    clusters = components(long.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "clusters")
    parts = long.select("id", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id", "left")
    parts = parts.withColumn("cluster", F.coalesce("cluster", "id"))
    sizes = parts.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = parts.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))
    )
    parts = saved(parts.withColumn("meet", F.explode(meets)).select("id", "component", "cluster", "block", "meet.i", "meet.j"), "block-parts")
    blocks = parts.join(texts.where(F.col("text").isNotNull()), "id").groupBy("cluster", "i", "j").applyInPandas(_block_links(words, percent), "a bigint, b bigint")

    # an id with several texts: one component for all
    members = members.select("id", "n", F.coalesce("rep", "id").alias("node"))
    several = members.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    own = members.where(F.col("id") != F.col("node")).join(several.select("id"), "id").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()

    edges = links.unionByName(more).unionByName(blocks).unionByName(own)
    forget(nodes)
    forget(sets)
    final = components(edges, "components").withColumnRenamed("id", "node")
    for table in (links, more, left, parts):
        forget(table)
    found = members.join(final, "node", "left").select("id", "n", F.coalesce("component", "node").alias("component"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
