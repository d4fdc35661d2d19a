"""Repeated passages by fixed-block anchors.

A window is a run of words of one document. A window that repeats an earlier one of 2 * BLOCK - 1 words or more holds one of
the earlier document's blocks: BLOCK consecutive words that begin at a multiple of BLOCK. So:

1. Texts go into containers of bounded size, a table bucketed by container, so that what later steps find out comes to the texts
   and the texts are never shuffled.
2. The non-overlapping blocks are the index, every rolling window of BLOCK words is a probe. Both are dealt out by hash, a container's values
   in one row for each bucket of hashes, each value once. A block that is found at another place too is an anchor. Of each row only a bit for
   each value returns.
3. Around the anchors, windows of the asked length are compared: again a container sends each value once, with its first place, and a bit
   comes back that says whether another container has it earlier. Windows that are not the first of their kind overlap to maximal repeats,
   which go.

So a passage that very many documents share costs one value for each container that holds it, and no pairs are made. Hashes of words and windows
have 64 bits; a bucket's own number adds to them. Of n compared windows in b buckets, two that differ are taken for equal with a chance of
n * n / (b * 2**65), 2e-6 for a hundred million in a hundred buckets.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shingles import PIECE, mix, word_hashes
from .storage import fresh_path, saved, short_batches

BLOCK = 10
#: Bytes of text of a container, about (a longer text has one of its own), and of texts whose windows share a bucket of hashes.
CONTAINER_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
#: Containers of a file of the bucketed table, about.
CONTAINERS_OF_FILE = 2
LEAST_BUCKETS = 8
#: Null ids come last.
LAST = np.iinfo(np.int64).max
PROBES = "bucket int, container bigint, step int, size int, planes binary, block binary, several binary"
PLACES = "bucket int, container bigint, size int, hashes binary, ids binary, sums binary, spots binary"
BITS = "container bigint, bucket int, bits binary"
RESULT = "n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>, id bigint"


def _packed(limit: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, nameless, texts, size = [], [], [], 0
        row = lambda: pd.DataFrame({"container": [uuid.uuid4().int >> 65], "ids": [ids], "nameless": [nameless], "texts": [texts]})
        for batch in batches:
            for i, without, text in zip(batch["id"], batch["nameless"], batch["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if texts and size + len(data) > limit:
                    yield row()
                    ids, nameless, texts, size = [], [], [], 0
                ids.append(i)
                nameless.append(without)
                texts.append(data)
                size += len(data) + 64
        if texts:
            yield row()

    return fn


class Windows:
    """All windows of a container, in the order of its documents: by id, then text.

    first: the word each document begins with (and the end of all); starts (of runs of BLOCK) and places (of whole windows) are word
    numbers; roll and whole are their hashes.
    """

    def __init__(self, ids: list, texts: list[bytes], words: int) -> None:
        keys = [int(i) for i in ids]
        sums = [zlib.crc32(t) for t in texts]
        self.order = sorted(range(len(texts)), key=lambda i: (keys[i], sums[i], texts[i]))
        self.keys = np.array([keys[i] for i in self.order], np.int64)
        self.sums = np.array([sums[i] for i in self.order], np.int64)
        self.texts, self.words = [texts[i] for i in self.order], words
        hashes, counts, at = [np.zeros(0, np.uint64)], [], 0
        while at < len(self.texts):
            stop, size = at, 0
            while stop < len(self.texts) and (stop == at or size + len(self.texts[stop]) < PIECE):
                size += len(self.texts[stop]) + 1
                stop += 1
            start, h = word_hashes(np.frombuffer(b"".join(t + b" " for t in self.texts[at:stop]), np.uint8))
            ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in self.texts[at:stop]]))
            counts += np.diff(ends, prepend=0).tolist()
            hashes.append(h)
            at = stop
        self.first = np.r_[0, np.cumsum(np.array(counts, np.int64))].astype(np.int64)
        word = np.concatenate(hashes)
        self.starts, self.roll = self._runs(word, BLOCK, 1)
        self.places, self.whole = self._runs(word, words, 2)

    def _runs(self, word: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of n words of one document begin, and their hashes."""
        inside = np.ones(len(word) + 1, bool)
        some = self.first[1:] > self.first[:-1]
        begin, end = self.first[:-1][some], self.first[1:][some]
        for back in range(1, n):
            inside[np.maximum(end - back, begin)] = False
        at = np.flatnonzero(inside[:-1])
        turn = mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out += word[at + j] * turn[j]
        return at, mix(out)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _probes(w: Windows, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct probes by bucket and value (bucket and the low half of the hash), for each: is it a block, is it there more than once; and of each run its probe."""
    key = (_bucket(w.roll, buckets).astype(np.uint64) << np.uint64(32)) | (w.roll & np.uint64(0xFFFFFFFF))
    values, which, count = np.unique(key, return_inverse=True, return_counts=True)
    doc = w.document(w.starts)
    block = np.zeros(len(values), bool)
    block[which[(w.starts - w.first[doc]) % BLOCK == 0]] = True
    return (values >> np.uint64(32)).astype(np.int64), (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), block, count > 1, which


def _to_planes(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as steps, their bytes in planes: the upper ones are mostly 0 and compress."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)


def _cuts(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each run of an ascending array of bucket numbers."""
    edge = [*np.flatnonzero(np.diff(buckets, prepend=-1)).tolist(), len(buckets)]
    return ((int(buckets[a]), a, b) for a, b in zip(edge[:-1], edge[1:], strict=True))


def _probing(words: int, buckets: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                bucket, value, block, several, _ = _probes(Windows(list(r.ids), list(r.texts), words), buckets)
                rows = [(k, r.container, 0, b - a, _to_planes(value[a:b]), _bits(block[a:b]), _bits(several[a:b])) for k, a, b in _cuts(bucket)]
                yield pd.DataFrame(rows, columns=["bucket", "container", "step", "size", "planes", "block", "several"])

    return fn


def _anchored(group: pd.DataFrame) -> pd.DataFrame:
    """For each row of a bucket, which of its probes are anchors: blocks that are found at more than one place."""
    values = [_from_planes(p) for p in group["planes"]]
    distinct, which, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    block, several = np.zeros(len(distinct), bool), count > 1
    for flags, column in ((block, "block"), (several, "several")):
        flags[which[np.concatenate([_flags(x, n) for x, n in zip(group[column], group["size"], strict=True)])]] = True
    found = np.split((block & several)[which], np.cumsum([len(v) for v in values])[:-1])
    return pd.DataFrame({"container": group["container"].array, "bucket": group["bucket"].array, "bits": [_bits(f) if f.any() else None for f in found]})


def _told(rows, sizes: list[tuple[int, int, int]]) -> np.ndarray:
    """The bits of all buckets in one array; a bucket without a row has none set."""
    found = {r["bucket"]: r["bits"] for r in rows} if rows is not None else {}
    out = [_flags(found[k], b - a) if found.get(k) else np.zeros(b - a, bool) for k, a, b in sizes]
    return np.concatenate(out) if out else np.zeros(0, bool)


def _compared(w: Windows, anchors, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows around anchors: distinct hashes by bucket, the first window of each, all such windows and of each its hash."""
    bucket, _, _, _, which = _probes(w, buckets)
    hit = np.zeros(int(w.first[-1]) + 1, np.int64)
    hit[w.starts] = _told(anchors, list(_cuts(bucket)))[which] if len(w.starts) else 0
    total = np.r_[0, np.cumsum(hit)]
    near = np.flatnonzero(total[w.places + w.words - BLOCK + 1] - total[w.places] > 0)  # an anchor begins in the window and ends in it
    h = w.whole[near]
    order = np.lexsort((near, h, _bucket(h, buckets)))
    new = np.r_[True, h[order][1:] != h[order][:-1]] if len(order) else np.zeros(0, bool)
    kind = np.empty(len(near), np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = near[order[new]]
    return _bucket(w.whole[lead], buckets), lead, near, kind


def _comparing(words: int, buckets: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                w = Windows(list(r.ids), list(r.texts), words)
                bucket, lead, _, _ = _compared(w, r.anchors, buckets)
                # in the order of places, in which ids and sums repeat and compress; the hashes' own order is found again from them
                rows = []
                for k, a, b in _cuts(bucket):
                    turn = np.argsort(lead[a:b], kind="stable")
                    doc = w.document(w.places[lead[a:b][turn]])
                    spot = w.places[lead[a:b][turn]] - w.first[doc]
                    columns = (w.whole[lead[a:b][turn]].astype("<u8"), w.keys[doc].astype("<i8"), w.sums[doc].astype("<u4"), spot.astype("<u4"))
                    rows.append((k, r.container, b - a, columns[0].tobytes(), *(_planes(c) for c in columns[1:])))
                yield pd.DataFrame(rows, columns=["bucket", "container", "size", "hashes", "ids", "sums", "spots"])

    return fn


def _planes(values: np.ndarray) -> bytes:
    """Differences (modulo their width) in planes of bytes."""
    width = values.dtype.itemsize
    steps = np.diff(values.view(f"<u{width}"), prepend=np.zeros(1, f"<u{width}"))
    return steps.view(np.uint8).reshape(-1, width).T.tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()
    return np.cumsum(steps, dtype=f"<u{width}").view(kind)


def _earlier(group: pd.DataFrame) -> pd.DataFrame:
    """For each row of a bucket, which of its windows another container has earlier; bits in ascending order of hashes."""
    h = np.concatenate([np.frombuffer(x, "<u8") for x in group["hashes"]])
    columns = [np.concatenate([_unplaned(x, kind) for x in group[c]]) for c, kind in (("spots", "<u4"), ("sums", "<u4"), ("ids", "<i8"))]
    size = group["size"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(group)), size)
    container = group["container"].to_numpy(np.int64)[row]
    order = np.lexsort((container, columns[0], columns[1], columns[2], h))
    later = np.zeros(len(h), bool)
    later[order] = np.r_[False, h[order][1:] == h[order][:-1]] if len(order) else False
    by_hash = np.lexsort((h, row))
    found = np.split(later[by_hash], np.cumsum(size)[:-1])
    return pd.DataFrame({"container": group["container"].array, "bucket": group["bucket"].array, "bits": [_bits(f) if f.any() else None for f in found]})


def _kept(words: int, buckets: int):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                w = Windows(list(r.ids), list(r.texts), words)
                bucket, lead, near, kind = _compared(w, r.anchors, buckets)
                later = _told(r.earlier, list(_cuts(bucket)))
                gone = later[kind] | (lead[kind] != near) if len(near) else np.zeros(0, bool)
                edge = np.zeros(int(w.first[-1]) + 1, np.int64)
                np.add.at(edge, w.places[near[gone]], 1)
                np.add.at(edge, w.places[near[gone]] + words, -1)
                covered = np.cumsum(edge)[:-1] > 0
                out = []
                for text, a, b in zip(w.texts, w.first[:-1], w.first[1:], strict=True):
                    cover = covered[a:b]
                    own = text.split()
                    digest = hashlib.sha256(b" ".join(own if not cover.any() else [own[j] for j in np.flatnonzero(~cover)])).hexdigest()
                    turn = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
                    spans = [{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)]
                    out.append((b - a, int(cover.sum()), digest, spans))
                found = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "removed"])
                yield found.assign(id=pd.array([None if r.nameless[i] else int(r.ids[i]) for i in w.order], "Int64"))

    return fn


def _with_bits(table: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """The containers with the bits that came back for them; the table's bucketing spares its side the shuffle."""
    own = bits.where("bits IS NOT NULL").groupBy("container").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))  # a container's own values
    return table.join(own.hint("shuffle_hash"), "container", "left")


def remove_repeats(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the words of windows that start earlier too: in a smaller id, or earlier in the same document.

    Words are runs without ASCII white space, unchanged. All windows are judged on the input. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words, joined by one space) and removed (maximal runs of removed words: start, end, counted from 0).

    words: 2 * BLOCK - 1 at least. Null, empty and blank texts have no words and nothing to remove; texts of fewer words lose none. Null ids are
    later than all others. Rows that repeat an id are documents of their own, in the order of their texts' checksums; of equal rows all
    but one lose what repeats. Very long texts are containers of their own. An empty table gives no rows; other columns may have any name.
    """
    if words < 2 * BLOCK - 1:
        raise ValueError(f"a window of {words} words may hold no block of {BLOCK}")
    spark = docs.sparkSession
    short_batches(spark)
    key = F.col(id_col).cast("bigint")
    texts = docs.select(F.coalesce(key, F.lit(LAST)).alias("id"), key.isNull().alias("nameless"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    buckets, files = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), max(LEAST_BUCKETS, -(-size // (CONTAINERS_OF_FILE * CONTAINER_BYTES)))
    name = f"containers_{uuid.uuid4().hex}"
    packed = texts.mapInPandas(_packed(CONTAINER_BYTES), "container bigint, ids array<bigint>, nameless array<boolean>, texts array<binary>")
    packed.write.bucketBy(min(files, 100_000), "container").option("path", fresh_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)

    probes = table.mapInPandas(_probing(words, buckets), PROBES)
    anchors = saved(probes.groupBy("bucket").applyInPandas(_anchored, BITS), "anchor-bits")
    around = _with_bits(table, anchors, "anchors").mapInPandas(_comparing(words, buckets), PLACES)
    earlier = saved(around.groupBy("bucket").applyInPandas(_earlier, BITS), "earlier-bits")
    both = _with_bits(_with_bits(table, anchors, "anchors"), earlier, "earlier")
    return both.mapInPandas(_kept(words, buckets), RESULT).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "removed")
