"""Token ids in files, packed by a static range asymmetric numeral system.

Documents are range-partitioned and sorted by id, so the files, taken by name, hold them in ascending order.
Each file is a run of independent blocks of whole documents. One frequency table, counted over all tokens,
serves every block. In a block, tokens are dealt round robin to interleaved lanes, each a coder of its own with a
64-bit state, and all lanes advance together as numpy vectors. Every ``CHECKPOINT`` steps the block keeps the
lane states and the place in the word stream, so the parts of a block decode side by side, as do blocks and files.
Blocks carry checksums of their body and of the ids they decode to; a mismatch raises.

File: ``RANS0001``, then blocks. Block: 8 little-endian uint32 (body bytes, crc32 of the body, crc32 of the ids,
documents, tokens, lanes, checkpoints, words), then the body: document ids (int64), null flags (uint8),
lengths (uint32), checkpoint places (uint32), checkpoint states (uint64, lanes each), words (uint32).
Beside the files, ``table.freq`` has the scaled frequencies (uint32 for each id, then their crc32).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .storage import forget, fresh_path, put_file, saved, short_batches

MAGIC = b"RANS0001"
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 1024
CHECKPOINT = 128
#: Tokens of a block and bytes of a file, about; a block holds whole documents.
BLOCK_TOKENS = 524_288
FILE_BYTES = 8 << 20
#: Words that a worker remembers the ids of; beyond it starts afresh.
KEPT_WORDS = 1_000_000
END_ID = 2


# -- the coder -----------------------------------------------------------------------------------------------


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE; every id that occurs keeps at least 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * (1 << SCALE) // total), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE)
    for i in np.argsort(-freq, kind="stable"):  # rounding up rare ids takes from the most frequent ones
        if not over:
            break
        step = over if over < 0 else min(over, int(freq[i]) - 1)
        freq[i] -= step
        over -= step
    return freq.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes, checkpoint places, checkpoint states and words of a run of ids."""
    n = len(ids)
    lanes = 1
    while lanes < LANES and lanes * 128 <= n:
        lanes *= 2
    steps = -(-n // lanes)
    f_all = freq[ids].astype(np.uint64)
    c_all = start[ids].astype(np.uint64)
    limit = f_all << np.uint64(31 - SCALE + 32)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    taken = np.zeros(steps, np.int64)
    states: list[np.ndarray] = []
    for s in range(steps - 1, -1, -1):
        at = s * lanes
        f, c, top = f_all[at : at + lanes], c_all[at : at + lanes], limit[at : at + lanes]
        own = x[: len(f)]
        full = own >= top
        out = own[full]
        words.append(out.astype(np.uint32))
        taken[s] = len(out)
        own[full] = out >> np.uint64(32)
        q = own // f
        own += q * ((np.uint64(1) << np.uint64(SCALE)) - f) + c  # (q << SCALE) + (x - q * f) + c
        if s % CHECKPOINT == 0:
            states.append(x.copy())
    place = np.concatenate(([0], np.cumsum(taken)))[:-1][::CHECKPOINT] if steps else np.zeros(0)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return lanes, place.astype(np.uint32), np.array(states[::-1], np.uint64).reshape(-1, lanes), stream


def decode_block(n: int, lanes: int, place: np.ndarray, states: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids again. Full parts between checkpoints go together, the last part by itself."""
    out = np.empty(n, symbols.dtype)
    part = CHECKPOINT * lanes
    parts = n // part
    mask = np.uint64((1 << SCALE) - 1)
    for first, count, tokens in ((0, parts, part), (parts, int(n > parts * part), n - parts * part)):
        if not count or not tokens:
            continue
        x = states[first : first + count].copy()
        p = place[first : first + count].astype(np.int64)
        to = out[first * part : first * part + count * tokens].reshape(count, tokens)
        for at in range(0, tokens, lanes):
            width = min(lanes, tokens - at)
            own = x[:, :width]
            slot = own & mask
            sym = symbols[slot]
            to[:, at : at + width] = sym
            own = freq[sym] * (own >> np.uint64(SCALE)) + slot - start[sym]
            low = own < LOW
            turn = np.cumsum(low, axis=1)
            index = (p[:, None] + turn - 1)[low]
            own[low] = (own[low] << np.uint64(32)) | words[index]
            p += turn[:, -1]
            x[:, :width] = own
    return out


def pack_block(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    lanes, place, states, words = encode_block(ids, freq, start)
    body = b"".join(
        (
            doc_ids.astype("<i8").tobytes(),
            nulls.astype("u1").tobytes(),
            lengths.astype("<u4").tobytes(),
            place.astype("<u4").tobytes(),
            states.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        )
    )
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack("<8I", len(body), zlib.crc32(body), crc, len(doc_ids), len(ids), lanes, len(place), len(words)) + body


def unpack_blocks(data: bytes, freq: np.ndarray, start: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, null flags, lengths, ids as uint32) of each block of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 8
    while at < len(data):
        size, body_crc, ids_crc, docs, n, lanes, checks, n_words = struct.unpack_from("<8I", data, at)
        body = memoryview(data)[at + 32 : at + 32 + size]
        if len(body) != size or zlib.crc32(body) != body_crc:
            raise ValueError(f"block at byte {at}: its body doesn't match its checksum")
        cut = np.cumsum([0, 8 * docs, docs, 4 * docs, 4 * checks, 8 * checks * lanes, 4 * n_words])
        piece = [body[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        ids = decode_block(
            n,
            lanes,
            np.frombuffer(piece[3], "<u4"),
            np.frombuffer(piece[4], "<u8").reshape(checks, lanes),
            np.frombuffer(piece[5], "<u4").astype(np.uint64),
            freq,
            start,
            symbols,
        ).astype("<u4")
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError(f"block at byte {at}: its ids don't match their checksum")
        yield np.frombuffer(piece[0], "<i8"), np.frombuffer(piece[1], "u1"), np.frombuffer(piece[2], "<u4"), ids
        at += 32 + size


def decoding_tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies and starts as uint64, and the id of each of the 2**SCALE slots."""
    start = np.concatenate(([0], np.cumsum(freq, dtype=np.int64)))[:-1]
    kind = np.uint16 if len(freq) <= 1 << 16 else np.uint32
    return freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=kind), freq)


# -- the tokenizer -------------------------------------------------------------------------------------------


class TextEncoder:
    """Ids of a text with a byte-level BPE file of the tokenizers library, word by word, remembering words.

    The file's pre-tokenizer never joins a character with the white space after it, so a text can be cut before each
    run of white space and the ids of the parts put together. A text that holds the string of a token added to the file
    (an end-of-text mark, say) goes to the library whole, as such a token is found before anything is split.
    """

    CONTROL = re.compile(r"[\x1c-\x1f]")
    UNIT = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.kind = kind
        # the letters that stand for bytes in the vocabulary, read off the pre-tokenizer itself
        latin = [chr(b) for b in range(0x80, 0x100)]
        forms = {c: self.split.pre_tokenize_str(c)[0][0] for c in latin if c.isalpha()}
        self.byte_letters = {b: f for c, f in forms.items() for b, f in zip(c.encode(), f, strict=True)}
        self.letters = re.compile("[" + re.escape("".join(c for c in forms)) + "A-Za-z]+").fullmatch
        self.units = _Remembered(self.ids_of)
        self.words = _Remembered(self._word)
        self.starts = _Remembered(self._start)
        self.packed = _Remembered(struct.Struct(np.dtype(kind).str.replace("u2", "H").replace("u4", "I")).pack)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def ids_of(self, unit: str) -> bytes:
        return b"".join([self._piece(piece) for piece, _ in self.split.pre_tokenize_str(unit)])

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        """The ids of a word with the space before it."""
        return self._marked(word, "\u0120", self.words, " ")

    def _start(self, word: str) -> bytes:
        """The ids of a word that begins a line."""
        return self._marked(word, "", self.starts, "")

    def _marked(self, word: str, before: str, known: "_Remembered", space: str) -> bytes:
        """Letters are one piece with the space before them; a mark after letters is a piece of its own."""
        if not word:
            raise _OtherSpaces
        if word.isascii() and word.isalpha():
            return self._piece(before + word)
        if self.letters(word):
            return self._piece(before + word.encode().decode("latin-1").translate(self.byte_letters))
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return known[word[:-1]] + self.units[word[-1]]
        return self.ids_of(space + word)

    def _line(self, line: str) -> bytes:
        words = line.split(" ")
        words[0] = self.starts[words[0]]
        words[1:] = map(self.words.__getitem__, words[1:])
        return b"".join(words)

    def encode(self, text: str) -> bytes:
        if any(map(text.__contains__, self.added)):
            return self._whole(text)
        if text.replace("\n", "").isprintable():
            try:
                return self.units["\n"].join(map(self._line, text.split("\n")))
            except _OtherSpaces:
                pass
        if self.CONTROL.search(text):
            return self._whole(text)
        return b"".join(map(self.units.__getitem__, self.UNIT.findall(text)))


class _OtherSpaces(Exception):
    """A text has white space besides single spaces and single line ends."""


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, kind: str) -> TextEncoder:
    """The worker's own encoder: what it remembers serves the tasks that follow."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = TextEncoder(path, kind)
    return _encoders[path, kind]


def _blocks(tokenizer_path: str, kind: str, end_id: int):
    """Documents of a sorted partition to rows of whole documents with about BLOCK_TOKENS ids."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = text_encoder(tokenizer_path, kind)
        part, width = TaskContext.get().partitionId(), np.dtype(kind).itemsize
        end = np.array([end_id], kind).tobytes()
        block, docs, lens, ids, tokens = 0, [], [], [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "block": [block], "doc_ids": [docs], "lengths": [lens], "ids": [b"".join(ids)]})

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = (coder.encode(text) if text else b"") + end
                docs.append(None if pd.isna(doc) else int(doc))
                lens.append(len(own) // width)
                ids.append(own)
                tokens += lens[-1]
                if tokens >= BLOCK_TOKENS:
                    yield row()
                    block, docs, lens, ids, tokens = block + 1, [], [], [], 0
        if docs:
            yield row()

    return fn


# -- the operator --------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, vocab: int, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Tokenizes whole texts and writes the files; returns their folder and the list of files.

    A null text counts as empty and gives the end id alone. Repeated ids follow each other, by a hash of the text, then the text; null
    ids come first. An empty table gives a folder with only the table of frequencies.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the digest lets the rows of one id lie in several ranges
    ordered = ordered.withColumn("digest", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").drop("digest")
    schema = "part int, block int, doc_ids array<bigint>, lengths array<int>, ids binary"
    blocks = saved(ordered.mapInPandas(_blocks(tokenizer_path, kind, end_id), schema), "token-blocks", codec="zstd")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                total += np.bincount(np.frombuffer(ids, kind), minlength=vocab)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    # one number for each id of the vocabulary at most
    seen = blocks.select("ids").mapInPandas(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in seen:
        counts[r["id"]] = r["n"]
    freq = scaled_frequencies(counts)
    path = fresh_path(spark, "token-files")
    table = freq.astype("<u4").tobytes()
    put_file(f"{path}/table.freq", table + struct.pack("<I", zlib.crc32(table)))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = np.concatenate(([0], np.cumsum(freq, dtype=np.int64)))[:-1]
        attempt = TaskContext.get().taskAttemptId()
        key, after, held, size = None, None, [], 0

        def file() -> pd.DataFrame:
            name = f"{key[0]:08d}-{key[1]:08d}-{attempt}.rans"
            put_file(f"{path}/{name}", MAGIC + b"".join(held))
            return pd.DataFrame({"part": [key[0]], "block": [key[1]], "name": [name], "blocks": [len(held)]})

        for batch in batches:
            for r in batch.itertuples():
                if held and (size >= FILE_BYTES or (r.part, r.block) != after):
                    yield file()
                    held, size = [], 0
                if not held:
                    key = (r.part, r.block)
                after = (r.part, r.block + 1)
                ids = [0 if x is None or pd.isna(x) else int(x) for x in r.doc_ids]
                nulls = [x is None or pd.isna(x) for x in r.doc_ids]
                held.append(pack_block(np.array(ids, np.int64), np.array(nulls), np.array(r.lengths), np.frombuffer(r.ids, kind), freq, start))
                size += len(held[-1])
        if held:
            yield file()

    files = saved(blocks.mapInPandas(write, "part int, block int, name string, blocks int"), "token-file-list")
    forget(blocks)
    return path, files


def read_token_files(spark: SparkSession, path: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""
    fs, place = pafs.FileSystem.from_uri(f"{path}/table.freq")
    with fs.open_input_stream(place) as f:
        data = f.read()
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the table of frequencies doesn't match its checksum")
    freq = np.frombuffer(data[:-4], "<u4")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = decoding_tables(freq)
        for batch in batches:
            for part, block, content in zip(batch["part"], batch["block"], batch["content"], strict=True):
                turn = 0
                for docs, nulls, lengths, ids in unpack_blocks(content, *tables):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    cut = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                    out = pd.DataFrame(
                        {
                            "part": np.int32(part),
                            "block": np.int32(block),
                            "turn": np.arange(turn, turn + len(docs)),
                            "doc_id": pd.array(np.where(nulls, 0, docs), "Int64"),
                            "n_tokens": lengths.astype(np.int64),
                            "ids_crc32": [zlib.crc32(c) for c in cut],
                        }
                    )
                    out.loc[nulls.astype(bool), "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = [c.astype(np.int32) for c in cut]
                    turn += len(docs)
                    yield out

    more = ", ids array<int>" if with_ids else ""
    schema = f"part int, block int, turn bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint{more}"
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(path)
    content = content.select(F.substring_index("path", "/", -1).alias("name"), "content")
    docs = content.join(files.select("part", "block", "name"), "name").select("part", "block", "content").mapInPandas(decode, schema)
    inside = Window.partitionBy("part").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, -1)
    docs = saved(docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))), "token-docs")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("offset"))
    kept = ["doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return docs.join(parts, "part").select(*kept)
