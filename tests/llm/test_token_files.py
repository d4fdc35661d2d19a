from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from dossier.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def coder(ids):
    freq = T.scaled_frequencies(np.bincount(ids, minlength=50_257))
    return freq, np.concatenate(([0], np.cumsum(freq, dtype=np.int64)))[:-1]


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 4097, 131_072, 300_001])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype("<u2")
    freq, start = coder(ids)
    assert n == 0 or freq.sum() == 1 << T.SCALE
    data = T.MAGIC + 2 * T.pack_block(np.array([3]), np.array([0]), np.array([n]), ids, freq, start)
    found = list(T.unpack_blocks(data, *T.decoding_tables(freq)))
    assert len(found) == 2 and all((f[3] == ids).all() for f in found)


def test_damage_is_noticed():
    ids = np.arange(1000, dtype="<u2")
    freq, start = coder(ids)
    data = bytearray(T.MAGIC + T.pack_block(np.array([3]), np.array([0]), np.array([1000]), ids, freq, start))
    data[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(T.unpack_blocks(bytes(data), *T.decoding_tables(freq)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab é,.'\n\t\r  　\x1c12ßñ😀!", "<|endoftext|>", "<|endof"]), max_size=40).map("".join))
def test_encoder_equals_library(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_library, "t") else test_encoder_equals_library.t
    test_encoder_equals_library.t = library
    assert np.frombuffer(T.text_encoder(PATH, "<u2").encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    texts = ["a b", "", None, "x " * 9000, "it's  odd\n\n text", "<|endoftext|>", "a b"]
    rows = [(i * 3 % 7, t, i) for i, t in enumerate(texts)] + [(None, "null id", 0), (2, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path, files = T.write_token_files(docs, PATH, vocab=50_257)
    out = T.read_token_files(spark, path, files, with_ids=True).toPandas().sort_values("start", kind="stable")
    order = [-1 if r[0] is None else r[0] for r in rows]
    assert out["doc_id"].fillna(-1).tolist() == sorted(order)
    pool = [(d, [*library.encode(text or "", add_special_tokens=False).ids, T.END_ID]) for d, (_, text, _) in zip(order, rows, strict=True)]
    at = 0
    for r in out.fillna({"doc_id": -1}).itertuples():
        pool.remove((r.doc_id, list(r.ids)))
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    assert not pool


def test_empty(spark):
    path, files = T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, vocab=50_257)
    assert T.read_token_files(spark, path, files).count() == 0
