from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dossier.llm import piece_sampling as S
from dossier.llm.shingles import mix

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattices():
    return S.Lattices(S.Vocabulary(PATH, 0.5))


def every(lattices, text):
    """All segmentations and their log probabilities, by walking the lattice."""
    states, out = lattices.states(S.words_of(text)), {}

    def go(word, state, path, logp):
        if state < 0:
            if word + 1 == len(states):
                out[tuple(path)] = logp
                return
            word, state = word + 1, int(states[word + 1])
        for e in range(lattices.first[state], lattices.first[state + 1]):
            go(word, int(lattices.next[e]), [*path, int(lattices.code[e])], logp + lattices.logp[e])

    go(0, int(states[0]), [], 0.0)
    return out


def test_sampling_without_replacement(lattices):
    chance = every(lattices, "the of in")
    assert abs(sum(np.exp(list(chance.values()))) - 1) < 1e-9
    n, first, pairs, horvitz = 12_000, collections.Counter(), collections.Counter(), 0.0
    for found, threshold in S.sample_batch(lattices, ["the of in"] * n, mix(np.arange(n, dtype=np.uint64)), 3):
        keys = [tuple(lattices.code[p].tolist()) for _, _, p in found]
        assert len(set(keys)) == 3 and all(abs(l - chance[k]) < 1e-9 for k, (_, l, _) in zip(keys, found, strict=True))
        numbers = [g for g, _, _ in found] + [threshold]
        assert numbers == sorted(numbers, reverse=True)
        first[keys[0]] += 1
        pairs[keys[0], keys[1]] += 1
        horvitz += sum(np.exp(l) / -np.expm1(-np.exp(l - threshold)) for _, l, _ in found) / n
    for k, c in first.most_common(3):
        assert abs(c / n - np.exp(chance[k])) < 0.02
    for (a, b), c in pairs.most_common(3):
        assert abs(c / n - np.exp(chance[a]) * np.exp(chance[b]) / -np.expm1(chance[a])) < 0.02
    assert abs(horvitz - 1) < 0.01  # inclusion scores make the sample's weights sum to one on average


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é\nñ梦😀  .t")), max_size=30))
def test_round_trip_and_company(text):
    lattices = S.worker_lattices(PATH, 0.5)
    seeds = np.array([1, 2, 3], np.uint64)
    alone = S.sample_batch(lattices, [text], seeds[1:2], 3)[0]
    other = S.sample_batch(lattices, ["x y z", text, "the"], seeds, 3)[1]
    assert [(g, l, lattices.code[p].tolist()) for g, l, p in alone[0]] == [(g, l, lattices.code[p].tolist()) for g, l, p in other[0]]
    for _, _, p in alone[0]:
        assert lattices.v.decode(lattices.v.ids(lattices.code[p])) == text


def test_all_segmentations_of_a_short_text(lattices):
    found, threshold = S.sample_batch(lattices, ["of"], np.array([9], np.uint64), 50)[0]
    assert len(found) == len(every(lattices, "of")) and threshold == -np.inf


def test_documents(spark):
    rows = [(1, "Hello world. " * 300, 1), (2, "", 1), (3, None, 1), (None, "no id", 1), (1, "other text", 1), (4, "Hola", 1), (4, "Hola", 1), (5, "a" * 3000, 1), (6, "▁", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int")
    out = S.sample_pieces(docs, PATH, with_ids=True)
    got = out.toPandas()
    assert got.groupby("sample").size().to_dict() == {1: 9, 2: 7}
    assert got[got["doc_id"].isin([2, 3])]["n_ids"].tolist() == [0, 0] and (got[got["doc_id"] == 4].groupby("sample")["ids_crc32"].nunique() == 1).all()
    assert ((got["inclusion"] > 0) & (got["inclusion"] <= 1)).all() and set(got[~got["round_trip"]]["doc_id"]) == {6}
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_ids for r in got.itertuples())
    texts = {r["t"] for r in out.where("doc_id = 1").select(S.decode_pieces(PATH, F.col("ids")).alias("t")).collect()}
    assert texts == {"Hello world. " * 300, "other text"}
    again = S.sample_pieces(docs.repartition(4), PATH).toPandas()
    columns = ["doc_id", "sample", "ids_crc32", "log_prob", "perturbed", "inclusion"]
    tidy = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(again))


def test_empty(spark):
    assert S.sample_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
