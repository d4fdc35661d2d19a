from __future__ import annotations

import hashlib

import numpy as np
import pytest

from dossier.llm import repeats


def words_of(text):
    return [w for w in (text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]


def brute(rows, n=20):
    """Rows in the order of id, a null last; repeated ids in the order of their texts' checksums."""
    import zlib

    held = sorted(((i is None, i or 0, zlib.crc32((t or "").encode()), i, words_of(t)) for i, t in rows), key=lambda r: r[:3])
    first, out = {}, []
    for at, (*_, w) in enumerate(held):
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), (at, j))
    for at, (*_, i, w) in enumerate(held):
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] != (at, j):
                gone |= {*range(j, j + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, [2], "x") for i, t in rows], "doc_id long, text string, id int, container array<int>, bits string")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passages = [word(int(n)) for n in rng.integers(19, 60, 12)]
    out = []
    for i in rng.permutation(400):
        text = word(int(rng.integers(0, 50)))
        for _ in range(int(rng.integers(0, 4))):
            text += passages[int(rng.integers(0, 12))][int(rng.integers(0, 3)) :] + word(int(rng.integers(0, 12)))
        out.append((int(i), " ".join(text)))
    copy = " ".join(word(70))
    out += [(1000 + i, copy) for i in range(200)] + [(2000 + i, copy[: 300 + i]) for i in range(30)]
    line = " ".join(word(7)) + "\n"
    out += [(3000, line * 30), (3001, "a " * 500 + "b"), (3002, "a " * 19), (3003, "a " * 20), (3004, "a b " * 25), (3005, "A " * 25)]
    out += [(None, copy), (None, None), (4000, None), (4001, ""), (4002, " \t\n "), (5, copy), (5, "other text here"), (1003, copy), (1003, copy), (2**53 + 1, "ünï " * 45)]
    return [*out, (6000, " ".join(word(40_000) + passages[3] + word(10))), (-3, " ".join(passages[3]))]


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "CONTAINER_BYTES", 20_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 40_000)
    out = found(repeats.remove_repeats(table(spark, rows)))
    assert out == brute(rows)


def test_other_lengths_and_spans(spark, rows):
    some = rows[:150]
    for n in (19, 33):
        df = repeats.remove_repeats(table(spark, some), words=n)
        assert found(df) == brute(some, n)
    for r in df.collect():
        spans = r["removed"]
        assert sum(s["end"] - s["start"] for s in spans) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False)) and all(s["end"] - s["start"] >= 33 for s in spans)
    with pytest.raises(ValueError, match="no block"):
        repeats.remove_repeats(table(spark, some), words=18)


def test_blocks_found_by_windows_at_all_offsets(spark):
    rng = np.random.default_rng(1)
    run = " ".join(f"r{x}" for x in rng.integers(0, 10**6, 20))
    rows = [(i, " ".join(f"p{i}x{j}" for j in range(i)) + " " + run + f" e{i}") for i in range(25)]
    assert found(repeats.remove_repeats(table(spark, rows))) == brute(rows)
    assert sum(r[2] for r in brute(rows)) == 24 * 20


def test_planes_and_bits():
    rng = np.random.default_rng(0)
    v = np.unique(rng.integers(0, 2**32, 1000, dtype=np.uint32))
    assert (repeats._from_planes(repeats._to_planes(v)) == v).all()
    for kind in ("<u4", "<i8"):
        x = rng.integers(-(2**31), 2**31, 500).astype(kind)
        assert (repeats._unplaned(repeats._planes(x), kind) == x).all()
    flags = rng.random(77) < 0.5
    assert (repeats._flags(repeats._bits(flags), 77) == flags).all()


def test_empty(spark):
    assert found(repeats.remove_repeats(table(spark, []))) == []
    assert found(repeats.remove_repeats(table(spark, [(1, None)]))) == brute([(1, None)])
