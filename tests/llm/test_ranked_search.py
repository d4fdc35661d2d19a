from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from dossier.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(docs, items, k=50):
    held = [(i, TERM.findall((t or "").translate(SMALL))) for i, t in docs if i is not None]
    held = [(i, t, Counter(t)) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        asked = set(TERM.findall(text.translate(SMALL)))
        scored = []
        for i, t, c in held:
            m = 50 + (50 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in asked if c[x])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string")
    return d, spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "Das", "DAS"]
    share = 1 / np.arange(1, len(words) + 1)
    topic = lambda: np.roll(share, int(rng.integers(0, 5)) * 60) / share.sum()
    out = [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 60)), p=topic()))) for i in rng.permutation(900)]
    same = "w3 w9, w11! das w399"
    return out + [(2000 + i, same) for i in range(150)] + [(7, "w3 w9"), (None, "w3"), (5000, None), (5001, ""), (5002, " .,! "), (5003, "w1 w2 " * 30_000 + "w399")]


ITEMS = [(0, "w3 w9 w9 das"), (1, "W399; das"), (2, "nothing here"), (3, None), (4, ""), (None, "w3"), (5, "w1 w1 w2 w5"), (6, "w17 w60 w61 w200"), (6, "w18"), (8, "ÜNÏ Ünï x w250")]


def test_equals_brute_force(spark, docs, monkeypatch):
    for name, value in (("LEAF_DOCS", 150), ("SHARD_DOCS", 100), ("CLUSTER_DOCS", 8)):
        monkeypatch.setattr(rs, name, value)
    d, i = tables(spark, docs, ITEMS)
    out = found(rs.ranked_search(d, i))
    assert out == brute(docs, ITEMS) and {r[0] for r in out} >= {0, 1, 5, 6, 8}
    hot = [r[2] for r in sorted(out) if r[0] == 1]
    assert hot == sorted(hot) and len(hot) == 50


def test_waves_and_fewer_results(spark, docs, monkeypatch):
    monkeypatch.setattr(rs, "WAVE_TERMS", 5)
    d, i = tables(spark, docs[:200], ITEMS)
    assert found(rs.ranked_search(d, i, k=7)) == brute(docs[:200], ITEMS, 7)


def test_clusters_are_skipped():
    rng = np.random.default_rng(0)
    docs = [np.unique(np.r_[rng.integers(0, 8, 3) + 8 * (i % 16), 128]) for i in range(2000)]
    terms, rows = rs._flat(docs)
    order = rs.ordered(terms, rows, len(docs), 129)
    assert sorted(order) == list(range(2000))
    topics = [{int(i) % 16 for i in order[a : a + 64]} for a in range(0, 2000, 64)]
    assert np.mean([len(t) for t in topics]) < 6  # a range of the order holds few of the sixteen topics

    group = pd.DataFrame({"id": np.arange(2000), "n": rng.integers(3, 40, 2000), "terms": docs, "counts": [np.ones(len(d), int) for d in docs], "leaf": 0, "part": 0})
    made = rs._index(2000, 40_000, 129, 50)(group).iloc[0]
    index = {c: np.frombuffer(made[c], np.int32 if c == "docs" else np.int64) for c in ("ids", "docs", "impacts", "offsets", "terms", "top")}
    index |= {"top": index["top"].reshape(len(index["terms"]), -1), "cluster": 64}
    weights = np.r_[rng.integers(500, 900, 128), 1]
    asked = np.array([3, 5, 128])
    ids, scores, visited = rs.shard_search(asked, weights[asked], index, 10)
    gives = rs.impact(np.ones(2000, np.int64), group["n"].to_numpy(), 2000, 40_000, 50)
    whole = np.array([sum(weights[t] for t in asked if t in d) for d in docs]) * gives
    best = np.lexsort((np.arange(2000), -whole))[:10]
    assert ids.tolist() == best.tolist() and scores.tolist() == whole[best].tolist()
    assert visited < 0.5 * len(topics)
    above = rs.shard_search(asked, weights[asked], index, 10, int(scores[4]) + 1)
    assert above[0].tolist() == ids[scores > scores[4]].tolist()


def test_empty(spark):
    for docs, items in (([], ITEMS), ([(1, "w3")], []), ([], []), ([(1, None)], [(1, None)])):
        assert found(rs.ranked_search(*tables(spark, docs, items))) == []
    assert found(rs.ranked_search(*tables(spark, [(1, "A b")], [(9, "a")]))) == brute([(1, "A b")], [(9, "a")])
