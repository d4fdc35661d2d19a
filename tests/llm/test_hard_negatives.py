from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from dossier.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, list string, score string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "s", "s", 1) for i, v, y in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    ok = [(i, [int(np.floor(scale * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731  a shorter vector counts as filled with 0
    anchors = {}
    for i, v, y in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-dot(q, v), i, y) for i, v, y in ok if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            own = [(t, i) for t, i, y in scored if y != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(own)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(500, 6)) + 2 * rng.normal(size=(10, 6)).repeat(50, axis=0), np.repeat(rng.normal(size=(1, 6)), 300, axis=0)))
    return [(i, [float(v) for v in r], int(rng.integers(0, 4))) for i, r in enumerate(x)]


ODD = [(None, [1.0] * 6, 1), (9100, None, 1), (9200, [1.0, None], 2), (9300, [float("nan")] * 6, 1), (9400, [1.0] * 6, None), (9500, [], 1), (9600, [0.5, 0.25], 2), (9601, [0.5], 2)]


def test_equals_brute_force(spark, rows, monkeypatch):
    for name, value in (("LIST_ROWS", 80), ("PART_ROWS", 100), ("FINE_ROWS", 8)):
        monkeypatch.setattr(hn, name, value)
    repeated = [rows[20], rows[21], rows[21], rows[40]]
    data = rows + ODD + repeated
    out = found(hn.hard_negatives(table(spark, data), every=20))
    assert out == brute(data, every=20) and len(out) > 500


def test_waves_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "WAVE_QUERIES", 7)
    monkeypatch.setattr(hn, "PART_ROWS", 300)
    assert found(hn.hard_negatives(table(spark, rows), every=50, positives=2, negatives=3)) == brute(rows, 50, 2, 3)


def test_lists_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 8)).repeat(32, axis=0) * 2000 + rng.normal(size=(1280, 8)) * 50).astype(np.int64)
    labels = rng.integers(0, 2, len(x))
    made = hn._index(pd.DataFrame({"vector": list(x), "vec_id": np.arange(len(x)), "label": labels, "list": 0, "part": 0})).iloc[0]
    index = {c: np.frombuffer(made[c], np.int64) for c in ("ids", "labels", "cut")}
    index |= {"rows": np.frombuffer(made["rows"], np.int64).reshape(-1, 8), "centres": np.frombuffer(made["centres"]).reshape(-1, 8), "radii": np.frombuffer(made["radii"])}
    q = x[::40]
    scores = q @ index["rows"].T
    least, most = hn.bounds(q, index["centres"], index["radii"])
    of = np.repeat(np.arange(len(index["cut"])), np.diff(np.r_[index["cut"], len(x)]))
    assert (scores >= least[:, of]).all() and (scores <= most[:, of]).all()
    high = (np.sort(scores, 1)[:, -60:-59]).astype(np.int64)
    out, scored = hn.list_search(q, np.full(len(q), -1) - np.arange(len(q)), labels[::40], False, high // 2, high, index, 5)
    assert scored < 0.5 * len(q) * len(index["cut"])
    for i in range(len(q)):
        fits = np.flatnonzero((index["labels"] != labels[40 * i]) & (scores[i] <= high[i]) & (scores[i] >= high[i] // 2))
        best = fits[np.lexsort((index["ids"][fits], -scores[i][fits]))[:5]]
        own = out[out["anchor_id"] == -1 - i].sort_values(["score", "vec_id"], ascending=[False, True])
        assert own["vec_id"].tolist() == index["ids"][best].tolist()


def test_scores_beyond_a_long(spark):
    data = [(0, [3e15, 1.0], 1), (1, [3e15, 0.0], 1), (2, [2.0, 0.0], 2), (3, [1e200, 0.0], 2), (4, [0.0, 5.0], 2), (5, [0.0, -9.0], 1)]
    most = 2**63 - 1
    out = found(hn.hard_negatives(table(spark, data), scale=1))
    assert out == []  # the window begins at 30 % of the positive's score, far above the others
    assert found(hn.hard_negatives(table(spark, data), scale=1, low=0))[0] == (0, 1, 1, 2, most, 6 * 10**15)


def test_one_label_one_row_and_empty(spark):
    assert found(hn.hard_negatives(table(spark, []))) == []
    assert found(hn.hard_negatives(table(spark, [(0, [1.0], 1)]))) == []
    assert found(hn.hard_negatives(table(spark, [(0, [1.0], 1), (1, [1.0], 1)]))) == []
    assert found(hn.hard_negatives(table(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]))) == [(0, 1, 1, 2, 65536, 32768)]
