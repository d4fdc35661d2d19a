from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dossier.functions.classes import CONJUNCTIONS, MODAL_WORDS, NUMBER_WORDS, SENSE_WORDS
from dossier.operators import statements as T


def signature(words):
    figure = lambda w: w in NUMBER_WORDS or w == "%" or any(c.isdigit() for c in w)
    return tuple((w, *words[i + 1 : i + 2]) for i, w in enumerate(words) if figure(w)), *(tuple(w for w in words if w in own) for own in (CONJUNCTIONS, SENSE_WORDS, MODAL_WORDS))


def longest_runs(a, b):
    """Words in matching runs: the longest run (the first of them), then those on either side of it."""
    best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=(0, 0, 0))
    k, i, j = best[0], -best[1], -best[2]
    return k and k + longest_runs(a[:i], b[:j]) + longest_runs(a[i + k :], b[j + k :])


def says(a, b, share, containment):
    if a == b:
        return True
    x, y = sorted((a, b), key=len)
    one, two = x.split(), y.split()
    if signature(one) != signature(two):
        return False
    if containment and T.is_contained(one, two):
        return True
    one, two = ([w for w in t.split() if w not in T.COMMON_WORDS] for t in (a, b))
    return bool(share < 1 and one and two and 2 * longest_runs(one, two) / (len(one) + len(two)) >= share)


def brute(rows, share, containment):
    out = {}
    for by in {r[0] for r in rows}:
        groups = []
        for _, at, form, wide in sorted(r for r in rows if r[0] == by):
            found = None if wide or not form else next((g for g in groups if not g[2] and any(says(form, m, share, containment) for m in g[1])), None)
            if found:
                found[1].append(form)
            else:
                found = (at, [form], wide or not form)
                groups.append(found)
            out[by, at] = found[0]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"palabra{i}" for i in range(25)] + ["no", "debe", "y", "5", "dos", "la", "del", "una", "el"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(14)]
    out = []
    for by in range(6):
        for at in range(60):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.8 else []
            out.append((by, at, " ".join(w), rng.random() < 0.05))
    return out + [(7, 0, "", False), (7, 1, "", False), (7, 2, "la del una", False), (7, 3, "la del una palabra1", False), (7, 4, "la del una palabra1 palabra2", False), (7, 5, "el la del una", False)]


@pytest.mark.parametrize(("share", "containment"), [(0.8, True), (0.6, False), (1.0, True), (1.0, False)])
def test_groups_equal_the_walk_over_all_pairs(spark, rows, share, containment):
    df = spark.createDataFrame(rows, "doc int, at int, form string, wide boolean").repartition(5)
    out = T.unified_like(df, "doc", "at", F.col("form"), F.col("wide"), share, containment)
    found = {(r["doc"], r["at"]): r["kept"] for r in out.collect()}
    want = brute(rows, share, containment)
    assert found == want
    assert len({(k[0], v) for k, v in want.items()}) < len(rows)


def test_order_decides(spark):
    # the second is like the first, the third only like the second: it joins their group, though it isn't like the first
    rows = [(1, 0, "p q r s t", False), (1, 1, "p q r s v", False), (1, 2, "p q r w v", False), (1, 3, "p q r s 5", False)]
    out = T.unified_like(spark.createDataFrame(rows, "k int, at int, form string, wide boolean"), "k", "at", F.col("form"), F.col("wide"), 0.8)
    assert {r["at"]: r["kept"] for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert T.unified_like(spark.createDataFrame([], "k int, at int, form string, wide boolean"), "k", "at", F.col("form"), F.col("wide"), 0.8).count() == 0


def test_statements_are_shuffled_once(spark, rows):
    df = spark.createDataFrame(rows, "doc int, at int, form string, wide boolean")
    plan = T.unified_like(df, "doc", "at", F.col("form"), F.col("wide"), 0.8, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CoGroup" not in plan


def test_long_statements_are_compared_too(spark, tmp_path):
    from dossier.plans import FUNCTIONS

    long = " ".join(f"palabra{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    text = f"{long}\notra cosa\n{long.replace('palabraaa', 'distinta')}\n{long}"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["kept"], r["n"]) for r in FUNCTIONS["X17_similar"](spark, str(tmp_path)).collect()} == {(0, 3), (1, 1)}
