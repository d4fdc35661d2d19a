from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import byte_cnn, queries, string_kernel
from dossier.llm.labelled import sample

FOLDER = "/root/testdata/sf0.001"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).tolist()) for n in (3, 300, 700, 1100)]
    y = np.array([0, 1, 1, 0], np.float32)
    model = byte_cnn.ByteCNN(1)
    # shifts off 0: there, the pools of padding lie on a corner of the activation, where differences are no gradient
    model.p = {k: v.astype(np.float64) + (0.5 if k == "shift" else 0) for k, v in model.p.items()}
    loss = lambda: float(-np.mean(np.log(np.where(y == 1, model.score(texts), 1 - model.score(texts)))))
    g = model.gradients(texts, y)
    for name, own in model.p.items():
        flat, grad = own.reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - grad[i]) < 0.02 * abs(grad[i]) + 1e-4, name


def test_scores_do_not_depend_on_company():
    model = byte_cnn.ByteCNN(2)
    texts = [b"", b"a" * 5, b"b c " * 900, b"x" * 256, b"y" * 257]
    alone = np.array([model.score([t])[0] for t in texts])
    assert np.allclose(model.score(texts), alone, atol=1e-6) and ((alone >= 0) & (alone <= 1)).all() and len(model.score([])) == 0


def test_one_label_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (1, None)], "doc_id long, quality int")
    model = byte_cnn.fit_quality(docs, labels, F.lit(True))
    out = docs.select("doc_id", byte_cnn.quality(model, F.col("text")).alias("s")).toPandas()
    assert len(out) == 3 and (out["s"] > 0.5).all()


def test_kernel_finds_languages_and_undetermined(spark):
    words = {"en": "the and of that with have", "de": "und der nicht mit auch eine", "fr": "les des une pour avec nous"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k, "x", 0) for i, k in enumerate(["en", "de", "fr"] * 30)]
    rows += [(1000, None, "en", "x", 0), (1001, "123 !!", None, "x", 0), (1002, "", "de", "x", 0), (1003, "Der UND nicht " * 5000, None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int")
    model = string_kernel.fit_languages(docs, F.lit(True))
    out = {r["doc_id"]: r["p"] for r in docs.select("doc_id", string_kernel.language(model, F.col("text")).alias("p")).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k, *_ in rows[:90])
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= p["score"] <= 1 for p in out.values())
    none = string_kernel.fit_languages(docs, F.lit(False))
    assert {r["p"]["lang_pred"] for r in docs.select(string_kernel.language(none, F.col("text")).alias("p")).collect()} == {"und"}


def naive_score(model, text):
    """The network, one window at a time."""
    n = -(-(len(text) + byte_cnn.WINDOW) // byte_cnn.HALF)
    filled = text + bytes(n * byte_cnn.HALF - len(text))
    pools = np.full((n, byte_cnn.FILTERS), -np.inf)
    for at in range(0, len(filled) - byte_cnn.WINDOW + 1, byte_cnn.STRIDE):
        own = model.p["bytes"][list(filled[at : at + byte_cnn.WINDOW])].reshape(-1) @ model.p["filters"]
        pools[at // byte_cnn.HALF] = np.maximum(pools[at // byte_cnn.HALF], own)
    chunks = [np.maximum(pools[i], pools[i + 1]) for i in range(n - 1)] or [pools[0]]
    chunks.append(chunks[-1]) if n > 1 else None  # the last half chunk stands in its chunk with the one before
    active = np.maximum(np.array(chunks) + model.p["shift"], 0)
    z = np.concatenate((active.mean(0), active.max(0), active.min(0), [np.log1p(len(text)) / 8]))
    return float(model.head(z[None, :])[0][0])


def test_pools_equal_a_naive_convolution():
    model = byte_cnn.ByteCNN(3)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n).tolist()) for n in (1, 7, 255, 257, 1500)]
    assert np.allclose(model.score(texts), [naive_score(model, t) for t in texts], atol=1e-4)


def test_kernel_equals_sets_of_grams():
    texts = [b"the old house", b"das alte Haus!", b"the older houses", b"x"]
    rows = string_kernel.presence(texts)
    scaled = rows / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]
    found = string_kernel.StringKernel._kernel(rows, scaled)

    def grams(text):
        low = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text) + b" "
        return {low[i : i + n] for n in string_kernel.PLACES for i in range(len(low) - n + 1)}

    sets = [grams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.abs(found - want).max() < 0.03  # places that two n-grams share


def test_long_texts_are_told_apart():
    rng = np.random.default_rng(0)
    letters = {"a": list("abcdefgh"), "b": list("efghijkl")}
    words = {k: ["".join(rng.choice(v, 6)) for _ in range(3000)] for k, v in letters.items()}
    train = [(" ".join(rng.choice(words[k], 60)), k) for k in ["a", "b"] * 40]
    model = string_kernel.StringKernel.fit([t.encode() for t, _ in train], [k for _, k in train])
    long = {k: " ".join(rng.choice(v, 30_000)).encode() for k, v in words.items()}
    assert model.predict([long["a"], long["b"], b"", long["b"][:90]])[0][:2] == ["a", "b"]
    for t in (b"", b"x", long["a"][:9000]):
        own = string_kernel.windows(t)
        assert len({len(w) for w in own[:-1]}) <= 1 and all(g in b"".join(own) for g in (t[:4], t[-4:]))


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), 50).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 200, 0).otherwise(1).alias("label"))
    found, counts = sample(docs.unionByName(docs.limit(5)), labels, size=600, chars=20)
    assert counts == {0: 200, 1: 3800} and found["doc_id"].is_unique and set(found["text"].str.len()) == {20}
    assert (found["label"] == 0).sum() == 200 and 300 < (found["label"] == 1).sum() < 500


TENFOLD = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    out = queries.queries()["op6_language"](spark, TENFOLD)
    both = out.join(spark.read.parquet(f"{TENFOLD}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, total = both.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 200 and right / total >= 0.97
    assert out.count() == spark.read.parquet(f"{TENFOLD}/documents.parquet").count()


def test_held_out_quality(spark):
    """Where both labels are held out: the order of scores, and each label's share that is predicted right."""
    out = queries.queries()["op3_quality"](spark, TENFOLD)
    both = out.join(spark.read.parquet(f"{TENFOLD}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    good, bad = (both[both["quality"] == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 10
    above = (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None, :]).mean()
    assert above >= 0.95 and (good["predicted"].mean() + 1 - bad["predicted"].mean()) / 2 >= 0.9
    assert out.count() == spark.read.parquet(f"{TENFOLD}/documents.parquet").count()
