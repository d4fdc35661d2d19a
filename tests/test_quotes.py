from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from dossier.operators import lines as N
from dossier.operators import quotes as Q


def test_located(spark):
    rows = [
        (1, "El  oferente\ndeberá presentar", "oferente deberá"),
        (2, "la contra-\ntista pre*senta gara°ntía", "contratista presenta garantía"),
        (3, "corto a*b", "ab"),
        (4, "nada de eso", "otra cosa distinta"),
        (5, "precio (total) + IVA", "(total) + IVA"),
        (6, "texto", ""),
        (7, "x (cid:13)presentar la oferta completa", "presentar la oferta"),
        (8, None, "algo"),
    ]
    out = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id int, t string, q string").select("id", Q.located(F.col("t"), F.col("q")).alias("p")).collect()}
    assert rows[0][1][out[1]["start"] : out[1]["end"]] == "oferente\ndeberá" and out[1]["way"] == "literal"
    assert rows[1][1][out[2]["start"] : out[2]["end"]] == "contra-\ntista pre*senta gara°ntía" and out[2]["way"] == "folded"
    assert out[3] is None and out[4] is None and out[6] is None and out[8] is None
    assert rows[4][1][out[5]["start"] : out[5]["end"]] == "(total) + IVA"
    assert rows[6][1][out[7]["start"] : out[7]["end"]] == "presentar la oferta"


def test_sentences(spark):
    text = "1.1. Según el art. 4 inc. b) se pide. ¿Cuándo? S.A. Norte firma! Fin"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "sin fin")], "id int, t string")
    out = [(r["id"], text[r["start"] : r["end"]] if r["id"] == 1 else r["end"]) for r in N.sentence_spans(df, "id", "t").orderBy("id", "sentence").collect()]
    assert out == [(1, "Según el art. 4 inc. b) se pide."), (1, "¿Cuándo?"), (1, "S.A. Norte firma!"), (1, "Fin"), (4, 7)]
    spans = spark.createDataFrame([(1, 7, 40, 44), (1, 8, 20, 44)], "id0 int, id int, start int, end int").withColumnRenamed("id0", "doc")
    wide = N.expanded(spans, N.sentence_spans(df, "id", "t").withColumnRenamed("id", "doc"), "doc").orderBy("id").collect()
    assert [text[r["start"] : r["end"]] for r in wide] == ["¿Cuándo?", "Según el art. 4 inc. b) se pide. ¿Cuándo?"]


def test_paragraphs(spark):
    rows = [(1, 1, "La contra-"), (1, 2, "tista firma"), (1, 3, "hoy."), (1, 4, "Otro A-"), (1, 5, "B párrafo")]
    df = spark.createDataFrame(rows, "d int, i int, l string").withColumn("o", F.col("i") == 4)
    out = [(r["text"], r["lines"], r["joins"]) for r in N.paragraphs(df, "d", "i", "l", F.col("o")).orderBy("paragraph").collect()]
    assert out == [("La contratista firma hoy.", 3, 1), ("Otro A- B párrafo", 2, 0)]


@pytest.mark.parametrize(("a", "b", "run"), [("the old red house", "an old red house burns", 3), ("of the", "of the", 0), ("", "x", 0), ("x y x y", "y x y", 3)])
def test_common_run(spark, a, b, run):
    df = spark.createDataFrame([(1, a, b)], "id int, a string, b string")
    assert Q.common_run(df, "id", F.split("a", " "), F.split("b", " ")).first()["run"] == run


def test_covers_and_similarity(spark):
    rows = [("abcdefgh", "xxabcdyy"), ("abcdefgh", "xxabcyy"), ("", "x"), ("a", ""), ("La  Oferta", "ver la oferta hoy")]
    out = spark.createDataFrame(rows, "n string, h string").select(Q.covers(F.col("h"), F.col("n")).alias("c")).collect()
    want = []
    for n, h in (("".join(n.lower().split()) if False else " ".join(n.lower().split()), " ".join(h.lower().split())) for n, h in rows):
        size = SequenceMatcher(None, h, n, autojunk=False).find_longest_match(0, len(h), 0, len(n)).size
        want.append(n == "" or (h != "" and size >= 0.5 * len(n)))
    assert [r["c"] for r in out] == want
    words = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "d"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    found = [r["r"] for r in words.select(F.round(Q.sequence_ratio("a", "b"), 6).alias("r")).collect()]
    assert found == [round(SequenceMatcher(None, list("abc"), list("acd"), autojunk=False).ratio(), 6), 0.0, 0.0]


def test_reanchored(spark):
    rows = [(1, "uno dos tres cuatro cinco", "cero uno dos  TRES, nuevo cuatro", 4, 13), (2, "a b", "x y", 0, 3), (3, None, "x", 0, 1)]
    out = {r["id"]: r for r in Q.reanchored(spark.createDataFrame(rows, "id int, o string, n string, s int, e int"), "id", "o", "n", "s", "e").collect()}
    assert rows[0][2][out[1]["s"] : out[1]["e"]] == "dos  TRES" and out[1]["share"] == 1.0
    assert out[2]["s"] is None and out[2]["share"] == 0.0 and out[3]["share"] == 0.0


def test_chosen_places_equal_all_choices():
    import itertools
    import random

    from dossier.operators.quotes import chosen_places

    rng = random.Random(4)
    for _ in range(300):
        candidates = [[(s, s + rng.randint(1, 4), rng.randint(0, 3)) for s in rng.sample(range(14), rng.randint(0, 3))] for _ in range(rng.randint(0, 6))]
        best = (0, 0)
        for choice in itertools.product(*[[None, *own] for own in candidates]):
            taken = [c for c in choice if c]
            if all(a[1] <= b[0] for a, b in itertools.pairwise(taken)):
                best = max(best, (len(taken), sum(c[2] for c in taken)))
        found = chosen_places(candidates)
        taken = [next(c for c in own if c[:2] == f) for own, f in zip(candidates, found, strict=True) if f]
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(taken))
        # candidates of one anchor may share a place with other evidence
        assert (len(taken), sum(max(c[2] for c in own if c[:2] == f) for own, f in zip(candidates, found, strict=True) if f)) == best


def test_repeated_anchors_keep_their_order(spark):
    old, new = "Pago a treinta días. Plazo uno. Pago a treinta días. Fin.", "Plazo uno; PAGO a  treinta días, fin y pago a treinta días"
    anchors = [(1, 7, 0, 19), (1, 8, 32, 51), (1, 9, 21, 30), (2, 1, 0, 4)]
    out = Q.reanchored_together(
        spark.createDataFrame(anchors, "doc int, anchor int, start int, end int"), spark.createDataFrame([(1, old, new), (3, "x", "x")], "doc int, old string, new string"), "doc", "old", "new"
    )
    rows = {(r["doc"], r["anchor"]): (r["start"], r["end"], r["places"]) for r in out.collect()}
    # the first and the third anchor can't both be placed in order with the second one in front of both: two of three can
    assert sum(rows[1, a][0] is not None for a in (7, 8, 9)) == 2 and rows[2, 1] == (None, None, 0)
    assert rows[1, 9][2] == 1 and rows[1, 7][2] == rows[1, 8][2] == 2
