from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from dossier.functions.search import STOP_WORDS, parse_search, stem
from dossier.operators import postings as I


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    rare = [f"rara{i}" for i in range(300)]
    common = ["casa", "plazo", "oferta", "pliego", "renglones", "garantía"]
    out = {i: " ".join(rng.choices(common, k=8) + rng.choices(rare, k=4) + ["licitación"]) for i in range(700)}
    out |= {700: "", 701: "de la", 702: "oferta del plazo", 703: "plazo ofertas", 704: "licitaciones " * 5000 + "rara7 final", 705: "plazo de la oferta"}
    return out


@pytest.fixture(scope="module")
def index(spark, texts):
    rows = [(i, t, "x") for i, t in texts.items()] + [(900, None, "x"), (None, "casa", "x")]
    block, I.BLOCK_DOCS = I.BLOCK_DOCS, 8
    try:
        return I.text_index(spark.createDataFrame(rows, "id long, text string, term string"), "id", "text")
    finally:
        I.BLOCK_DOCS = block


def stems(text):
    from dossier.functions.search import SEARCH_WORD
    import re

    plain = text.lower().translate(str.maketrans("áéíóú", "aeiou")).replace("cion ", "ción ")
    return [(i, stem(w)) for i, w in enumerate(re.findall(SEARCH_WORD, re.sub(r"([au])cion\b", r"\1ción", plain))) if w not in STOP_WORDS]


def answers(texts, query):
    out = set()
    for i, t in texts.items():
        own = set(stems(t))
        places = lambda terms: any(all((s + d, w) in own for d, w in terms) for s, _ in own)  # noqa: B023, E731
        for clauses in parse_search(query):
            wanted = [c for no, c in clauses if not no]
            if wanted and all(map(places, wanted)) and not any(places(c) for no, c in clauses if no):
                out.add(i)
    return out


QUERIES = ["casa rara3", '"plazo oferta" or rara9 -casa', '"plazo de la oferta"', "oferta -plazo", "-casa", "de la", "", "nada", "casa nada or rara1", "casas", 'plazo "garantia licitación"', "pliego -nada", "casa casa"]


def test_web_queries_equal_a_scan(spark, texts, index):
    asked = I.asked_terms(spark.createDataFrame([*enumerate(QUERIES), (99, None), (None, "casa")], "q long, text string"), "q", "text")
    found = {(r["query_id"], r["id"]) for r in I.answers(index, asked).collect()}
    assert found == {(q, i) for q, text in enumerate(QUERIES) for i in answers(texts, text)}
    assert {q for q, _ in found} == {0, 1, 2, 3, 8, 9, 11, 12}


def bm25(texts, query, k):
    docs = {i: [w for _, w in stems(t)] for i, t in texts.items()}
    some = [len(d) for d in docs.values() if d]
    mean, n, out = sum(some) / len(some), len(texts) + 1, []
    terms = {w for _, w in stems(query)}
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    for i, d in docs.items():
        s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if t in d)
        if s:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_ranked_equals_a_scan_and_skips_hot_lists(spark, texts, index):
    rng = random.Random(2)
    # every document but a few has licitación; casa, plazo and oferta are in most
    queries = [(q, f"licitación casa plazo oferta rara{rng.randrange(300)} rara{rng.randrange(300)} rara{rng.randrange(300)}") for q in range(12)] + [(50, "licitación"), (51, "nada"), (52, None), (None, "casa"), (53, "casa casas plazo")]
    found = I.ranked(index, spark.createDataFrame(queries, "item long, text string"), "item", "text", 10)
    rows = {}
    for r in found.scores.orderBy("query_id", "place").collect():
        rows.setdefault(r["query_id"], []).append((r["id"], pytest.approx(r["score"], abs=2e-6)))
    assert rows == {q: bm25(texts, t, 10) for q, t in queries if q is not None and t and bm25(texts, t, 10)}
    read = {r["query_id"]: (r["read"], r["all"]) for r in found.read.collect()}
    rare = [read[q] for q in range(12)]
    assert sum(a for a, _ in rare) < 0.5 * sum(b for _, b in rare)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string")
    index = I.text_index(empty, "id", "text")
    one = spark.createDataFrame([(1, "casa")], "id long, text string")
    assert I.answers(index, I.asked_terms(one, "id", "text")).count() == 0
    assert I.ranked(index, one, "id", "text", 3).scores.count() == 0
    assert I.ranked(I.text_index(one, "id", "text"), empty, "id", "text", 3).scores.count() == 0


def test_functions_in_sql(spark):
    from dossier.functions.search import register_functions

    register_functions(spark)
    r = spark.sql("SELECT search_normalize('Adjudicacion de la GARANTÍA') AS n, search_document('la casa, las casas y el plazo') AS d, search_query('casas \"plazo de oferta\" -mora or pliego') AS q").first()
    assert r["n"] == "Adjudicación de la GARANTIA" and r["d"] == {"cas": [2, 4], "plaz": [7]}
    said = [[(c["excluded"], [(t["distance"], t["term"]) for t in c["terms"]]) for c in a] for a in r["q"]]
    assert said == [[(False, [(0, "cas")]), (False, [(0, "plaz"), (2, "ofert")]), (True, [(0, "mor")])], [(False, [(0, "plieg")])]]


def test_index_of_asked_terms_answers_and_ranks_as_the_whole_one(spark):
    words = "casa perro norma gastos ley compra oferta precio acta pliego".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([*words, "de", "la"], k=12))) for i in range(150)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = I.asked_terms(spark.createDataFrame([(1, 'casa "perro norma" or ley -acta'), (2, "nada")], "q long, text string"), "q", "text")
    whole, own = I.text_index(docs, "id", "text"), I.text_index(docs, "id", "text", asked)
    assert (own.docs, own.mean) == (whole.docs, whole.mean) and own.terms.count() < whole.terms.count()
    found = [sorted(map(tuple, I.answers(x, asked).collect())) for x in (whole, own)]
    assert found[0] == found[1] and found[0]
    queries = spark.createDataFrame([(1, "gastos de compra"), (2, "precio")], "q long, text string")
    own = I.text_index(docs, "id", "text", I.ranked_terms(queries, "q", "text"))
    scores = [sorted(map(tuple, I.ranked(x, queries, "q", "text", 5).scores.collect())) for x in (whole, own)]
    assert scores[0] == scores[1] and len(scores[0]) == 10
    plan = I.answers(own, asked)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
