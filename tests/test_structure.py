from __future__ import annotations

import pytest

from dossier.functions.headings import heading
from hypothesis import given, settings, strategies as st

from dossier.functions.numbers import figures
from dossier.functions.search import parse_search, phrase_pattern, stem, word_forms
from dossier.operators import items as I
from dossier.operators import passages as G
from dossier.operators import points as O
from dossier.operators import structure as S

NORM = [
    "VISTO el expediente", "CONSIDERANDO:", "Que es útil.", "Que conviene.", "Por ello,", "TÍTULO I", "ARTÍCULO 1°.- OBJETO. Alcance:", "a) uno:", "1) uno uno", "2) uno dos", "b) dos",
    "d) fuera de orden", "ARTÍCULO 1° bis.- Otro.", "ARTÍCULO 9°.- muy lejos", "ARTÍCULO 3°.- Tercero.", "sigue el tercero", "CLÁUSULA TRANSITORIA", "ARTÍCULO 4°.- Comuníquese, publíquese y archívese.",
    "Firma del Director", "ANEXO I", "ARTÍCULO 1°.- Del anexo.", "Firmado digitalmente por X",
]


def test_units(spark):
    rows = [(1, i, p) for i, p in enumerate(NORM)] + [(2, 0, "ANEXO I"), (2, 1, "texto suelto"), (3, 0, None)]
    out = {(r["d"], r["i"]): (r["unit_type"], r["key"]) for r in S.units_of(spark.createDataFrame(rows, "d int, i int, t string"), "d", "i", "t").collect()}
    keys = [out[1, i][1] for i in range(len(NORM))]
    assert keys == [
        "visto", None, "considerando-1", "considerando-2", None, None, "art-1", "art-1/inc-a", "art-1/inc-a/inc-1", "art-1/inc-a/inc-2", "art-1/inc-b", "art-1",
        "art-1-bis", "art-1-bis", "art-3", "art-3", "clausula-transitoria", "art-4", None, "anexo-i", "anexo-i/art-1", None,
    ]
    assert out[1, 21][0] == "unlocated" and out[2, 0][0] == "unlocated" and out[3, 0][0] == "unlocated"


def test_points(spark):
    texts = ["I. HECHOS", "1. Uno", "cuerpo", "1.1 Baja", "9. lejos", "2. Dos", "II. DERECHO", "1. Vuelve", "Firmado digitalmente por X", "resto"]
    rows = [(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "sin números"), (2, 1, "1. solo uno")]
    out = {(r["d"], r["i"]): r["key"] for r in O.points_of(spark.createDataFrame(rows, "d int, i int, t string"), "d", "i", "t").collect()}
    assert [out[1, i] for i in range(10)] == ["punto-i", "punto-i/punto-1", "punto-i/punto-1", "punto-i/punto-1.1", "punto-i/punto-1.1", "punto-i/punto-2", "punto-ii", "punto-ii/punto-1", None, None]
    assert [out[2, i] for i in range(2)] == ["parrafo-1", "parrafo-2"]


def test_items_by_their_ends():
    letter, paren, dot, word = ("letter", False), ("paren", False), ("dot", False), ("paren", True)
    heads = [None, ("a", letter), ("1", paren), None, ("b", letter), ("d", letter), None, ("1", dot), ("2", dot), None]
    presents = [True, True, True, False, True, False, True, False, True, False]
    tree = I.item_tree(heads, presents)
    # a holds 1, which presents what follows; b is the last of its list and takes the item in another form as its own list
    assert [(x.key, x.at, x.end) for x in tree] == [("inc-a", 1, 3), ("inc-b", 4, 9)]
    assert [(y.key, y.at, y.end) for x in tree for y in x.inside] == [("inc-a/inc-1", 2, 3), ("inc-b/inc-1", 7, 7), ("inc-b/inc-2", 8, 9)]
    named = I.item_tree([None, ("1", word), ("a", letter), ("2", word), None], [False] * 5)
    assert [(x.key, x.end) for x in named] == [("inc-1", 2), ("inc-2", 4)]
    assert I.comes_next("n", "o") and I.comes_next("n", "ñ") and not I.comes_next("a", "c") and not I.comes_next("a", "1")


numbers = st.lists(st.integers(1, 12), min_size=1, max_size=4).map(tuple)


@given(numbers, st.integers(1, 1 + S.MARGIN), st.integers(0, 3), st.integers(0, 2))
def test_points_go_on_at_one_level_only(last, step, level, ones):
    level = min(level, len(last) - 1)
    after = last[:level] + (last[level] + step,) + (1,) * ones
    assert O.follows(last, after)
    assert O.follows(last, last + (1,) * (ones + 1))  # a level down
    assert not O.follows(last, last) and not O.follows(after, last[: level + 1]) and not O.follows(last, last + (2,))
    assert not O.follows(last, last[:level] + (last[level] + S.MARGIN + 2,))


texts = st.lists(st.sampled_from(["una ", "frase. ", "Larga, ", "\n", "palabra ", "x" * 30 + " ", "¿Dos? ", "\n\n", "y; ", "RENGLÓN 5 ", "\f", "  "]), max_size=120).map("".join)


@given(texts, st.integers(4, 30), st.integers(0, 12), st.sampled_from(["", "Norma 1", "uno dos tres"]), st.sampled_from([G.words, G.word_pieces]), st.lists(st.integers(0, 400), max_size=4))
@settings(max_examples=300, deadline=None)
def test_passages_cover_all_and_keep_to_the_limits(text, most, overlap, header, tokens, items):
    count = lambda a, b: sum(a <= t < b for t in tokens(text))
    room = most - len(tokens(header))
    spans = G.passages(text, most, overlap, header, items, tokens)
    covered = {c for a, b in spans for c in range(a, b)}
    assert all(c in covered for c, ch in enumerate(text) if not ch.isspace())
    assert all(text[a:b] == text[a:b].strip() and (count(a, b) <= room or not any(map(str.isspace, text[a:b]))) for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c and b < d and (c >= b or count(c, b) <= overlap)
    if count(0, len(text)) <= room:
        assert len(spans) <= 1


@given(texts, st.integers(1, 60), st.integers(40, 120))
@settings(max_examples=300, deadline=None)
def test_bid_passages_keep_to_pages_and_limits(text, least, most):
    spans = G.bid_passages(text, least, most)
    covered = {c for _, a, b in spans for c in range(a, b)}
    assert all(c in covered for c, ch in enumerate(text) if not ch.isspace())
    assert all(b - a <= most and "\f" not in text[a:b] and page == text[:a].count("\f") + 1 for page, a, b in spans)
    assert all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:]))


def test_cuts_of_passages():
    text = "Una dos tres cuatro. Cinco seis siete ocho. Nueve diez once doce. Trece catorce quince."
    said = lambda spans: [text[a:b] for a, b in spans]
    assert said(G.passages(text, 8, 4)) == ["Una dos tres cuatro. Cinco seis siete ocho.", "Cinco seis siete ocho. Nueve diez once doce.", "Nueve diez once doce. Trece catorce quince."]
    assert said(G.passages(text, 10, 0, header="Norma 5")) == ["Una dos tres cuatro. Cinco seis siete ocho.", "Nueve diez once doce. Trece catorce quince."]
    assert said(G.passages(text, 12, 0, items=[text.index("Cinco")])) == ["Una dos tres cuatro.", "Cinco seis siete ocho. Nueve diez once doce. Trece catorce quince."][:0] or said(G.passages(text, 12, 0, items=[text.index("Cinco")]))[0].startswith("Una dos")
    offer = "RENGLÓN 1 " + "uno dos. " * 20 + "RENGL0N 2 " + "tres. " * 30
    spans = G.bid_passages(offer, 10, 200)
    assert [offer[a : a + 9] for _, a, _ in spans] == ["RENGLÓN 1", "RENGL0N 2"]
    assert [(p, "corta" in "corta\fotra"[a:b]) for p, a, b in G.bid_passages("corta\fotra", 200, 300)] == [(1, True), (2, False)]


def test_headings(spark):
    lines = {"ARTÍCULO 5°.- X": "article", "Art. 5. Algo": "article", "ANEXO I (artículo 2°)": "annex", "ANEXO I de la norma": "text", "SECCIÓN 2ª": "title", "Que sí": "recital", "ÍNDICE": "index", "c)Nombre": "item", "OTRAS COSAS": "upper", "12 de mayo": "text", "": "text"}
    out = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in lines], "t string").select("t", heading_of()).collect()}
    assert out == lines


def heading_of():
    from pyspark.sql import functions as F

    return heading(F.col("t")).alias("k")


# words and stems that an adopted search configuration expects
STEMS = {"licitación": "licit", "licitaciones": "licit", "adjudicación": "adjud", "adjudicaciones": "adjud", "contratación": "contrat", "contrataciones": "contrat", "articulo": "articul", "articulos": "articul", "garantia": "garanti", "garantias": "garanti", "rápidamente": "rapid", "posibilidades": "posibil"}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


@given(st.integers(1, 999_999_999))
def test_numbers_in_words_come_back(n):
    assert figures(spelt(n)) == str(n)


def spelt(n):
    from dossier.functions.numbers import HUNDREDS, TEENS, TENS, UNITS

    back = lambda words: {v: k for k, v in reversed(words.items())}
    if n >= 1_000_000:
        head = "un millon" if n < 2_000_000 else spelt(n // 1_000_000) + " millones"
        return " ".join(filter(None, (head, spelt(n % 1_000_000) if n % 1_000_000 else "")))
    if n >= 1000:
        return " ".join(filter(None, (spelt(n // 1000) if n >= 2000 else "", "mil", spelt(n % 1000) if n % 1000 else "")))
    if n == 100:
        return "cien"
    if n > 100:
        return " ".join(filter(None, (back(HUNDREDS)[n // 100 * 100], spelt(n % 100) if n % 100 else "")))
    if n >= 30:
        return back(TENS)[n // 10 * 10] + (f" y {back(UNITS)[n % 10]}" if n % 10 else "")
    return back(TEENS)[n] if n >= 10 else back(UNITS)[n]


def test_words_stand_for_their_plurals():
    assert {"luz", "luces"} <= word_forms("luz") & word_forms("luces") and "mes" in word_forms("meses") and "polizas" in word_forms("poliza")
    import re

    found = lambda phrase, text: re.search(phrase_pattern(phrase).replace(r"\p{L}\p{N}_", r"\w"), text) is not None
    assert found("poliza de caucion", "las polizas de cauciones") and not found("1 %", "0,1 %") and not found("casa", "casamiento")


@pytest.mark.parametrize(
    ("text", "want"),
    [("treinta y cinco dias", "35 dias"), ("ciento veinte", "120"), ("dos mil quinientos", "2500"), ("cinco por ciento", "5 por ciento"), ("dos tres", "2 3"), ("un millon doscientos mil uno", "1200001"), ("mil", "1000"), ("y nada", "y nada"), ("cien uno", "100 1"), ("siete por mil", "7 por mil"), ("treinta y", "30 y"), ("dos milla", "2 milla"), ("un millon mil", "1001000")],
)
def test_figures(text, want):
    assert figures(text) == want


def test_search_language():
    assert parse_search('garantía "mantener de oferta" -póliza or cheque -"de pago"') == [
        [(False, [(0, "garant")]), (False, [(0, "manten"), (2, "ofert")]), (True, [(0, "poliz")])],
        [(False, [(0, "chequ")]), (True, [(0, "pag")])],
    ]
    assert parse_search("") == [] and parse_search("de la or el") == []


def test_paragraphs_are_classed_after_they_are_dealt_out(spark):
    rows = spark.createDataFrame([(1, 1, "ARTÍCULO 1°.- OBJETO. Uno."), (1, 2, "a) dos")], "doc long, at long, text string").coalesce(1)
    plan = S.units_of(rows, "doc", "at", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "rlike" not in plan[plan.index("Exchange hashpartitioning") :].lower()


def test_units_over_long_and_many_documents(spark):
    # documents of equal classes, of other ones, and one longer than what a task walks at once; places have gaps
    long = ["ARTÍCULO 1°.- Uno."] + ["texto"] * (S.WALKED + 5) + ["ARTÍCULO 2°.- Dos.", "a) uno", "b) dos"]
    rows = [(d, 10 * i, p if d % 7 else p.replace("bis", "ter")) for d in range(40) for i, p in enumerate(NORM)] + [(99, i, p) for i, p in enumerate(long)] + [(None, 1, "TÍTULO I")]
    df = spark.createDataFrame(rows, "d int, i int, t string").repartition(3)
    out = {(r["d"], r["i"]): r for r in S.units_of(df, "d", "i", "t").collect()}
    assert len(out) == len(rows) - 1
    for d in range(40):
        keys = [out[d, 10 * i]["key"] for i in range(len(NORM))]
        assert keys[12:14] == (["art-1-bis"] if d % 7 else ["art-1-ter"]) * 2 and keys[7:11] == ["art-1/inc-a", "art-1/inc-a/inc-1", "art-1/inc-a/inc-2", "art-1/inc-b"]
        assert (out[d, 70]["first"], out[d, 70]["last"]) == (70, 90) and (out[d, 120]["first"], out[d, 120]["last"]) == (120, 130)
    assert out[99, 5]["key"] == "art-1" and out[99, 5]["last"] == S.WALKED + 5 and out[99, len(long) - 1]["key"] == "art-2/inc-b"
    some = S.units_of(df, "d", "i", "t", ("key", "last"))
    assert some.columns == ["d", "i", "key", "last"] and {(r["d"], r["i"]): (r["key"], r["last"]) for r in some.collect()} == {k: (r["key"], r["last"]) for k, r in out.items()}


def test_equal_documents_are_walked_once(monkeypatch):
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(S, "_walk", lambda rows: calls.append(len(rows)) or [("text", None, None, None, None, 0, 0)] * len(rows))
    walked = S._Walked()
    codes = pa.array(["article\t\t1\t", "text\tpresents\t", "item\t\ta\t\t\tinciso\t"] * 50)
    numbers = walked.numbers(codes)
    assert [len(walked.of(numbers[i : i + 3].tobytes())) for i in range(0, 150, 3)] == [3] * 50 and calls == [3]
    assert [p.kind for p in walked.paragraphs] == ["article", "text", "item"] and walked.paragraphs[1].presents and walked.paragraphs[2][1:5] == ("a", "", "letter", True)


def test_paragraphs_are_classed_on_both_sides_of_the_sort(spark):
    # Java compiles no method of 8,000 bytes of code, and one of all patterns is larger
    rows = spark.createDataFrame([(1, 1, "a) dos")], "doc long, at long, text string")
    plan = S.units_of(rows, "doc", "at", "text")._jdf.queryExecution().executedPlan().toString()
    after, before = plan[: plan.index("Exchange hashpartitioning")].split("- Sort", 1)
    assert "MapInArrow" in after and "RLIKE" in after and "RLIKE" in before


def test_beginnings_are_those_of_the_patterns(spark):
    import re

    from dossier.functions import headings as H

    lines = [*NORM, "Art. 5. Algo", "INDICE", "ÍNDICE:", "ANEXO", "ANEXO B (x)", "TITULO 2", "SECCIÓN 2ª", "CAPITULO IV", "CLAUSULA TRANSITORIA", "Y CONSIDERANDO:", "CONSIDERANDO", "Digitally signed by X", "Date: 2024.01.02", "NOTA: se publica en la edición web del BORA", "e. 12/03/2024 N° 1234/24 v. 12/03/2024"]
    for _, pattern, _ in H.LADDER:
        found = [x for x in lines if re.search(pattern, x)]
        assert found or pattern in (H.LOOSE_ITEM,)
        assert all(x.startswith(H.BEGINNINGS.get(pattern, "")) for x in found)
