from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dossier.functions import values as V
from dossier.operators import names, rules, selection
from dossier.sources import files, html, json_values, page_tables

ACTA = """<table id="otra"><tr><td>x</td></tr></table><table id="ctl00_gvOfertas"><tr><th>Oferente</th></tr>
<tr><td>ACME &amp; C&iacute;a <b>S.A.</b></td><td>30-12345678-9</td><td>Confirmada 5/3/2024</td><td>Pesos</td><td>$ 1.234,50</td><td></td><td>Mant.</td><td>Póliza</td><td>100,00</td></tr>
<tr><td>Acme y Cía</td><td>30123456789</td><td>5/3/2024</td><td>Pesos</td><td>9</td><td><table><tr><td>n</td></tr></table></td><td>Mant.</td><td>Póliza</td><td>100,00</td></tr>
<tr><td>Sin</td><td>1</td><td></td><td></td><td></td><td></td><td></td><td></td><td></td></tr><tr><td>corta</td></tr>
<tr><td>Beta</td><td>20-11111111-1</td><td>31/2/2024</td><td>USD</td><td>n/d</td><td></td><td></td><td></td><td></td></tr></table>"""


def test_opening_record(spark):
    pages = spark.createDataFrame([(1, ACTA), (2, None), (3, "<p>nada")], "id int, html string")
    rows = page_tables.read_pages(pages, "id", "html", "opening").collect()
    out = {r["tax_id"]: r for r in rows if r["issue"] is None}
    assert set(out) == {"30123456789", "20111111111"}
    acme = out["30123456789"]
    assert (acme["bidder"], acme["total"], str(acme["confirmed_on"]), len(acme["guarantees"])) == ("ACME & Cía S.A.", Decimal("1234.50"), "2024-03-05", 1)
    assert out["20111111111"]["guarantees"] == [] and out["20111111111"]["total"] is None
    issues = sorted((r["id"], r["tax_id"] or "", r["issue"]) for r in rows if r["issue"])
    own = [("", "no tax id"), ("20111111111", "no date"), ("20111111111", "no total"), ("30123456789", "several names"), ("30123456789", "several totals")]
    assert issues == [(1, *x) for x in own] + [(2, "", "no table of offers"), (3, "", "no table of offers")]


CUADRO = """<span id="a_rptProveedores_ctl01_lblNombreProveedor">ACME S.A. - 30-12345678-9</span><span id="a_rptProveedores_ctl01_lblTotal">Total: $ 1.234,50</span>
<span id="a_rptProveedores_ctl02_lblNombreProveedor">Sin nada</span><span id="a_rptLineas_ctl00_lblRenglon">1</span><span id="a_rptLineas_ctl01_lblRenglon">uno</span>
<span id="a_rptLineas_ctl00_rptLineasOfertas_ctl00_lblNombre">ACME - 30123456789</span><span id="a_rptLineas_ctl00_rptLineasOfertas_ctl00_txtPrecioUnitario">$ 10,5</span><span id="a_rptLineas_ctl00_rptLineasOfertas_ctl00_lblCantidadOfertada">1.500</span>
<span id="a_rptLineas_ctl00_rptLineasOfertas_ctl01_lblNombre">ACME - 30123456789</span><span id="a_rptLineas_ctl00_rptLineasOfertas_ctl01_txtPrecioUnitario">11</span><span id="a_rptLineas_ctl00_rptLineasOfertas_ctl01_lblCantidadOfertada">1</span>
<span id="a_rptLineas_ctl00_rptLineasOfertas_ctl02_lblNombre">Beta</span>"""


def test_comparative_table_in_sql(spark):
    spark.udtf.register("page_rows", page_tables.page_rows)
    spark.createDataFrame([(1, CUADRO)], "id int, html string").createOrReplaceTempView("cuadros")
    rows = spark.sql("SELECT id, r.* FROM cuadros, LATERAL page_rows(html, 'comparative') AS r").collect()
    said = [(r["part"], r["line"], r["tax_id"], r["price"], r["quantity"], r["issue"]) for r in rows]
    assert said == [
        ("bidder", None, "30123456789", None, None, None), ("issue", None, None, None, None, "a bidder has no tax id"), ("issue", None, None, None, None, "a line has no number"),
        ("quote", 1, "30123456789", Decimal("10.50"), Decimal("1500.00"), None), ("issue", 1, "30123456789", None, None, "stands twice"), ("issue", 1, None, None, None, "no tax id"),
    ]
    assert rows[0]["total"] == Decimal("1234.50")
    with pytest.raises(Exception, match="kind of page"):
        spark.sql("SELECT * FROM page_rows('<p>', 'other')").collect()


MARKUP = """<div>|</div>|<span id="a">|</span>|x|12|<br>|<br/>|<td>|</td>|<tr>|<table id="t">|</table>|<p>|</p >|<P>| |&amp;|&nbsp|<|>|<!-- c -->|<!DOCTYPE html>|<script>|</script>|<a href="x&amp;y=1" ID='q'>|<a href=x>|<b x="1"y="2">|<b x="1" x="2" id="">|</ b>|<title>|é|<li>|<td class="a>b" id="c<d">|<img src="a">x</img>|<b>x</i>|<td>1</td>|</x|<a x="|"|'""".split("|")


def test_plain_and_broken_markup_give_the_standard_parsers_elements():
    def tree(e):
        inside = [x if isinstance(x, str) else tree(x) for x in e.inside]
        return e.tag, e.attributes, e.text(), [x for x in inside if not isinstance(x, str)]

    rng = random.Random(1)
    for _ in range(3000):
        page = "".join(rng.choices(MARKUP, k=rng.randint(1, 14)))
        standard = page_tables._Builder("")
        standard.feed(page)
        standard.close()
        own = page_tables._Builder(page)
        assert (tree(own.root), [e.key for e in own.keyed]) == (tree(standard.root), [e.key for e in standard.keyed]), page


def test_plain_markup_needs_no_standard_parser(monkeypatch):
    def stop(*_):
        raise AssertionError("read by the standard parser")

    monkeypatch.setattr(page_tables._Builder, "feed", stop)
    assert len(page_tables.Page(CUADRO.rstrip()).keyed) == CUADRO.count(" id=")


def test_pages_are_read_with_the_columns_asked(spark):
    pages = spark.createDataFrame([(i, CUADRO.replace("10,5", "10,555") if i else None) for i in range(3)], "id int, html string")
    assert page_tables.read_pages(pages, "id", "html", "comparative", "issue", "price").columns == ["id", "issue", "price"]
    rows = page_tables.read_pages(pages, "id", "html", "comparative", "issue", "price").collect()
    assert sorted(r["id"] for r in rows) == [1] * 6 + [2] * 6
    assert [r["price"] for r in rows if r["price"]] == [Decimal("10.56")] * 2
    pages.createOrReplaceTempView("cuadros")
    spark.udtf.register("page_rows", page_tables.page_rows)
    told = spark.sql("SELECT id, r.* FROM cuadros, LATERAL page_rows(html, 'comparative') AS r").collect()
    assert sorted(map(str, told)) == sorted(map(str, page_tables.read_pages(pages, "id", "html", "comparative").collect()))


def test_process_page_without_sections():
    rows = list(page_tables.process_page(page_tables.Page("<p>nada")))
    assert [(r[0], r[2]) for r in rows] == [("issue", "header"), ("issue", "basic"), ("missing", "number"), ("missing", "name"), ("missing", "kind"), ("issue", "schedule"), ("issue", "guarantees"), ("issue", "lines")]
    form, direct = page_tables.Element("a", {"href": "javascript:__doPostBack('t$1','x')"}), page_tables.Element("a", {"href": 'javascript:WebForm_DoPostBackWithOptions(new WebForm_PostBackOptions("t", "a", true, "", "/doc?id=1", false, true))'})
    assert page_tables.link_of(form) == {"opens": "form", "target": "t$1", "argument": "x"} and page_tables.link_of(None) == {}
    assert page_tables.link_of(direct) == {"opens": "url", "target": "t", "argument": "a", "url": "/doc?id=1"}


@pytest.mark.parametrize(("text", "want"), [("$ 1.234,50", "1234.50"), ("178.376", "178376"), ("12.5", "12.5"), ("1.500,5 kg", "1500.5"), ("n/d", None), ("-3", "3"), ("1,2,3", None), ("12,", "12.")])
def test_amount_of(text, want):
    assert page_tables.amount_of(text) == (Decimal(want) if want else None)


def test_json_strings_at_any_depth(spark):
    texts = [r'{"a" :"x \"y\"", "b": [["\u00e9", 1, {"c\t" : ""}], null, true]}', '"alone"', "[]", "12", "no json", None, '{"a": 1, "a": 2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = sorted(tuple(r) for r in json_values.json_strings(rows, "id", "t").collect())
    assert out == [(0, 1, False, 'x "y"'), (0, 1, True, "a"), (0, 1, True, "b"), (0, 3, False, "é"), (0, 4, False, ""), (0, 4, True, "c\t"), (1, 0, False, "alone")]
    assert json_values.json_strings(rows.where("id > 2"), "id", "t").count() == 0


def test_page_lines_equal_a_plain_reading(spark):
    page = "<html><body><h1>A &amp; B</h1><script>x</script><figure>f<figcaption>c</figcaption></figure>uno <b>dos</b><br>tres<p>cuatro<table><tr><td>5</td><td> </td></tr></table><menu>seis</menu>"
    out = html.page_lines(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html").orderBy("line").collect()
    assert [(r["block"], r["text"]) for r in out] == [("h1", "A & B"), ("figure", "f"), ("figcaption", "c"), ("body", "uno dos"), ("br", "tres"), ("p", "cuatro"), ("td", "5"), ("menu", "seis")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$ 1.234,50", ["1234.50"]), ("178.376", ["178376"]), ("el punto 11.10 y 3.15", []), ("el monto de 11.10 es", ["11.10"]), ("11.10 pesos", ["11.10"]), ("21% y 30 días", []),
        ("IVA $ 10,00; total con IVA $ 20,00", ["20.00"]), ("prima de $ 5,00. Precio $ 7,00", ["7.00"]), (None, []), ("", []),
    ],
)
def test_amounts_in_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(V.amounts_in("t").alias("a")).first()["a"] == [Decimal(x) for x in want]


def test_matched_names(spark):
    portal_rows = [(1, 1, "30111111111", "ACME Norte S.A."), (1, 2, "30222222222", "Sur y Compañía"), (1, 3, "30333333333", "Gamma Delta SRL"), (1, 4, "30444444444", "Omega")]
    loaded = [(1, 10, "30111111111", "otro nombre"), (1, 20, None, "SUR"), (1, 30, None, "gamma"), (1, 31, None, "delta"), (1, 40, "30999999999", "Omega"), (1, 50, None, "S.A.")]
    out = names.matched_offers(
        spark.createDataFrame(portal_rows, "p int, portal_id int, tax_id string, name string"), spark.createDataFrame(loaded, "p int, offer_id int, tax_id string, name string"), "p"
    )
    assert {r["portal_id"]: (r["offer_id"], r["how"]) for r in out.collect()} == {1: (10, "tax_id"), 2: (20, "name"), 3: (None, "ambiguous"), 4: (None, "other_tax_id")}


def test_csv_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Tipo;Numero\nx;1\n", encoding="utf-8")
    assert [tuple(r) for r in files.csv_table(spark, f"file://{tmp_path}/a.csv", ["tipo", "numero"]).collect()] == [("x", "1")]
    with pytest.raises(ValueError, match="anio"):
        files.csv_table(spark, f"file://{tmp_path}/a.csv", ["tipo", "anio"])


def test_walks_keep_state_over_batches(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 7 > 0, F.lit(4)).alias("c"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = selection.packed_groups(rows, ["k"], ["i"], "c", 10).toPandas()
        taken = selection.budget_fill(rows, ["k"], ["i"], "c", 40).where("taken AND c IS NOT NULL").groupBy("k").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, own in out.sort_values("i").groupby("k"):
        sums = own.fillna({"c": 0}).groupby("part")["c"].sum()
        assert (sums <= 10).all() and own["part"].is_monotonic_increasing and list(sums.index) == list(range(1, len(sums) + 1))
    assert {r["count"] for r in taken} == {10}
    assert selection.packed_groups(rows.limit(0), ["k"], ["i"], "c", 10).count() == 0


def test_no_rule_fires_and_order_decides(spark):
    cell = dict(
        outcome="undetermined", doubt="", category="formal", complete=True, cited=False, required_forms=["policy"], chosen_forms=["note"], option="x", located=True, option_shown=False, option_use="no",
        option_unsure=False, concluded=False, physical=False, touched=False, marked=False, form_applies=None, external=True, has_sheet=False, ok_verdict=None, has_document=True, quoted=False, nothing_found=True,
        unreadable=False, kind=1, asked=False, offered=False, matching=False, compared="equal", conditions=0, pending=0, asks_more=False, by_absence=False, evidence=0, exigence="condition",
    )
    types = {str: "string", bool: "boolean", int: "int", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {'boolean' if k == 'form_applies' else types[type(v)]}" for k, v in cell.items()) + ", bid int"
    variants = [cell, cell | {"chosen_forms": ["policy"]}, cell | {"required_forms": [], "option": None}, cell | {"required_forms": [], "option": None, "external": False, "option_use": "yes"}]
    df = rules.reach_of_unreadable(spark.createDataFrame([(*v.values(), i) for i, v in enumerate(variants)], schema), "bid", "kind")
    assert [r["rule"] for r in rules.applied(df).orderBy("bid").collect()] == ["guarantee_form", "option", "external", None]
