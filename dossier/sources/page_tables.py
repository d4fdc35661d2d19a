"""Portal pages as typed rows: a table function with a reader for each kind of page, each page parsed once.

    SELECT page_id, r.* FROM pages, LATERAL page_rows(html, 'comparative') AS r

READERS is the register: a kind of page, the columns it yields and the function that reads a parsed page. New kinds are added
with :func:`reader`; the table function learns its columns from the kind's name when the query is analysed. :func:`read_pages` gives
the same rows of a DataFrame's pages in Arrow batches, with only the columns that are asked.
"""

from __future__ import annotations

import datetime
import html as entities
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, IntegerType, MapType, StringType, StructField, StructType

from .files import short_batches

AMOUNT = DecimalType(18, 2)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What an element closes when it opens, if that is still open inside the same table or list.
CLOSES = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: A piece of plain markup: a text and the end tag behind it, or the start tag with its first attribute, its others and, if nothing else
#: is in the element, its text up to its end tag. Tags are in lower case and attributes quoted. From where it isn't so, the last piece
#: goes on to the page's end. Elements whose content is no markup (or isn't in some versions of the standard parser) aren't plain.
NAME, SPACE = "[a-zA-Z][a-zA-Z0-9_:-]*+", r"[ \t\r\n]"
OPAQUE = "script|style|textarea|title|iframe|noembed|noframes|noscript|plaintext|xmp"
PIECE = re.compile(
    rf"([^<]*+)<(?:/([a-z][a-z0-9]*+){SPACE}*+>|(?!(?:{OPAQUE})\b)([a-z][a-z0-9]*+)"
    rf"""(?:{SPACE}++({NAME})="([^"]*)")?+((?:{SPACE}++{NAME}=(?:"[^"]*"|'[^']*'))*+){SPACE}*+"""
    r"(?:(/)>|>(?:([^<]*+)</\3(>))?+))|([\s\S]+)"
)
ATTRIBUTE = re.compile(rf"""({NAME})=(?:"([^"]*)"|'([^']*)')""")
PRICE = re.compile(r"([0-9]{1,3}(?:\.[0-9]{3})*+|[0-9]++),([0-9]++)")
FIGURE, THOUSANDS, NUMBER = re.compile(r"[^0-9.,]"), re.compile(r"\d{1,3}(?:\.\d{3})+"), re.compile(r"\d+\.?\d*|\.\d+")
DAMAGE = re.compile("[¿�è](?=[a-záéíóúñ])|[a-záéíóúñ][¿�]")


@dataclass(slots=True)
class Element:
    """An element of a page: its tag, attributes, parent and what is in it, texts and elements in order."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    inside: list[Element | str] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.attributes.get("id", "")

    def elements(self) -> Iterator[Element]:
        """All elements below, in the order of the page."""
        todo = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while todo:
            own = todo.pop()
            yield own
            todo += [x for x in reversed(own.inside) if isinstance(x, Element)]

    def children(self, *tags: str) -> list[Element]:
        return [x for x in self.inside if isinstance(x, Element) and x.tag in tags]

    def raw(self) -> str:
        out, todo = [], list(reversed(self.inside))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.inside)
        return "".join(out)

    def text(self) -> str:
        inside = self.inside
        return clean(inside[0] if len(inside) == 1 and isinstance(inside[0], str) else self.raw())

    def above(self, tag: str) -> Element | None:
        own = self.parent
        while own is not None and own.tag != tag:
            own = own.parent
        return own


class _Builder(HTMLParser):
    """Builds a page's elements. Plain markup is read by a pattern, tag by tag; from the first place that isn't plain on, the standard
    parser reads the rest, to the same elements."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("page")
        self.keyed: list[Element] = []
        for text, shut, tag, name, value, others, empty, inner, ended, rest in PIECE.findall(html):
            if text:
                self.at.inside.append(unescaped(text))
            if tag:
                attributes = {name.lower(): unescaped(value) if "&" in value else value} if name else {}
                if others:
                    attributes |= {k.lower(): unescaped(v or w) for k, v, w in ATTRIBUTE.findall(others)}
                if ended and tag not in CLOSES and tag not in VOID:
                    own = Element(tag, attributes, self.at, [unescaped(inner) if "&" in inner else inner] if inner else [])
                    self.at.inside.append(own)
                    if "id" in attributes and attributes["id"]:
                        self.keyed.append(own)
                    continue
                self.open(tag, attributes, bool(empty))
                if ended:
                    if inner:
                        self.at.inside.append(unescaped(inner))
                    self.handle_endtag(tag)
            elif shut:
                self.handle_endtag(shut)
            else:
                self.feed(rest)
                self.close()

    def open(self, tag: str, attributes: dict[str, str], empty: bool) -> None:
        if not empty and tag in CLOSES:
            shut = CLOSES[tag]
            while self.at.tag in shut:
                self.at = self.at.parent
        own = Element(tag, attributes, self.at)
        self.at.inside.append(own)
        if "id" in attributes and attributes["id"]:
            self.keyed.append(own)
        if not empty and tag not in VOID:
            self.at = own

    def handle_starttag(self, tag, attrs):
        self.open(tag, {k: v or "" for k, v in attrs}, False)

    def handle_startendtag(self, tag, attrs):
        self.open(tag, {k: v or "" for k, v in attrs}, True)

    def handle_endtag(self, tag):
        own = self.at
        if own.tag == tag and own.parent is not None:
            self.at = own.parent
            return
        while own.parent is not None and own.tag != tag:
            if own.tag == "table":  # what ends outside a table doesn't end it
                return
            own = own.parent
        if own.parent is not None:
            self.at = own.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def unescaped(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def clean(text: str) -> str:
    """Entities read, control characters out, letters composed, white space as one space."""
    plain = unescaped(text) if "&" in text else text
    if plain.isascii() and plain.isprintable():
        return " ".join(plain.split()) if " " in plain else plain
    return " ".join(unicodedata.normalize("NFC", CONTROL.sub("", plain.replace("\xa0", " "))).split())


def damaged(text: str) -> bool:
    """Letters of the text were replaced by the portal."""
    return bool(DAMAGE.search(text))


def amount_of(text: str) -> Decimal | None:
    """The figure of a text: a comma is before decimals, points are for thousands where they part groups of three; else null."""
    if text.isascii() and (text.isdigit() or not text):
        return Decimal(text) if text else None
    if m := PRICE.fullmatch(text):
        return Decimal(f"{m[1].replace('.', '')}.{m[2]}")
    bare = FIGURE.sub("", text)
    whole, comma, cents = bare.partition(",")
    if comma or THOUSANDS.fullmatch(whole):
        whole = whole.replace(".", "")
    number = f"{whole}.{cents}" if comma else whole
    return Decimal(number) if NUMBER.fullmatch(number) else None


def day_of(text: str) -> datetime.date | None:
    m = re.search(r"(\d{1,2})/(\d{1,2})/(\d{4})", text)
    try:
        return datetime.date(int(m[3]), int(m[2]), int(m[1])) if m else None
    except ValueError:
        return None


def tax_id_of(text: str) -> str | None:
    digits = text if text.isascii() and text.isdigit() else "".join(c for c in text if c in "0123456789")
    return digits if len(digits) == 11 else None


class Page:
    """A parsed page: its elements by id."""

    def __init__(self, html: str | None) -> None:
        builder = _Builder(html or "")
        self.root, self.keyed = builder.root, builder.keyed
        self.by_key = {e.attributes["id"]: e for e in reversed(self.keyed)}

    def value(self, key: str) -> str:
        own = self.by_key.get(key)
        return own.text() if own is not None else ""

    def ending(self, tag: str, suffix: str) -> Element | None:
        return next((e for e in self.keyed if e.tag == tag and e.key.endswith(suffix)), None)

    def rows(self, suffix: str) -> list[list[Element]]:
        """The cells of each row of the table whose id ends so; cells of tables inside it are no cells of it."""
        table = self.ending("table", suffix)
        if table is None:
            return []
        bodies = [table, *table.children("tbody", "thead", "tfoot")]
        return [tr.children("td") for body in bodies for tr in body.children("tr")]


READERS: dict[str, tuple[StructType, Callable[[Page], Iterator[tuple]]]] = {}


def reader(kind: str, columns: list[tuple[str, object]]):
    """Registers a reader of a kind of page with the columns of its rows."""

    def register(fn: Callable[[Page], Iterator[tuple]]):
        READERS[kind] = StructType([StructField(n, t) for n, t in columns]), fn
        return fn

    return register


class _PageRows:
    @staticmethod
    def analyze(html: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in READERS:
            raise ValueError(f"the kind of page is one of {', '.join(sorted(READERS))}")
        return AnalyzeResult(READERS[kind.value][0])

    def eval(self, html: str, kind: str):
        yield from READERS[kind][1](Page(html))


page_rows = udtf(_PageRows)


def _arrow(t: DataType) -> pa.DataType:
    if isinstance(t, ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, MapType):
        return pa.map_(_arrow(t.keyType), _arrow(t.valueType))
    if isinstance(t, StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in t])
    if isinstance(t, DecimalType):
        return pa.decimal128(t.precision, t.scale)
    return {StringType: pa.string(), IntegerType: pa.int32(), BooleanType: pa.bool_(), DateType: pa.date32()}[type(t)]


def _fitted(t: DataType) -> Callable | None:
    """How a value becomes one that Arrow takes for that type: figures are rounded to its places; null if it already is."""
    if isinstance(t, DecimalType):
        unit = Decimal(1).scaleb(-t.scale)
        return lambda x: None if x is None else x.quantize(unit, ROUND_HALF_UP)
    if isinstance(t, ArrayType):
        own = _fitted(t.elementType)
        return own and (lambda x: None if x is None else [own(y) for y in x])
    if isinstance(t, MapType):
        return lambda x: None if x is None else list(x.items())
    if isinstance(t, StructType):
        each = [(f.name, _fitted(f.dataType)) for f in t]
        return lambda x: None if x is None else {name: own(y) if own else y for (name, own), y in zip(each, x, strict=True)}
    return None


#: Rows of an Arrow batch that is given back, about: a page's rows stay together.
ROWS_OUT = 4096


def read_pages(pages: DataFrame, id_col: str, html: str, kind: str, *columns: str) -> DataFrame:
    """The id of each page and the rows that the reader of that kind finds in it; of its columns those that are named, else all."""
    short_batches(pages.sparkSession)
    told, read = READERS[kind]
    places = [told.names.index(c) for c in columns or told.names]
    kept = [told[i] for i in places]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, fits = [_arrow(f.dataType) for f in kept], [_fitted(f.dataType) for f in kept]

        def out(ids: pa.Array, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            said = list(zip(*rows, strict=True))
            values = [pa.array([fit(x) for x in said[i]] if fit else said[i], t) for i, t, fit in zip(places, types, fits, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *values], names=[id_col, *(f.name for f in kept)])

        for batch in batches:
            ids, of, rows = batch.column(0), [], []
            for i, content in enumerate(batch.column(1)):
                rows += read(Page(content.as_py()))
                of += [i] * (len(rows) - len(of))
                if len(rows) >= ROWS_OUT:
                    yield out(ids, of, rows)
                    of, rows = [], []
            if rows:
                yield out(ids, of, rows)

    return pages.select(id_col, html).mapInArrow(fn, StructType([pages.schema[id_col], *kept]))


# -- opening records ------------------------------------------------------------------------------------------------------------

GUARANTEE = StructType([StructField("kind", StringType()), StructField("form", StringType()), StructField("amount", AMOUNT)])


@reader(
    "opening",
    [("tax_id", StringType()), ("bidder", StringType()), ("confirmed_on", DateType()), ("currency", StringType()), ("total", AMOUNT), ("guarantees", ArrayType(GUARANTEE)), ("place", IntegerType()), ("damaged", BooleanType()), ("issue", StringType())],
)
def opening_record(page: Page) -> Iterator[tuple]:
    """A row for each bidder (issue null), in order, and one for each thing that is wrong. Rows of one tax id are one offer; its first row tells the rest."""
    issue = lambda tax, what: (tax, None, None, None, None, None, None, None, what)
    table, offers, wrong = page.ending("table", "gvOfertas"), {}, []
    if table is None:
        yield issue(None, "no table of offers")
        return
    for cells in page.rows("gvOfertas"):
        if len(cells) < 9:
            continue
        said = [c.text() for c in cells]
        tax, total = tax_id_of(said[1]), amount_of(said[4])
        if tax is None:
            wrong.append(issue(None, "no tax id"))
            continue
        own = offers.setdefault(tax, {"bidder": said[0], "day": day_of(said[2]), "currency": said[3], "total": total, "held": []})
        if said[0].lower() != own["bidder"].lower():
            wrong.append(issue(tax, "several names"))
        if total is not None and own["total"] is not None and total != own["total"]:
            wrong.append(issue(tax, "several totals"))
        held = (said[6], said[7], amount_of(said[8]))
        if any(x not in ("", None) for x in held) and held not in own["held"]:
            own["held"].append(held)
    for place, (tax, o) in enumerate(offers.items(), 1):
        yield tax, o["bidder"], o["day"], o["currency"], o["total"], o["held"], place, damaged(o["bidder"]), None
        wrong += [issue(tax, what) for what, value in (("no total", o["total"]), ("no date", o["day"])) if value is None]
    yield from dict.fromkeys(wrong)


# -- comparative tables -----------------------------------------------------------------------------------------------------------


BEHIND, DIGITS = re.compile(r"(.*?)\s*(?:-\s*(\d[\d-]*)|\(([\d-]+)\))"), re.compile(r"[\d-]+")
LINE, QUOTE = re.compile(r"(.*rptLineas_ctl\d+_)lblRenglon"), re.compile(r"(.*rptLineas_ctl\d+_)rptLineasOfertas_ctl\d+_lblNombre")


def _named(text: str) -> tuple[str, str | None]:
    """A bidder's name and tax id, which stands behind it after a dash or between brackets."""
    if text.endswith(")"):
        name, bracket, tax = text[:-1].rpartition("(")
        return (name.rstrip(), tax_id_of(tax)) if bracket and DIGITS.fullmatch(tax) else (text, None)
    m = BEHIND.fullmatch(text) if text[-1:].isdigit() or text.endswith("-") else None
    return (m[1], tax_id_of(m[2])) if m else (text, None)


@reader(
    "comparative",
    [("part", StringType()), ("line", IntegerType()), ("alternative", IntegerType()), ("tax_id", StringType()), ("bidder", StringType()), ("price", AMOUNT), ("quantity", AMOUNT), ("total", AMOUNT), ("place", IntegerType()), ("issue", StringType())],
)
def comparative_table(page: Page) -> Iterator[tuple]:
    """Rows of three parts: bidder (with total), quote (of a line and alternative) and issue. Of a quote that stands twice the first counts."""
    named, numbered, quoted = [], [], []
    for e in page.keyed:
        key = e.attributes["id"]
        if key.endswith("lblNombre"):
            quoted.append((key, e))
        elif key.endswith("lblRenglon"):
            numbered.append((key, e))
        elif key.endswith("_lblNombreProveedor"):
            named.append(e)
    bidders = [(e, *_named(e.text())) for e in named]
    for place, (e, name, tax) in enumerate(bidders, 1):
        if tax is None:
            yield "issue", None, None, None, name, None, None, None, None, "a bidder has no tax id"
        else:
            yield "bidder", None, None, tax, name, None, None, amount_of(page.value(e.key.removesuffix("lblNombreProveedor") + "lblTotal")), place, None
    lines: dict[str, tuple[int, int]] = {}
    for key, e in numbered:
        if m := LINE.fullmatch(key):
            number, option = e.text(), page.value(m[1] + "lblOpcion")
            if number.isdecimal():
                lines[m[1]] = int(number), int(option) if option.isdecimal() else 1
            else:
                yield "issue", None, None, None, None, None, None, None, None, "a line has no number"
    seen = set()
    for key, e in quoted:
        m = QUOTE.fullmatch(key)
        if not m or m[1] not in lines:
            continue
        own = key.removesuffix("lblNombre")
        (line, alternative), (name, tax) = lines[m[1]], _named(e.text())
        price, quantity, total = amount_of(page.value(own + "txtPrecioUnitario")), amount_of(page.value(own + "lblCantidadOfertada")), amount_of(page.value(own + "txtTotalPorRenglon"))
        why = "no tax id" if tax is None else "no price or quantity" if price is None or quantity is None else "stands twice" if (line, alternative, tax) in seen else None
        if why:
            yield "issue", line, alternative, tax, name, None, None, None, None, why
            continue
        seen.add((line, alternative, tax))
        yield "quote", line, alternative, tax, name, price, quantity, total, len(seen), None


# -- process pages --------------------------------------------------------------------------------------------------------------

# How the portal names the elements of a process page, and the fields that they are here.
FRAME = "UCVistaPreviaPliego_"
HEADER = {"lblNumPliego": "number", "lblNumExpediente": "file", "lblNomPliego": "name", "lblUnidadOperativa": "unit"}
BASIC = {
    "lblNumeroProceso": "number",
    "lblNombreProceso": "name",
    "lblObjetoContratacion": "object",
    "lblProcedimientoSeleccion": "kind",
    "lblEtapa": "stage",
    "lblModalidad": "mode",
    "lblAlcance": "scope",
    "lblMoneda": "currency",
    "lblEncuadreLegal": "legal_basis",
    "lblTipoProcesoGen": "outcome_document",
    "lblLugarRecepcionFisica": "place_of_delivery",
    "lblPlazoMantenimientoOferta": "offer_term",
}
LISTS = {"lblTipoCotizacionCantidad": "quote_kinds", "lblTipoCotizacionLinea": "quote_kinds", "lblTipoAdjudicacionCantidad": "award_kinds", "lblTipoAdjudicacionLinea": "award_kinds"}
COUNTS = {"lblOfertasPresentadas": "bidders", "lblOfertasConfirmadas": "confirmed_offers"}
REQUIRED = ("number", "name", "kind")
ACTS = {"UC_Clausulas_gvActosAdministrativos": "clauses", "UC_ActosAdministrativos_gvActosAdministrativos": "acts"}
DATED = {"UC_VistaPreviaActasApertura_gvActasApertura": ("opening", "lblNombreActaApertura"), "UC_VistaPreviaDictamenesPreAdjudicacion_gvDictamenesPreAdjudicacion": ("opinion", "lblNombreDictamen")}
GENERAL, LINES, CIRCULARS, VERSIONS = "UCCondicionesGenerales_gvCondicionesGenerales", "UC_DetalleProductos_gvLineaPliego", "UC_Circulares_gvCirculares", "UC_VersionesAnteriores_gvVersiones"
CIRCULAR_URL = "/PLIEGO/VistaPreviaCircularCiudadano.aspx?qs="


def link_of(anchor: Element | None) -> dict[str, str]:
    """How a link opens its document: by a form (target and argument) or by the url that the form's script names; nothing for other links."""
    href = anchor.attributes.get("href", "") if anchor is not None else ""
    called = re.search(r"(__doPostBack|WebForm_PostBackOptions)\((.*)", href)
    if not called:
        return {}
    said = [a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", called[2])]
    if len(said) < 2:
        return {}
    url = said[3] if called[1].startswith("WebForm") and len(said) > 3 else ""
    return {"opens": "url" if url else "form", "target": said[0], "argument": said[1]} | ({"url": url} if url else {})


@reader(
    "process",
    [("section", StringType()), ("place", IntegerType()), ("name", StringType()), ("value", StringType()), ("day", DateType()), ("quantity", DecimalType(18, 4)), ("details", MapType(StringType(), StringType())), ("damaged", BooleanType())],
)
def process_page(page: Page) -> Iterator[tuple]:
    """All that a process page says, by section: field, list, schedule, guarantee, count, line, document, circular, version; and what is
    wrong: missing (a required field), issue (a section that isn't there, a row that can't be read)."""
    out: list[tuple] = []
    places: dict[str, int] = {}

    def add(section: str, name: str | None, value: str | None, day=None, quantity=None, details=None) -> None:
        places[section] = places.get(section, 0) + 1
        out.append((section, places[section], name, value, day, quantity, {k: v for k, v in (details or {}).items() if v}, any(damaged(x) for x in (name, value) if x)))

    own = [(e, e.key.split(FRAME, 1)[1]) for e in page.keyed if FRAME in e.key]
    spans = [(e, at) for e, at in own if e.tag == "span"]
    named = {}
    for e, at in spans:
        named.setdefault(at, e)

    fields: dict[str, str] = {}
    for group, names in (("usrCabeceraPliego_", HEADER), ("UC_InformacionBasica_", BASIC)):
        there = {name: named[group + suffix].text() for suffix, name in names.items() if group + suffix in named}
        fields |= there
        if not there and not (group.startswith("UC") and any(group + s in named for s in LISTS)):
            add("issue", "header" if names is HEADER else "basic", "not found")
    for name, value in fields.items():
        if value:
            add("field", name, value)
    for name in REQUIRED:
        if not fields.get(name):
            add("missing", name, None)
    for suffix, name in LISTS.items():
        if "UC_InformacionBasica_" + suffix in named and (value := named["UC_InformacionBasica_" + suffix].text()):
            add("list", name, value)

    for e, at in spans:
        if at.startswith("UC_Cronograma_lbl") and "lblTit" not in at:
            panel = e.above("div")
            label = next((x for x in panel.elements() if x.tag == "label"), None) if panel is not None else None
            if label is not None:
                add("schedule", label.text(), e.text(), day_of(e.text()))
        elif at.startswith("UC_Garantias_") and (value := e.text()):
            add("guarantee", None, value)
    for suffix, name in COUNTS.items():
        if "UC_OfertasProceso_" + suffix in named and (value := named["UC_OfertasProceso_" + suffix].text()).isdecimal():
            add("count", name, value)

    for cells in page.rows(LINES):
        said = [c.text() for c in cells]
        if len(said) < 5 or not said[0].isdecimal():
            continue
        m = re.match(r"([\d.,]+)\s*(.*)", said[4])
        quantity = amount_of(m[1]) if m else None
        add("line", said[0], said[3], None, quantity, {"object": said[1], "item": said[2], "unit": m[2] if quantity is not None else said[4]})
        if quantity is None:
            add("issue", "lines", f"line {said[0]} has no quantity")

    def document(section: str, name: str, anchor: Element | None, day=None, details=None) -> None:
        opens = link_of(anchor)
        if not name:
            add("issue", "documents", "a document has no name")
            return
        add("document", section, name, day, None, (details or {}) | opens)
        if not opens:
            add("issue", "documents", f"nothing opens {name}")

    def inside(cells: list[Element], suffix: str, tag: str = "span") -> Element | None:
        return next((e for c in cells for e in c.elements() if e.tag == tag and e.key.endswith(suffix)), None)

    said_in = lambda cells, suffix: e.text() if (e := inside(cells, suffix)) is not None else ""
    for cells in page.rows(GENERAL):
        for anchor in (e for c in cells for e in c.elements() if e.tag == "a" and link_of(e)):
            approves = "Disposicion" in anchor.key
            document("general", "approval of the general terms" if approves else cells[0].text(), anchor, day_of(cells[2].text()) if len(cells) > 2 else None)
    for suffix, section in ACTS.items():
        for cells in page.rows(suffix):
            more = {"number": said_in(cells, "lblNumeroSade"), "special_number": said_in(cells, "lblNumeroEspecial")}
            document(section, said_in(cells, "lblDocumento"), inside(cells, "_btnVer", "a"), day_of(said_in(cells, "lblFechaVinculacion")), more)
    for row in (e for e in page.root.elements() if e.tag == "tr"):
        cells = row.children("td")
        anchor = next((e for c in cells for e in c.elements() if e.tag == "a" and re.search(r"UCAnexos_rptAnexos_.*_btnVerAnexo$", e.key)), None)
        if anchor is not None and not any(c.children("table") for c in cells):
            ends = {e.key.rsplit("_", 1)[-1]: e.text() for c in cells for e in c.elements() if e.tag == "span" and "UCAnexos_rptAnexos_" in e.key}
            document("annexes", ends.get("Label4", ""), anchor, None, {"kind": ends.get("Label2"), "description": ends.get("Label6")})
    for suffix, (section, name) in DATED.items():
        for cells in page.rows(suffix):
            anchor = next((e for c in cells for e in c.elements() if e.tag == "a" and re.search(r"_lnkVer(ActaApertura|Dictamen)$", e.key)), None)
            if anchor is not None and inside(cells, name) is not None:
                document(section, said_in(cells, name), anchor, day_of(cells[1].text()) if len(cells) > 1 else None, {"state": cells[2].text()} if section == "opinion" and len(cells) > 2 else None)
    if link_of(compared := page.ending("a", "UC_OfertasProceso_lnkVerCuadroComparativo")):
        document("comparative", "comparative table of offers", compared)

    for cells in page.rows(CIRCULARS):
        anchor = next((e for c in cells for e in c.elements() if e.tag == "a" and e.key.endswith("_btnVerCircular")), None)
        m = re.search(r"VerCircularCiudadano\(\s*'([^']*)'", anchor.attributes.get("onclick", "")) if anchor is not None else None
        number = said_in(cells, "lblNumero")
        if not cells:
            continue
        add("circular", number, CIRCULAR_URL + m[1] if m else None, day_of(said_in(cells, "lblFechaCreacion")), None, {"kind": said_in(cells, "lblTipo")})
        if not m:
            add("issue", "circulars", f"nothing opens circular {number}")
    for cells in page.rows(VERSIONS):
        if len(cells) >= 2 and cells[0].text().isdecimal():
            add("version", cells[0].text(), None, day_of(cells[1].text()))

    call = next((x for x in out if x[0] == "document" and x[2] == "acts" and x[3].lower().startswith("autoriza") and "llamado" in x[3].lower()), None)
    if call and call[4]:
        add("candidate", "authorised_on", None, call[4])
    for section, name in (("schedule", "schedule"), ("guarantee", "guarantees"), ("line", "lines")):
        if section not in places:
            add("issue", name, "not found")
    yield from out
