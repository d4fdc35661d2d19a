"""Amounts, identifiers, quantities, dates and terms read from text, and records as text."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DecimalType


def amount(text: Column) -> Column:
    """The number of a text as a decimal: points before a comma and points in groups of three are for thousands.

    Signs, currencies and letters around the figure are left out; null where no number is left.
    """
    bare = F.regexp_replace(text, r"[^0-9.,]", "")
    whole = F.replace(bare, F.lit("."), F.lit(""))
    number = F.when(bare.contains(","), F.replace(whole, F.lit(","), F.lit("."))).when(bare.rlike(r"^\d{1,3}(\.\d{3})+$"), whole).otherwise(bare)
    return number.try_cast("decimal(18,2)")


def amount_text(value: Column) -> Column:
    """A decimal as 1.234.567,89."""
    return F.translate(F.format_number(value.cast("decimal(18,2)"), 2), ",.", ".,")


# Weights of the first ten digits of a tax id, modulo 11.
TAX_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)


def tax_id_valid(text: Column) -> Column:
    """Eleven digits whose last one fits the others."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    total = F.lit(0)
    for i, w in enumerate(TAX_WEIGHTS):
        total = total + F.substring(digits, i + 1, 1).try_cast("int") * w
    check = (11 - total % 11) % 11
    return F.coalesce((F.length(digits) == 11) & (check == F.substring(digits, 11, 1).try_cast("int")), F.lit(False))


#: Percentages that texts spell out.
PERCENT_WORDS = {"uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "quince": 15, "veinte": 20, "treinta": 30, "cincuenta": 50, "cien": 100}


def only_percent(text: Column) -> Column:
    """The percentage that a text names, in figures or words; null if it names none or several."""
    low = F.lower(text)
    figures = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:[.,]\d+)?)\s*(?:%|por ciento)"), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(9,4)"))
    values = F.create_map(*[F.lit(x) for w, n in PERCENT_WORDS.items() for x in (w, n)])
    spelt = F.transform(F.regexp_extract_all(low, F.lit(r"([a-z]+)\s+por\s+ciento"), 1), lambda w: F.try_element_at(values, w).cast("decimal(9,4)"))
    found = F.array_distinct(F.array_compact(F.concat(figures, spelt)))
    return F.when(F.size(found) == 1, found[0])


def quantity(text: Column) -> Column:
    """value and unit of a leading quantity such as 1.500,50 kg; null where there is no number."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d[\d.,]*)\s*(.*?)\s*$", i)
    raw = part(1)
    whole = F.replace(raw, F.lit("."), F.lit(""))
    thousands = raw.rlike(r"^\d{1,3}(\.\d{3})+$") | raw.rlike(r"\..*\.")
    number = F.when(raw.contains(","), F.replace(whole, F.lit(","), F.lit("."))).when(thousands, whole).otherwise(raw).try_cast("decimal(18,4)")
    return F.when(number.isNotNull(), F.struct(number.alias("value"), part(2).alias("unit")))


def term(text: Column) -> Column:
    """days, kind (calendar or business), origin and from_opening of a term such as 60 días corridos desde la apertura; null otherwise."""
    pattern = r"(?iu)^\s*(\d+)\s*d[ií]as?\s+(corridos?|h[aá]biles?)\b\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    kind = F.when(F.lower(part(2)).startswith("h"), "business").otherwise("calendar")
    found = F.struct(part(1).try_cast("int").alias("days"), kind.alias("kind"), part(3).alias("origin"), F.lower(part(3)).contains("apertura").alias("from_opening"))
    return F.when(text.rlike(pattern), found)


def reference_date(day: Column, today: Column) -> Column:
    """ok, missing or future: a question can be asked of a day that has come."""
    return F.when(day.isNull(), "missing").when(day > today, "future").otherwise("ok")


def day_first(text: Column) -> Column:
    """d/m/yyyy as a date, null for no date."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{1,2}/\d{1,2}/\d{4})\s*$", 1), F.lit("d/M/yyyy")).cast("date")


def due(start: Column, days: Column, calendar: Column) -> Column:
    """The day a term of calendar days ends; unknown for business days."""
    return F.when(calendar, F.date_add(start, days))


def due_mark(day: Column, today: Column) -> Column:
    return F.when(day.isNull(), "unknown").when(day < today, "overdue").when(day == today, "today").otherwise("upcoming")


def month_window(moment: Column, month: Column) -> Column:
    """The moment is in the month that begins then; half-open."""
    return (moment >= month) & (moment < F.add_months(month, 1))


def elapsed(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)


def progress(done: Column, total: Column) -> Column:
    """Percent of a running job: never 100 before its end."""
    return F.when(total > 0, F.least(F.lit(99), F.round(done * 100 / total).cast("int"))).otherwise(0)


def canonical_json(*columns: str) -> Column:
    """A record as JSON text: fields in the order of their names, a space after colons and commas, nulls written."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
    fields = [F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def percent_text(value: Column) -> Column:
    """A share with one decimal as +12,5 %."""
    sign = F.when(value < 0, "-").otherwise("+")
    return F.concat(sign, F.translate(F.format_number(F.abs(value), 1), ",.", ".,"), F.lit(" %"))


# -- amounts of free text -------------------------------------------------------------------------------------------------

# How figures are written, what stands before the number of a clause, what names money, other concepts and the one asked for,
# and how far before and behind a figure they count.
FIGURE = re.compile(r"(?<![\w.,])(\$\s*)?(\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?)(?![\d])(?!\s*%)(?![.,]\d)")
CLAUSE_WORDS = "punto puntos clausula clausulas articulo articulos art arts inciso incisos apartado apartados numeral numerales item items capitulo seccion titulo anexo anexos pto".split()
MONEY_WORDS = "monto montos importe importes suma total valor precio pesos ars usd dolares".split()
CURRENCIES = ("pesos", "ars", "usd", "dolares", r"u\$s")
OTHER_CONCEPTS = (r"iva", r"i\W?v\W?a", r"impuestos?", r"alicuotas?", r"percepcion\w*", r"retencion\w*", r"primas?", r"premios?", r"sellados?", r"tasas?", r"recargos?", r"comision\w*", r"intereses")
SAME_CONCEPTS = (r"total\w*", r"precio\w*", r"importe total", r"monto total", r"suma asegurada", r"monto asegurado", r"monto de la garantia", r"valor de la garantia", r"cotizacion\w*")
BEFORE_CHARS, NEAR_CHARS, BEHIND_CHARS = 60, 25, 12

_words = lambda words: re.compile(r"\b(?:" + "|".join(words) + r")\b")
#: What is looked for around a figure: its place (the label up to it, the words near it, the text behind it, all before it) and the pattern.
SIGNALS = {
    "clause": ("before", re.compile(_words(CLAUSE_WORDS).pattern + r"\.?\s*(?:n[°ºo]\.?\s*|nro\.?\s*)?(?:[\d.]+\s*(?:,|;|\by\b|\be\b|\bo\b|\bal\b|-)\s*)*$")),
    "money": ("near", _words(MONEY_WORDS)),
    "currency": ("behind", re.compile(r"^\W{0,3}(?:" + "|".join(CURRENCIES) + r")\b")),
    "other": ("label", _words(OTHER_CONCEPTS)),
    "same": ("label", _words(SAME_CONCEPTS)),
}


def _signals(text: str, figure: re.Match) -> set[str]:
    """Which signals a figure has; sign and shape (thousands points or two decimals) among them, clause_like for one such as 11.10."""
    before = _folded(text[max(figure.start() - BEFORE_CHARS, 0) : figure.start()])
    places = {
        "before": before,
        "near": re.split(r"[.;:]\s", before[-NEAR_CHARS:])[-1],
        "behind": _folded(text[figure.end() : figure.end() + BEHIND_CHARS]),
        "label": re.split(r"[;\n]|\.\s", before)[-1],
    }
    out = {name for name, (place, pattern) in SIGNALS.items() if pattern.search(places[place])}
    whole, _, decimals = figure[2].replace(",", ".").rpartition(".")
    out |= {"sign"} if figure[1] else set()
    out |= {"shape"} if re.search(r"\.\d{3}", figure[2]) or (whole and len(decimals) == 2) else set()
    return out | ({"clause_like"} if re.fullmatch(r"\d{1,2}\.\d{1,2}", figure[2]) else set())


#: What makes a figure no amount, in terms of its signals.
NO_AMOUNT = (
    lambda s: not s & {"sign", "shape"},
    lambda s: "clause_like" in s and "sign" not in s and ("clause" in s or not s & {"money", "currency"}),
    lambda s: "other" in s and "same" not in s,
)


def _decimal(figure: str) -> Decimal:
    """1.234,5 and 1.234 have thousands points, 12.5 has none."""
    whole, comma, cents = figure.partition(",")
    points = comma or all(len(g) == 3 for g in whole.split(".")[1:])
    return Decimal((whole.replace(".", "") if points else whole) + ("." + cents if comma else ""))


@F.pandas_udf(ArrayType(DecimalType(18, 2)))
def amounts_in(text: pd.Series) -> pd.Series:
    """The amounts that a text states, in order.

    An amount has a currency sign, thousands points or two decimals. The number of a clause isn't one, nor is an amount that is
    labelled as a tax, premium or charge, unless its label names the total, the price or the guarantee too.
    """

    def one(x: str | None) -> list[Decimal]:
        figures = ((m, _signals(x, m)) for m in FIGURE.finditer(x or ""))
        return [_decimal(m[2]) for m, signals in figures if not any(rule(signals) for rule in NO_AMOUNT)]

    return text.map(one, na_action=None)


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
