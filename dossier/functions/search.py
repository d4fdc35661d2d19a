"""The language of searches: stems, web-style queries, references, compared answers, phrases that allow for plurals."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from ..sources.files import short_batches
from .numbers import NUMBER, figures
from .text import ACCENTED, PLAIN, folded, plain, search_normalized

# -- Spanish stems: the published Snowball algorithm, step by step --------------------------------------------------------

VOWELS = "aeiouáéíóúü"
# The suffixes of the algorithm's steps.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir".split()
STANDARD = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
    "log": "logía logías".split(),
    "u": "ución uciones".split(),
    "ente": "encia encias".split(),
    "mente": ["amente"],
    "able": ["mente"],
    "abil": "idad idades".split(),
    "at": "iva ivo ivas ivos".split(),
}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERBS_GU = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría "
    "iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas "
    "adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó".split()
_PLAIN = str.maketrans("áéíóú", "aeiou")


def _regions(w: str) -> tuple[int, int, int]:
    """Where the regions RV, R1 and R2 of a word begin."""
    v = [c in VOWELS for c in w]

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if v[i - 1] and not v[i]:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1)
    rv = len(w)
    if len(w) > 2:
        if not v[1]:
            rv = next((i + 1 for i in range(2, len(w)) if v[i]), len(w))
        elif v[0]:
            rv = next((i + 1 for i in range(2, len(w)) if not v[i]), len(w))
        else:
            rv = 3
    return rv, r1, r2


class _Suffixes(frozenset):
    """A set of suffixes."""

    def __init__(self, own) -> None:
        self.most = max(map(len, self))


def _longest(w: str, suffixes: _Suffixes) -> str:
    """The longest suffix that a word ends with: its endings are looked up, not the suffixes one by one."""
    for n in range(min(len(w), suffixes.most), 0, -1):
        if w[-n:] in suffixes:
            return w[-n:]
    return ""


#: The suffixes as they are looked up, and the step that each standard one belongs to.
_PRONOUNS, _BEFORE, _Y, _VERBS, _RESIDUAL = (_Suffixes(x) for x in (PRONOUNS, BEFORE_PRONOUN, Y_VERBS, VERBS + VERBS_GU, RESIDUAL))
_KIND = {s: k for k, own in reversed(STANDARD.items()) for s in own}
_STANDARD = _Suffixes(_KIND)


def stem(word: str) -> str:
    """The stem of a small-letter Spanish word."""
    w = word
    rv, r1, r2 = _regions(w)
    cut = lambda w, n: w[: len(w) - n]
    # pronouns
    p = _longest(w, _PRONOUNS)
    if p and len(w) - len(p) >= rv:
        body = cut(w, len(p))
        b = _longest(body, _BEFORE)
        if b and len(body) - len(b) >= rv:
            w = body if b[0] in "aeiou" else cut(body, len(b)) + b.translate(_PLAIN)
        elif body.endswith("uyendo") and len(body) - 5 >= rv:
            w = body
    # suffixes
    s, changed = _longest(w, _STANDARD), False
    kind = _KIND.get(s)
    inside = lambda w, s, r: len(w) - len(s) >= r

    def drop(w: str, *options: str) -> str:
        for o in options:
            if w.endswith(o) and inside(w, o, r2):
                return cut(w, len(o))
        return w

    if kind and (inside(w, s, r2) if kind != "mente" else inside(w, s, r1)):
        changed, w = True, cut(w, len(s))
        if kind == "ic":
            w = drop(w, "ic")
        elif kind == "log":
            w += "log"
        elif kind == "u":
            w += "u"
        elif kind == "ente":
            w += "ente"
        elif kind == "mente":
            if w.endswith("iv") and inside(w, "iv", r2):
                w = drop(cut(w, 2), "at")
            else:
                w = drop(w, "os", "ic", "ad")
        elif kind == "able":
            w = drop(w, "ante", "able", "ible")
        elif kind == "abil":
            w = drop(w, "abil", "ic", "iv")
        elif kind == "at":
            w = drop(w, "at")
    if not changed:
        s = _longest(w[rv:], _Y)
        if s and w[: len(w) - len(s)].endswith("u"):
            w, changed = cut(w, len(s)), True
    if not changed:
        s = _longest(w[rv:], _VERBS)
        if s:
            w = cut(w, len(s))
            if s in VERBS_GU and w.endswith("gu"):
                w = cut(w, 1)
    # what is left
    s = _longest(w[rv:], _RESIDUAL)
    if s:
        w = cut(w, len(s))
    elif w[rv:].endswith(("e", "é")):
        w = cut(w, 1)
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = cut(w, 1)
    return w.translate(_PLAIN)


#: Words that searches leave out.
STOP_WORDS = frozenset(
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien "
    "desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco "
    "ella estar estas algunas algo nosotros es son fue ser".split()
)


#: A word that is stemmed: letters and digits, with what follows a bar if it is digits; the same for a query's own words.
WORD = r"([\p{L}\p{N}]+(?:/[\p{N}]+)*)"
SEARCH_WORD = r"[^\W_]+(?:/\d+)*"


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            if len(known) > 500_000:
                known.clear()
            known[w] = stem(w)
        return known[w]

    return words.map(lambda ws: [one(w) for w in ws if w not in STOP_WORDS] if ws is not None else None)


def lexemes(text: Column) -> Column:
    """The stems of a text's words in order, common words left out; each distinct word is stemmed once a batch."""
    return _stems(F.regexp_extract_all(F.lower(search_normalized(text)), F.lit(WORD), 1))


#: One alternative of a search: clauses of (excluded, terms), a term with its distance from the first of its clause.
Alternative = list[tuple[bool, list[tuple[int, str]]]]


def parse_search(text: str, stemmer: Callable[[str], str] = stem, stop: Collection[str] = STOP_WORDS) -> list[Alternative]:
    """The alternatives of a web-style query: words are all asked for; or begins another alternative, quotes make a phrase, a minus sign excludes.

    Common words ask for nothing, but count in the distances of a phrase. What excludes belongs to its own alternative. Alternatives and
    clauses without terms go.
    """
    out: list[Alternative] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        terms = [(i, stemmer(w)) for i, w in enumerate(re.findall(SEARCH_WORD, (phrase or word).lower())) if w not in stop]
        if terms:
            out[-1].append((minus == "-", [(i - terms[0][0], t) for i, t in terms]))
    return [x for x in out if x]


STEMS_TYPE = MapType(StringType(), ArrayType(IntegerType()))
_TERM = StructType([StructField("distance", IntegerType()), StructField("term", StringType())])
QUERY_TYPE = ArrayType(ArrayType(StructType([StructField("excluded", BooleanType()), StructField("terms", ArrayType(_TERM))])))


@F.pandas_udf(STEMS_TYPE)
def document_lexemes(words: pd.Series) -> pd.Series:
    """The stems of a list of words, each with its positions from 1; common words count as positions only."""

    def one(own) -> dict[str, list[int]] | None:
        out: dict[str, list[int]] = {}
        for i, w in enumerate(own if own is not None else (), 1):
            if w not in STOP_WORDS:
                out.setdefault(stem(w), []).append(i)
        return out if own is not None else None

    return words.map(one)


@F.pandas_udf(QUERY_TYPE)
def query_lexemes(text: pd.Series) -> pd.Series:
    """The alternatives of a normalised web-style query, as :func:`parse_search` gives them."""
    clause = lambda c: {"excluded": c[0], "terms": [{"distance": d, "term": t} for d, t in c[1]]}
    return text.map(lambda x: [[clause(c) for c in a] for a in parse_search(x)], na_action="ignore")


def register_functions(spark: SparkSession) -> None:
    """search_normalize, search_document and search_query as SQL functions of the session; all three depend on their argument alone.

    search_document(text) is a map from stems to positions, search_query(text) the alternatives of a web-style query.
    """
    short_batches(spark)
    spark.udf.register("search_words_located", document_lexemes)
    spark.udf.register("search_query_parsed", query_lexemes)
    form = rf"regexp_replace(translate(input, '{ACCENTED}', '{PLAIN}'), r'(?i)([au])cion(?![\p{{L}}\p{{N}}_])', r'$1ción')"
    bodies = {
        "search_normalize": ("STRING", form),
        "search_document": (STEMS_TYPE.simpleString(), f"search_words_located(regexp_extract_all(lower({form}), r'{WORD}', 1))"),
        "search_query": (QUERY_TYPE.simpleString(), f"search_query_parsed({form})"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(input STRING) RETURNS {kind} RETURN {body}")


# -- synonyms, identities, references --------------------------------------------------------------------------------------

#: Names of one issuer; the first stands for all.
ISSUER_NAMES = ("AFIP", "ARCA", "Administración Federal de Ingresos Públicos", "Agencia de Recaudación y Control Aduanero")
_LOOSE = {"a": "[aá]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uúü]"}
_LOW = [re.sub(r"\s+", " ", n.lower().translate(_PLAIN)) for n in ISSUER_NAMES]
ISSUER = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(r"\s+".join("".join(_LOOSE.get(c, c) for c in w) for w in n.split()) for n in sorted(_LOW, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])"


def identity(text: Column) -> Column:
    """Type, number or issuer in one form: small letters, no accents but ñ, single spaces; the issuer's names are one."""
    form = F.trim(F.regexp_replace(F.translate(F.lower(text), "áéíóúü", "aeiouu"), r"\s+", " "))
    return F.when(form.isin(_LOW), _LOW[0]).otherwise(form)


def issuer_variants(text: Column) -> Column:
    """The text, and where it names the issuer a variant with each of its names; distinct, in order."""
    variants = F.array(text, *[F.regexp_replace(text, ISSUER, n) for n in ISSUER_NAMES])
    return F.when(text.rlike(ISSUER), F.array_distinct(variants)).otherwise(F.array(text))


def or_query(text: Column) -> Column:
    """The text's distinct words joined by or; the issuer's names follow where one of them is named, long ones quoted."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+(?:/[\p{L}\p{N}_]+)*)"), 1), lambda w: F.lower(w) != "or"))
    names = F.array(*[F.lit(f'"{n}"' if " " in n else n) for n in ISSUER_NAMES])
    both = F.when((F.size(words) > 0) & text.rlike(ISSUER), F.concat(words, names)).otherwise(words)
    return F.array_join(both, " or ")


# How questions name articles (with a suffix of their own, or a number with a suffix alone) and norms, in a text without accents.
SUFFIX = r"(?:bis|ter|quater|quinquies)"
ARTICLE = rf"\bart(?:iculo|\.)?\s*(?:n\s*[°º.]+\s*)?(\d+)(?:\s*[°º])?(?:\s+({SUFFIX})\b)?"
SUFFIXED = rf"\b(\d+)\s+({SUFFIX})\b"
NORM = r"(?<![\d/.])(\d{1,3}(?:\.\d{3})+|\d+)\s*/\s*(\d{4}|\d{2})(?![\d/])"


def _all_pairs(text: Column, pattern: str, name) -> Column:
    """name(first group, second group) of every match; a group that took no part is empty."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2)]
    return F.zip_with(*groups, lambda a, b: name(a, F.coalesce(b, F.lit(""))))


def article_references(text: Column) -> Column:
    """The articles that a question names, such as 23 or 14 bis; distinct, sorted. A number has no zeros before it."""
    own = lambda n, suffix: F.rtrim(F.concat(F.regexp_replace(n, "^0+(?=[0-9])", ""), F.lit(" "), suffix))
    found = [_all_pairs(plain(text), pattern, own) for pattern in (ARTICLE, SUFFIXED)]
    return F.sort_array(F.array_distinct(F.concat(*found)))


def norm_references(text: Column) -> Column:
    """The norms that a question names, as number/year with no points or spaces; distinct, sorted."""
    own = lambda n, year: F.concat(F.replace(n, F.lit("."), F.lit("")), F.lit("/"), year)
    return F.sort_array(F.array_distinct(_all_pairs(plain(text), NORM, own)))


def names_norm(number: Column, year: Column, reference: Column) -> Column:
    """A reference (number/year, of two or four digits) names a norm."""
    n, y = F.split_part(reference, F.lit("/"), F.lit(1)), F.split_part(reference, F.lit("/"), F.lit(2))
    return (F.replace(number, F.lit("."), F.lit("")) == n) & F.when(F.length(y) == 4, year == y.cast("int")).otherwise(year % 100 == y.cast("int"))


# -- answers and key data ---------------------------------------------------------------------------------------------------

#: Endings of the singular and of the plural: a word stands for another if one changes into the other.
PLURALS = (("", "s"), ("", "es"), ("z", "ces"))
#: A figure between brackets behind the number that it repeats.
REPEATED = NUMBER + r"(?: por ciento)? ?\( ?(\d[\d.,]*(?: ?%)?) ?\)"
#: A point between the thousands of a figure.
THOUSANDS_POINT = r"(?<=(?<![\d.,])\d{1,3}(?:\.\d{3}){0,9})\.(?=\d{3}(?:\.\d{3})*(?!\d))"


@F.pandas_udf(StringType())
def _figures(text: pd.Series) -> pd.Series:
    return text.map(figures, na_action="ignore")


def compared_answer(text: Column) -> Column:
    """The form in which answers are searched: folded; numbers in words as figures, once; no thousands points; % apart by a space."""
    once = F.regexp_replace(folded(text), REPEATED, "$1")
    shares = F.regexp_replace(_figures(once), r"(?<=\d)(?: ?%| por ciento\b)", " %")
    return F.trim(F.regexp_replace(F.regexp_replace(shares, THOUSANDS_POINT, ""), " +", " "))


def word_forms(word: str) -> set[str]:
    """A word, its plurals, and the words whose plural it may be."""
    swap = lambda old, new: {word[: len(word) - len(old)] + new} if word.endswith(old) else set()
    return {f for one, many in PLURALS for f in swap(one, many) | swap(many, one) if f} | {word}


def phrase_pattern(phrase: str) -> str:
    """A pattern for a folded phrase, each word in any of its forms, with no letter or digit at its ends and no part of a larger figure."""
    either = lambda m: "(?:" + "|".join(sorted(map(re.escape, word_forms(m[0])), key=lambda f: (-len(f), f))) + ")"
    parts = re.split(r"([^\W\d_]+)", phrase)
    body = "".join(re.sub(".+", either, p) if i % 2 else re.escape(p) for i, p in enumerate(parts))
    return rf"(?<![\p{{L}}\p{{N}}_])(?<!\d[.,]){body}(?![\p{{L}}\p{{N}}_])(?![.,]\d)"


def missing_data(first: Column, whole: Column, data: list[list[str]]) -> Column:
    """The numbers (from 0) of the key data of which no variant is in the answer. first: the first statement, folded; whole: all of
    it as :func:`compared_answer` gives it. A yes or no has to open the first statement; variants are given in their compared form."""

    def found(variant: str) -> Column:
        if variant in ("si", "no"):
            return first.rlike(r"^[\s\p{P}]*" + variant + r"(?:\p{P}|$)")
        return whole.rlike(phrase_pattern(variant))

    lacking = []
    for i, variants in enumerate(data):
        any_ = F.lit(False)
        for v in variants:
            any_ = any_ | found(v)
        lacking.append(F.when(~any_, F.lit(i)))
    return F.array_compact(F.array(*lacking))
