"""Text normalisation, shingles, similarity and pattern columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

# Accented letters of the languages covered and their plain forms. The letter ñ stays.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycAAAAAAEEEEIIIIOOOOOUUUUYC"
#: Ligatures, hard spaces and the soft hyphen, and what they become in a canonical line.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u00ad": ""}
#: Letters and the marks that Unicode puts on them as characters of their own, for the languages covered.
COMPOSED = {x + mark: unicodedata.normalize("NFC", x + mark) for mark, letters in (("\u0301", "aeiouyAEIOUY"), ("\u0300", "aeiouAEIOU"), ("\u0302", "aeiouAEIOU"), ("\u0308", "aeiouyAEIOU"), ("\u0303", "anoANO"), ("\u0327", "cC")) for x in letters}
#: Signs before figures and the words they become.
SIGNS = {"[-−]": "menos", "[+]": "mas", "±": "masmenos"}
#: Shingle size, least words of a text that is compared, share that makes a copy.
SHINGLE = 3
LEAST_WORDS = 20
COPY_SHARE = 0.9


def unaccented(text: Column) -> Column:
    """Accents off, ñ kept."""
    return F.translate(text, ACCENTED, PLAIN)


def search_normalized(text: Column) -> Column:
    """Accents off but for ñ; words in -acion and -ucion get theirs back, whatever their case."""
    return F.regexp_replace(unaccented(text), r"(?i)([au])cion(?![\p{L}\p{N}_])", "$1ción")


def plain(text: Column) -> Column:
    """Lower case without accents, ñ too."""
    return F.translate(unaccented(F.lower(text)), "ñ", "n")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compared(text: Column) -> Column:
    """The form in which two statements are compared: plain, without a leading "a)", signs before figures as words, marks and spaces
    as one space."""
    out = F.regexp_replace(plain(text), r"^\s*\(?[a-z0-9]{1,3}\)\s+", "")
    for sign, word in SIGNS.items():
        out = F.regexp_replace(out, rf"(^|[^\p{{L}}\p{{N}}_]){sign}([0-9])", f"$1{word}_$2")
    return collapsed(F.regexp_replace(out, r"[^\p{L}\p{N}_%]+", " "))


def canonical_line(text: Column) -> Column:
    """A line with marks put on their letters, ligatures spelt out, hard spaces as spaces, runs of spaces as one."""
    for old, new in (COMPOSED | LIGATURES).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, " {2,}", " ")


def folded(text: Column) -> Column:
    """The form in which answers are compared: no accents, no capitals, white space as one space."""
    return collapsed(F.replace(plain(text), F.lit("ß"), F.lit("ss")))


def digitless(text: Column) -> Column:
    """Runs of digits as #, so that lines that differ in a number only are one form."""
    return F.regexp_replace(text, r"\d+", "#")


def split_words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def bound(value: Column, fn) -> Column:
    """fn(value) with value computed once: inside a lambda, an expression from outside runs again for every element."""
    return F.transform(F.array(value), fn)[0]


def shingles(text: Column, k: int = SHINGLE, least: int = LEAST_WORDS) -> Column:
    """Distinct runs of k words; empty for a text of fewer than least words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", *[F.element_at(w, i + j) for j in range(k)]))
    enough = lambda w: F.when(F.size(w) >= max(least, k), F.array_distinct(runs(w))).otherwise(F.array().cast("array<string>"))
    return bound(split_words(text), enough)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def stems(text: Column, letters: int = 6, kept: int = 5) -> Column:
    """The first letters of each long word, distinct, in order."""
    long = F.filter(F.regexp_extract_all(plain(text), F.lit(r"([a-z]+)"), 1), lambda w: F.length(w) >= letters)
    return F.sort_array(F.array_distinct(F.transform(long, lambda w: F.substring(w, 1, kept))))


def nth_occurrence(text: Column, anchor: str, k: int) -> Column:
    """Zero-based place of the k-th occurrence of an anchor, -1 if there are fewer."""
    parts = F.split(text, F.regexp_replace(F.lit(anchor), r"([\W])", r"\\$1"))
    before = F.array_join(F.slice(parts, 1, k), anchor)
    return F.when(F.size(parts) > k, F.length(before)).otherwise(-1)


def item_rows(df: DataFrame, by: str, text: str) -> DataFrame:
    """The rows of tables of items in texts: by, number, what, amount (quantity and unit, or empty).

    Such a table has a first line that names the item, and two rows at least that begin with their number; the first row of a
    number counts. A tab between cells parts them, else the last figure with a unit is the amount.
    """
    lines = F.split(F.col(text), "\n")
    tables = df.select(by, lines.alias("lines")).where((F.size("lines") >= 3) & F.col("lines")[0].rlike(r"(?i)r[eé]ngl|[ií]tem"))
    rows = tables.select(by, F.posexplode("lines").alias("at", "line")).where("at > 0").withColumn("number", F.regexp_extract("line", r"^\s*(\d+)\s+\S", 1).try_cast("int"))
    rows = rows.where("number IS NOT NULL").groupBy(by, "number").agg(F.min_by("line", "at").alias("line"))
    many = rows.groupBy(by).agg(F.count("*").alias("n")).where("n >= 2").select(by)
    rest = F.regexp_extract("line", r"^\s*\d+\s+(\S.*?)\s*$", 1)
    amount = r"^(.*?)[\s.]+(\d[\d.,]*\s+\p{L}[\p{L}\d.]*)\.?$"
    cells = F.filter(F.transform(F.split("line", "\t"), F.trim), lambda c: c != "")
    tabbed, split = F.col("line").contains("\t"), rest.rlike(amount)
    what = F.when(tabbed, F.coalesce(F.try_element_at(cells, F.lit(2)), F.lit(""))).when(split, F.regexp_extract(rest, amount, 1)).otherwise(rest)
    many_cells = F.when(F.size(cells) > 2, F.array_join(F.slice(cells, 3, 1000), " ")).otherwise("")
    how_much = F.when(tabbed, many_cells).when(split, F.regexp_extract(rest, amount, 2)).otherwise("")
    return rows.join(many, by, "left_semi").select(by, "number", what.alias("what"), how_much.alias("amount"))


def marks(text: Column, *patterns: str) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike(p), F.lit(False)).cast("int")
    return total


def repaired(text: Column) -> Column:
    """A text whose UTF-8 was read as Latin-1 once too often, put right; any other text as it is."""
    fixed = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return F.when(text.rlike("[ÃÂ][\u0080-¿]") & ~text.rlike("[^\u0000-ÿ]"), fixed).otherwise(text)


def unusable_share(text: Column) -> Column:
    """The share of characters that are neither letters, digits, usual marks nor white space."""
    rest = F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:()\-/%$°º'\"]", "")
    return F.when(F.length(text) > 0, F.length(rest) / F.length(text)).otherwise(0.0)
