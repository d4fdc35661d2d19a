"""The public portal's pages as rows: opening records, comparative tables, process pages, and how their bytes are read."""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


DAMAGED = "[\u00bf\ufffd\u00e8](?=[a-záéíóúñ])|[a-záéíóúñ][\u00bf\ufffd]"


@F.pandas_udf(StringType())
def portal_text(text: pd.Series) -> pd.Series:
    """Entities read, control characters out, letters composed, white space as one space; null gives an empty text."""
    control = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

    def one(x: str | None) -> str:
        plain = control.sub("", entities.unescape(x or "").replace("\xa0", " "))
        return " ".join(unicodedata.normalize("NFC", plain).split())

    return text.map(one, na_action=None)


def damaged(text: Column) -> Column:
    """The text has letters that the portal replaced; they can't be put right."""
    return F.coalesce(text.rlike(DAMAGED), F.lit(False))


def format_of(content: Column) -> Column:
    """pdf, html or unknown, from the first bytes; a byte order mark may come first."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    bare = F.regexp_replace(head, "^(?:\u00ef\u00bb\u00bf|\u00fe\u00ff|\u00ff\u00fe)", "")
    return F.when(bare.startswith("%PDF-"), "pdf").when(bare.rlike(r"(?i)^\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body)\b"), "html").otherwise("unknown")


def decoded(content: Column) -> Column:
    """The text of a page's bytes: by its byte order mark, the charset it declares, or UTF-8 where that fits, else Latin-1."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"\']?\s*([a-z0-9_-]+)", 1))
    latin = F.decode(content, "ISO-8859-1")
    utf8 = F.decode(content, "UTF-8")
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(marked, F.decode(F.substring(content, F.lit(4), F.octet_length(content)), "UTF-8")).when(declared.isin("iso-8859-1", "latin-1", "windows-1252"), latin).when(valid, utf8).otherwise(latin)


def page_kind(chars: Column, unusable: Column, image_cover: Column, ink: Column, annotations: Column, cover: float = 0.9, share: float = 0.1) -> Column:
    """scanned, unusable text, text, fields only or blank, from what was seen of a page."""
    return (
        F.when(image_cover >= cover, "scanned")
        .when((chars > 0) & (unusable / chars >= share), "unusable text")
        .when(chars > 0, "text")
        .when(ink, "scanned")
        .when(annotations > 0, "fields only")
        .otherwise("blank")
    )


def recognised_state(words: DataFrame, by: list[str], word: str, confidence: str) -> DataFrame:
    """read, doubtful or illegible for each recognised page: fewer than three words with a letter or digit are illegible, else the
    average confidence decides (80 and 50)."""
    seen = words.groupBy(*by).agg(F.count_if(F.col(word).rlike(r"(?U)\w")).alias("__words"), F.avg(confidence).alias("confidence"))
    state = F.when(F.col("__words") < 3, "illegible").when(F.col("confidence") >= 80, "read").when(F.col("confidence") >= 50, "doubtful").otherwise("illegible")
    return seen.withColumn("state", state).drop("__words")
