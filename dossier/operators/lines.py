"""Lines and sentences of texts: boilerplate, paragraphs, repeated statements, sentence spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Stands where a sentence ends; a control character that texts don't have.
MARK = "\u0001"
# Abbreviations after whose point a sentence goes on.
ABBREVIATIONS = (
    "art arts inc incs dec decs res disp nro nros núm num cap apdo pto ptos pág pag págs ap cód cod ej dto "
    "lic dr dra ing sr sra ref vs s.a s.r.l s.a.s c.u.i.t cons pár par anex exp expte fs tít tit sec ss cfr"
).split()
ABBREVIATION = "(?i)(^|[^\\p{L}.])((?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"|\p{L}(?:\.\p{L})*)\.\s+)" + MARK
# Fixed value: what a passage opens with before its first word: a clause number, a bullet or an item letter.
LABEL = r"^(\s*(?:\d{1,3}(?:\.\d{1,3}){0,3}\.|[•−–\-]|[a-zñ]\)))(?:\s|$)"


def boilerplate(lines: DataFrame, group: str, page: str, form: Column, pages: DataFrame) -> DataFrame:
    """group, form, n, pages: forms of lines on more than half of a group's pages, and on two at least."""
    total = pages.groupBy(group).agg(F.countDistinct(page).alias("pages"))
    found = lines.select(group, page, form.alias("form")).groupBy(group, "form").agg(F.countDistinct(page).alias("n")).where("n >= 2")
    return found.join(total, group).where("2 * n > pages").select(group, "form", "n", "pages")


def unified(rows: DataFrame, by: str, order: str, form: Column, wide: Column) -> DataFrame:
    """kept: the first row of the group that has the row's form. A wide row, or one without a form, is kept by itself.

    The first is found by a grouping and joined back, so a form that very many rows share is no single window.
    """
    own = rows.withColumns({"__form": form, "__wide": wide})
    firsts = own.where("NOT __wide AND __form <> ''").groupBy(by, "__form").agg(F.min(order).alias("__first"))
    out = own.join(firsts, [by, "__form"], "left")
    kept = F.when(F.col("__wide") | (F.col("__form") == "") | F.col("__form").isNull(), F.col(order)).otherwise(F.col("__first"))
    return out.withColumn("kept", kept).drop("__form", "__wide", "__first")


def paragraphs(lines: DataFrame, by: str, order: str, text: str, opens: Column) -> DataFrame:
    """Lines joined to paragraphs: by, paragraph (from 1), text, lines, joins.

    A paragraph begins at the first line and where opens holds. A word cut by a hyphen before a line that goes on in small
    letters is joined; other lines are joined by one space.
    """
    place = Window.partitionBy(by).orderBy(order)
    rows = lines.withColumn("__text", F.col(text))
    new = F.when(F.lag("__text").over(place).isNull() | opens, 1).otherwise(0)
    rows = rows.withColumn("__new", new).withColumn("paragraph", F.sum("__new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "paragraph").orderBy(order)
    follows = F.lead("__text").over(inside)
    cut = F.col("__text").rlike(r"\p{L}[-\u2010]$") & F.coalesce(follows.rlike("^[a-záéíóúüñ]"), F.lit(False))
    rows = rows.withColumn("__cut", cut)
    after = F.lag("__cut").over(inside)
    body = F.when(F.col("__cut"), F.regexp_replace("__text", r"[-\u2010]$", "")).otherwise(F.col("__text"))
    gap = F.when(after.isNull() | after | F.lag("__text").over(inside).endswith(" "), "").otherwise(" ")
    piece = F.concat(gap, F.when(after.isNull(), body).otherwise(F.ltrim(body)))
    rows = rows.select(by, "paragraph", order, piece.alias("__piece"), F.col("__cut").cast("int").alias("__join"))
    pieces = F.sort_array(F.collect_list(F.struct(order, "__piece")))
    out = rows.groupBy(by, "paragraph").agg(pieces.alias("__p"), F.count("*").alias("lines"), F.sum("__join").alias("joins"))
    return out.select(by, F.col("paragraph").cast("int"), F.array_join("__p.__piece", "").alias("text"), "lines", "joins")


def sentence_spans(df: DataFrame, by: str, text: str) -> DataFrame:
    """by, sentence (from 1), start, end: half-open spans without the white space around them; the label of a passage is no part.

    A sentence ends at a point, exclamation or question mark before white space, but not after an abbreviation or an initial.
    """
    marked = F.regexp_replace(F.col(text), r"([.!?]\s+)", "$1" + MARK)
    for _ in range(2):  # an abbreviation right after another one shares its mark
        marked = F.regexp_replace(marked, ABBREVIATION, "$1$2")
    label = F.length(F.regexp_extract(F.col(text), LABEL, 1))
    label = label + F.when(label > 0, F.length(F.regexp_extract(F.substring(F.col(text), label + 1, F.lit(1 << 30)), r"^\s*", 0))).otherwise(0)
    rows = df.select(by, label.alias("__label"), F.posexplode(F.split(marked, MARK)).alias("sentence", "__piece"))
    before = Window.partitionBy(by).orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum(F.length("__piece")).over(before), F.lit(0)))
    blank = F.length("__piece") - F.length(F.regexp_replace("__piece", r"^\s+", ""))
    start, end = F.greatest(F.col("__at") + blank, F.col("__label")), F.col("__at") + F.length(F.regexp_replace("__piece", r"\s+$", ""))
    return rows.select(by, (F.col("sentence") + 1).alias("sentence"), start.cast("int").alias("start"), end.cast("int").alias("end")).where(F.col("start") < F.col("end"))


def expanded(spans: DataFrame, sentences: DataFrame, by: str, bucket: int = 256) -> DataFrame:
    """spans (by, id, start, end) widened to the sentences they touch; a span that touches none stays as it is.

    Spans and sentences meet through the buckets of positions they cover.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / bucket), F.floor((e - 1) / bucket)))
    left = spans.withColumn("__b", cells(F.col("start"), F.col("end")))
    right = sentences.select(by, F.col("start").alias("__s"), F.col("end").alias("__e")).withColumn("__b", cells(F.col("__s"), F.col("__e")))
    met = left.join(right, [by, "__b"]).where("__s < end AND __e > start").groupBy(by, "id").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    out = spans.join(met, [by, "id"], "left")
    return out.select(by, "id", F.least("start", "__s").alias("start"), F.greatest("end", "__e").alias("end"))
