"""A bounded sample of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Documents that a sample has, about; each label gets an equal share as far as it has documents.
SAMPLE_DOCS = 3000
#: Code points of a document that the sample keeps: a longer text gives a run from a place that its id decides.
SAMPLE_CHARS = 8192


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, by folds, leaves fold; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[pd.DataFrame, dict]:
    """text and label of about size documents, drawn by a hash of their id, and how many rows each label has.

    docs: doc_id, text; labels: doc_id, label. Rows with a null id, text or label are left out. An id with several labels
    has the largest, with several texts the least. The sample is bounded by its parameters and not by the tables.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share, left = {}, float(size)
    for i, (k, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        own = min(left / (len(counts) - i), n)
        share[k], left = own / n, left - own
    wanted = F.lit(False)
    for k, s in share.items():
        wanted = wanted | ((F.col("label") == F.lit(k)) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(s * (1 << 30))))
    drawn = labels.where(wanted).groupBy("doc_id").agg(F.max("label").alias("label"))
    room = F.greatest(F.length("text") - chars, F.lit(0))
    begin = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(7)), room + 1).cast("int")
    run = F.substring(F.col("text"), begin, F.lit(chars))
    # drawn has about size rows, a number that a parameter sets
    kept = docs.where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min(run).alias("text"))
    return kept.orderBy("doc_id").toPandas(), counts
