"""The corpus pipeline: documents in, sampled token ids of what is kept out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. Between stages, run() writes the rows to the shared folder, so a lost executor costs one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from dossier.llm.byte_cnn import fit_quality, quality
from dossier.llm.labelled import held_out
from dossier.llm.mixing import WORD, mix_sources
from dossier.llm.near_dup import near_duplicates
from dossier.llm.piece_sampling import sample_pieces
from dossier.llm.storage import saved, short_batches
from dossier.llm.string_kernel import UNDETERMINED, fit_languages, language

#: A document stays if its quality, and the share of its likeliest language, are this much at least.
LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; a null text is scored as an empty one.

    Each row is judged by itself: repeated rows stay or go together, null ids are judged like others and never held out.
    """
    short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, ~held_out("doc_id", 3, 1))
    return docs.where(quality(model, F.col("text")) >= LEAST_QUALITY)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is recognised; null, empty and letterless texts go.

    Each row is judged by itself: repeated rows stay or go together, null ids are judged like others. Of languages of equal share
    the first by name counts.
    """
    short_batches(spark)
    model = fit_languages(docs, ~held_out("doc_id", 4, 2))
    found = language(model, F.col("text"))
    return docs.where((found["lang_pred"] != UNDETERMINED) & (found["score"] >= LEAST_LANGUAGE))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id, with all its texts.

    Rows that repeat an id and a text are one. Rows with a null id, and texts without words, are like nothing and stay.
    """
    kept = saved(near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id").distinct(), "kept-ids")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; one taken twice is two rows.

    Repeated rows are documents of their own; of rows with equal id, source and size those that are taken more often are the first by
    text. Null is a source and an id like others. Texts without words have no size and weigh nothing; they are taken as often as the
    whole part of their source's rate.
    """
    keys = ["doc_id", "source", "__size"]
    turn = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    taken = mix_sources(docs).withColumnRenamed("size", "__size").withColumn("__turn", turn("copies")).where("copies > 0")
    taken = taken.select(*[F.col(k).alias(f"__of_{k}") for k in [*keys, "__turn"]], F.col("copies").alias("__copies"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.withColumn("__size", size)
    rows = rows.withColumn("__turn", turn("text"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in [*keys, "__turn"]]
    return rows.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document as token ids; rows with equal id and text get equal ones, null texts one without ids."""
    return sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix),
    ("pieces", encode),
]

#: The classifiers and the random draws have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
