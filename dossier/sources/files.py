"""Small text formats and where queries write: CSV texts, JSON lines, appended tables."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); a local run without it writes under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or f'file:///tmp/checkpoints/{spark.sparkContext.applicationId}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch at most: documents are long, so a batch of Spark's default of 10,000 could outgrow a worker.
ARROW_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small where documents go to Python; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; earlier rows are never touched."""
    df.write.mode("append").parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; a line that doesn't fit stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header in UTF-8; the separator is the one its first line has more of. Missing columns are an error."""
    first = spark.read.text(path).first()
    head = first[0].lstrip("\ufeff") if first else ""
    sep = ";" if head.count(";") > head.count(",") else ","
    out = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)
    out = out.toDF(*[c.lstrip("\ufeff").strip().lower() for c in out.columns])
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"the file lacks the columns {', '.join(missing)}")
    return out.select(*required)


def csv_rows(df: DataFrame, id_col: str, text: str, required: list[str]) -> DataFrame:
    """The rows of CSV texts, one text a row: id, row (from 1) and the required columns; texts that lack one of them give none."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, row int, " + ", ".join(f"`{c}` string" for c in required)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, content in zip(batch[id_col], batch[text], strict=True):
                head = (content or "").lstrip("\ufeff").split("\n", 1)[0]
                reader = csv.reader(io.StringIO((content or "").lstrip("\ufeff")), delimiter=";" if head.count(";") > head.count(",") else ",")
                names = [n.strip().lower() for n in next(reader, [])]
                if set(required) <= set(names):
                    place = [names.index(c) for c in required]
                    rows += [(key, i, *[r[p] if p < len(r) else None for p in place]) for i, r in enumerate(reader, 1)]
            yield pd.DataFrame(rows, columns=[id_col, "row", *required])

    return df.select(id_col, F.col(text)).mapInPandas(fn, schema)
