"""Where the operators keep what they write: tables and files in the folder that all executors share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch. Documents are long, so a batch of Spark's default of 10,000 rows could outgrow a worker.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``; where that is unset, one under /tmp for a local master, else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", told)
    return told if ":" in told.split("/", 1)[0] else f"file://{told}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    This cuts lineage: later jobs start from files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Writes df to the shared folder as a table bucketed by a key, as many buckets as a shuffle has partitions: joins by it leave df where it is.

    Best for what has just been grouped by the key: each task then has one bucket's rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    return spark.table(table)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`saved` or :func:`bucketed` that no later plan reads."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].strip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
            spark.sql(f"DROP TABLE IF EXISTS `{folder.rsplit('/', 1)[1].replace('-', '_')}`")


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of documents small; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def trim() -> None:
    """Gives memory that a task has freed back to the system, where the C library can: Python workers outlive their tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file from a task. It appears at once or not at all, so a repeated task does no harm."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)
