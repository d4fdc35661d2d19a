"""Values of JSON texts at any depth, by VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .files import scratch


def json_strings(df: DataFrame, by: str, text: str) -> DataFrame:
    """by, depth, name (whether it is the name of a field) and string: every string of a JSON text at any depth, decoded, names too.

    Each level of all texts is opened by one job and written to the shared folder, so there are as many jobs as the deepest text has
    levels. A text that is no JSON, or that repeats a name in one object, has no strings; numbers, booleans and nulls are none.
    """
    spark = df.sparkSession
    level, found, depth = df.select(F.col(by), F.try_parse_json(F.col(text)).alias("v")).where("v IS NOT NULL"), [], 0
    while True:
        path = scratch(spark, "json-level")
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        kind = F.schema_of_variant("v")
        tag = lambda d, name, string: [by, F.lit(d).alias("depth"), F.lit(name).alias("name"), string.alias("string")]
        found.append(level.where(kind == "STRING").select(*tag(depth, False, F.variant_get("v", "$", "string"))))
        nested = level.where(kind.startswith("ARRAY") | kind.startswith("OBJECT"))
        if nested.isEmpty():
            return reduce(DataFrame.unionByName, found)
        depth += 1
        inner = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        found.append(inner.where("key IS NOT NULL").select(*tag(depth, True, F.col("key"))))
        level = inner.select(by, F.col("value").alias("v"))
