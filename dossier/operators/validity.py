"""Validity at a date: half-open intervals, repeals, changes and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def in_force(start: str, end: str, at: Column) -> Column:
    """The interval [start, end) holds the date; no end means still in force."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def ancestors(key: Column) -> Column:
    """A path key and every key above it: a/b/c gives a, a/b and a/b/c."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def earliest_repeals(units: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """Units in force that a repeal reaches, with the earliest one: repealed_on, relation_id, repealed_by.

    Containment is an equality join on the unit's ancestors, so no pair of unit and relation is made in vain.
    """
    valid = units.where(in_force("effective_from", "effective_to", at))
    repeals = relations.where((F.col("relation_type") == "deroga") & (F.col("effective_date") <= at)).select(
        F.col("target_norm_id").alias("norm_id"),
        F.coalesce("target_unit_key", F.lit("")).alias("reach"),
        F.struct("effective_date", "relation_id", "source_norm_id").alias("repeal"),
    )
    reached = valid.select("norm_id", "unit_id", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("key")))).alias("reach"))
    first = reached.join(repeals, ["norm_id", "reach"]).groupBy("unit_id").agg(F.min("repeal").alias("repeal"))
    found = {"repealed_on": "effective_date", "relation_id": "relation_id", "repealed_by": "source_norm_id"}
    return valid.join(first, "unit_id").select(*valid.columns, *[F.col(f"repeal.{x}").alias(k) for k, x in found.items()])


def consultable_units(units: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """Units of documents in force, with the earliest repeal that reaches them.

    units: norm_id, unit_id, key, effective_from, effective_to; relations: relation_id, relation_type, target_norm_id,
    target_unit_key (null: the whole norm), source_norm_id, effective_date. A repeal of a unit reaches what is inside it.
    """
    valid = units.where(in_force("effective_from", "effective_to", at))
    first = earliest_repeals(units, relations, at).select("unit_id", "repealed_on", "repealed_by")
    out = valid.join(first.dropDuplicates(["unit_id"]), "unit_id", "left")
    return out.select(*valid.columns, F.col("repealed_on").isNotNull().alias("repealed"), "repealed_on", "repealed_by")


def unit_changes(units: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """Changes that touch a unit or something inside it: relation and unit for each relation other than a repeal."""
    changes = relations.where((F.col("relation_type") != "deroga") & (F.col("effective_date") <= at) & F.col("target_unit_key").isNotNull())
    inner = changes.select("relation_id", "relation_type", "effective_date", "source_norm_id", F.col("target_norm_id").alias("norm_id"), F.explode(ancestors(F.col("target_unit_key"))).alias("key"))
    return inner.join(units.where(in_force("effective_from", "effective_to", at)).select("norm_id", "key", "unit_id"), ["norm_id", "key"])


def applicable_regimes(norms: DataFrame, documents: DataFrame, at: Column) -> DataFrame:
    """Norms of the general regime with a document in force."""
    valid = documents.where(in_force("effective_from", "effective_to", at)).select("norm_id").distinct()
    return norms.where("general_regime").join(valid, "norm_id", "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the key's last right row at or before its time.

    Both sides go through one window over the key in time order, so no pair of rows is ever made.
    """
    rest = [c for c in left.columns if c not in (key, left_time)]
    a = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*rest).alias("__left"), F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType).alias("__right"))
    b = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*rest)).schema[0].dataType).alias("__left"), F.struct(right_time, *values).alias("__right"))
    before = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__right", ignorenulls=True).over(before)).where("__side = 1")
    return both.select(key, F.col("__t").alias(left_time), "__left.*", *[F.col("__last")[v].alias(f"last_{v}") for v in values])


def close_intervals(versions: DataFrame, by: list[str], order: list[str], start: str) -> DataFrame:
    """effective_to of each version: the start of the next one, null for the last."""
    return versions.withColumn("effective_to", F.lead(start).over(Window.partitionBy(*by).orderBy(*order)))
