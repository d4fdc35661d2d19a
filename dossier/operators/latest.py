"""Current state derived from append-only rows: the latest row of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One partial aggregation on the key, no sort of whole groups."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*by, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def latest_if(df: DataFrame, by: list[str], order: list[str], kept: Column) -> DataFrame:
    """The last row of each key, if it is of the kind asked for: the choice comes before the filter."""
    return latest(df, by, order).where(kept)


def overlay(results: DataFrame, decisions: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """Results with the action of their latest decision, null where there is none."""
    last = latest(decisions.select(key, action, *[c for c in order if c not in (key, action)]), [key], order)
    return results.join(last.select(key, action), key, "left")


def unanswered(asked: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a counterpart."""
    return asked.join(answered.select(*keys).distinct(), keys, "left_anti")


def changed(current: DataFrame, earlier: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """Rows whose content differs from the latest earlier row of the key, or that are new."""
    last = latest(earlier.select(*keys, digest, *order), keys, order).select(*keys, F.col(digest).alias("__old"))
    out = current.join(last, keys, "left")
    return out.where(~F.col(digest).eqNullSafe(F.col("__old")) | F.col("__old").isNull()).drop("__old")


def discard_units(failed: DataFrame, by: str, item: str) -> DataFrame:
    """by, line, whole, grounds: what is proposed to be discarded of each bid.

    A bid with a ground that isn't one line's (null item) is one unit, the whole bid, with those grounds; any other bid is a unit a line.
    """
    lines = failed.groupBy(by, F.col(item).alias("line")).agg(F.count("*").alias("grounds"))
    whole = lines.groupBy(by).agg(F.bool_or(F.col("line").isNull()).alias("whole"))
    return lines.join(whole, by).where(~F.col("whole") | F.col("line").isNull()).select(by, "line", "whole", "grounds")


def best_in_time(df: DataFrame, by: list[str], score: list[Column | str], time: list[str], k: int) -> DataFrame:
    """The k best rows of each key by score, with their place in time among those kept."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(*score))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*time))
    return df.withColumn("__k", best).where(F.col("__k") <= k).withColumn("place", place).drop("__k")
