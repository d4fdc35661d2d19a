"""Half-open spans of text: coverage, overlap, merging, slices, greedy pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def sliced(text: str, start: str | Column, end: str | Column) -> Column:
    """The characters [start, end) of a text."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.substring(F.col(text), s + 1, e - s)


def coverage_faults(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Holes and overlaps between a group's spans: one row for each, with its bounds."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = df.select(*by, start, end, F.coalesce(F.max(end).over(before), F.lit(0)).alias("reach"))
    kind = F.when(F.col(start) > F.col("reach"), "hole").when(F.col(start) < F.col("reach"), "overlap")
    low, high = F.least(start, "reach"), F.when(kind == "hole", F.col(start)).otherwise(F.least(end, "reach"))
    return reach.withColumn("kind", kind).where("kind is not null").select(*by, "kind", low.alias("from_char"), high.alias("to_char"))


def merged(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans that touch or overlap as one, with how many went into it. The order of rows doesn't matter."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = df.select(*by, start, end, new.alias("__new")).withColumn("__island", island)
    return out.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__island")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket: int, share: float = 0.5) -> DataFrame:
    """Pairs of spans (key, id, start, end) of one document of which share of the left span is covered.

    Spans meet through the buckets of positions they touch, so a long document gives no pair of distant spans.
    """
    touch = lambda d, t: d.select(F.col(key), *[F.col(c).alias(f"{t}_{c}") for c in ("id", "start", "end")]).withColumn("b", F.explode(F.sequence(F.floor(F.col(f"{t}_start") / bucket), F.floor((F.col(f"{t}_end") - 1) / bucket))))
    both = touch(left, "l").join(touch(right, "r"), [key, "b"])
    common = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    out = both.withColumn("common", common).where((F.col("common") > 0) & (F.col("common") >= share * (F.col("l_end") - F.col("l_start"))))
    return out.select(key, "l_id", "r_id", "common").distinct()


def guarded(df: DataFrame, by: str, first: str, last: str, firm: Column, loose: Column) -> DataFrame:
    """df with guarded: a loose row whose sentences (first to last) meet those of a firm row of its group.

    Rows meet through single sentences, so a group's rows are not paired with each other.
    """
    spread = lambda c: F.explode(F.sequence(c(first), c(last)))
    sure = df.where(firm).select(by, spread(F.col).alias("__at")).distinct()
    own = df.where(loose).select(by, first, last).distinct()
    hit = own.withColumn("__at", spread(F.col)).join(sure, [by, "__at"], "left_semi").select(by, first, last).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, [by, first, last], "left").withColumn("guarded", loose & F.col("__hit").isNotNull()).drop("__hit")


def greedy_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """One-to-one pairs of l_id and r_id in each document: largest common part first, ties by l_id, then r_id.

    Pairs are sorted within partitions and pass through in batches, so a task holds a batch and the ids taken in one document, however
    many documents there are.
    """

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, right = None, set(), set()
        for batch in batches:
            keep = []
            for own, l_id, r_id in zip(batch[key], batch["l_id"], batch["r_id"], strict=True):
                if own != at:
                    at, left, right = own, set(), set()
                free = l_id not in left and r_id not in right
                keep.append(free)
                if free:
                    left.add(l_id)
                    right.add(r_id)
            yield batch[keep]

    rows = pairs.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, F.desc("common"), "l_id", "r_id")
    return rows.mapInPandas(fn, pairs.schema)
