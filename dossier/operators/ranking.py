"""Economic ranking of bids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def competition_rank(df: DataFrame, by: list[str], amount: str, currency: str | None = None, discarded: Column | None = None) -> DataFrame:
    """position: 1 for the lowest amount, equal amounts share one and the next is skipped.

    Rows without an amount and discarded rows have none. Where a group's ranked rows name several currencies, nobody is
    ranked and mixed is true; a blank currency counts as one.
    """
    takes_part = F.col(amount).isNotNull() & (~discarded if discarded is not None else F.lit(True))
    group = Window.partitionBy(*by)
    place = F.rank().over(Window.partitionBy(*by, "__in").orderBy(amount))
    mixed = F.lit(False)
    if currency:
        own = F.when(F.col("__in"), F.coalesce(currency, F.lit("")))
        mixed = F.coalesce(F.min(own).over(group) != F.max(own).over(group), F.lit(False))
    out = df.withColumn("__in", F.coalesce(takes_part, F.lit(False))).withColumns({"__rank": place, "mixed": mixed})
    return out.withColumn("position", F.when(F.col("__in") & ~F.col("mixed"), F.col("__rank"))).drop("__in", "__rank")


def line_amount(price: str, quantity: str) -> Column:
    """Price times quantity; a missing quantity is 1, a missing price leaves no amount."""
    return F.col(price) * F.coalesce(F.col(quantity), F.lit(1))


def gap_to_lowest(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """gap_pct (one decimal, half up) over the group's lowest amount, and flags of the lowest and the highest."""
    group = Window.partitionBy(*by)
    low, high = F.min(amount).over(group), F.max(amount).over(group)
    gap = F.when(low > 0, F.round((F.col(amount) - low) * 100 / low, 1))
    return df.withColumns({"gap_pct": gap, "is_lowest": F.col(amount) == low, "is_highest": (F.col(amount) == high) & (high > low)})
