"""Quality measures: proportions with intervals, confusion, thresholds, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The normal quantile of the interval, and the bound of a score before its logarithm.
Z = 1.96
BOUND = 1e-9


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Lower and upper end of the interval of a proportion; null without cases."""
    n, p = total.cast("double"), hits.cast("double") / total
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    low, high = F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
    return F.when(total > 0, low), F.when(total > 0, high)


def proportion(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """hits, total, share and its interval for each group, in one pass."""
    out = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    low, high = wilson(F.col("hits"), F.col("total"))
    share = F.when(F.col("total") > 0, F.col("hits") / F.col("total"))
    return out.withColumns({"share": F.round(share, 9), "low": F.round(low, 9), "high": F.round(high, 9)})


def confusion(predicted: DataFrame, truth: DataFrame, key: str, value: str, expected: str) -> DataFrame:
    """Cases that are exact, abstained (no prediction) or wrong; truth rows without a case are abstained."""
    both = truth.join(predicted, key, "left")
    kind = F.when(F.col(value).isNull(), "abstained").when(F.col(value) == F.col(expected), "exact").otherwise("wrong")
    return both.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def compare_runs(old: DataFrame, new: DataFrame, key: str, passed: str) -> DataFrame:
    """Each case's change between two runs."""
    a, b = old.select(key, F.col(passed).alias("__a")), new.select(key, F.col(passed).alias("__b"))
    change = (
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "removed")
        .when(F.col("__a") & ~F.col("__b"), "regression")
        .when(~F.col("__a") & F.col("__b"), "improvement")
        .otherwise("same")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def gap_threshold(df: DataFrame, score: str, positive: Column, decimals: int = 3) -> DataFrame:
    """A threshold in the middle of the gap between the best negative and the worst positive score, cut to decimals.

    Null where the scores overlap or a side is empty.
    """
    out = df.agg(F.min(F.when(positive, F.col(score))).alias("worst_positive"), F.max(F.when(~positive, F.col(score))).alias("best_negative"))
    scale = 10**decimals
    middle = F.floor((F.col("worst_positive") + F.col("best_negative")) / 2 * scale) / scale
    return out.withColumn("threshold", F.when(F.col("worst_positive") > F.col("best_negative"), middle))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    """The inverse of the sigmoid, for a score kept off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(BOUND)), F.lit(1 - BOUND))
    return F.ln(q / (1 - q))
