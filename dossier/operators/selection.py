"""Selection that depends on what was taken before: budgets, groups, samples; and even splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def _walked(df: DataFrame, by: list[str], order: list[str], columns: str, step: Callable[[list, float], object], cost: str) -> DataFrame:
    """df with a column that step(state, cost) gives for each row, the rows of a key taken in order.

    Rows are sorted within partitions and pass through in batches, so a task holds a batch and one key's state, however
    many rows a key has. A null cost counts as 0.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    name = columns.split()[0]

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, []
        for batch in batches:
            out = []
            for own, price in zip(batch[by].itertuples(index=False, name=None), batch[cost].fillna(0), strict=True):
                if own != key:
                    key, state = own, []
                out.append(step(state, price))
            batch[name] = out
            yield batch

    parts = df.repartition(*by).sortWithinPartitions(*by, *order)
    return parts.mapInPandas(fn, f"{fields}, {columns}")


def budget_fill(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """taken: the row fits in what is left of its group's budget, in order; those that don't are passed over."""

    def step(state: list, price: float) -> bool:
        price, used = int(price), state[0] if state else 0
        fits = used + price <= budget
        state[:] = [used + price if fits else used]
        return fits

    return _walked(df, by, order, "taken boolean", step, cost)


def packed_groups(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """part: consecutive groups of each key's rows (from 1) within the budget; a row over the budget is one by itself."""

    def step(state: list, price: float) -> int:
        price, (part, used) = int(price), state or (1, 0)
        if state and used + price > budget:
            part, used = part + 1, 0
        state[:] = [part, used + price]
        return part

    return _walked(df, by, order, "part bigint", step, cost)


def levels(df: DataFrame, by: list[str], order: list[str], place: str, separation: float) -> DataFrame:
    """level: the first one on which the row's place is that far from the last row put there; rows go in order of place."""

    def step(state: list, own: float) -> int:
        level = next((i for i, last in enumerate(state) if own - last >= separation), len(state))
        state[level : level + 1] = [own]
        return level

    return _walked(df, by, order, "level int", step, place)


def systematic(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """size rows of each group at even places (i * total div size); all rows of smaller groups."""
    group = Window.partitionBy(*by)
    turn, total = F.row_number().over(group.orderBy(*order)) - 1, F.count("*").over(group)
    out = df.withColumns({"__turn": turn, "__total": total})
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * F.col("__total") / size))
    return out.where((F.col("__total") <= size) | F.array_contains(places, F.col("__turn").cast("bigint"))).drop("__turn", "__total")


def even_parts(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """part: consecutive parts of equal size, the fewest that hold most rows each; the last may be shorter."""
    group = Window.partitionBy(*by)
    turn, total = F.row_number().over(group.orderBy(*order)) - 1, F.count("*").over(group)
    size = F.ceil(total / F.ceil(total / most))
    return df.withColumn("part", F.floor(turn / size).cast("int"))


def fold_conditions(failed: Column, passed: Column, silent: Column) -> Column:
    """One outcome for a group of conditions: any failed; all passed; all silent; otherwise undetermined."""
    return F.when(F.bool_or(failed), "fail").when(F.bool_and(passed), "pass").when(F.bool_and(silent), "silent").otherwise("undetermined")
