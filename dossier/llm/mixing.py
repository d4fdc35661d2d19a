"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken the same fractional number of times (target over source size).
The whole part is given to each; the fraction is rounded by the pivotal method: two documents with
undecided fractions meet, and mass (words) moves from one to the other, at random but fairly, until one of
them is decided. Each meeting keeps the words of the pair unchanged, so only the last
undecided document moves a source off its target. Buckets of a source are rounded apart, each leaves at most one undecided document, and those
meet in a reduction tree whose levels are Spark jobs; a source with a third of all rows is many buckets.
The one document left of a source goes to the nearer side, so a source ends within half a document of its target.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .storage import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket at most, about, and how many buckets meet in the next level of the tree; a source has as many at least.
BUCKET_ROWS = 20_000
FAN_IN = 64
WEIGHTS = (3, 1, 2)


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words; none gets
    over ``most`` times its own words, the excess goes to the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target: dict[str | None, float] = {}
    free, left = list(names), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not above:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        free = [s for s in free if s not in target]
    return target


def pivot(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds the fractions of a list of documents; returns them (0, 1, or one left open) and the open one or -1."""
    out = parts.astype(float).tolist()
    size = sizes.tolist()
    luck = draws.tolist()
    held = -1
    for j, p in enumerate(out):
        if not 0.0 < p < 1.0:
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        mine, other = a * out[held], b * p
        give, take = min(mine, b - other), min(other, a - mine)
        if luck[j] * (give + take) < take:  # held gives
            if give == mine and give < b - other:
                out[held], out[j] = 0.0, (other + give) / b
            elif give == mine:
                out[held], out[j] = 0.0, 1.0
            else:
                out[j], out[held] = 1.0, (mine - give) / a
        elif take == other and take < a - mine:
            out[j], out[held] = 0.0, (mine + take) / a
        elif take == other:
            out[j], out[held] = 0.0, 1.0
        else:
            out[held], out[j] = 1.0, (other - take) / b
        held = next((i for i in (held, j) if 0.0 < out[i] < 1.0), -1)
    return np.array(out), held


def _rounding(level: int, last: bool, seed: int):
    def fn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # the largest meet first, so that what is left at the end is small
        group = group.sort_values(["size", "doc_id", "digest", "part"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        own = crc32(repr((seed, level, *(None if pd.isna(k) else k for k in key))).encode())
        draws = np.random.Generator(np.random.PCG64(own)).random(len(group))
        part, held = pivot(group["size"].to_numpy(), group["part"].to_numpy(), draws)
        if last and held >= 0:
            part[held] = float(part[held] >= 0.5)
            held = -1
        group["part"] = part
        group["open"] = False
        if held >= 0:
            group.loc[held, "open"] = True
        return group

    return fn


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size (words of the text; none for null), source_size, target, copies and taken
    (copies times size). Documents without words take part with size 0 and give nothing. Null is a source of
    its own, the last. Repeated rows are documents of their own. The draws depend on seed, source and row key
    only, so reruns agree. Of documents with equal row keys any may be taken. A very long text counts whole and is one document like
    others. Other columns of docs may have any name. An empty table gives an empty result. The driver holds one number for each source.
    """
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.col(text_col).cast("string")).alias("digest"),
        ),
        "mix-rows",
    )
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["words"] for r in totals}
    targets = source_targets(sizes, weights, share, most)
    buckets = FAN_IN
    while buckets * BUCKET_ROWS < max((r["n"] for r in totals), default=0):
        buckets *= FAN_IN
    table = spark.createDataFrame(
        [(s, int(sizes[s]), float(targets[s]), float(targets[s] / sizes[s]) if sizes[s] else 0.0) for s in sizes],
        "name string, source_size bigint, target double, rate double",
    )
    whole = F.floor("rate").cast("int")
    level = (
        rows.join(table, rows["source"].eqNullSafe(table["name"]))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            whole.alias("whole"),
            F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0).alias("part"),
            "digest",
            F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).alias("bucket"),
        )
    )
    done, depth = [], 0
    while True:
        last = buckets == 1
        schema = f"{_ddl(level)}, open boolean"
        out = saved(level.groupBy("source", "bucket").applyInPandas(_rounding(depth, last, seed), schema), f"mix-level{depth}")
        done.append(out.where(~F.col("open")))
        if last:
            break
        buckets //= FAN_IN
        depth += 1
        level = out.where("open").drop("open").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    copies = F.col("whole") + F.col("part").cast("int")
    return result.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken")
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "open")
