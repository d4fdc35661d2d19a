"""Sharding by minimax contiguous partition, with DataFrame operations only.

Documents of equal text form one atomic group. The groups, ordered by a hash of their text, are cut
into consecutive shards so that the largest shard is as small as that order allows:

1. prefix sums of the group sizes come from two levels (within hash buckets, then over bucket totals),
   so no task sees all groups;
2. the smallest feasible capacity is found by binary search. A capacity is checked greedily: each shard
   takes groups while they fit. The greedy walk needs, for a few byte positions, the last prefix sum
   at or below them. The driver holds only a summary of bounded size (least and largest prefix sum of
   at most ``blocks`` ranges); where that cannot decide, just the undecided ranges are summarised again,
   finer, until every look-up is exact;
3. the groups are cut there.

The order begins with the groups larger than the fair share of what is left, the largest first; each is a shard of
its own, as it would set the capacity for all others. The shards are consecutive runs of that order, and the search
covers all groups after the giants. Rows get gapless slots in their shard. Rows that repeat an id and a text are one
entry with a number; the entries of a group are counted in salted parts, so neither a text nor an id that a third of the
rows share is one task's work.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import saved

#: Ranges that one summary brings to the driver at most.
BLOCKS = 8192
#: Groups in a bucket of the prefix sums, and rows in a salted part of a group, about.
PART_ROWS = 50_000
#: Repeats of one row that are written out together.
REPEATS = 10_000


@dataclass(frozen=True)
class Block:
    """A range of prefix sums: the least, the largest, how many, and the number of its part in the table."""

    low: int
    high: int
    n: int
    part: int


class Summary:
    """What the driver knows of the prefix sums."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda b: b.low)
        self.lows = [b.low for b in self.blocks]

    def at(self, x: int) -> tuple[int, int]:
        """Bounds of the largest prefix sum <= x; equal where it is known."""
        i = bisect_right(self.lows, x) - 1
        if i < 0:
            return 0, 0
        b = self.blocks[i]
        if b.high <= x:
            return b.high, b.high
        return b.low, (x if b.n > 2 else b.low)

    def walk(self, capacity: int, shards: int, total: int, hopeful: bool) -> tuple[bool, list[int], list[int]]:
        """The greedy check: feasible or not, the positions looked up, and the cuts."""
        at, asked, cuts = 0, [], []
        for _ in range(shards):
            if at + capacity >= total:
                return True, asked, cuts
            asked.append(at + capacity)
            at = self.at(at + capacity)[1 if hopeful else 0]
            cuts.append(at)
        return False, asked, cuts

    def least(self, shards: int, total: int, low: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity that the greedy check accepts."""
        high = total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, total, hopeful)[0]:
                high = mid
            else:
                low = mid + 1
        return low

    def open_ranges(self, capacities: tuple[int, int], shards: int, total: int) -> list[Block]:
        """The inexact blocks in which a look-up for any capacity of this range can fall."""
        _, first, _ = self.walk(capacities[0], shards, total, False)
        _, last, _ = self.walk(capacities[1], shards, total, True)
        found = set()
        for k in range(max(len(first), len(last))):
            a = first[k] if k < len(first) else total
            b = last[k] if k < len(last) else total
            i, j = bisect_right(self.lows, min(a, b)) - 1, bisect_right(self.lows, max(a, b)) - 1
            found.update(b for b in self.blocks[max(i, 0) : j + 1] if b.n > 2)
        return sorted(found, key=lambda b: b.low)


def _summarise(parts: DataFrame) -> list[Block]:
    """Least, largest and number of the prefix sums in each part; one small row a part."""
    rows = parts.groupBy("part").agg(F.min("high").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).collect()
    return [Block(r["low"], r["high"], r["n"], r["part"]) for r in rows]


def _refined(parts: DataFrame, ranges: list[Block], pieces: int, begin: int) -> DataFrame:
    """The prefix sums of some parts, each cut into pieces of its own, numbered from begin."""
    step = lambda b: -(-(b.high - b.low + 1) // pieces)
    table = parts.sparkSession.createDataFrame(
        [(b.part, begin + i * pieces, b.low, step(b)) for i, b in enumerate(ranges)], "part bigint, first bigint, low bigint, step bigint"
    )
    # the table has a row for each undecided part, a number that the summary's size bounds
    return parts.join(F.broadcast(table), "part").select("high", F.expr("first + (high - low) div step").alias("part"))


def minimax_cuts(prefix: DataFrame, total: int, shards: int, largest: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """The smallest capacity and the prefix sums after which to cut. prefix: a column ``high`` of distinct longs.

    Every round cuts each undecided part into two pieces at least, of which the first has its least and the last its largest
    prefix sum. So the parts get smaller in each round, and the search ends, for any number of shards.
    """
    parts = _refined(prefix.select("high", F.lit(0).cast("bigint").alias("part")), [Block(1, total, 0, 0)], blocks, 0)
    summary, begin = Summary(_summarise(parts)), blocks
    least = max(largest, -(-total // shards))
    while True:
        sure = summary.least(shards, total, least, hopeful=False)
        hoped = summary.least(shards, total, least, hopeful=True)
        open_ranges = summary.open_ranges((hoped, sure), shards, total)
        if not open_ranges:
            return sure, summary.walk(sure, shards, total, hopeful=False)[2]
        pieces = max(2, blocks // len(open_ranges))
        parts = _refined(parts, open_ranges, pieces, begin)
        begin += pieces * len(open_ranges)
        fresh, stale = _summarise(parts), set(open_ranges)
        if max(b.n for b in fresh) >= max(b.n for b in stale):
            raise RuntimeError("a round of the capacity search made no part smaller: the prefix sums are not distinct")
        summary = Summary([b for b in summary.blocks if b not in stale] + fresh)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard, equal texts together, sizes near equal.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32 (unsigned; 0 for null),
    shard, slot (gapless from 0 in the shard) and capacity (the largest shard that the search allowed).
    Null and empty texts are one group. Repeated rows each get their own slot; null ids are kept.
    An empty table gives an empty result, and shards stay empty where groups are fewer than shards. A very long text is
    a group over a fair share, with a shard of its own. Other columns of docs may have any name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    rows = saved(rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("times")), "shard-rows")
    n = rows.count()
    salts = max(16, n // PART_ROWS)
    buckets = max(256, n // PART_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int"))
    parts = saved(
        rows.groupBy("key", "salt").agg(F.sum("times").alias("n"), F.sum(F.col("size") * F.col("times")).alias("bytes")), "shard-parts"
    )
    groups = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards).select("key", "bytes").collect()
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    alone: list[bytes] = []
    rest, left = total, shards
    for r in top:
        if left > 1 and r["bytes"] * left > rest:
            alone.append(bytes(r["key"]))
            rest, left = rest - r["bytes"], left - 1
    is_alone = F.col("key").isin([F.lit(k) for k in alone]) if alone else F.lit(False)

    groups = groups.where(~is_alone).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumns({"in_bytes": F.sum("bytes").over(inside), "in_rows": F.sum("n").over(inside)})
    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        groups.groupBy("bucket")
        .agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
        .select(
            "bucket",
            F.coalesce(F.sum("b").over(over), F.lit(0)).alias("byte_offset"),
            F.coalesce(F.sum("r").over(over), F.lit(0)).alias("row_offset"),
        )
    )
    prefix = saved(
        groups.join(offsets, "bucket").select(
            "key",
            (F.col("in_bytes") + F.col("byte_offset")).alias("high"),
            (F.col("in_rows") + F.col("row_offset") - F.col("n")).alias("before"),
        ),
        "shard-prefix",
    )
    largest = max([r["bytes"] for r in top if bytes(r["key"]) not in alone], default=0)
    capacity, cuts = minimax_cuts(prefix, rest, left, largest) if rest else (0, [])

    shard: Column = F.lit(len(alone))
    for c in cuts:
        shard = shard + (F.col("high") > c).cast("int")
    placed = prefix.select("key", shard.cast("int").alias("shard"), "before")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("before").alias("first")).collect()}
    first: Column = F.lit(0).cast("bigint")
    for s, f in firsts.items():
        first = F.when(F.col("shard") == s, F.lit(f)).otherwise(first)
    own: Column = F.lit(None).cast("int")
    for s, k in enumerate(alone):
        own = F.when(F.col("key") == F.lit(k), F.lit(s)).otherwise(own)

    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    part_slots = (
        parts.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(placed.withColumn("start", F.col("before") - first).select("key", "shard", "start"), "key", "left")
        .select(
            "key",
            "salt",
            F.coalesce("shard", own).alias("shard"),
            (F.coalesce("start", F.lit(0)) + F.col("inner")).alias("start"),
        )
    )
    turn = Window.partitionBy("key", "salt").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed_rows = rows.withColumn("turn", F.coalesce(F.sum("times").over(turn), F.lit(0))).join(part_slots, ["key", "salt"])
    # the repeats of an entry again as rows, first in runs of bounded length
    first_of_run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1, F.lit(REPEATS).cast("bigint")))
    within = F.sequence(F.col("run"), F.least(F.col("run") + REPEATS, F.col("times")) - 1)
    return (
        placed_rows.withColumn("run", first_of_run)
        .withColumn("again", F.explode(within))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("start") + F.col("turn") + F.col("again")).cast("bigint").alias("slot"),
            F.lit(max(capacity, *[r["bytes"] for r in top], 0) if top else 0).cast("bigint").alias("capacity"),
        )
    )
