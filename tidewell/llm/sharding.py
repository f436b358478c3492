"""Sharding by minimax contiguous partition of ordered atomic groups.

Documents with equal texts form one group that stays together. Groups are ordered by the SHA-256 of
their text, so the order doesn't depend on files or partitions. The smallest shard capacity for which
greedy filling needs no more than ``n_shards`` shards is searched for, and the order is cut there.

Cut k of a capacity lies within one largest group below k times the capacity. Where the group ends in all these
windows are at most ``IN_REACH``, one pass brings them to the driver and the search ends there; where they are more, as with
one huge group, passes that try ``CANDIDATES`` capacities at once narrow the range first.

Only DataFrame functions run on the executors. The driver sees sums, maxima, cut positions and group ends: at most
``CANDIDATES`` numbers for each shard and round, and ``IN_REACH`` in all, whatever the input. Rows without an id
are dealt over the salts by their place, written down with the rows so that it stays, and numbered in any order.

Defined results: a null text counts as empty (size 1). A repeated row is a row of its own with its own
slot. With an empty table the result is empty. Shards stay empty if there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, shuffle_partitions

#: Capacities that one pass over the prefix sums tries at once: the search is 64-ary, not binary.
CANDIDATES = 64
#: Group ends that the driver may hold, 16 bytes each.
IN_REACH = 200_000
#: Sub-groups in which the rows of a group are numbered, so that no task gets a whole large group.
SALTS = 64


def _salt(own: Column) -> Column:
    """By the id; rows without one by their place. The features are stored, so a row keeps its salt."""
    return F.pmod(F.when(own.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(own)), F.lit(SALTS)).cast("int")


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
        _salt(F.col(id_col).cast("long")).alias("salt"),
    )


def _prefix_sums(features: DataFrame, partitions: int) -> DataFrame:
    """A row for each group: its bytes and rows, and the bytes and rows of all groups before it."""
    groups = (
        features.groupBy("key")
        .agg(F.sum("size").alias("g_bytes"), F.count(F.lit(1)).alias("g_rows"))
        .withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    )
    before = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inner = groups.repartitionByRange(partitions, "bucket").select(
        "key", "bucket", "g_bytes", "g_rows", F.coalesce(F.sum("g_bytes").over(before), F.lit(0)).alias("b_in"), F.coalesce(F.sum("g_rows").over(before), F.lit(0)).alias("r_in")
    )
    # 4,096 rows at most, so one task may number them
    totals = groups.groupBy("bucket").agg(F.sum("g_bytes").alias("b"), F.sum("g_rows").alias("r"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("r0"))
    return inner.join(F.broadcast(offsets), "bucket").select(
        "key", "g_bytes", "g_rows", (F.col("b_in") + F.col("b0")).alias("start"), (F.col("b_in") + F.col("b0") + F.col("g_bytes")).alias("end"), (F.col("r_in") + F.col("r0")).alias("start_rows")
    )


def _greedy(groups: DataFrame, capacities: list[int], n_shards: int, total: int) -> list[list[int]]:
    """For each capacity the cuts that greedy filling makes, at most ``n_shards`` of them.

    All capacities take their next cut in one pass; the filter keeps the pass to the row groups of the
    stored prefix sums in which those cuts lie.
    """
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(n_shards):
        at = [c[-1] if c else 0 for c in cuts]
        open_ = [i for i, a in enumerate(at) if a < total]
        if not open_:
            break
        limits = {i: at[i] + capacities[i] for i in open_}
        row = (
            groups.where(F.col("end").between(min(at[i] for i in open_), max(limits.values())))
            .agg(*[F.max(F.when(F.col("end") <= limits[i], F.col("end"))).alias(f"c{i}") for i in open_])
            .first()
        )
        for i in open_:
            cuts[i].append(int(row[f"c{i}"]))
    return cuts


def _windows(low: int, high: int, largest: int, n_shards: int, total: int) -> list[tuple[int, int]]:
    """Where the cuts of all capacities from low to high lie, as intervals that don't overlap."""
    out: list[tuple[int, int]] = []
    for k in range(1, n_shards + 1):
        a, b = max(1, k * (low - largest)), min(k * high, total)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if a <= b]


def _cuts(ends: list[int], capacity: int, n_shards: int) -> list[int]:
    """The cuts that greedy filling makes, from the sorted group ends in reach."""
    cuts: list[int] = []
    for _ in range(n_shards):
        at = cuts[-1] if cuts else 0
        if ends and at >= ends[-1]:
            break
        cuts.append(ends[bisect_right(ends, at + capacity) - 1])
    return cuts


def smallest_capacity(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts (bytes before each next shard)."""
    row = groups.agg(F.max("end").alias("total"), F.max("g_bytes").alias("largest")).first()
    total, largest = int(row["total"] or 0), int(row["largest"] or 0)
    if not total:
        return 0, []
    low = max(-(-total // n_shards), largest)
    high = max(low, total // n_shards + largest)  # feasible: every closed shard holds more than total / n_shards
    while low < high:
        inside = F.lit(False)
        for a, b in _windows(low, high, largest, n_shards, total):
            inside = inside | F.col("end").between(a, b)
        reach = groups.where(inside | (F.col("end") == total)).select("end")
        if reach.count() <= IN_REACH:
            ends = sorted(r["end"] for r in reach.collect())  # IN_REACH at most
            while low < high:  # binary search over the capacity
                middle = (low + high) // 2
                if _cuts(ends, middle, n_shards)[-1] >= total:
                    high = middle
                else:
                    low = middle + 1
            return high, _cuts(ends, high, n_shards)
        step = max(1, -(-(high - low + 1) // CANDIDATES))
        tried = sorted({*range(low, high + 1, step), high})
        cuts = _greedy(groups, tried, n_shards, total)
        k = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        high, low = tried[k], tried[k - 1] + 1 if k else tried[k]
    return high, _greedy(groups, [high], n_shards, total)[0]


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    spark = docs.sparkSession
    features = Stored(_features(docs, id_col, text_col), "shard-features").df
    groups = Stored(_prefix_sums(features, shuffle_partitions(spark)), "shard-groups", 8).df
    _, cuts = smallest_capacity(groups, n_shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("start") >= cut).cast("int")
    placed = groups.withColumn("shard", shard.cast("int"))
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("start_rows").alias("first")).collect()}  # n_shards rows
    first = F.lit(0).cast("long")
    for k, rows in firsts.items():
        first = F.when(F.col("shard") == k, F.lit(rows)).otherwise(first)
    placed = placed.select("key", "shard", (F.col("start_rows") - first).alias("slot0"))
    # numbering inside groups: counts by (group, salt) first, then row numbers inside each such part
    parts = features.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(placed, "key").select("key", "salt", "shard", (F.col("slot0") + F.col("before")).alias("slot0"))
    rank = F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id"))
    return (
        features.withColumn("rank", rank.cast("long"))
        .join(parts, ["key", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
