"""Sharding: consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points (virtual nodes) of a hash ring; a row's key falls on the arc that ends at the
next point clockwise. Only the number of rows of each arc reaches the driver - as many numbers as there
are points, whatever the input's size. The driver fills the shards up to their capacity in ring order and
sends what overflows on clockwise to the next point of a shard that has room; the outcome is a list
of intervals of ranks within arcs. A row's rank within its arc then decides its shard and its slot. Ranks are prefix sums in two
levels, over SLICES slices of each arc and within a slice; slices are dealt by all columns, so that a repeated key is spread as well, and
no task sees more than one slice of an arc.

Capacities are the tightest that hold all rows (counts differ by one at most), so the law held is `rows`.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

SHARDS = 24
POINTS = 64  # virtual nodes of a shard
SLICES = 64  # of an arc
RING = 1 << 32


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard), by position; of equal positions the first shard's stays."""
    at: dict[int, int] = {}
    for s in range(shards):
        for p in range(points):
            at.setdefault(int(hashlib.md5(f"shard {s} point {p}".encode()).hexdigest()[:8], 16), s)
    return sorted(at.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, slot of the first): where the rows of each arc go.

    First every shard takes what its own arcs hold, in ring order, while it has room; then what has overflowed
    moves on clockwise from its arc to the next points of shards that are not full."""
    used = [0] * len(capacity)
    out, over = [], []
    for arc, (n, s) in enumerate(zip(counts, owners)):
        take = min(n, capacity[s] - used[s])
        if take:
            out.append((arc, 0, take, s, used[s]))
            used[s] += take
        if take < n:
            over.append((arc, take, n))
    free = [a for a, s in enumerate(owners) if used[s] < capacity[s]]
    for arc, lo, hi in over:
        while lo < hi:
            free = [a for a in free if used[owners[a]] < capacity[owners[a]]]
            at = free[bisect.bisect_right(free, arc) % len(free)]
            s = owners[at]
            take = min(hi - lo, capacity[s] - used[s])
            out.append((arc, lo, lo + take, s, used[s]))
            used[s] += take
            lo += take
    return out


def assign(df: DataFrame, key: str, tie: list[str], shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 within the shard).

    A null key is a key like any other. Rows of equal keys fall on one arc and are ordered by `tie`; rows equal in these too are
    interchangeable. An empty df gives no rows."""
    spark = df.sparkSession
    at = ring(shards, points)
    ends, owners = [p for p, _ in at], [s for _, s in at]
    pos = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")
    # the number of ring points before the position: arcs are found in a literal array, not by a join
    first = {}
    for i, e in enumerate(ends):
        first.setdefault(e >> 24, i)
    starts, last = [], len(ends)
    for b in range(255, -1, -1):
        last = first.get(b, last)
        starts.append(last)
    starts = starts[::-1] + [len(ends)]
    ends_lit, starts_lit = F.lit(ends), F.lit(starts)
    top = F.shiftright(pos, 24).cast("int")
    near = F.slice(ends_lit, F.get(starts_lit, top) + 1, F.get(starts_lit, top + 1) - F.get(starts_lit, top))
    arc = F.get(starts_lit, top) + F.size(F.filter(near, lambda e: e < pos))
    d = df.withColumn("_pos", pos).withColumn("_arc", (arc % len(ends)).cast("int"))
    d = d.withColumn("_slice", F.pmod(F.xxhash64(key, *tie), F.lit(SLICES)))
    slices = d.groupBy("_arc", "_slice").count()  # at most SLICES rows for each ring point
    counts = [0] * len(ends)
    for r in slices.groupBy("_arc").agg(F.sum("count").alias("count")).collect():  # one number for each ring point
        counts[r["_arc"]] = r["count"]
    moves = plan(counts, owners, capacities(sum(counts), shards))
    by: dict[int, list] = {}
    for a, lo, hi, s, slot in moves:
        by.setdefault(a, []).append((lo, hi, s, slot))
    rows = [(a, *m) for a, ms in by.items() for m in ms]
    table = spark.createDataFrame(rows, "_arc int, _lo long, _hi long, shard int, _slot long")
    along = Window.partitionBy("_arc").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_base", F.coalesce(F.sum("count").over(along), F.lit(0))).drop("count")
    w = Window.partitionBy("_arc", "_slice").orderBy("_pos", key, *tie)
    ranked = d.withColumn("_rank", F.row_number().over(w) - 1).join(F.broadcast(slices), ["_arc", "_slice"])  # bounded by the ring
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_rank"))
    moves_of = table.groupBy("_arc").agg(F.collect_list(F.struct("_lo", "_hi", "shard", "_slot")).alias("_moves"))
    out = ranked.join(F.broadcast(moves_of), "_arc")  # at most points + shards intervals, by construction
    m = F.get(F.filter("_moves", lambda x: (F.col("_rank") >= x["_lo"]) & (F.col("_rank") < x["_hi"])), 0)
    return (out.withColumn("_m", m).withColumn("shard", F.col("_m.shard"))
            .withColumn("slot", F.col("_m._slot") + F.col("_rank") - F.col("_m._lo"))
            .drop("_m", "_moves", "_arc", "_pos", "_rank", "_slice", "_base"))


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return pick(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    Null text counts as empty (size 8, crc32 0); grown_shard is null, as the law is `rows`. Extra columns are ignored."""
    out = assign(sized(docs), "doc_id", ["text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir):
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def loads_query(spark, sf_dir):
    """What SQL can express of op6: rows, slots and sizes of the shards, without who goes where."""
    d = query(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("size"))
    return d.select(F.col("shard").cast("long").alias("shard"), "rows", (F.col("slots") == F.col("last") + 1).alias("gapless"), F.sum("size").over(Window.partitionBy(F.lit(1))).alias("all_sizes"))


LOADS = """
with d as (select count(*) n, sum(octet_length(encode(coalesce(text, ''))) + 8) size from documents)
select i shard, n // 24 + case when i < n % 24 then 1 else 0 end "rows", true gapless, cast(size as bigint) all_sizes from d, range(24) t(i)
"""
