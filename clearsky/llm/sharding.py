"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Each shard owns ``virtual`` points on the ring of 64-bit hashes. A row belongs
to the next point clockwise. Capacities add up to the number of rows and differ
by at most one, so every shard ends exactly at its capacity (law ``rows``). Rows
beyond a full shard's capacity go on clockwise to the next shard with room; all
others stay where the ring put them, which keeps movement small when a shard is
added.

The rows' hashes are written once, narrow (about 40 bytes), and only their *numbers*
per arc (``shards * virtual``, whatever the data) reach the driver, which walks
the ring over these numbers. The answer is a list of rank ranges per arc, at most
``shards * virtual + shards`` for each of two passes. Ranks inside an arc come
from buckets of about ``bucket_rows`` rows, whatever the size of the arc.

Cases: a null text has size 8 and the CRC of the empty text; a null ``doc_id`` is
hashed like any value; rows that are equal in id, size and CRC are spread over the
buckets by their place in the written table; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearsky.session import stored

SHARDS = 24
VIRTUAL = 64
BUCKET_ROWS = 50_000


def ring_points(shards: int = SHARDS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(point, shard) in ring order. A new shard adds points and moves none."""
    points = []
    for shard in range(shards):
        for v in range(virtual):
            raw = hashlib.sha256(f"shard {shard} point {v}".encode()).digest()[:8]
            points.append((int.from_bytes(raw, "big", signed=True), shard))
    return sorted(points)


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges (arc, first, last exclusive, shard, first slot) with bounded loads.

    First every arc fills its own shard in ring order; then what is left goes
    clockwise to the next shard with room.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    ranges, left = [], []
    for arc, n in enumerate(counts):
        s = owners[arc]
        take = min(n, room[s] - filled[s])
        if take:
            ranges.append((arc, 0, take, s, filled[s]))
            filled[s] += take
        if take < n:
            left.append((arc, take, n))
    for arc, first, n in left:
        at = arc
        while first < n:
            at = (at + 1) % len(owners)
            s = owners[at]
            take = min(n - first, room[s] - filled[s])
            if take:
                ranges.append((arc, first, first + take, s, filled[s]))
                filled[s] += take
                first += take
    return ranges


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    virtual: int = VIRTUAL,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    spark = docs.sparkSession
    points = ring_points(shards, virtual)
    edges = [p for p, _ in points]
    owners = [s for _, s in points]
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    keys = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    ).withColumn("at", F.xxhash64("doc_id"))
    # The first point at or after the hash; beyond the last one the ring begins again.
    coarse = F.shiftright("at", 52).cast("int") + 2048
    starts = [bisect_left(edges, (i - 2048) << 52) for i in range(4097)]
    lowest = F.element_at(F.array(*map(F.lit, starts)), coarse + 1)
    inside = F.slice(
        F.array(*map(F.lit, edges)), lowest + 1, F.element_at(F.array(*map(F.lit, starts)), coarse + 2) - lowest
    )
    arc = (lowest + F.size(F.filter(inside, lambda e: e < F.col("at")))) % len(edges)
    keys = keys.withColumns({"arc": arc.cast("int"), "place": F.monotonically_increasing_id()})
    keys = stored(keys, "ring")

    total = keys.count()
    buckets = max(1, -(-total // (len(edges) * bucket_rows)))
    # Hash bits order the arc; equal rows differ by their place, so that no bucket grows with copies.
    order = F.xxhash64("at", "text_crc32", "place")
    keys = keys.withColumn("bucket", F.pmod(order, F.lit(buckets)).cast("int"))
    sizes = keys.groupBy("arc", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("arc", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    counts = [0] * len(edges)
    for row in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one row per arc at most
        counts[row.arc] = row.n
    ranges = walk(counts, owners, shards)
    plan = spark.createDataFrame(
        ranges, "arc int, first long, last long, shard int, slot0 long"
    ).groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("first", "last", "shard", "slot0"))).alias("ranges"))

    inside_bucket = Window.partitionBy("arc", "bucket").orderBy("at", "text_crc32", "doc_id", "size", "place")
    ranked = (
        keys.withColumn("nth", F.row_number().over(inside_bucket))
        .join(offsets, ["arc", "bucket"])
        .withColumn("rank", F.col("start") + F.col("nth") - 1)
        .join(F.broadcast(plan), "arc")
    )
    hit = F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["last"]))[0]
    return ranked.withColumn("hit", hit).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("hit.shard").alias("shard"),
        (F.col("hit.slot0") + F.col("rank") - F.col("hit.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
