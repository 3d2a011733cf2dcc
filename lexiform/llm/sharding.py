"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns ``vnodes`` points of a ring of 65,536 positions; a row stands at the hash of its doc_id and
belongs to the next point clockwise. A shard takes at most its capacity: floor or ceil of rows / shards, so that
the capacities add up to the rows and counts are at most one apart. What a full shard can't take goes on clockwise to
the next point whose shard has room. Only the ring (shards * vnodes points with a row count each, a size that does not
depend on the data) is gathered on the driver, which walks it as a range partitioner plans its bounds; rows move
once, as narrow ids, never as texts.

Defined cases: a null doc_id hashes like a value of its own; a null text has size 8 and the checksum of no bytes;
rows that agree in doc_id, size and checksum are counted before they are shuffled and then dealt in pieces of COPIES, so a
key with a third of all rows is expanded by many tasks and spreads over shards like any others; an empty table gives an empty result; columns beyond
doc_id and text are not read.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiform.llm.common import table, written

RING = 1 << 16
#: Rows that share a cell of an arc, about; a cell is what one window group holds.
CELL_ROWS = 4096
#: Equal rows that are dealt as one, and rows that a task expands, about.
COPIES = 1024
TASK_ROWS = 100_000


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; of equal positions the lowest shard counts."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(xxhash.xxh64_intdigest(f"shard-{s}/{v}") % RING, s)
    return sorted(at.items())


def place_arcs(loads: list[int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, rank behind the last, shard) pieces of all arcs under the capacities.

    First each shard takes what its own arcs hold, in ring order; then what is left over travels clockwise
    from arc to arc and enters any shard with room on its way.
    """
    n, room, pieces = len(loads), list(capacities), []
    left: list[tuple[int, int, int]] = []
    for arc, load in enumerate(loads):
        take = min(load, room[owners[arc]])
        if take:
            pieces.append((arc, 0, take, owners[arc]))
            room[owners[arc]] -= take
        if take < load:
            left.append((arc, take, load))
    open_arcs = [a for a in range(n) if room[owners[a]]]
    for arc, lo, hi in left:
        i = bisect.bisect_right(open_arcs, arc)
        while lo < hi:
            i = 0 if i >= len(open_arcs) else i
            shard = owners[open_arcs[i]]
            if not room[shard]:
                open_arcs.pop(i)
                continue
            take = min(hi - lo, room[shard])
            pieces.append((arc, lo, lo + take, shard))
            room[shard] -= take
            lo += take
    return pieces


def assign_shards(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard) of every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("times"))
    )
    points = ring_points(shards, vnodes)
    code = F.xxhash64("doc_id")
    arc_of = spark.createDataFrame(arcs(points), "position int, arc int")
    rows = rows.withColumn("position", F.pmod(code, F.lit(RING)).cast("int")).join(F.broadcast(arc_of), "position")  # RING rows
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES)))
    rows = rows.select("doc_id", "size", "text_crc32", "arc", "times", piece.alias("piece")).withColumn("times", F.least(F.lit(COPIES), F.col("times") - F.col("piece") * COPIES))
    rows = written(rows.withColumn("spread", F.xxhash64("doc_id", "size", "text_crc32", "piece")), "shard-rows")

    total = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.sum("times").alias("n")).collect()}  # one row for each arc
    loads = [total.get(a, 0) for a in range(len(points))]
    n = sum(loads)
    pieces = place_arcs(loads, [s for _, s in points], [n // shards + (s < n % shards) for s in range(shards)])
    filled, plan = [0] * shards, []
    for arc, lo, hi, shard in pieces:
        plan.append((arc, lo, hi, shard, filled[shard]))
        filled[shard] += hi - lo
    plan = spark.createDataFrame(plan, "arc int, lo long, hi long, shard int, base long")

    # An arc has cells in proportion to its rows; like the plan below, one row for each arc.
    cells = spark.createDataFrame([(a, -(-load // CELL_ROWS)) for a, load in enumerate(loads) if load], "arc int, cells long")
    rows = rows.join(F.broadcast(cells), "arc").withColumn("cell", F.pmod("spread", "cells"))
    # Rank of a row in its arc: rows before it in its cell and in the cells before.
    inside = W.partitionBy("arc", "cell").orderBy("spread", "doc_id", "size", "text_crc32", "piece").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("arc").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("arc", "cell").agg(F.sum("times").alias("held"))
    counts = counts.select("arc", "cell", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    ranked = rows.withColumn("nth", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(counts, ["arc", "cell"])
    ranked = ranked.withColumn("first", F.col("nth") + F.col("earlier"))
    # The plan has at most one piece for each arc and overflow: bounded by the ring, so it is broadcast.
    placed = ranked.join(F.broadcast(plan), "arc").where((F.col("first") < F.col("hi")) & (F.col("first") + F.col("times") > F.col("lo")))
    # Pieces are few bytes whatever they stand for, so their tasks are counted in rows.
    placed = placed.repartition(max(1, -(-n // TASK_ROWS)), "spread")
    rank = F.explode(F.sequence(F.greatest("first", "lo"), F.least(F.col("first") + F.col("times"), F.col("hi")) - 1)).alias("rank")
    return placed.select("doc_id", "size", "text_crc32", "shard", "lo", "base", rank).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot")
    )


def arcs(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(position, arc) of the whole ring: the arc of a position ends at the first point at or after it."""
    at = [p for p, _ in points]
    return [(x, bisect.bisect_left(at, x) % len(points)) for x in range(RING)]


def write_shards(docs: DataFrame, path: str, shards: int = 24, vnodes: int = 64) -> None:
    """Write docs below path, a folder for each shard: here texts are shuffled, once.

    Rows that agree in doc_id and text stay together in the lowest of their shards.
    """
    placed = assign_shards(docs, shards, vnodes).groupBy(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc")).agg(F.min("shard").alias("shard"))
    crc = F.crc32(F.coalesce(docs.text, F.lit("")).cast("binary"))
    docs.join(placed, docs.doc_id.eqNullSafe(F.col("_id")) & (crc == F.col("_crc"))).drop("_id", "_crc").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose counts differ by one at most."""
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
