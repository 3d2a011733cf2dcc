"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has a bit for each of 64 positions, set if set in over half the hashes of the text's word shingles.
Two fingerprints that differ in at most three bits, cut into two segments of 32, agree in one of them up to one bit.
So each distinct fingerprint is indexed under its one-wildcard variants (segment, place of the wildcard, the other 31
bits), the variants meet by equality of that key, and what meets is verified by its Hamming distance.

Copies never meet in pairs: equal fingerprints are one entry, and fingerprints under one key are compared in blocks
that return a spanning forest of their links, not the links. Under a key with more than BLOCK fingerprints the other
segment is cut in two and indexed in the same way: of two that differ in at most three bits there, one half agrees up
to one. Only what still has more than BLOCK fingerprints under such a narrower key is spread over tasks block against
block. Fingerprints, links and components stay in tables.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and links like any other; fewer
words than a shingle are one shingle; repeated rows share a component; a null doc_id is kept and takes the component
of its links; an empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import table, written
from lexiform.llm.components import connected_components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints under one key that are compared in one piece.
BLOCK = 1024
#: Distinct fingerprints whose signatures one task makes.
TASK_ROWS = 20_000
#: Hashes counted at a time.
STEP = 65_536

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    found = (text or "").encode().translate(LOWER).split()  # bytes split at ASCII blanks only
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in spans], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[i : i + STEP].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def signatures(fps: DataFrame) -> DataFrame:
    """(key, fp) for the 64 one-wildcard variants of both segments of every fingerprint."""
    segment = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")) for s in (0, 1)]))
    place = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(~(1 << p) & 0xFFFFFFFF).alias("keep")) for p in range(32)]))
    out = fps.select("fp", segment.alias("seg")).select("fp", "seg", place.alias("at"))
    key = F.shiftleft((F.col("seg.s") * 32 + F.col("at.p")).cast("long"), 32).bitwiseOR(F.col("seg.v").bitwiseAND(F.col("at.keep")))
    return out.select(key.alias("key"), "fp")


def narrower(runs: DataFrame) -> DataFrame:
    """(key, fp) for fingerprints under a key: a code of it and the one-wildcard variants of both halves of the other segment."""
    segment = F.shiftrightunsigned("key", 37).bitwiseAND(F.lit(1))
    other = F.when(segment == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    places = [F.struct(F.lit(16 * h + p).alias("at"), F.lit((0xFFFF & ~(1 << p)) << 16 * h).alias("keep")) for h in (0, 1) for p in range(16)]
    out = runs.select("key", "fp", other.alias("other"), F.explode(F.array(*places)).alias("at"))
    # Codes that fall together cost comparisons, as links are verified.
    return out.select(F.xxhash64("key", "at.at", F.col("other").bitwiseAND(F.col("at.keep"))).alias("key"), "fp")


def linked(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the links of distance or less connect: each node is searched from once."""
    nodes = left if right is None else np.unique(np.concatenate((left, right)))
    view = nodes.view(np.uint64)
    waiting = np.ones(len(nodes), bool)
    out: list[tuple[int, int]] = []
    for seed in range(len(nodes)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            rest = np.flatnonzero(waiting)
            if not len(rest):
                return out
            near = rest[np.bitwise_count(view[rest] ^ view[at]) <= distance]
            waiting[near] = False
            out += [(int(nodes[at]), int(nodes[j])) for j in near]
            front += near.tolist()
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all pairs within the distance (3 at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard each find distances up to 3")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a key, in order. Short ones are compared; long ones go out in numbered blocks."""
        key, run, block = None, [], 0  # run: arrays of the current key's fingerprints, at most BLOCK of them
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(cuts, len(keys)))
            out: list[tuple] = []
            # Runs that don't touch an end of the batch and have one fingerprint say nothing.
            busy = np.flatnonzero((sizes > 1) | (cuts == 0) | (cuts + sizes == len(keys)))
            for r in busy.tolist():
                k, part = int(keys[cuts[r]]), values[cuts[r] : cuts[r] + sizes[r]]
                if k != key:
                    out += _closed(key, run, block, distance)
                    key, run, block = k, [], 0
                while len(part):
                    room = BLOCK - sum(map(len, run))
                    run.append(part[:room])
                    part = part[room:]
                    if len(part):
                        out += [(key, int(x), block) for x in np.concatenate(run)]
                        run, block = [], block + 1
            yield _edge_batch(out)
        yield _edge_batch(_closed(key, run, block, distance))

    def met_under(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The edges of short runs; the rows of long ones."""
        met = keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long, block int")
        met = written(met, "simhash-links")
        return met.where("block < 0").select("a", "b"), met.where("block >= 0").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")

    edges, hot = met_under(signatures(fps))
    if not hot.isEmpty():
        more, long_runs = met_under(narrower(hot))
        edges = edges.union(more)
    else:
        long_runs = hot
    # Of a key with n blocks, each meets each: a row goes to its n pairs of blocks.
    counts = long_runs.groupBy("key").agg(F.max("block").alias("last"))
    pairs = long_runs.join(counts, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    pairs = pairs.select("key", "fp", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked(np.unique(pdf["fp"].to_numpy()), None, distance), columns=["a", "b"], dtype=np.int64)

    return edges.union(pairs.groupBy("key", "lo", "hi").applyInPandas(blocks, "a long, b long")).distinct()


def _closed(key: int | None, run: list[np.ndarray], block: int, distance: int) -> list[tuple]:
    """What a finished run of a key gives: links, or its last block if it is long."""
    if key is None or not run:
        return []
    all_ = np.concatenate(run)
    if block:
        return [(key, int(x), block) for x in all_]
    if len(all_) == 1:
        return []
    if len(all_) == 2:
        a, b = all_.tolist()
        return [(a, b, -1)] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance else []
    return [(a, b, -1) for a, b in linked(np.unique(all_), None, distance)]


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, block = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(block, pa.int32())], names=["a", "b", "block"])


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints."""
    prints = written(fingerprints(docs, shingle), "simhash-fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    spread = distinct.select("fp").repartition(-(-distinct.count() // TASK_ROWS) or 1)
    roots = connected_components(links(spread, distance), "simhash-edges")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # The smallest doc_id of a component comes by an aggregation, so a large component is combined where it is read.
    owner = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(owner, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
