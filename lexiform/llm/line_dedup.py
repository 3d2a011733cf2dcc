"""Removal of passages of whole lines that repeat anywhere in the corpus.

Lines are hashed; a rolling hash over the hashes of ``WINDOW`` neighbouring lines ends a chunk where it falls on a
residue, so boundaries depend on the lines around them alone and come back wherever a passage does, shifted or not. A
line of passage length (MIN_WORDS) is a chunk by itself; other chunks count from MIN_LINES lines on. Boundaries by
chance may all miss a short passage, so the shortest run of lines of MIN_WORDS words that begins at each line, and the
shortest that ends there, are chunks as well: any passage of that length, whatever its lines and wherever it stands, is
the union of such runs. Of each chunk the first occurrence in the corpus, by doc_id and place, stays; others go after
their bytes have been compared with its own. Chunks that continue one another in both places are compared as one
stretch, so no line is carried twice. No number of lines, words or copies bounds what is found.

What is shuffled is a narrow row of hashes for each chunk, and once the stretches that repeat, combined where they are
read; so a stretch that a third of all documents hold is one row from each task. Documents are joined with their
stretches twice, to compare and to cut; both joins read one shuffle of the texts.

Defined cases: a null text stays null and an empty one empty; words lie between ASCII blanks; a chunk that repeats in one
document goes there too, and where it overlaps its first occurrence, its lines behind that; rows that agree in doc_id
and text are one document to each other (all keep what the first keeps); a null doc_id comes after all others; a
document may end empty, its row stays; stretches of equal hash and other bytes stay; an empty table gives an empty
result; other columns, under whatever name, pass through deduplicate(), but for removed_lines, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from lexiform.llm.common import table, written

#: A chunk ends after a line whose rolling hash is 0 modulo this.
DIVISOR = 3
WINDOW = 2
MIN_LINES = 2
MIN_WORDS = 50
#: Bytes of texts whose lines are hashed at a time (one text at least).
STEP_BYTES = 4 << 20
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_ID = {"doc_id": pa.int64(), "row_hash": pa.int64()}
_SPAN = {"first": pa.int32(), "behind": pa.int32()}
_FOUND = _ID | _SPAN | {"hash": pa.int64(), "check": pa.int64()}
#: A stretch of a document, and the document and line where its first occurrence begins.
_RUN = _ID | _SPAN | {"of_id": pa.int64(), "of_hash": pa.int64(), "of_first": pa.int32()}
_KEY = ("of_id", "of_hash", "of_first", "length")
_SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {_SQL_TYPES[k]}" for n, k in kinds.items())


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def chunk_ends(hashes: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a chunk ends after each line; starts: the first line of each text, and the number of lines."""
    rolling, lead = hashes.copy(), np.uint64(1)
    for back in range(1, WINDOW):
        lead = lead * np.uint64(_ODD[0])
        earlier = np.concatenate((np.zeros(back, np.uint64), hashes[:-back]))[: len(hashes)]
        for n in range(back):  # lines of the text before are not neighbours
            at = starts[:-1] + n
            earlier[at[at < starts[1:]]] = 0
        rolling += earlier * lead
    ends = (rolling ^ rolling >> np.uint64(31)) % np.uint64(DIVISOR) == 0
    long_line = words >= MIN_WORDS
    ends |= long_line
    ends[:-1] |= long_line[1:]
    ends[starts[1:] - 1] = True
    return ends


def chunk_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first line, line behind the last, hash, second hash) of the chunks of some texts."""
    lines = [x for t in texts for x in t.split(b"\n")]
    words = np.array([len(x.split()) for x in lines], np.int64)
    hashes = np.array([xxh64_intdigest(x) for x in lines], np.uint64)
    others = np.array([xxh3_64_intdigest(x) for x in lines], np.uint64)
    starts = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    read = np.concatenate(([0], np.cumsum(words)))

    behind = np.flatnonzero(chunk_ends(hashes, words, starts)) + 1
    first = np.concatenate(([0], behind[:-1]))
    kept = (read[behind] > read[first]) & ((behind - first >= MIN_LINES) | (read[behind] - read[first] >= MIN_WORDS))
    at = np.flatnonzero(words)
    until = np.searchsorted(read, read[at] + MIN_WORDS, "left")
    since = np.searchsorted(read, read[at + 1] - MIN_WORDS, "right") - 1
    ahead, back = until <= starts[text_of[at] + 1], since >= starts[text_of[at]]
    a = np.concatenate((first[kept], at[ahead], since[back]))
    b = np.concatenate((behind[kept], until[ahead], at[back] + 1))
    n = len(lines) + 1
    spans = np.unique(a * n + b)
    a, b = spans // n, spans % n

    def joined(h: np.ndarray, odd: int) -> np.ndarray:
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(h), x, np.uint64)), dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)))
        return ((total[b] - total[a]) * down[a]).view(np.int64)

    owner = text_of[a] if len(a) else a
    return owner, a - starts[owner], b - starts[owner], joined(hashes, _ODD[0]), joined(others, _ODD[1])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) in steps of STEP_BYTES; nulls as empty texts."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.as_py() or b""
        if part and size + len(raw) > STEP_BYTES:
            yield first, part
            first, part, size = i, [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text").where("text <> ''")


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, first, behind, hash, check) of every chunk of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _pieces(batch.column("text")):
                owner, first, behind, hash_, check = chunk_spans(texts)
                mine = pa.array(owner + i)
                cols = [batch.column("doc_id").take(mine), batch.column("row_hash").take(mine), pa.array(first.astype(np.int32)), pa.array(behind.astype(np.int32)), pa.array(hash_), pa.array(check)]
                yield pa.RecordBatch.from_arrays(cols, names=list(_FOUND))

    return _rows(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, _ddl(_FOUND))


def stretches(spans: list[dict], doc_id: int | None, row_hash: int) -> list[tuple]:
    """(first, behind, of_id, of_hash, of_first) of the stretches that chunks (first, behind, of_id, of_hash, of_first) make up."""
    by_line: dict[tuple, list[tuple[int, int]]] = {}
    for s in spans:
        first, behind, shift = s["first"], s["behind"], s["first"] - s["of_first"]
        if (s["of_id"], s["of_hash"]) == (doc_id, row_hash):
            first = max(first, behind - shift)  # lines that are not in the first occurrence themselves
        by_line.setdefault((s["of_id"], s["of_hash"], shift), []).append((first, behind))
    out = []
    for (of_id, of_hash, shift), found in by_line.items():
        found.sort()
        first, behind = found[0]
        for a, b in found[1:] + [(1 << 31, 0)]:
            if a > behind:
                out.append((first, behind, of_id, of_hash, first - shift))
                first, behind = a, b
            behind = max(behind, b)
    return out


def _by_doc(rows: DataFrame, *names: str) -> DataFrame:
    """One row for each document, with the distinct others gathered, combined where they are read."""
    return rows.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct(*names)).alias("spans"))


def repeated(docs: DataFrame) -> DataFrame:
    """The stretches of lines that stand earlier by their hashes (first, behind of a row; of_id, of_hash, of_first, length)."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_hash", "first")
    mark = F.xxhash64("doc_id", "row_hash", "first")
    found = written(chunks(docs), "line-chunks")
    first = found.groupBy("hash", "check").agg(F.min(place).alias("at"), F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi")
    # A hash may occur in a third of all rows: the join is against one row for each hash and may be split.
    again = found.join(first.select("hash", "check", "at"), ["hash", "check"]).where(place != F.col("at"))
    again = again.select("doc_id", "row_hash", "first", "behind", F.col("at.doc_id").alias("of_id"), F.col("at.row_hash").alias("of_hash"), F.col("at.first").alias("of_first"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row_hash, spans in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "spans")], strict=True):
                out += [(doc_id, row_hash, *s) for s in stretches(spans, doc_id, row_hash)]
            yield _batch(out, _RUN)

    runs = _by_doc(again, "first", "behind", "of_id", "of_hash", "of_first").mapInArrow(merge, _ddl(_RUN))
    return written(runs.withColumn("length", F.col("behind") - F.col("first")), "line-runs")


def _held(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text and, where there are others, _row) beside the spans of each row."""
    right = by_doc.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), F.col("spans").alias("_spans"))
    same = docs.doc_id.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_hash"))
    if "_row" in docs.columns:
        # Always true. It keeps the same columns on this side of every join, so that texts are shuffled once for all.
        same = same & (F.size(F.array_repeat(docs["_row"], F.least(F.size("_spans"), F.lit(1)))) > 0)
    return docs.join(right.hint("merge"), same, how)


def unequal(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The first occurrences (of_id, of_hash, of_first, length) of which some stretch has other bytes."""
    own = runs.select(F.col("of_id").alias("doc_id"), F.col("of_hash").alias("row_hash"), F.col("of_first").alias("first"), (F.col("of_first") + F.col("length")).alias("behind"), *_KEY)
    asked = runs.select("doc_id", "row_hash", "first", "behind", *_KEY).union(own)
    joined = _held(docs, _by_doc(asked, "first", "behind", *_KEY), "inner").select(F.col("text").cast("binary").alias("text"), F.col("_spans").alias("spans"))
    kinds = {k: v for k, v in _RUN.items() if k in _KEY} | {"length": pa.int32(), "body": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                lines = text.as_py().split(b"\n")
                for s in spans.as_py():
                    out.append((*(s[k] for k in _KEY), b"\n".join(lines[s["first"] : s["behind"]])))
                    size += len(out[-1][-1])
                if size > STEP_BYTES:
                    yield _batch(out, kinds)
                    out, size = [], 0
            yield _batch(out, kinds)

    # Equal bytes have one smallest and largest value: a hot stretch is one row of each task.
    bodies = joined.mapInArrow(cut, _ddl(kinds)).groupBy(*_KEY).agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    return bodies.where("lo <> hi").select(*[F.col(c).alias(f"bad_{c}") for c in _KEY])


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text, and removed_lines (long) beside its columns."""
    runs = repeated(docs)
    # Other columns travel in one struct, so no name of theirs can meet one of a join.
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "removed_lines")]
    rows = docs.select("doc_id", "text", *([F.struct(*[docs[c] for c in rest]).alias("_row")] if rest else []))
    bad = unequal(rows, runs)
    same = [runs[c].eqNullSafe(bad[f"bad_{c}"]) for c in _KEY]
    equal = runs.join(bad, same[0] & same[1] & same[2] & same[3], "left_anti")
    joined = _held(rows, _by_doc(equal, "first", "behind"), "left").withColumn("_done", _without(F.col("text"), F.col("_spans")))
    out = [F.col("_done.text").alias(c) if c == "text" else F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in docs.columns if c != "removed_lines"]
    return joined.select(*out, F.col("_done.removed").alias("removed_lines"))


def _without(text: Column, cuts: Column) -> Column:
    """(text, removed) without the lines of the cuts."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())]))
    def without(text: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        texts, removed = [], []
        for t, spans in zip(text, cuts, strict=True):
            n = 0
            if spans is not None and len(spans):
                lines = t.split("\n")
                gone = {i for s in spans for i in range(s["first"], s["behind"])}
                n = len(gone)
                t = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            texts.append(t)
            removed.append(n)
        return pd.DataFrame({"text": texts, "removed": removed})

    return without(text, cuts)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what stays of its text."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
