"""Stupid-backoff language-model scores of all documents, against n-gram counts of all documents.

A document's n-grams are scored by counts from which its own occurrences are taken away (leave one out), else each
would be known: S(w | context) is the count of context and w over that of the context where both are positive, else
BACKOFF times the score in a context shorter by one word; at one word, its count over all tokens; and for a word that
no other document has, BACKOFF / (tokens of the others + 1). A document's score is the mean log10 of S over its tokens.

Counting and scoring are a join partitioned by n-gram hash, in packed rows: a row for each n-gram would take 13 bytes or
so of shuffle each way and three of them for each token, many times the input. Documents lie in batches (a task's
next texts, compressed into one row); a batch asks each hash partition for its distinct n-grams (sorted 64-bit hashes
with the batch's counts, packed column-wise in one row), the partition sums the counts of equal hashes over all
batches, which is its count table, and answers each batch in the same order; the batch joins the answers to its
exploded n-grams and sums each document's scores. So an n-gram crosses the network once per batch that has it,
however frequent it is: a word of every document is no hot key.

Words and pairs are asked for together. A longer n-gram can stand in another document only if both n-grams one word
shorter that it holds do, so of those only such are asked for, in a round for each length: the answers tell which.

Words lie between ASCII blanks, A-Z lower-cased.

Defined cases: a null text is an empty one; a text without words has 0 tokens and a null score; repeated rows count
and are scored each; a null doc_id is kept; an empty table gives an empty result; columns beyond doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import table

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a batch of documents (one text at least), and of the corpus for each hash partition, about.
BATCH_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: Bytes of text whose words are hashed at a time.
STEP_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and the index of the text of each."""
    hashes, owners, first = [], [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= STEP_BYTES):
            size += len(texts[last]) + 1
            last += 1
        raw = np.frombuffer(b"\n".join(texts[first:last]) + b"\n", np.uint8)
        blank = _BLANK[raw]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        if len(starts):
            ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
            lengths = ends - starts
            power = np.cumprod(np.full(int(lengths.max()), _PRIME, np.uint64))
            inside = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(raw))))
            value = np.where(blank, np.uint64(0), (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[np.minimum(inside, len(power) - 1)])
            hashes.append(_mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64)))
            bounds = np.cumsum([len(t) + 1 for t in texts[first:last]])
            owners.append(first + np.searchsorted(bounds, starts, side="right"))
        first = last
    empty = np.empty(0, np.int64)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (empty.astype(np.uint64), empty)


def ngram_hashes(words: np.ndarray, owners: np.ndarray, order: int) -> list[np.ndarray]:
    """Of every token and every n up to order, the hash of the n-gram that ends there, 0 where the text is too short."""
    out = [words]
    for n in range(2, order + 1):
        h = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            same = owners[n - 1 :] == owners[: len(owners) - n + 1]
            joined = _mixed(out[-1][n - 2 : len(words) - 1] * _PRIME + words[n - 1 :] + np.uint64(n))
            h[n - 1 :] = np.where(same, joined | np.uint64(1), np.uint64(0))
        out.append(h)
    return out


def _packed(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes: equal high bytes lie together."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


@dataclass
class Level:
    """Tokens in the order of their n-grams, and the distinct n-grams with their counts."""

    order: np.ndarray
    keys: np.ndarray
    counts: np.ndarray


def level(grams: np.ndarray, wanted: np.ndarray) -> Level:
    at = np.flatnonzero(wanted)
    order = at[np.argsort(grams[at], kind="stable")]  # tokens of a document stay together
    sorted_ = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else order
    return Level(order, sorted_[starts], np.diff(np.append(starts, len(order))))


def others(found: Level, owners: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of every token, how often its n-gram occurs in all other documents; 0 for tokens that are not of the level."""
    own = owners[found.order]
    new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.empty(0, bool)
    new[(np.cumsum(found.counts) - found.counts).astype(np.int64)] = True
    runs = np.diff(np.append(np.flatnonzero(new), len(own)))
    out = np.zeros(len(owners))
    out[found.order] = np.repeat(totals.astype(np.float64), found.counts) - np.repeat(runs, runs)
    return out


def _after(x: np.ndarray) -> np.ndarray:
    """Each token's value of the token before."""
    return np.concatenate(([0.0], x[:-1]))[: len(x)]


class Batch:
    """The texts of a batch with their n-grams, and what is known of these from the answers of a number of rounds."""

    def __init__(self, lengths: list[int], blob: bytes, order: int):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        ends = np.cumsum([0, *lengths]).tolist()
        self.texts = len(lengths)
        self.words, owners = word_hashes([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        self.owners = owners.astype(np.int32)
        self.grams = ngram_hashes(self.words, self.owners, order)

    def first(self) -> tuple[list[Level], np.ndarray, np.ndarray, np.ndarray]:
        """Words and pairs; their keys together, behind the key 0 of all tokens; the counts; and the keys' order."""
        levels = [level(g, g != 0) for g in self.grams[:2]]
        keys = np.concatenate([np.zeros(1, np.uint64), *[x.keys for x in levels]])
        counts = np.concatenate([[len(self.words)], *[x.counts for x in levels]])
        order = np.argsort(keys, kind="stable")
        return levels, keys[order], counts[order], order

    def known(self, answers: pd.DataFrame, rounds: int) -> tuple[float, list[np.ndarray]]:
        """All tokens of the corpus, and what others() says of each length that these rounds have answered."""
        def totals(n: int) -> np.ndarray:
            parts = answers[answers["round"] == n].sort_values("part")["totals"]
            return np.concatenate([_unpacked(x) for x in parts]) if len(parts) else np.empty(0, np.uint64)

        levels, _, _, order = self.first()
        sorted_ = totals(0)
        mine = np.empty_like(sorted_)
        mine[order] = sorted_
        out, at = [], 1
        for found in levels:
            out.append(others(found, self.owners, mine[at : at + len(found.keys)]))
            at += len(found.keys)
        for n in range(1, rounds):
            out.append(others(self.next(out), self.owners, totals(n)))
        return float(mine[0]), out

    def next(self, known: list[np.ndarray]) -> Level:
        """The n-grams one word longer than those known that may occur in another document."""
        grams, last = self.grams[len(known)], known[-1]
        return level(grams, (grams != 0) & (last > 0) & (_after(last) > 0))


def batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(batch, ids, lengths, texts): the rows of each task in order, compressed in batches."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def done() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["batch", "ids", "lengths", "texts"])

        for b in rows:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = t.as_py() or b""
                if texts and size + len(raw) > batch_bytes:
                    yield done()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield done()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "batch long, ids array<long>, lengths array<long>, texts binary")


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, tokens, score) of every row of docs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(0, (size // part_bytes).bit_length())
    shift = 64 - parts.bit_length() + 1
    rows = batches(docs, batch_bytes)

    def asked(batch: int, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """The keys and counts by hash partition."""
        bounds = np.arange(1, parts, dtype=np.uint64) << np.uint64(shift) if parts > 1 else np.empty(0, np.uint64)
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        out = [(p, batch, _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pd.DataFrame(out, columns=["part", "batch", "hashes", "counts"])

    def read(pdf: pd.DataFrame) -> Batch:
        return Batch(list(pdf["lengths"].iloc[0]), pdf["texts"].iloc[0], order)

    def ask(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for i in range(len(pdf)):
                one = pdf.iloc[i : i + 1]
                _, keys, counts, _ = read(one).first()
                yield asked(int(one["batch"].iloc[0]), keys, counts)

    def ask_next(rounds: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            mine = read(pdf)
            found = mine.next(mine.known(answers, rounds)[1])
            return asked(int(pdf["batch"].iloc[0]), found.keys, found.counts)

        return run

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in pdf["hashes"]]
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        all_ = np.concatenate(keys)
        del keys
        found = level(all_, np.ones(len(all_), bool))
        counts = np.concatenate([_unpacked(x) for x in pdf["counts"]])
        starts = np.cumsum(found.counts) - found.counts
        totals = np.empty(len(all_), np.uint64)
        totals[found.order] = np.repeat(np.add.reduceat(counts[found.order], starts), found.counts)
        return pd.DataFrame({"batch": pdf["batch"], "part": pdf["part"], "totals": [_packed(t) for t in np.split(totals, sizes)]})

    def score(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        mine = read(pdf)
        owners, n = mine.owners, np.bincount(mine.owners, minlength=mine.texts)
        total, known = mine.known(answers, max(1, order - 1))
        rest = total - n[owners]  # tokens of the other documents
        s = np.where(known[0] > 0, known[0] / np.maximum(rest, 1), backoff / (rest + 1))
        for k in range(1, order):
            context = _after(known[k - 1])
            held = (known[k] > 0) & (context > 0)
            s = np.where(mine.grams[k] == 0, s, np.where(held, known[k] / np.maximum(context, 1), backoff * s))
        sums = np.bincount(owners, weights=np.log10(s), minlength=mine.texts)
        mean = [float(x) if k else None for x, k in zip(sums / np.maximum(n, 1), n.tolist(), strict=True)]
        ids = pd.array([None if pd.isna(x) else int(x) for x in pdf["ids"].iloc[0]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "tokens": n, "score": pd.array(mean, dtype="Float64")})

    def answered(asks: DataFrame, n: int) -> DataFrame:
        return asks.groupBy("part").applyInPandas(answer, "batch long, part int, totals binary").withColumn("round", F.lit(n))

    message = "part int, batch long, hashes binary, counts binary"
    answers = answered(rows.select("batch", "lengths", "texts").mapInPandas(ask, message), 0)
    for n in range(1, order - 1):
        asks = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(ask_next(n), message)
        answers = answers.union(answered(asks, n))
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "doc_id long, tokens long, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and mean log10 score."""
    out = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "tokens", F.round("score", 5).alias("score"))


#: The same scores from plain counts of words, pairs and triples; a context's count is that of the token before.
OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), t AS (
  SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
), k AS (
  SELECT *, (SELECT sum(len(w)) FROM w) - n AS rest,
    count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS c1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) ELSE 0 END AS c2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) ELSE 0 END AS c3 FROM t
), x AS (SELECT *, lag(c1) OVER d AS x1, lag(c2) OVER d AS x2 FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), s1 AS (SELECT *, CASE WHEN c1 > 0 THEN c1::DOUBLE / greatest(rest, 1) ELSE 0.4e0 / (rest + 1) END AS s FROM x
), s2 AS (SELECT * REPLACE (CASE WHEN i = 1 THEN s WHEN c2 > 0 AND x1 > 0 THEN c2::DOUBLE / x1 ELSE 0.4e0 * s END AS s) FROM s1
), s3 AS (SELECT * REPLACE (CASE WHEN i <= 2 THEN s WHEN c3 > 0 AND x2 > 0 THEN c3::DOUBLE / x2 ELSE 0.4e0 * s END AS s) FROM s2
), g AS (SELECT doc_id, sum(log10(s)) AS score FROM s3 GROUP BY 1)
SELECT w.doc_id, len(w.w) AS tokens, round(g.score / len(w.w), 5) AS score FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
