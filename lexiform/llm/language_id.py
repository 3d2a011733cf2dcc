"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its lower-cased UTF-8 byte windows of SIZES bytes (so they cover letters of any script, and word
ends as blanks), hashed into BUCKETS rows of an embedding table. A text is the average of its subwords' embeddings;
a linear softmax over it gives the languages. Both are trained together by stochastic gradient descent in numpy, on a
bounded sample (SAMPLE labelled rows, chosen by a hash of doc_id, none with crc32(doc_id) mod 5 = 0), whose texts the
executors reduce to bucket counts. A temperature fitted on a part of the sample kept from training calibrates the
scores; the score under which an answer is rejected is set on the same part.

An average of embeddings under a linear layer is an average of per-bucket language scores, so prediction gathers one
row of that table for each byte of a text, whole texts, in a map without a shuffle.

Defined cases: a null text and one without a letter give ``und`` with score 0 and are rejected; without labelled rows
every answer is ``und`` with score 0; a null doc_id is not held out; repeated rows are answered each; columns other
than doc_id, text and lang are not read, lang only in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import sampled, table

BUCKETS = 1 << 16
SIZES = (3, 4)
DIMENSIONS = 16
SAMPLE = 3000
EPOCHS = 20
RATE = 2.0
SEED = 11
#: Rejection keeps this share of the right answers of the calibration part.
KEEP = 0.995
#: Bytes of a text looked up at a time.
STEP = 1 << 20

_LETTER = regex.compile(r"\p{L}")


def buckets(text: str) -> np.ndarray:
    """The bucket of every subword of a text."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in SIZES:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    scores: np.ndarray | None = None  # a row of language scores for each bucket
    bias: np.ndarray | None = None
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        found = buckets(text)
        total = np.zeros(len(self.languages))
        for i in range(0, len(found), STEP):
            total += self.scores[found[i : i + STEP]].sum(0, dtype=np.float64)
        return softmax((total / max(1, len(found)) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """A model from sparse bucket shares and languages; every fifth example is kept for calibration."""
    names = sorted(set(langs))
    if not names:
        return Model()
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    tuned, used = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    balance = len(used) / (len(names) * np.maximum(1, np.bincount(y[used], minlength=len(names))))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(used).tolist():
            at, share = features[i]
            if not len(at):
                continue
            rows = table_[at]
            mean = share @ rows
            error = softmax(mean @ weights + bias)
            error[y[i]] -= 1
            error *= min(4.0, balance[y[i]])
            back = weights @ error
            weights -= rate * 0.1 * np.outer(mean, error)
            bias -= rate * 0.02 * error
            # The step for a bucket is scaled up by the text's subwords, as each has a small share of the mean.
            table_[at] = rows - np.outer(np.minimum(rate * 50 * share, rate), back)
    model = Model(names, (table_ @ weights).astype(np.float32), bias.astype(np.float64))
    logits = np.array([features[i][1] @ model.scores[features[i][0]] + bias if len(features[i][0]) else bias for i in tuned.tolist()], np.float64)
    grid = np.geomspace(0.25, 16, 49)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(tuned)), y[tuned]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y[tuned]])
    model.reject_below = float(right[int(len(right) * (1 - KEEP))]) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on about ``sample`` rows with a language that are not held out (twice as many at most)."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.select("lang").count()
    chosen = usable.where(sampled(F.xxhash64("doc_id", F.lit(SEED)), sample / max(1, n))).select("text", "lang").limit(2 * sample)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, share, lang = [], [], []
            for text, name in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                if has_letter(text.as_py()):
                    found, counts = np.unique(buckets(text.as_py()), return_counts=True)
                    at.append(found.astype("<u4").tobytes())
                    share.append((counts / counts.sum()).astype("<f4").tobytes())
                    lang.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(share, pa.binary()), pa.array(lang, pa.string())], names=["at", "share", "lang"])

    rows = chosen.mapInArrow(reduce, "at binary, share binary, lang string").collect()  # bucket counts of a bounded sample
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"])))
    return train([(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["share"], "<f4")) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, rejected = [], [], []
            for t in b.column("text"):
                text = t.as_py()
                lang, score = "und", 0.0
                if m.languages and has_letter(text):
                    p = m.probabilities(text)
                    lang, score = m.languages[int(p.argmax())], float(p.max())
                langs.append(lang)
                scores.append(score)
                rejected.append(lang == "und" or score < m.reject_below)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
