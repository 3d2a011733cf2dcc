"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel compares two words by their common subsequences of ORDER letters, each discounted by LAMBDA for every
letter it spans, so that gaps and inserted characters lower a match but don't lose it; it is normalised to 1 for
equal words. A word's features are its kernels with the landmarks, times the inverse root of the landmarks' own kernel
matrix (Nyström). A support vector machine over these features is trained on labelled texts, not on words: a text's
margin is that of its strongest words, so in each round the executors find, in every text of the sample, the words that
are strongest under the machine of the round before; those of toxic texts must come out over 1, those of others under
-1 (a squared hinge, minimised by Newton steps), whatever words they are. A text is rated by the mean margin of its two
strongest words, over the whole text, and a logistic curve turns it into a score. The curve is fitted to one of
KEPT_FOR_CURVE labelled texts by a machine that was trained on the others (to all, if these have one label only). RIDGE,
and the mean against the strongest word alone and both with slopes of their own, were compared by cross-validation on
rows that are not held out; so were LAMBDA (0.7, 0.8, 0.9) and TOXIC_WEIGHT (1, 1.5, 2.5), by the log loss of texts and of
toxic texts with a letter inserted into each marked word. Earlier values of these two had been chosen with labels of
held-out rows in view.

Training sees a bounded sample (SAMPLE labelled rows, chosen by a hash of doc_id) of rows whose crc32(doc_id) mod 5 is
not 0. Landmarks are words of the sample: those that tell its toxic texts from the others best, and some of the others.
Executors turn texts into distinct words; the driver gets, for each word, in how many toxic and other texts of the
sample it occurs (words of a text or two only being left out), and WITNESSES words a text in each round. Scoring is a
map over the table: each task rates each distinct word it meets once. Letters apart by single punctuation marks or
blanks ("i d i o t", "i.d.i.o.t") are also read as one word.

Defined cases: null and empty texts have the score of a text without any word; a null doc_id is not held out; no
labelled rows, or labels of one kind only, give the share of toxic labels (0 without labels) as every score; repeated
rows are scored each, and of rows that share a labelled doc_id the smallest text is learnt from; columns other than
doc_id, text and labels' toxic are not read by score_texts().
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiform.llm.common import dropped, sampled, table, written

ORDER = 3
LAMBDA = 0.9
#: Letters of a word that the kernel reads; longer words are rated window by window.
LENGTH = 16
#: Labelled rows of the training sample, about.
SAMPLE = 6000
#: Landmarks from words that mark toxic texts, and from others; texts of the sample that a word must be in.
MARKED = 160
OTHERS = 64
MIN_TEXTS = 3
ROUNDS = 4
#: Strongest words of a text that a round adds to those the machine is trained on; of toxic texts two must be over 1.
WITNESSES = 3
STRONGEST = 2
RIDGE = 1e-3
#: Weight of a toxic text's words against others'.
TOXIC_WEIGHT = 1.0
#: One of so many texts of the sample is kept from the machine, for the curve.
KEPT_FOR_CURVE = 4
#: Words a task remembers the margins of.
REMEMBERED = 300_000
#: Words rated in one step, and characters of texts (one text at least) whose words are held at a time.
TOGETHER = 1000
CHUNK = 1_000_000
#: Letters, one for all others included, up to which the weights of triples are a plain table.
DENSE_LETTERS = 128
SEED = 7
#: The margin of no word at all; none is below it.
FLOOR = -2.0

_WORD = regex.compile(r"\p{L}+(?:[\p{L}\p{N}@$*_'\-]*\p{L})?")
_NOT_LETTER = regex.compile(r"[^\p{L}]")
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?:[ .\-_*]\p{L}){3,}(?![\p{L}\p{N}])")


def words_of(text: str) -> dict[str, int]:
    """The lower-case words of a text, spelled-out ones joined, and how often they occur."""
    low = text.lower()
    out = Counter(_WORD.findall(low))
    for w in [w for w in out if not w.isalpha()]:
        out[_NOT_LETTER.sub("", w)] += out.pop(w)
    out.update(_NOT_LETTER.sub("", w) for w in _SPACED.findall(low))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """What scoring needs: explicit weights of gapped letter triples, from the landmarks and the machine."""

    triples: dict[str, float]
    bias: float
    curve: tuple[float, float] = (0.0, 1.0)  # offset and slope over a text's margin
    constant: float | None = None


class Rater:
    """Margins of many words at once: words of one length share the places of their triples and the kernel's recursion."""

    def __init__(self, model: Model):
        self.bias = model.bias
        self.letters = np.array(sorted({ord(c) for t in model.triples for c in t}), np.int64)
        n = len(self.letters) + 1  # the last index stands for letters without weights
        codes = np.array([self._code(np.searchsorted(self.letters, [ord(c) for c in t])) for t in model.triples], np.int64)
        order = np.argsort(codes)
        self.codes, self.weights = codes[order], np.array(list(model.triples.values()), float)[order]
        self.dense = None
        if n <= DENSE_LETTERS:
            self.dense = np.zeros(n**ORDER)
            self.dense[self.codes] = self.weights

    def _code(self, at: np.ndarray) -> np.ndarray:
        n = len(self.letters) + 1
        return (at[..., 0] * n + at[..., 1]) * n + at[..., 2]

    def _weight(self, codes: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[codes]
        if not len(self.codes):
            return np.zeros(codes.shape)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.weights[at], 0.0)

    def _same_length(self, words: list[str]) -> np.ndarray:
        """The margins of words of equal length, of LENGTH letters at most."""
        n = len(words[0])
        if n < ORDER:
            return np.full(len(words), self.bias)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.int64)
        at = np.searchsorted(self.letters, letters)
        if len(self.letters):
            at = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == letters, at, len(self.letters))
        places, powers = _places(n)
        linear = self._weight(self._code(at[:, places])) @ powers
        # The kernel of each word with itself: pairs of equal letters, carried on by a discounted sum over all earlier pairs.
        same = (letters[:, :, None] == letters[:, None, :]).astype(float)
        gap = np.tril(LAMBDA ** np.maximum(np.subtract.outer(np.arange(n), np.arange(n)), 0), -1)
        own = same
        for _ in range(ORDER - 1):
            own = same * (gap @ own @ gap.T)
        return linear / np.sqrt(LAMBDA**2 * own.sum((1, 2))) + self.bias

    def margins(self, words: list[str]) -> np.ndarray:
        """One margin a word; a word of over LENGTH letters has that of its strongest window."""
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        step = LENGTH // 2
        for i, w in enumerate(words):
            for part in [w] if len(w) <= LENGTH else (w[a : a + LENGTH] for a in range(0, len(w) - step, step)):
                at, parts = by_length.setdefault(len(part), ([], []))
                at.append(i)
                parts.append(part)
        out = np.full(len(words), -np.inf)
        for at, parts in by_length.values():
            for a in range(0, len(parts), TOGETHER):
                np.maximum.at(out, at[a : a + TOGETHER], self._same_length(parts[a : a + TOGETHER]))
        return out


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all triples in n letters, and LAMBDA to the letters each spans."""
    at = np.array(list(combinations(range(n), ORDER)))
    return at, LAMBDA ** (at[:, -1] - at[:, 0] + 1.0)


def triple_weights(word: str) -> dict[str, float]:
    """The kernel's feature space: every subsequence of ORDER letters with LAMBDA to the letters it spans."""
    out: dict[str, float] = {}
    n = len(word)
    powers = _POWERS
    for i in range(n - 2):
        a = word[i]
        for j in range(i + 1, n - 1):
            ab = a + word[j]
            for k in range(j + 1, n):
                t = ab + word[k]
                out[t] = out.get(t, 0.0) + powers[k - i + 1]
    return out


_POWERS = [LAMBDA**n for n in range(LENGTH + 2)]


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine with a squared hinge, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    share = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    share /= share.sum()
    ridge = np.append(np.full(x.shape[1] - 1, RIDGE), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(20):
        inside = y * (x @ w) < 1
        part = x[inside] * share[inside, None]
        new = np.linalg.solve(2 * part.T @ x[inside] + np.diag(ridge), 2 * part.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new if not w.any() else 0.5 * (w + new)
    return w[:-1], float(w[-1])


def contrast(toxic_texts: int, other_texts: int, base: float) -> float:
    """How much likelier the texts with a word are under their own share of toxic ones than under the share of all (log-likelihood)."""
    q = toxic_texts / (toxic_texts + other_texts)
    if q <= base:
        return 0.0
    return toxic_texts * log(q / base) + (other_texts * log((1 - q) / (1 - base)) if other_texts else 0.0)


class Nystroem:
    """Features of words from their kernels with the landmarks."""

    def __init__(self, landmarks: list[str]):
        feats = [_unit(w) for w in landmarks]
        self.names = {t: i for i, t in enumerate(dict.fromkeys(t for f in feats for t in f))}
        self.base = self._matrix(feats)  # the kernel is the inner product of the triples' weights
        values, vectors = np.linalg.eigh(self.base @ self.base.T)
        kept = values > 1e-4
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])

    def _matrix(self, found: list[dict[str, float]]) -> np.ndarray:
        out = np.zeros((len(found), len(self.names)))
        for i, f in enumerate(found):
            for t, v in f.items():
                if t in self.names:
                    out[i, self.names[t]] = v
        return out

    def features(self, words: list[str]) -> np.ndarray:
        parts = [self._matrix([_unit(w) for w in words[i : i + 500]]) @ self.base.T @ self.whiten for i in range(0, len(words), 500)]
        return np.concatenate(parts) if parts else np.empty((0, self.whiten.shape[1]))

    def model(self, w: np.ndarray, b: float) -> Model:
        """A word's margin is linear in its triples: kernels with the landmarks, whitened, times the machine's weights."""
        dense = self.base.T @ (self.whiten @ w)
        return Model({t: float(dense[i]) for t, i in self.names.items()}, b)


def train(counts: list[tuple[str, int, int]], toxic: int, clean: int, strongest: Callable[[Model], list[tuple[str, bool, list[str]]]]) -> Model:
    """A model from (word, toxic texts with it, other texts with it), the numbers of texts, and the texts' strongest words.

    strongest(model) gives (key, toxic, words) of every labelled text: its WITNESSES strongest words under a model.
    """
    if not toxic or not clean:
        return Model({}, 0.0, constant=1.0 if toxic else 0.0)
    base = toxic / (toxic + clean)
    counts = sorted((x for x in counts if len(x[0]) >= ORDER), key=lambda x: (zlib.crc32(x[0].encode()), x[0]))
    rated = [(contrast(t, c, base), w) for w, t, c in counts]
    chance = log(max(2, len(rated)))  # so much contrast is found by chance among so many words
    marked = [w for v, w in sorted(rated, key=lambda x: -x[0]) if v > chance][:MARKED]
    others = [w for v, w in rated if v <= chance][:OTHERS]
    if not marked or not others:
        return Model({}, 0.0, constant=base)
    space = Nystroem(marked + others)
    known = dict(zip(marked + others, space.features(marked + others)))
    model = space.model(*_machine(np.array(list(known.values())), np.array([1.0] * len(marked) + [-1.0] * len(others))))
    pools: dict[str, tuple[bool, set[str]]] = {}
    for _ in range(ROUNDS):
        for key, is_toxic, words in strongest(model):
            pools.setdefault(key, (is_toxic, set()))[1].update(words)
        new = sorted({w for _, words in pools.values() for w in words} - set(known))
        known |= dict(zip(new, space.features(new)))
        rater, names = Rater(model), list(known)
        margin = dict(zip(names, rater.margins(names).tolist()))
        chosen = [(w, is_toxic) for is_toxic, words in pools.values() for w in sorted(words, key=lambda w: (-margin[w], w))[: STRONGEST if is_toxic else WITNESSES]]
        x, y = np.array([known[w] for w, _ in chosen]), np.array([1.0 if t else -1.0 for _, t in chosen])
        model = space.model(*_machine(x, y))
    return model


def _unit(word: str) -> dict[str, float]:
    f = triple_weights(word[:LENGTH])
    norm = sum(v * v for v in f.values()) ** 0.5
    return {t: v / norm for t, v in f.items()} if norm else {}


def calibrated(model: Model, margins: np.ndarray, labels: np.ndarray) -> Model:
    """The model with the logistic curve over texts' margins that fits their labels, by Newton steps."""
    x = np.column_stack((np.ones(len(margins)), margins.mean(1)))
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ beta)
    model.curve = float(beta[0]), max(0.0, float(beta[1]))  # a stronger word never lowers a score
    return model


def score_of(model: Model, margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * margins.reshape(-1, 2).mean(1), -30, 30)))


def text_margins(rater: Rater, memory: dict[str, float], texts: list[dict[str, int]]) -> list[tuple[float, float]]:
    """The margins of each text's two strongest words, which are one word if that occurs twice."""
    if len(memory) > REMEMBERED:
        memory.clear()
    new = list({w for found in texts for w in found if w not in memory})
    memory.update(zip(new, np.maximum(FLOOR, rater.margins(new)).tolist()))
    out = []
    for found in texts:
        best = second = FLOOR
        for w, n in found.items():
            m = memory[w]
            if m > best:
                best, second = m, (m if n > 1 else best)
            elif m > second:
                second = m
        out.append((best, second))
    return out


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of at most CHUNK characters or one text."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def scorer(model: Model) -> Callable[[Iterable], np.ndarray]:
    """Scores of texts (what isn't a string has no words), a chunk of them at a time; words are remembered from call to call."""
    rater, memory = Rater(model), {}

    def scores(texts: Iterable) -> np.ndarray:
        if model.constant is not None:
            return np.array([model.constant for _ in texts], float)
        found = (text_margins(rater, memory, [words_of(t) for t in part]) for part in chunks(t if isinstance(t, str) else "" for t in texts))
        return score_of(model, np.array([x for part in found for x in part], float))

    return scores


def scored_batches(model: Model, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a key and a text as the key and its score; texts leave the batch one by one, so no more than a chunk is held as strings."""
    scores = scorer(model)
    for b in batches:
        got = scores(t.as_py() for t in b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=[b.schema.names[0], "toxicity"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on about ``sample`` labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if not n:
        return Model({}, 0.0, constant=0.0)
    chosen = usable.where(sampled(F.xxhash64("doc_id", F.lit(SEED)), sample / n))
    # About sample narrow rows: broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[w for w, n in sorted(words_of(t.as_py() or "").items()) for _ in range(min(n, 2))] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.string())), b.column("toxic")], names=["key", "words", "toxic"])

    learns = F.crc32(F.concat(F.lit("learns"), "key").cast("binary")) % KEPT_FOR_CURVE != 0
    split_ = written(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "toxic").mapInArrow(split, "key string, words array<string>, toxic int").withColumn("learns", learns), "toxicity-sample")

    def rated(model: Model, part: str) -> list[tuple]:
        """(key, toxic, strongest words, two largest margins) of every text of a part of the sample."""
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rater, memory = Rater(shared.value), {}
            for b in batches:
                found = [Counter(w) for w in b.column("words").to_pylist()]
                got = text_margins(rater, memory, found)
                best = [sorted(words, key=lambda w: (-memory[w], w))[:WITNESSES] for words in found]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("toxic"), pa.array(best, pa.list_(pa.string())), pa.array([list(x) for x in got], pa.list_(pa.float64()))], names=["key", "toxic", "best", "margins"])

        out = split_.where(part).select("key", "words", "toxic").mapInArrow(rate, "key string, toxic int, best array<string>, margins array<double>").collect()
        return sorted((r["key"], r["toxic"], r["best"], r["margins"]) for r in out)

    def trained(part: str) -> Model:
        """The machine of a part of the sample."""
        texts = split_.where(part)
        kinds = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        per_word = texts.select(F.explode(F.array_distinct("words")).alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        counts = per_word.where(f"t >= {MIN_TEXTS} or c >= {MIN_TEXTS}").collect()  # frequent words of a bounded sample
        return train([(r["word"], r["t"], r["c"]) for r in counts], kinds.get(1, 0), kinds.get(0, 0), lambda m: [(key, toxic == 1, best) for key, toxic, best, _ in rated(m, part)])

    model = trained("true")
    if model.constant is None:
        judge = trained("learns")
        unseen = rated(judge, "not learns") if judge.constant is None else []
        if len({t for _, t, _, _ in unseen}) < 2:
            unseen = rated(model, "true")
        model = calibrated(model, np.array([m for *_, m in unseen]), np.array([t for _, t, _, _ in unseen]))
    dropped(split_)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (0 to 1) beside its columns; a map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = scorer(shared.value)
        for series in texts:
            yield pd.Series(scores(series), dtype="float64")

    return docs.withColumn("toxicity", toxicity("text"))


def score_keys(docs: DataFrame, key: str, model: Model) -> DataFrame:
    """The key and the toxicity of every row, as score_texts() has it; no row waits in the JVM for its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(key, "text")
    schema = StructType([narrow.schema[0], StructField("toxicity", DoubleType())])
    return narrow.mapInArrow(lambda batches: scored_batches(shared.value, batches), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_keys(docs, "doc_id", fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
