"""The encoder's forward pass and the fill-mask head, in numpy over Arrow batches.

Each text is a row of its own (token ids, segments), so the pass is a map without a shuffle; the weights are broadcast, and
their number is the model's, not the data's. Rows that the model can't take carry an error instead of a vector; no text
is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.operators.tensor import resolve_layer
from lexiform.sources.container import Container

POOLS = ("none", "cls", "avg", "max")
# The prefix of the weights' names below a container's namespace, and codes of the architectures and of the activation that loads.
PREFIX = "bert."
BERT, ROBERTA = 0, 1
GELU = 0
#: Attention weights that are held at a time.
TOGETHER = 1 << 18


@dataclass
class Encoder:
    """Weights by name (without prefix) and the numbers that shape them."""

    weights: dict[str, np.ndarray]
    heads: int
    layers: int
    max_tokens: int
    segments: int = 2
    eps: float = 1e-12
    #: The padding id of models whose positions skip padding and begin after that id; None for positions from 0.
    pad_id: int | None = None

    def error(self, ids: list[int] | None, segments: list[int] | None) -> str | None:
        """Why the model can't take a text, or null."""
        if ids is None or not len(ids):
            return "no tokens"
        if len(ids) > self.max_tokens or self.positions(np.asarray(ids)).max() >= len(self.weights["embeddings.position_embeddings.weight"]):
            return "too many tokens"
        if min(ids) < 0 or max(ids) >= len(self.weights["embeddings.word_embeddings.weight"]):
            return "unknown token id"
        if segments is not None:
            if len(segments) != len(ids):
                return "segments and tokens differ in number"
            if min(segments) < 0 or max(segments) >= self.segments:
                return "unknown segment"
        return None

    def positions(self, ids: np.ndarray) -> np.ndarray:
        if self.pad_id is None:
            return np.broadcast_to(np.arange(ids.shape[-1]), ids.shape)
        real = ids != self.pad_id
        return np.where(real, np.cumsum(real, -1) + self.pad_id, 0)

    def dense(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[name + ".weight"].T + self.weights[name + ".bias"]

    def norm(self, x: np.ndarray, name: str) -> np.ndarray:
        spread = x - x.mean(-1, keepdims=True)
        return spread / np.sqrt((spread**2).mean(-1, keepdims=True) + self.eps) * self.weights[name + ".weight"] + self.weights[name + ".bias"]

    def hidden(self, ids: list[int] | np.ndarray, segments: list[int] | np.ndarray | None = None, layer: int = -1, only: np.ndarray | None = None) -> np.ndarray:
        """The states of all tokens, of one text or of several of one length, after a layer; 0 is the embeddings, -1 the last.

        With only, a place for each of several texts, of the tokens at these places alone: the last layer looks from nowhere else.
        """
        at = np.asarray(ids)
        w = self.weights
        kinds = np.zeros(at.shape, int) if segments is None else np.asarray(segments)
        x = w["embeddings.word_embeddings.weight"][at] + w["embeddings.position_embeddings.weight"][self.positions(at)] + w["embeddings.token_type_embeddings.weight"][kinds]
        x = self.norm(x, "embeddings.LayerNorm")
        last = resolve_layer(layer, self.layers)
        if only is not None and not last:
            return x[np.arange(len(x)), only][:, None]
        for n in range(last):
            name = f"encoder.layer.{n}"
            own = x[np.arange(len(x)), only][:, None] if only is not None and n == last - 1 else x
            q, k, v = (self.dense(of, f"{name}.attention.self.{part}").reshape(*of.shape[:-1], self.heads, -1).swapaxes(-3, -2) for part, of in (("query", own), ("key", x), ("value", x)))
            seen = softmax(q @ k.swapaxes(-1, -2) / np.sqrt(q.shape[-1])) @ v
            x = self.norm(own + self.dense(seen.swapaxes(-3, -2).reshape(*own.shape[:-1], -1), f"{name}.attention.output.dense"), f"{name}.attention.output.LayerNorm")
            x = self.norm(x + self.dense(gelu(self.dense(x, f"{name}.intermediate.dense")), f"{name}.output.dense"), f"{name}.output.LayerNorm")
        return x

    def pooled(self, x: np.ndarray, pool: str) -> np.ndarray:
        """All states, or one vector through the pooler's dense layer and tanh."""
        if pool == "none":
            return x
        one = x[..., 0, :] if pool == "cls" else x.mean(-2) if pool == "avg" else x.max(-2)
        return np.tanh(self.dense(one, "pooler.dense"))

    def vocabulary(self, x: np.ndarray) -> np.ndarray:
        """The probability of each token of the vocabulary at each state."""
        x = self.norm(gelu(self.dense(x, "predictions.transform.dense")), "predictions.transform.LayerNorm")
        return softmax(self.dense(x, "predictions.decoder"))


def position_ids(ids: Column, pad_id: int | None = None) -> Column:
    """The positions of an array of token ids; with a padding id they skip it and begin behind it. No text leaves the JVM."""
    if pad_id is None:
        return F.transform(ids, lambda _, i: i.cast("long"))

    def numbered(x: Column) -> Column:
        pad = F.lit(pad_id)
        real = F.array_compact(F.transform(x, lambda t, i: F.when(~t.eqNullSafe(pad), i)))
        skipped = F.array_compact(F.transform(x, lambda t, i: F.when(t.eqNullSafe(pad), i)))
        at = F.transform(real, lambda i, n: F.struct(i.alias("i"), (n.cast("long") + pad_id + 1).alias("at")))
        # Two runs that are sorted already: putting them in order is a merge.
        return F.transform(F.sort_array(F.concat(at, F.transform(skipped, lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("at"))))), lambda s: s["at"])

    # As a lambda's variable the array is computed once.
    return F.element_at(F.transform(F.array(ids), numbered), 1)


def errors(model: Encoder, ids: Column, segments: Column | None = None) -> Column:
    """Why a model can't take a text of ids and segments, or null where it can; in Arrow batches."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def why(rows: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([shared.value.error(x, k) for x, k in zip(rows, kinds)], dtype=object)

    return why(ids.cast("array<int>"), (F.lit(None) if segments is None else segments).cast("array<int>"))


def why_not(model: Encoder, ids: Column, mask_id: int | None = None) -> Column:
    """errors() of texts of one segment without Python, and with a mask's id also those of texts that haven't exactly one."""
    rows = {n: len(model.weights[f"embeddings.{n}_embeddings.weight"]) for n in ("word", "position")}

    def why(x: Column) -> Column:
        n = F.size(x)
        last = n - 1 if model.pad_id is None else F.size(F.filter(x, lambda t: t != model.pad_id)) + model.pad_id
        if model.pad_id is not None:
            last = F.when(F.array_max(x) != F.array_min(x), last).when(F.array_max(x) == model.pad_id, 0).otherwise(last)
        out = F.when(x.isNull() | (n <= 0), "no tokens").when((n > model.max_tokens) | (last >= rows["position"]), "too many tokens")
        out = out.when((F.array_min(x) < 0) | (F.array_max(x) >= rows["word"]), "unknown token id")
        if mask_id is None:
            return out
        masks = F.size(F.filter(x, lambda t: t == mask_id))
        return out.when(masks != 1, F.concat(masks.cast("string"), F.lit(" masks")))

    # As a lambda's variable the array is computed once.
    return F.element_at(F.transform(F.array(ids), why), 1)


def taken(df: DataFrame, model: Encoder, mask_id: int | None = None) -> DataFrame:
    """The rows (ids, and other columns) that a model takes; no others travel to Python."""
    return df.where(why_not(model, F.col("ids"), mask_id).isNull())


def rejected(df: DataFrame, model: Encoder, mask_id: int | None = None) -> DataFrame:
    """The other rows, with the error that encode() or, with a mask's id, fill_mask() gives each; the model isn't run."""
    return df.withColumn("error", why_not(model, F.col("ids"), mask_id)).where("error is not null")


def dense(model: Encoder, v: Column, name: str) -> Column:
    """A model's dense layer over arrays of numbers, in Arrow batches; null for null."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def layer(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        places = [i for i, x in enumerate(rows) if x is not None]
        if places:
            for i, x in zip(places, shared.value.dense(np.stack([rows.iloc[i] for i in places]), name)):
                out[i] = x
        return pd.Series(out, dtype=object)

    return layer(v)


def best(p: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest numbers (of all for k <= 0), falling, equal ones by place."""
    return np.lexsort((np.arange(len(p)), -p))[: k if k > 0 else len(p)]


def top_places(v: Column, k: int) -> Column:
    """best() over arrays of numbers, in Arrow batches; null for null."""

    @F.pandas_udf("array<int>")
    def places(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else best(np.asarray(x), k).astype(np.int32) for x in rows], dtype=object)

    return places(v)


def together(ids: list, heads: int) -> Iterator[list[int]]:
    """The places of texts of one length, in groups whose attention has TOGETHER weights at most (one text at least); nulls are left out."""
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(ids):
        if x is not None:
            by_length.setdefault(len(x), []).append(i)
    for n, places in by_length.items():
        step = max(1, TOGETHER // (heads * n * n))
        for at in range(0, len(places), step):
            yield places[at : at + step]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


def shapes(vocab: int, hidden: int, layers: int, inner: int, max_tokens: int, segments: int = 2, head: bool = True) -> dict[str, tuple[int, ...]]:
    """The names and shapes of all weights of a model."""
    def pair(name: str, out: int, into: int) -> dict[str, tuple[int, ...]]:
        return {f"{name}.weight": (out, into), f"{name}.bias": (out,)}

    def norm(name: str) -> dict[str, tuple[int, ...]]:
        return {f"{name}.weight": (hidden,), f"{name}.bias": (hidden,)}

    found: dict[str, tuple[int, ...]] = {f"embeddings.{n}_embeddings.weight": (rows, hidden) for n, rows in (("word", vocab), ("token_type", segments), ("position", max_tokens))}
    found |= norm("embeddings.LayerNorm")
    for n in range(layers):
        at = f"encoder.layer.{n}"
        for part in ("query", "key", "value"):
            found |= pair(f"{at}.attention.self.{part}", hidden, hidden)
        found |= pair(f"{at}.attention.output.dense", hidden, hidden) | norm(f"{at}.attention.output.LayerNorm")
        found |= pair(f"{at}.intermediate.dense", inner, hidden) | pair(f"{at}.output.dense", hidden, inner) | norm(f"{at}.output.LayerNorm")
    found |= pair("pooler.dense", hidden, hidden)
    if head:
        found |= pair("predictions.transform.dense", hidden, hidden) | norm("predictions.transform.LayerNorm") | pair("predictions.decoder", vocab, hidden)
    return found


def synthetic(vocab: int, hidden: int = 8, heads: int = 2, layers: int = 1, inner: int = 16, max_tokens: int = 512, pad_id: int | None = None) -> Encoder:
    """A model with closed-form weights ((31 i + 17 j + salt) mod 13 - 6) / 64, salt being the weight's ordinal; norms scale by 1 + that."""
    weights = {}
    for salt, (name, shape) in enumerate(shapes(vocab, hidden, layers, inner, max_tokens).items()):
        grid = sum(f * np.arange(n).reshape([-1 if k == axis else 1 for k in range(len(shape))]) for axis, (n, f) in enumerate(zip(shape, (31, 17))))
        weights[name] = ((grid + salt) % 13 - 6) / 64.0 + (1.0 if name.endswith("LayerNorm.weight") else 0.0)
    return Encoder(weights, heads, layers, max_tokens, pad_id=pad_id)


def from_container(c: Container, pad_id: int | None = None) -> Encoder:
    """The model in a container; missing weights, other architectures and other activations are errors."""
    h = c.hparams()
    if h["bert_type"] not in (BERT, ROBERTA):
        raise ValueError(f"unknown architecture {h['bert_type']}")
    if h["hidden_act"] != GELU:
        raise ValueError("only the activation gelu is supported")
    if h["bert_type"] == ROBERTA and pad_id is None:
        raise ValueError("this architecture needs the padding id")
    head = c.own(PREFIX + "predictions.decoder.weight") in c.tensors
    want = shapes(h["vocab_size"], h["hidden_dim"], h["n_layers"], h["intermediate_dim"], h["max_token"], h["segments"], head)
    if missing := [n for n in want if c.own(PREFIX + n) not in c.tensors]:
        raise ValueError(f"container lacks {missing}")
    weights = {n: c.array(c.own(PREFIX + n)).astype(np.float32).reshape(s) for n, s in want.items()}
    return Encoder(weights, h["attn_heads"], h["n_layers"], h["max_token"], h["segments"], h["layer_norm_eps"], pad_id if h["bert_type"] == ROBERTA else None)


def to_container(e: Encoder, kind: str = "F32", namespace: str = "model") -> Container:
    words, inner = e.weights["embeddings.word_embeddings.weight"], e.weights.get("encoder.layer.0.intermediate.dense.bias", np.zeros(0))
    c = Container(namespace=namespace)
    for key, v in (("bert_type", BERT if e.pad_id is None else ROBERTA), ("vocab_size", len(words)), ("hidden_dim", words.shape[1]), ("n_layers", e.layers), ("attn_heads", e.heads), ("max_token", e.max_tokens), ("intermediate_dim", len(inner)), ("hidden_act", GELU), ("segments", e.segments)):
        c.kv[c.own(key)] = ("u32", v)
    c.kv[c.own("layer_norm_eps")] = ("f64", e.eps)
    for name, x in e.weights.items():
        c.put(c.own(PREFIX + name), x, kind if x.ndim == 2 and name.endswith(".weight") else "F32")
    return c


def encode(df: DataFrame, model: Encoder, pool: str = "cls", layer: int = -1, key: str = "doc_id") -> DataFrame:
    """(key, error, vectors) of rows (key, ids array, and segments array where there is one); one vector unless pool is none."""
    if pool not in POOLS:
        raise ValueError(f"unknown pool {pool}")
    resolve_layer(layer, model.layers)
    shared = df.sparkSession.sparkContext.broadcast(model)
    picked = df.select(key, "ids", (F.col("segments") if "segments" in df.columns else F.lit(None)).cast("array<int>").alias("segments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            why = [m.error(ids, kinds) for ids, kinds in zip(b["ids"], b["segments"])]
            out: list = [None] * len(b)
            takes = [None if w else ids for w, ids in zip(why, b["ids"])]
            for places in together(takes, m.heads):
                kinds = [np.zeros(len(takes[i]), int) if b["segments"].iloc[i] is None else b["segments"].iloc[i] for i in places]
                only = np.zeros(len(places), int) if pool == "cls" else None
                found = m.pooled(m.hidden(np.stack([takes[i] for i in places]), np.stack(kinds), layer, only), pool)
                for i, x in zip(places, found):
                    out[i] = np.atleast_2d(x).astype(float).tolist()
            rows = list(zip(b[key], why, out))
            yield pd.DataFrame(rows, columns=[key, "error", "vectors"])

    return picked.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, error string, vectors array<array<double>>")


def fill_mask(df: DataFrame, model: Encoder, mask_id: int, k: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, error, rank, token_id, prob): the k likeliest tokens (all if k <= 0) at the one mask of each row (key, ids).

    Equal probabilities are ordered by id. Rows without exactly one mask, or that the model can't take, have one row with an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            masks = [[] if ids is None else np.flatnonzero(np.asarray(ids) == mask_id).tolist() for ids in b["ids"]]
            why = [m.error(ids, None) or (None if len(found) == 1 else f"{len(found)} masks") for ids, found in zip(b["ids"], masks)]
            rows = [(key_, w, None, None, None) for key_, w in zip(b[key], why) if w]
            takes = [None if w else ids for w, ids in zip(why, b["ids"])]
            for places in together(takes, m.heads):
                states = m.hidden(np.stack([takes[i] for i in places]), only=np.array([masks[i][0] for i in places]))
                for i, p in zip(places, m.vocabulary(states[:, 0])):
                    rows += [(b[key].iloc[i], None, n + 1, int(x), float(p[x])) for n, x in enumerate(best(p, k))]
            yield pd.DataFrame(rows, columns=[key, "error", "rank", "token_id", "prob"]).astype({"rank": "Int32", "token_id": "Int32"})

    return df.select(key, "ids").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, error string, rank int, token_id int, prob double")
