"""What a caller asks of a model beside its vectors: special tokens, wrapping, sizes, and the fill-mask program on texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiform.operators import bpe, encoder, wordpiece
from lexiform.sources.container import special_ids

# Names of the architectures; a role's token, and another one that stands for it.
ARCHITECTURES = {encoder.BERT: "BERT", encoder.ROBERTA: "ROBERTA"}
BERT_TOKENS = {"cls": ("[CLS]", "<s>"), "mask": ("[MASK]", "<mask>"), "pad": ("[PAD]", "<pad>"), "sep": ("[SEP]", "</s>"), "unk": ("[UNK]", "<unk>")}
ROBERTA_TOKENS = {"bos": ("<s>", "[CLS]"), "cls": ("<s>", "[CLS]"), "eos": ("</s>", "[SEP]"), "mask": ("<mask>", "[MASK]"), "pad": ("<pad>", "[PAD]"), "sep": ("</s>", "[SEP]"), "unk": ("<unk>", "[UNK]")}
BORROWED = {"bos": "cls", "cls": "bos", "eos": "sep", "sep": "eos"}


def architecture(kind: int | None) -> str:
    return ARCHITECTURES.get(kind, "UNKNOWN")


def vocab_size(vocab: DataFrame) -> int:
    return vocab.count()


def roles(vocab: DataFrame, kind: int, stored: dict[str, int] | None = None) -> dict[str, int]:
    """The id of every role: the stored one, else that of the role's tokens; bos and cls, eos and sep stand for each other.

    A role of the architecture without an id is an error; roles that it hasn't are left out.
    """
    names = ROBERTA_TOKENS if kind == encoder.ROBERTA else BERT_TOKENS
    found = {r["role"]: r["id"] for r in special_ids(vocab, {r: ((stored or {}).get(r), t) for r, t in names.items()}).collect()}
    if kind == encoder.ROBERTA:
        found = {r: found[r] if found[r] is not None else found.get(BORROWED.get(r, r)) for r in found}
    if missing := sorted(r for r, i in found.items() if i is None):
        raise ValueError(f"no id for {missing}")
    return found


def special_tokens(vocab: DataFrame, kind: int, stored: dict[str, int] | None = None) -> DataFrame:
    """(role, id, token) of all roles; tokens of byte-level vocabularies are decoded."""
    spark, found = vocab.sparkSession, roles(vocab, kind, stored)
    asked = spark.createDataFrame(sorted(found.items()), "role string, id int")
    token = F.coalesce(bpe.byte_decode(F.col("token")), F.col("token")) if kind == encoder.ROBERTA else F.col("token")
    return asked.join(vocab.select("id", "token"), "id", "left").select("role", "id", token.alias("token"))


def wrapped(ids: Column, cls_id: int, sep_id: int) -> Column:
    """cls, the ids, sep; nothing is cut."""
    return F.concat(F.array(F.lit(cls_id)), ids, F.array(F.lit(sep_id)))


def wrapped_size(n: Column) -> Column:
    """The number of tokens of so many ids between cls and sep."""
    return n + 2


def tokenize(docs: DataFrame, vocab: DataFrame, max_tokens: int, cls_id: int, sep_id: int, unk_id: int, profile: wordpiece.Profile = wordpiece.CASED) -> DataFrame:
    """docs with ids between cls and sep, their number, and whether the model takes fewer."""
    return sized(wordpiece.token_ids(docs, vocab, unk_id, profile=profile).withColumn("ids", wrapped(F.col("ids"), cls_id, sep_id)), max_tokens)


def sized(docs: DataFrame, max_tokens: int) -> DataFrame:
    """docs with the number of their ids, and whether a model takes fewer; both are null where ids are."""
    n = F.when(F.col("ids").isNotNull(), F.size("ids").cast("long"))
    return docs.withColumn("tokens", n).withColumn("too_long", n > max_tokens)


def vector_size(hidden: int, pool: str, tokens: int) -> int:
    """Numbers that a text of so many tokens gets from a pool."""
    if pool not in encoder.POOLS:
        raise ValueError(f"unknown pool {pool}")
    return hidden * tokens if pool == "none" else hidden


def likeliest_size(vocab: int, k: int, tokens: int) -> int:
    """Tokens that so many states get from the head: k each, all of the vocabulary for k <= 0, never more."""
    return tokens * (min(k, vocab) if k > 0 else vocab)


def likeliest(states: DataFrame, model: encoder.Encoder, k: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, error, pos, token_ids, probs): the k likeliest tokens at each hidden state of rows (key, vectors).

    Equal probabilities are ordered by id. With k <= 0 all tokens are returned, the ids by falling probability and the
    probabilities in the vocabulary's order. Rows whose states have another size than the model's have an error.
    """
    shared = states.sparkSession.sparkContext.broadcast(model)
    width = model.weights["embeddings.word_embeddings.weight"].shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for key_, vectors in zip(b[key], b["vectors"]):
                x = [] if vectors is None else [np.asarray(v, float) for v in vectors]
                if not x or any(len(v) != width for v in x):
                    rows.append((key_, "no states" if not x else "states of another size", None, None, None))
                    continue
                for pos, p in enumerate(m.vocabulary(np.stack(x))):
                    best = encoder.best(p, k)
                    rows.append((key_, None, pos, best.tolist(), p.tolist() if k <= 0 else p[best].tolist()))
            yield pd.DataFrame(rows, columns=[key, "error", "pos", "token_ids", "probs"]).astype({"pos": "Int32"})

    return states.select(key, "vectors").mapInPandas(run, f"{key} {states.schema[key].dataType.simpleString()}, error string, pos int, token_ids array<int>, probs array<double>")


def fill_mask(docs: DataFrame, vocab: DataFrame, model: encoder.Encoder, k: int = 3, key: str = "doc_id", profile: wordpiece.Profile = wordpiece.CASED) -> DataFrame:
    """(key, error, rank, token, prob): the k likeliest tokens, as strings, at the one mask of each text.

    Texts without exactly one mask, or that the model can't take, have one row with an error. k is from 1 to the vocabulary's size.
    """
    n = vocab_size(vocab)
    if not 1 <= k <= n:
        raise ValueError(f"k is {k}; it has to be from 1 to {n}")
    own = roles(vocab, encoder.BERT)
    ids = tokenize(docs, vocab, model.max_tokens, own["cls"], own["sep"], own["unk"], profile).select(key, "ids")
    filled = encoder.fill_mask(ids, model, own["mask"], k, key)
    names = F.broadcast(vocab.select(F.col("id").alias("token_id"), "token"))  # at most VOCAB_ROWS: tokenize() has checked
    return filled.join(names, "token_id", "left").select(key, "error", "rank", "token", "prob")
