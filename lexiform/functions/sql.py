"""The tokenizer and the encoder as functions of SQL.

register() gives a session word_ids(array<string>), text_vector(array<int>) and mask_tokens(array<int>, int), and
register_texts() gives it text_words(string) and text_ids(string), which split texts. Each works on Arrow batches; errors of a row are nulls, as encode() and fill_mask() in operators report them beside the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiform.operators.encoder import POOLS, Encoder, best
from lexiform.operators.wordpiece import CASED, Pieces, Profile, ReferenceWalk, split_text

NAMES = ("word_ids", "text_vector", "mask_tokens")
TEXT_NAMES = ("text_words", "text_ids")


def register_texts(spark: SparkSession, cut: Pieces, profile: Profile = CASED) -> list[str]:
    """Register text_words and text_ids: a text's words under a profile, and the ids of their pieces; null texts give null."""
    shared = spark.sparkContext.broadcast(cut)

    @F.pandas_udf("array<string>")
    def text_words(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(x, profile) if isinstance(x, str) else None for x in texts], dtype=object)

    @F.pandas_udf("array<int>")
    def text_ids(texts: pd.Series) -> pd.Series:
        return pd.Series([[i for w in split_text(x, profile) for i in shared.value.ids(w)] if isinstance(x, str) else None for x in texts], dtype=object)

    for name, function in zip(TEXT_NAMES, (text_words, text_ids), strict=True):
        spark.udf.register(name, function)
    return list(TEXT_NAMES)


def register(spark: SparkSession, ids: dict[str, int] | None = None, unk_id: int = 0, model: Encoder | None = None, mask_id: int | None = None, pool: str = "cls") -> list[str]:
    """Register what the arguments allow; returns the names. word_ids keeps the defects that ReferenceWalk states."""
    if pool not in POOLS[1:]:
        raise ValueError(f"a vector needs one of the pools {POOLS[1:]}")
    done = []
    if ids is not None:
        walk = ReferenceWalk(ids, unk_id)

        @F.pandas_udf("array<int>")
        def word_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for words in batches:
                yield pd.Series([None if x is None else walk.ids(list(x)) for x in words], dtype=object)

        spark.udf.register(NAMES[0], word_ids)
        done.append(NAMES[0])
    if model is not None:
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("array<double>")
        def text_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = shared.value
            for rows in batches:
                yield pd.Series([None if m.error(x, None) else np.ravel(m.pooled(m.hidden(x, None, -1), pool)).astype(float).tolist() for x in rows], dtype=object)

        spark.udf.register(NAMES[1], text_vector)
        done.append(NAMES[1])
    if model is not None and mask_id is not None:

        @F.pandas_udf("array<int>")
        def mask_tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            m = shared.value
            for rows, ks in batches:
                out = []
                for x, k in zip(rows, ks, strict=True):
                    at = [] if x is None else np.flatnonzero(np.asarray(x) == mask_id).tolist()
                    if m.error(x, None) or len(at) != 1 or pd.isna(k):
                        out.append(None)
                        continue
                    p = m.vocabulary(m.hidden(x)[at])[0]
                    out.append(best(p, int(k)).astype(int).tolist())
                yield pd.Series(out, dtype=object)

        spark.udf.register(NAMES[2], mask_tokens)
        done.append(NAMES[2])
    return done
