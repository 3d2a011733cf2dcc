"""Queries against their DuckDB counterparts, and unit cases of the text functions."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.functions import text as T
from lexiform.operators import tensor, wordpiece
from lexiform.plans.queries import PAIRS, UNPAIRED

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query_equals_sql(spark, name):
    query, sql = PAIRS[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "part", "nation", "conversations", "region", "supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = query(spark, DATA), con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(UNPAIRED))
def test_query_runs(spark, name):
    rows = UNPAIRED[name](spark, DATA).collect()
    assert rows and all(r.error is None for r in rows)


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert _one(spark, T.clean_text(F.lit("a\x00�\x07​b\tc d中e"))) == "ab c d 中 e"
    assert _one(spark, T.strip_accents(F.lit("naïve Ångström"))) == "naive Angstrom"
    assert _one(spark, T.split_punctuation(F.lit("a$b^c"))) == ["a", "$", "b", "^", "c"]
    assert _one(spark, T.regex_split(F.lit("bacdaef"), "a.")) == ["b", "ac", "d", "ae", "f"]
    assert _one(spark, wordpiece.basic_words(F.lit("x [MASK] y [MASK]."))) == ["x", "[MASK]", "y", "[", "MASK", "]", "."]


def test_wordpiece_keeps_pieces_before_the_unknown(spark):
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1), ("abc", 2), ("##d", 3), ("b", 4)], "token string, id int")
    words = spark.createDataFrame([("abcd",), ("abcx",), ("abd",), ("ab",), ("q",)], "word string")
    got = {r.word: r.ids for r in wordpiece.greedy_pieces(words, vocab, 0).collect()}
    assert got == {"abcd": [2, 3], "abcx": [2, 0], "abd": [1, 0], "ab": [1, 0], "q": [0]}


def test_output_layers():
    assert [tensor.resolve_layer(x, 12) for x in (-12, -1, 0, 12)] == [1, 12, 0, 12]
    for x in (-13, 13):
        with pytest.raises(ValueError):
            tensor.resolve_layer(x, 12)


@pytest.mark.parametrize("kind,steps", [("q8_0", 254), ("q4_0", 15), ("q4_1", 15), ("q5_0", 31), ("q5_1", 31)])
def test_block_round_trip(kind, steps):
    x = np.random.default_rng(1).normal(size=(50, 32)).astype(np.float32)
    x[0] = 0
    back = tensor.dequantize_blocks(*tensor.quantize_blocks(x, kind))
    width = 2 * np.abs(x).max(1, keepdims=True) / steps
    assert (np.abs(back - x) <= 1.1 * width + 1e-6).all()
