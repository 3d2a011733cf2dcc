"""What must not grow with a batch or a corpus: texts that Python holds, steps that are computed again."""

from __future__ import annotations

import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiform.functions import text as T
from lexiform.operators import encoder, wordpiece
from lexiform.plans.queries import PAIRS, REJECTED


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pad", [None, 0, 1, 5])
def test_positions_stay_out_of_python(spark, pad):
    rng = np.random.default_rng(3)
    texts = [None, [], [1], [5, 1], [1, 1, 1]] + [rng.integers(0, 6, n).tolist() for n in (7, 100, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, ids array<int>").select("i", encoder.position_ids(F.col("ids"), pad).alias("at"))
    assert "Python" not in _plan(df) and df.schema["at"].dataType.simpleString() == "array<bigint>"
    model = encoder.Encoder({}, 1, 0, 0, pad_id=pad)
    assert {r.i: r["at"] for r in df.collect()} == {i: None if x is None else model.positions(np.asarray(x, int)).tolist() for i, x in enumerate(texts)}


def test_a_batch_of_words_is_cut_in_chunks(spark, monkeypatch):
    assert wordpiece.piece_ids(F.col("w"), wordpiece.Pieces({}, 0))._jc.toString()
    cut = wordpiece.Pieces({"a": 1, "ab": 2, "##c": 3, "[MASK]": 4}, 0)
    rows = [None, [], ["a"], ["abc", "[MASK]", "", "x"]] + [["ab", "acc"] * n for n in (1, 40, 3)]
    seen = []
    for arr in wordpiece.chunks(pa.array(rows, pa.list_(pa.string()))):
        seen.append(arr.to_pylist())
    assert sum(seen, []) == rows
    monkeypatch.setattr(wordpiece, "TOGETHER", 8)
    parts = [x.to_pylist() for x in wordpiece.chunks(pa.array(rows, pa.list_(pa.string())).slice(1))]
    assert len(parts) > 2 and sum(parts, []) == rows[1:]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, w array<string>")
    got = {r.i: r.ids for r in df.select("i", wordpiece.piece_ids(F.col("w"), cut).alias("ids")).collect()}
    assert got == {i: None if x is None else sum((cut.ids(w) for w in x), []) for i, x in enumerate(rows)}


def test_simple_texts_are_those_that_normal_forms_leave_alone(spark):
    simple = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), T.SIMPLE) + "]")
    inside = [c for c in map(chr, range(0x110000)) if simple.match(c)]
    second = {unicodedata.normalize("NFD", c)[1:] for c in map(chr, range(0x110000))}
    bare = dict(zip(*T._MARKED))
    for c in inside:
        stripped = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        assert unicodedata.normalize("NFC", c) == c and bare.get(c, c) == unicodedata.normalize("NFC", stripped) and c not in second
        assert unicodedata.normalize("NFC", c.lower()) == c.lower() and unicodedata.category(c) != "Mn"


def test_simple_and_other_texts_give_the_same_words(spark):
    texts = [None, "", "Naïve, [MASK] ÅNGSTRÖM x\u4e2dy", "Й [MASK]. ß\u00a0Ⱥ\u200b", "İ a\u0301b", "\u1100\u1161 Ω", "tab\there\r\nand\ufffd \x07 there"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for profile in (wordpiece.CASED, wordpiece.UNCASED, wordpiece.Profile.of(lower=True, strip_accents=False), wordpiece.Profile.of(cjk=False, strip_accents=True), wordpiece.Profile.of(basic=False)):
        got = {r.i: r.w for r in df.select("i", wordpiece.basic_words(F.col("text"), profile).alias("w")).collect()}
        assert got == {i: None if x is None else wordpiece.split_text(x, profile) for i, x in enumerate(texts)}


def _tables(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_known_and_unknown_words_without_a_join(spark, tmp_path):
    d = _tables(spark, tmp_path, [(1, "a b b c"), (2, "a d"), (None, "a z z c b"), (3, ""), (4, None), (5, "q\ta")])
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    for name in ("has_token", "unknown_tokens", "too_long", "punct_split", "positions_roberta", "ws_split", "token_to_id"):
        query, sql = PAIRS[name]
        got = query(spark, d)
        want = con.sql(sql)
        assert sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(repr, want.fetchall())), name
        if name in ("has_token", "unknown_tokens"):
            assert "Join" not in _plan(got)


def test_a_text_is_split_once(spark, tmp_path):
    d = _tables(spark, tmp_path, [(1, "a b, c")])
    for name in ("ws_split", "punct_split", "positions_roberta", "unknown_tokens"):
        assert _plan(PAIRS[name][0](spark, d)).split("+- == Initial Plan ==")[0].count("split(") == 1, name


def test_rejected_texts_are_named_without_the_model(spark, tmp_path):
    d = _tables(spark, tmp_path, [(1, None), (2, ""), (3, "a b c"), (4, "w " * 511), (5, "w " * 510)])
    for name in ("encode_texts", "fill_mask"):
        assert "Python" not in _plan(REJECTED[f"{name}_rejected"](spark, d)) and "Pandas" not in _plan(REJECTED[f"{name}_rejected"](spark, d))
    rows = [None, [], [3], [1, 3, 2], [3, 3], [-1, 3], [32, 3], [1] * 20, [1] * 14, [3] + [1] * 20, [3] + [5] * 13, [3] + [5] * 14, [0, 2]]
    for model in (encoder.synthetic(32, max_tokens=16), encoder.synthetic(32, max_tokens=16, pad_id=1)):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, ids array<int>")
        for mask, whole in ((None, encoder.encode(docs, model)), (3, encoder.fill_mask(docs, model, 3))):
            want = {r.doc_id: r.error for r in whole.where("error is not null").collect()}
            assert {r.doc_id: r.error for r in encoder.rejected(docs, model, mask).collect()} == want
            assert {r.doc_id for r in encoder.taken(docs, model, mask).collect()} == set(range(len(rows))) - set(want)


def test_the_last_layer_at_one_place():
    model = encoder.synthetic(32, layers=2)
    for layer in (0, 1, 2):
        ids, at = np.arange(24).reshape(3, 8) % 32, np.array([0, 3, 7])
        assert np.allclose(model.hidden(ids, layer=layer, only=at)[:, 0], model.hidden(ids, layer=layer)[np.arange(3), at], rtol=0, atol=1e-12)


def test_simple_texts_are_stripped_without_python(spark):
    texts = [None, "", "naïve Ångström ǕẞЙ", "áb é", "가 Ω", "ệ ñ", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)

    def want(x):
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))

    assert {r.i: r.p for r in df.select("i", T.strip_accents(F.col("text")).alias("p")).collect()} == {i: None if x is None else want(x) for i, x in enumerate(texts)}
    assert "Python" not in _plan(df.select(T.strip_simple(F.col("text"))))
    assert [r.s for r in df.orderBy("i").select(T.is_simple(F.col("text")).alias("s")).collect()] == [None, True, False, False, False, False, True]
