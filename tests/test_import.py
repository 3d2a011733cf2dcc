"""Imports, types, the defects kept on request, SQL functions and the log."""

from __future__ import annotations

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform import log, quantize
from lexiform.functions import sql
from lexiform.operators import bpe, encoder, wordpiece
from lexiform.sources import container, importer, types

SETTINGS = {"vocab_size": 4, "hidden_dim": 8, "n_layers": 1, "attn_heads": 2, "max_token": 16, "intermediate_dim": 16, "hidden_act": "gelu"}


def test_the_walk_keeps_its_defects(spark):
    ids = {"[UNK]": 0, "a": 1, "abc": 2, "##d": 3, "b": 4, "d": 5}
    walk = wordpiece.ReferenceWalk(ids, 0)
    assert walk.ids(["abd"]) == [1, 3]  # b is lost
    assert walk.ids(["abcd", "d"]) == [2, 3, 5]
    assert walk.ids(["ax", "d"]) == [1, 0, 3]  # the next word begins inside
    assert walk.ids(["x", "d"]) == [0, 5] and walk.ids([]) == []
    vocab = spark.createDataFrame(list(ids.items()), "token string, id int")
    docs = spark.createDataFrame([(1, "ax d"), (2, "abcd"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.pos, r.token_id) for r in wordpiece.tokenize(docs, vocab, 0, compat="reference").collect()]
    assert sorted(got) == [(1, 0, 1), (1, 1, 0), (1, 2, 3), (2, 0, 2), (2, 1, 3)]
    got = [(r.doc_id, r.pos, r.token_id) for r in wordpiece.tokenize(docs, vocab, 0).collect()]
    assert sorted(got) == [(1, 0, 1), (1, 1, 0), (1, 2, 5), (2, 0, 2), (2, 1, 3)]


def test_added_tokens(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    new = spark.createDataFrame([(1, "c"), (2, "a"), (3, "c"), (4, "d")], "pos int, token string")
    out, rejected = wordpiece.add_tokens(vocab, new)
    assert {r.token: r.id for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted((r.pos, r.token) for r in rejected.collect()) == [(2, "a"), (3, "c")]


def test_types(spark):
    rows = spark.createDataFrame([("q8_0",), ("8",), ("Q4_2",), ("4",), ("",), (None,), ("-1",), ("99999999999",)], "t string")
    assert [r.x for r in rows.select(types.parse_type(F.col("t")).alias("x")).collect()] == [8, 8, None, None, None, None, None, None]
    codes = spark.createDataFrame([(0,), (18,), (None,)], "c int")
    assert [r.x for r in codes.select(types.file_type_name(F.col("c")).alias("x")).collect()] == ["ALL_F32", "MOSTLY_Q6_K", None]
    for wrong in (19, -1):
        with pytest.raises(Exception, match="unrecognized file type"):
            spark.createDataFrame([(wrong,)], "c int").select(types.file_type_name(F.col("c"))).collect()
    assert types.stored_bytes("Q8_0", (64, 3)) == 204 and types.stored_bytes("F16", (5, 2)) == 20


def test_key_header(spark, tmp_path):
    (tmp_path / "keys.h").write_text('#pragma once\n  #define A_KEY "a.key"\n#define B "b"\nint x;\n')
    assert {r.name: r.key for r in importer.key_header(spark, str(tmp_path / "keys.h")).collect()} == {"A_KEY": "a.key", "B": "b"}
    (tmp_path / "bad.h").write_text("#define A 1\n")
    with pytest.raises(Exception, match="not a key"):
        importer.key_header(spark, str(tmp_path / "bad.h")).collect()


@pytest.mark.parametrize("kind", ["BertModel", "RobertaModel"])
def test_import_makes_a_model_that_loads(spark, tmp_path, kind):
    model = encoder.synthetic(4, max_tokens=16)
    body = {n: x.astype(np.float32) for n, x in model.weights.items() if not n.startswith("predictions.")}
    head = {n: x.astype(np.float32) for n, x in model.weights.items() if n.startswith("predictions.")}
    if kind == "RobertaModel":
        back = {v: k for k, v in importer.HEAD_NAMES.items()}
        head = {back[n]: x for n, x in head.items()} | {"bias": np.zeros(4, np.float32)}
    else:
        head["predictions.bias"] = np.zeros(4, np.float32)
    vocab = {"a": 0, "b": 1, "ab": 3}
    c = importer.import_model(spark, kind, SETTINGS, vocab, body, head, [("a", "b")])
    container.save(spark, str(tmp_path / "m"), c)
    c = container.load(spark, str(tmp_path / "m"))
    assert c.vocab() == ["a", "b", "[unused0]", "ab"] and c.merges() == [(0, 1)]
    kinds = {n: k for n, (k, _, _) in c.tensors.items()}
    assert kinds["model.bert.pooler.dense.weight"] == "F16" and kinds["model.bert.pooler.dense.bias"] == "F32"
    assert "model.bert.predictions.bias" not in kinds
    loaded = encoder.from_container(c, pad_id=0 if kind == "RobertaModel" else None)
    assert set(loaded.weights) == set(model.weights)
    assert max(np.abs(loaded.weights[n] - x).max() for n, x in model.weights.items()) < 1e-3


def test_import_refuses(spark):
    body = {"pooler.dense.bias": np.zeros(8, np.float32)}
    for kind, settings, merges in (("DebertaModel", SETTINGS, None), ("BertModel", SETTINGS | {"hidden_act": "relu"}, None), ("BertModel", SETTINGS | {"never_split": ["x"]}, None), ("BertModel", {}, None)):
        with pytest.raises(ValueError):
            importer.import_model(spark, kind, settings, {"a": 0}, body, merges=merges)
    with pytest.raises(Exception, match="unknown token"):
        importer.import_model(spark, "BertModel", SETTINGS, {"a": 0}, body, merges=[("a", "z")])


def test_sql_functions(spark):
    model = encoder.synthetic(32)
    assert sql.register(spark, {"[UNK]": 0, "a": 1}, 0, model, 3) == list(sql.NAMES)
    spark.createDataFrame([(1, ["a", "x"], [1, 5, 3, 2]), (2, None, None), (3, [], [1, 2])], "doc_id long, words array<string>, ids array<int>").createOrReplaceTempView("sql_functions")
    got = spark.sql("SELECT *, word_ids(words) AS w, text_vector(ids) AS v, mask_tokens(ids, 3) AS m FROM sql_functions ORDER BY doc_id").collect()
    assert [r.w for r in got] == [[1, 0], None, []] and [r.m is None for r in got] == [False, True, True]
    docs = spark.table("sql_functions").where("doc_id = 1")
    assert got[0].v == pytest.approx(encoder.encode(docs, model).first().vectors[0])
    assert got[0].m == [r.token_id for r in encoder.fill_mask(docs, model, 3, 3).orderBy("rank").collect()]


def test_texts_from_sql(spark):
    texts = [(1, "Na\u00efve caf\u00e9, [MASK] x\u4e2dy!"), (2, None), (3, ""), (4, "a\x07b\ufffd\u00a0c\td\u200be [SEP]. A\u030a")]
    df = spark.createDataFrame(texts, "doc_id long, text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    df.createOrReplaceTempView("sql_texts")
    ids = {"[UNK]": 0, "[MASK]": 1, "[SEP]": 2} | {p + chr(c): 3 + 2 * (c - 97) + n for c in range(97, 123) for n, p in enumerate(("", "##"))}
    vocab = spark.createDataFrame(list(ids.items()), "token string, id int")
    for profile in (wordpiece.CASED, wordpiece.UNCASED, wordpiece.Profile.of(lower=True, basic=False), wordpiece.Profile.of(cjk=False, strip_accents=True)):
        assert sql.register_texts(spark, wordpiece.pieces(vocab, 0), profile) == list(sql.TEXT_NAMES)
        got = spark.sql("SELECT doc_id, text_words(text) AS words, text_ids(text) AS ids FROM sql_texts").collect()
        cut = wordpiece.token_ids(df, vocab, 0, profile=profile).withColumn("words", wordpiece.basic_words(F.col("text"), profile)).collect()
        assert sorted((r.doc_id, r.words or [], r.ids or []) for r in got) == sorted((r.doc_id, r.words or [], r.ids or []) for r in cut)
        assert sum(r.ids is None for r in got) == 1


def test_tokenizer_settings_are_stored(spark):
    body = {"pooler.dense.bias": np.zeros(8, np.float32)}
    flags = {"do_lower_case": False, "strip_accents": None, "tokenize_chinese_chars": False}
    c = importer.import_model(spark, "BertModel", SETTINGS | flags, {"a": 0}, body, specials={"cls": 2, "pad": None})
    assert importer.special_settings(c) == {"cls": 2} and importer.profile(c) == wordpiece.Profile.of(cjk=False)
    assert importer.profile(container.Container()) == wordpiece.UNCASED
    c = importer.import_model(spark, "RobertaModel", SETTINGS | flags | {"hidden_act": "relu"}, {"a": 0}, body, specials={"bos": 1})
    assert importer.special_settings(c) == {"bos": 1} and c.hparams()["hidden_act"] == 1 and "model.do_lower_case" not in c.kv
    with pytest.raises(ValueError, match="bos"):
        importer.import_model(spark, "BertModel", SETTINGS, {"a": 0}, body, specials={"bos": 1})


def test_bound_unused_and_missing_tensors(spark, tmp_path):
    c = encoder.to_container(encoder.synthetic(4))
    whole = list(c.tensors)
    container.save(spark, str(tmp_path / "a"), c)
    del c.tensors[whole[0]]
    c.put("model.extra", np.zeros(3, np.float32))
    container.save(spark, str(tmp_path / "b"), c)
    found = container.binding(container.tensors(spark, str(tmp_path)), whole).collect()
    odd = sorted((r.path[-1], r.name, r.state) for r in found if r.state != "bound")
    assert odd == sorted([("b", "model.extra", "unused"), ("b", whole[0], "missing")]) and len(found) == 2 * len(whole) + 1


def test_quantize_from_the_command_line(spark, tmp_path, capsys):
    container.save(spark, str(tmp_path / "m"), encoder.to_container(encoder.synthetic(4, hidden=32, inner=64)))
    assert quantize.main([str(tmp_path / "m"), str(tmp_path / "q"), "q8_0"]) == 0
    assert "total: " in capsys.readouterr().out
    kinds = {k for k, d, _ in container.load(spark, str(tmp_path / "q")).tensors.values() if len(d) == 2}
    assert kinds == {"Q8_0"}
    assert quantize.main([str(tmp_path / "nothing"), str(tmp_path / "x"), "Q8_0"]) == 1 and not (tmp_path / "x").exists()


def test_spans_of_unknown_characters():
    model = bpe.Bpe({"?": 0, "a": 1, "b": 2, "ab": 3}, {(1, 2): (0, 3)}, unk="?")
    assert model.spans("xxabya") == [(0, 0, 2), (3, 2, 4), (0, 4, 5), (1, 5, 6)]
    assert bpe.Bpe(model.ids, model.ranks).spans("xab") == [(3, 1, 3)]


def test_log():
    out = io.StringIO()
    log.set_file(out)
    try:
        assert log.get_level() == log.DEFAULT and log.get_file() is out
        log.logger.error("seen")
        log.logger.info("unseen")
        log.set_level(10)
        log.logger.error("unseen")
        assert out.getvalue() == "seen\n"
        with pytest.raises(ValueError):
            log.set_level(5)
    finally:
        log.set_level(log.DEFAULT)
        log.set_file(None)
