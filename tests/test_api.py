"""Golden ids over mini vocabularies, profiles, special tokens, sizes, the head over states and fill-mask on texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.operators import api, bpe, encoder, wordpiece

# Published ids of tokens.
CASED = {"[CLS]": 101, "[MASK]": 103, "[PAD]": 0, "[SEP]": 102, "[UNK]": 100, "Hi": 8790, ",": 117, "I": 146, "am": 1821, "man": 1299, ".": 119, "How": 1731, "are": 1132, "you": 1128, "?": 136, "Hello": 8667, "'": 112, "m": 182, "a": 170, "model": 2235}
BYTES = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "<mask>": 50264, "Hi": 30086, ",": 6, "ĠI": 38, "Ġam": 524, "Ġman": 313, ".": 4, "ĠHow": 1336, "Ġare": 32, "Ġyou": 47, "?": 116, "Hello": 31414, "'m": 437, "Ġa": 10, "Ġmodel": 1421}


def _vocab(spark, ids):
    return spark.createDataFrame(list(ids.items()), "token string, id int")


def test_golden_ids_of_wordpiece(spark):
    texts = {"Hi, I am [MASK] man.": [101, 8790, 117, 146, 1821, 103, 1299, 119, 102], "Hi, I am [MASK] man. How are you?": [101, 8790, 117, 146, 1821, 103, 1299, 119, 1731, 1132, 1128, 136, 102], "Hello I'm a [MASK] model.": [101, 8667, 146, 112, 182, 170, 103, 2235, 119, 102]}
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = {r.text: (r.ids, r.tokens, r.too_long) for r in api.tokenize(docs, _vocab(spark, CASED), 10, 101, 102, 100).collect()}
    assert got == {t: (ids, len(ids), len(ids) > 10) for t, ids in texts.items()} | {None: (None, None, None)}


def test_golden_ids_of_byte_pairs(spark):
    texts = {"Hi, I am <mask> man.": [30086, 6, 38, 524, 50264, 313, 4], "Hi, I am <mask> man. How are you?": [30086, 6, 38, 524, 50264, 313, 4, 1336, 32, 47, 116], "Hello I'm a <mask> model.": [31414, 38, 437, 10, 50264, 1421, 4]}
    # Merges that build each token from its characters, left to right, and the tokens on the way; blanks before a token go with it.
    tokens, merges, ids = [t for t in BYTES if t not in bpe.SPECIALS], {}, dict(BYTES)
    for t in tokens:
        for n in range(1, len(t)):
            merges.setdefault((t[:n], t[n]))
            for part in (t[:n], t[n], t[: n + 1]):
                ids.setdefault(part, 60_000 + len(ids))
    vocab = _vocab(spark, ids)
    model = bpe.model(vocab, spark.createDataFrame([(n, *m) for n, m in enumerate(merges)], "rank int, left string, right string"), unk="<unk>")
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.ids for r in bpe.tokenize(docs, model).collect()} == texts


def test_profiles_and_tokens_that_the_vocabulary_lacks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    text = F.lit("Naïve [MASK] ÅNGSTRÖM áb,x 中文")
    assert one(wordpiece.basic_words(text)) == ["Naïve", "[MASK]", "ÅNGSTRÖM", "áb", ",", "x", "中", "文"]
    assert one(wordpiece.basic_words(text, wordpiece.UNCASED)) == ["naive", "[MASK]", "angstrom", "ab", ",", "x", "中", "文"]
    assert one(wordpiece.basic_words(text, wordpiece.Profile.of(lower=True, strip_accents=False, cjk=False))) == ["naïve", "[MASK]", "ångström", "áb", ",", "x", "中文"]
    assert one(wordpiece.basic_words(text, wordpiece.Profile.of(basic=False, cjk=False))) == ["Naïve", "[MASK]", "ÅNGSTRÖM", "áb,x", "中文"]
    assert one(wordpiece.basic_words(F.lit("́ x̀"), wordpiece.UNCASED)) == ["x"]
    docs = spark.createDataFrame([("a [MASK] a",), ("a" * 50_000,), (None,), ("",)], "text string")
    got = [r.ids for r in wordpiece.token_ids(docs, _vocab(spark, {"a": 5, "##aa": 6, "[UNK]": 9}), 9).collect()]
    assert got == [[5, 9, 5], [5] + [6] * 24_999 + [9], None, []]


def test_special_tokens_and_sizes(spark):
    assert api.roles(_vocab(spark, CASED), encoder.BERT) == {"cls": 101, "mask": 103, "pad": 0, "sep": 102, "unk": 100}
    found = api.roles(_vocab(spark, BYTES), encoder.ROBERTA, {"mask": 7})
    assert found == {"bos": 0, "cls": 0, "eos": 2, "sep": 2, "pad": 1, "unk": 3, "mask": 7}
    short = _vocab(spark, {t: i for t, i in BYTES.items() if t != "</s>"})
    assert api.roles(short, encoder.ROBERTA, {"sep": 11})["eos"] == 11  # one borrows from the other
    with pytest.raises(ValueError, match="eos.*sep"):
        api.roles(short, encoder.ROBERTA)
    with pytest.raises(ValueError, match="cls"):
        api.roles(_vocab(spark, {"[UNK]": 1}), encoder.BERT)
    assert (api.architecture(0), api.architecture(1), api.architecture(None), api.architecture(9)) == ("BERT", "ROBERTA", "UNKNOWN", "UNKNOWN")
    assert (api.vector_size(8, "none", 5), api.vector_size(8, "avg", 5), api.likeliest_size(30, 3, 5), api.likeliest_size(30, 0, 5), api.likeliest_size(30, 99, 5)) == (40, 8, 15, 150, 150)
    assert api.vocab_size(short) == len(BYTES) - 1


def test_texts_together_have_the_vectors_of_each(spark):
    for pad in (None, 1):
        model = encoder.synthetic(32, pad_id=pad, max_tokens=600)
        rng = np.random.default_rng(3)
        rows = [(i, rng.integers(0, 32, n).tolist(), rng.integers(0, 2, n).tolist() if i % 2 else None) for i, n in enumerate([3, 5, 3, 5, 5, 1, 40, 3, 3, 40, 500])]
        df = spark.createDataFrame(rows, "doc_id int, ids array<int>, segments array<int>").coalesce(1)
        for pool in encoder.POOLS:
            got = {r.doc_id: r.vectors for r in encoder.encode(df, model, pool).collect()}
            assert all(np.allclose(got[i], np.atleast_2d(model.pooled(model.hidden(ids, kinds), pool))) for i, ids, kinds in rows)


def test_the_head_over_states_and_fill_mask_on_texts(spark):
    words = ["[CLS]", "[MASK]", "[PAD]", "[SEP]", "[UNK]", *"a b c d e f g".split()]
    vocab, model = _vocab(spark, {t: i for i, t in enumerate(words)}), encoder.synthetic(len(words))
    docs = spark.createDataFrame([(1, "a b [MASK] c", "x"), (2, "a b c", "x"), (3, None, "x"), (4, "[MASK] q [MASK]", "x"), (5, "a " * 600 + "[MASK]", "x")], "doc_id long, text string, token string")
    got = api.fill_mask(docs, vocab, model, 4).collect()
    ids = [0, 5, 6, 1, 7, 3]
    p = model.vocabulary(model.hidden(ids))[3]
    best = np.lexsort((np.arange(len(p)), -p))[:4]
    assert [(r.token, pytest.approx(r.prob)) for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.rank)] == [(words[i], p[i]) for i in best]
    assert {r.doc_id: r.error for r in got if r.error} == {2: "0 masks", 3: "no tokens", 4: "2 masks", 5: "too many tokens"}
    for k in (0, 13):
        with pytest.raises(ValueError):
            api.fill_mask(docs, vocab, model, k)
    states = model.hidden(ids).tolist()
    rows = spark.createDataFrame([(1, states), (2, None), (3, [[1.0]])], "doc_id long, vectors array<array<double>>")
    for k in (3, 0, 99):
        out = api.likeliest(rows, model, k).collect()
        assert {r.doc_id: r.error for r in out if r.error} == {2: "no states", 3: "states of another size"}
        mine = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.pos)
        assert len(mine) == len(ids) and sum(len(r.token_ids) for r in mine) == api.likeliest_size(len(words), k, len(ids))
        q = mine[3].probs
        assert mine[3].token_ids[:4] == best.tolist()[: 3 if k == 3 else 4] and (np.allclose(q, p) if k == 0 else q == sorted(q, reverse=True))
