"""Byte-pair encoding, containers, the encoder and fill-mask against fixtures and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiform.operators import bpe, encoder
from lexiform.sources import container

WORDS = "u n r e l a t d re at ed un ated rel related unrelated".split()
VOCAB = {t: i for i, t in enumerate(WORDS)}
MERGES = [("r", "e"), ("a", "t"), ("e", "d"), ("u", "n"), ("at", "ed"), ("re", "l"), ("rel", "ated"), ("un", "related")]


def _model(spark, vocab=VOCAB, merges=MERGES, **options):
    v = spark.createDataFrame(list(vocab.items()), "token string, id int")
    m = spark.createDataFrame([(n, *x) for n, x in enumerate(merges)], "rank int, left string, right string")
    return bpe.model(v, m, **options)


def test_merges_and_dropout(spark):
    m = _model(spark)
    for word, want in (("unrelated", ["unrelated"]), ("unre", ["un", "re"]), ("rated", ["r", "ated"]), ("lated", ["l", "ated"]), ("related", ["related"]), ("", [])):
        assert [m.names[i] for i in m.merge(word)] == want
    assert [m.names[i] for i in m.merge("unrelated", dropout=1.0)] == list("unrelated")
    assert m.merge("unrelated", 0.5, seed=3) == m.merge("unrelated", 0.5, seed=3)
    with pytest.raises(ValueError):
        _model(spark, {"a": 0, "b": 1, "c": 2, "ab": 3}, [("a", "b"), ("a", "d")])


def test_merges_equal_a_plain_loop(spark):
    m, rng = _model(spark), np.random.default_rng(1)
    for _ in range(300):
        at = m.symbols(word := "".join(rng.choice(list("unrelatd"), 12)))
        while found := [(m.ranks[p][0], i) for i, p in enumerate(zip(at, at[1:])) if p in m.ranks]:
            _, i = min(found)
            at[i : i + 2] = [m.ranks[at[i], at[i + 1]][1]]
        assert m.merge(word) == at


@pytest.mark.parametrize("fuse,want", [(False, [1, 0, 0, 2]), (True, [1, 0, 2])])
def test_unknown_symbols(spark, fuse, want):
    assert _model(spark, {"<unk>": 0, "a": 1, "b": 2}, [], unk="<unk>", fuse_unk=fuse).merge("accb") == want
    assert _model(spark, {"a": 1, "b": 2}, []).merge("accb") == [1, 2]


def test_splits_and_bytes(spark):
    row = spark.createDataFrame([("Hi <s>abc  <mask>d</s>", "Hello I'm a  model.", "".join(map(chr, range(256))) + "日𝄞")], "a string, b string, c string")
    got = row.select(bpe.special_split(F.col("a")), bpe.pre_tokens(F.col("b")), bpe.byte_encode("c"), bpe.byte_decode(bpe.byte_encode(F.col("c"))), "c").first()
    assert got[0] == ["Hi ", "<s>", "abc", "<mask>", "d", "</s>"]
    assert got[1] == ["Hello", " I", "'m", " a", " ", " model", "."]
    assert got[3] == got[4] and got[2][:33] == "".join(chr(0x100 + i) for i in range(33)) and len(got[2]) == len(got[4].encode())


def test_tokenize_texts(spark):
    vocab = {"<s>": 0, "<mask>": 4, "Ġ": 5, "a": 6, "b": 7, "Ġa": 8}
    m = _model(spark, vocab, [("Ġ", "a")])
    docs = spark.createDataFrame([(1, "a ab <mask>b<s>"), (2, ""), (3, None), (4, "a?")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.tokenize(docs, m).collect()} == {1: [6, 8, 7, 4, 7, 0], 2: [], 3: None, 4: None}


def _plain(e, ids, layer):
    """The forward pass in loops."""
    w = {n: x.tolist() for n, x in e.weights.items()}
    def dense(x, n):
        return [sum(a * b for a, b in zip(row, x)) + c for row, c in zip(w[n + ".weight"], w[n + ".bias"])]
    def norm(x, n):
        mu = sum(x) / len(x)
        sd = math.sqrt(sum((a - mu) ** 2 for a in x) / len(x) + e.eps)
        return [(a - mu) / sd * g + b for a, g, b in zip(x, w[n + ".weight"], w[n + ".bias"])]
    xs = [norm([a + b + c for a, b, c in zip(w["embeddings.word_embeddings.weight"][t], w["embeddings.position_embeddings.weight"][p], w["embeddings.token_type_embeddings.weight"][0])], "embeddings.LayerNorm") for p, t in enumerate(ids)]
    for n in range(layer):
        at = f"encoder.layer.{n}"
        q, k, v = ([dense(x, f"{at}.attention.self.{p}") for x in xs] for p in ("query", "key", "value"))
        d = len(q[0]) // e.heads
        seen = [[] for _ in xs]
        for h in range(0, len(q[0]), d):
            for i in range(len(xs)):
                s = [math.exp(sum(q[i][h + c] * k[j][h + c] for c in range(d)) / math.sqrt(d)) for j in range(len(xs))]
                seen[i] += [sum(s[j] * v[j][h + c] for j in range(len(xs))) / sum(s) for c in range(d)]
        xs = [norm([a + b for a, b in zip(x, dense(y, f"{at}.attention.output.dense"))], f"{at}.attention.output.LayerNorm") for x, y in zip(xs, seen)]
        act = [[0.5 * a * (1 + math.tanh(0.7978845608 * (a + 0.044715 * a**3))) for a in dense(x, f"{at}.intermediate.dense")] for x in xs]
        xs = [norm([a + b for a, b in zip(x, dense(y, f"{at}.output.dense"))], f"{at}.output.LayerNorm") for x, y in zip(xs, act)]
    return xs


def test_forward_pass_equals_loops(spark):
    e = encoder.synthetic(30, layers=2, max_tokens=8)
    ids = [3, 7, 7, 29, 0]
    for layer, n in ((0, 0), (1, 1), (-1, 2), (-2, 1)):
        assert np.allclose(e.hidden(ids, layer=layer), _plain(e, ids, n), atol=1e-12)
    docs = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, list(range(9))), (5, [30])], "doc_id long, ids array<int>")
    for pool, vector in (("cls", lambda x: x[0]), ("avg", lambda x: x.mean(0)), ("max", lambda x: x.max(0))):
        got = {r.doc_id: (r.error, r.vectors) for r in encoder.encode(docs, e, pool).collect()}
        want = np.tanh(e.weights["pooler.dense.weight"] @ vector(np.array(_plain(e, ids, 2))) + e.weights["pooler.dense.bias"])
        assert np.allclose(got[1][1][0], want)
        assert {k: v[0] for k, v in got.items()} == {1: None, 2: "no tokens", 3: "no tokens", 4: "too many tokens", 5: "unknown token id"}
    assert encoder.synthetic(9, pad_id=1).positions(np.array([0, 5, 1, 6, 2])).tolist() == [2, 3, 0, 4, 5]


def test_fill_mask(spark):
    e = encoder.synthetic(12, max_tokens=8)
    docs = spark.createDataFrame([(1, [3, 5, 4]), (2, [3, 4]), (3, [5, 5])], "doc_id long, ids array<int>")
    got = encoder.fill_mask(docs, e, 5, 3).collect()
    p = e.vocabulary(e.hidden([3, 5, 4]))[1]
    assert [r.token_id for r in got if r.doc_id == 1] == sorted(range(12), key=lambda i: (-p[i], i))[:3]
    assert {r.doc_id: r.error for r in got if r.error} == {2: "0 masks", 3: "2 masks"}
    assert encoder.fill_mask(docs, e, 5, 99).where("doc_id = 1").count() == encoder.fill_mask(docs, e, 5, 0).where("doc_id = 1").count() == 12


def test_container_round_trip(spark, tmp_path):
    e = encoder.synthetic(40, hidden=32, heads=4, layers=1, inner=64, max_tokens=16)
    c = encoder.to_container(e)
    c.kv |= {"general.name": ("string", "größe"), "flags": ("array:bool", [True, False]), "names": ("array:string", ["a", ""])}
    c.put_vocab({"a": 0, "[unused0]": 1, "x" * 256: 4, "ü": 5})
    path = str(tmp_path / "m.bin")
    container.save(spark, path, c)
    back = container.load(spark, path)
    assert (back.kv, back.tensors, back.namespace) == (c.kv, c.tensors, c.namespace)
    assert back.vocab() == ["a", "[unused0]", "[unused1]", "[unused2]", "x" * 256, "ü"]
    assert container.kv(spark, path).count() == len(c.kv) and {r.name: r.nbytes for r in container.tensors(spark, path).collect()} == {n: len(t[2]) for n, t in c.tensors.items()}
    assert np.allclose(encoder.from_container(back).hidden([1, 2, 3]), e.hidden([1, 2, 3]), atol=1e-4)
    for bad in (b"", b"GGUF", container.render(c)[:-40], b"XXXX" + container.render(c)[4:]):
        with pytest.raises(ValueError):
            container.parse(bad)
    with pytest.raises(KeyError):
        back.get("absent")


@pytest.mark.parametrize("kind,limit", [("Q8_0", 0.01), ("Q4_0", 0.15), ("Q4_1", 0.15), ("Q5_0", 0.08), ("Q5_1", 0.08)])
def test_quantized_container(kind, limit):
    e = encoder.synthetic(40, hidden=32, heads=4, layers=1, inner=64, max_tokens=16)
    c = encoder.to_container(e)
    q, report = container.quantize(c, kind.lower())
    assert all(q.tensors[n][0] == (kind if n.endswith("weight") and len(t[1]) == 2 else "F32") for n, t in c.tensors.items())
    assert all(after * 32 == before // 4 * container.BLOCKS[kind][1] and abs(sum(bins) - 1) < 1e-9 for _, before, after, bins in report)
    for n, *_ in report:
        x = c.array(n)
        assert np.abs(container.parse(container.render(q)).array(n) - x).max() <= limit * np.abs(x).max() + 1e-6
    with pytest.raises(ValueError):
        container.quantize(q, kind)


def test_special_ids_and_offsets(spark):
    vocab = spark.createDataFrame([("[CLS]", 7), ("<s>", 1), ("</s>", 2)], "token string, id int")
    got = container.special_ids(vocab, {"cls": (None, ("[CLS]", "<s>")), "sep": (None, ("[SEP]", "</s>")), "pad": (5, ("[PAD]",)), "unk": (None, ("[UNK]",))})
    assert {r.role: r.id for r in got.collect()} == {"cls": 7, "sep": 2, "pad": 5, "unk": None}
    sizes = spark.createDataFrame([(0, 3), (1, 0), (2, 1)], "id int, len int")
    assert [(r.len, r.begin) for r in container.vocab_offsets(sizes).orderBy("id").collect()] == [(3, 0), (256, 3), (1, 259)]
