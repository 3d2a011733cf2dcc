"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for operators that only read."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from lexiform.llm import decontamination, language_id, lm_scoring, packing, toxicity

LONG = "long words of a very long text " * 40_000
SCHEMA = "doc_id long, text string, lang string, batch string, hash string, part string, tokens string, score string, hits string, toxicity string, sequence_id string, item_id string, _doc string"
TEXTS = [(1, "the cat and the dog"), (2, None), (3, ""), (4, "the cat and the dog"), (4, "the cat and the dog"), (None, "le chat et le chien"), (5, LONG), (6, " \t\n"), (7, "123 ..."), (8, "THE cat")]


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", *["x"] * 10) for i, t in texts], SCHEMA)


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in low.encode().split()]


@pytest.mark.parametrize("order,batch_bytes", [(1, 8 << 20), (2, 40), (3, 8 << 20), (3, 40), (4, 40)])
def test_language_model_scores_equal_a_plain_loop(spark, order, batch_bytes):
    texts = TEXTS + [(20 + i, f"the cat and the {w} dog sat and the cat ran") for i, w in enumerate(("big", "old", "big"))]
    found = [_words(t) for _, t in texts]

    def counts(words, n):
        return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    own = [{n: counts(w, n) for n in range(1, order + 1)} for w in found]
    all_ = {n: sum((o[n] for o in own), Counter()) for n in range(1, order + 1)}
    total, want = sum(map(len, found)), []
    for (i, _), w, mine in zip(texts, found, own):
        rest, logs = total - len(w), []
        for at, word in enumerate(w):
            n = all_[1][word,] - mine[1][word,]
            s = n / max(rest, 1) if n else 0.4 / (rest + 1)
            for k in range(2, min(order, at + 1) + 1):
                gram = tuple(w[at - k + 1 : at + 1])
                n, c = (all_[len(g)][g] - mine[len(g)][g] for g in (gram, gram[:-1]))
                s = n / c if n and c else 0.4 * s
            logs.append(math.log10(s))
        want.append((i, len(w), round(sum(logs) / len(w), 5) if w else None))
    rows = lm_scoring.scores(_docs(spark, texts).repartition(3), order=order, batch_bytes=batch_bytes, part_bytes=batch_bytes).collect()
    assert sorted([(r.doc_id, r.tokens, None if r.score is None else round(r.score, 5)) for r in rows], key=repr) == sorted(want, key=repr)
    assert lm_scoring.scores(_docs(spark, []), order=order).collect() == []


def test_languages_of_odd_texts(spark):
    train = [(i, f"{x} {w} {x}", lang, *["x"] * 10) for i, (x, lang, w) in enumerate([("the cat and the dog", "en", "was"), ("le chat et le chien", "fr", "est")] * 100)]
    model = language_id.fit(spark.createDataFrame(train, SCHEMA))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(_docs(spark), model).collect()]
    assert sorted((repr(i) for i, _, _ in got)) == sorted(repr(i) for i, _ in TEXTS)
    by = {i: (lang, s) for i, lang, s in got}
    assert by[1][0] == by[4][0] == by[8][0] == "en" and by[None][0] == "fr" and by[1] == by[4]
    assert all(by[i] == ("und", 0.0) for i in (2, 3, 6, 7)) and all(0 <= s <= 1 for _, _, s in got)
    assert language_id.identify(_docs(spark, []), model).collect() == []
    none = language_id.fit(_docs(spark, []))
    assert {(r.lang_pred, r.score) for r in language_id.identify(_docs(spark), none).collect()} == {("und", 0.0)}


def test_toxicity_of_odd_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    for labels, want in ((empty, 0.0), (spark.createDataFrame([(1, 1, 1, "x"), (None, 1, 0, "x")], empty.schema), None)):
        scored = toxicity.score_texts(_docs(spark).drop("toxicity"), toxicity.fit(_docs(spark), labels)).collect()
        assert len(scored) == len(TEXTS) and all(0 <= r.toxicity <= 1 for r in scored)
        assert len({r.toxicity for r in scored if r.doc_id in (2, 3, 6, 7)}) == 1
        assert want is None or {r.toxicity for r in scored} == {want}


def test_leaks_of_odd_texts(spark):
    items = [("a", "the cat and the dog"), ("b", None), ("c", ""), ("d", "THE cat"), ("d", "THE cat"), ("e", "a very long text long words of a very long text"), ("f", "words that are nowhere at all")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id string, text string, doc_id string, hash long")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(_docs(spark), bench).collect()}
    want = set()
    for i, t in TEXTS:
        for j, u in items:
            w, v = _words(t), _words(u)
            mine, theirs = ({tuple(x[k : k + 5]) for k in range(max(len(x) - 4, 1))} if x else set() for x in (w, v))
            if theirs and len(mine & theirs) >= 0.8 * len(theirs) - 1e-9:
                want.add((i, j))
    assert got == want and (5, "e") in got and (8, "d") in got
    assert decontamination.contaminated(_docs(spark, []), bench).collect() == []
    assert decontamination.contaminated(_docs(spark), bench.where("false")).collect() == []


def test_packing_of_odd_texts(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = packing.pack(_docs(spark), path).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == {i for i, _ in TEXTS}
    for i, found in pieces.items():
        copies = sum(x == i for x, _ in TEXTS)
        assert sum(n for _, n, _ in found) == copies * found[0][2]
    assert all(pieces[i] == [(0, 1, 1)] for i in (2, 3))
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
    assert packing.pack(_docs(spark, []), path).collect() == []
