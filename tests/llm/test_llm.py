"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lexiform.llm import gif, line_dedup, lm_scoring, packing, sharding, simhash, toxicity

ROWS = [(1, "Hello world one two three", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "Hello world one two three", "en", "s", 5), (4, "Hello world one two three", "en", "s", 5), (None, "x", "fr", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, random.Random(1).randbytes(20000), b"x" * 100000, bytes(random.Random(2).choices(b"abc de", k=100000))])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_digest_of_empty_text():
    assert gif.digest(None)[:2] == (0, 192)
    assert gif.digest(None) == gif.digest("")


def test_best_fit_decreasing_fills_windows():
    lengths = np.random.default_rng(1).integers(1, 2049, 3000)
    bins, offsets, n = packing.best_fit_decreasing(lengths)
    used = np.bincount(bins, weights=lengths, minlength=n)
    assert used.max() <= 2048 and lengths.sum() / n / 2048 > 0.97
    for b in range(0, n, 50):
        own = sorted((int(o), int(x)) for o, x in zip(offsets[bins == b], lengths[bins == b]))
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))]


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 600):
        lengths = rng.choice([1, 2, 3, 700, 1024, 1025, 2047, 2048, *rng.integers(1, 2049, 30).tolist()], n).astype(np.int64)
        bins, offsets, count = packing.best_fit_decreasing(lengths)
        used, fits = [], []
        for x in sorted(lengths.tolist(), reverse=True):
            open_ = [u for u in used if u + x <= 2048]
            if open_:
                used.remove(max(open_))  # the tightest window that still holds it
                used.append(max(open_) + x)
            else:
                used.append(x)
            fits.append(max(open_) if open_ else 0)
        assert count == len(used) and sorted(np.bincount(bins, weights=lengths, minlength=count).tolist()) == sorted(used)
        assert offsets[np.argsort(-lengths, kind="stable")].tolist() == fits


def test_packing_cuts_overlong_documents_into_full_windows(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((5000, 2047, 2048, 4095, 10, 1, 3))], "doc_id long, text string")
    rows = packing.pack(docs.coalesce(1), path).collect()
    for i in range(7):
        mine = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert all(n == 2048 for _, n, _ in mine[:-1]) and sum(n for _, n, _ in mine) == mine[0][2]
    assert len({r.sequence_id for r in rows}) == 2 + 1 + 1 + 2 + 1  # what is left of the cuts shares one window


def test_languages_of_held_out_documents(spark):
    from lexiform.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    out = [r for r in language_id.op3_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in langs and r.lang_pred != "und"]
    assert len(out) > 150 and sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.97 * len(out)
    assert not any(language_id.has_letter(t) for t in (None, "", "²½ Ⅷ ① ٣", "12 ...", "\u0301")) and all(map(language_id.has_letter, ("a", "1ß", "中", "ʰ")))


def test_word_tokenizer_equals_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tok = packing.tokenizer(public.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeé ñß.,!12'ΣİǅÅ\x1c\x00", k=60)) for _ in range(300)] + ["<|endoftext|> a", "don't've", " "]
    for t in texts:
        assert tok.text(t) == np.array(tok.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_every_character_has_the_tokenizers_ids():
    public = pytest.importorskip("public_tokenizers")
    tok = packing.tokenizer(public.path("word_bpe_49k.json"))
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rare = [i for i in points if i < 0x20000 and not i % 7 or i in (0x1C89, 0x1C8A, 0xA7CB, 0x10D50, 0x16EA0, 0x1E5D0)]
    for i in rare:
        text = f"a{chr(i)}b {chr(i)}"
        assert tok.text(text) == np.array(tok.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(i)


def test_ring_capacities_hold():
    pieces = sharding.place_arcs([10, 0, 5, 1], [0, 1, 0, 2], [6, 5, 5])
    taken = [0, 0, 0]
    for _, lo, hi, s in pieces:
        taken[s] += hi - lo
    assert taken == [6, 5, 5]


def test_sharding_counts_and_edge_cases(spark):
    rows = sharding.assign_shards(spark.createDataFrame(ROWS, SCHEMA), 4).collect()
    assert len(rows) == len(ROWS)
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0


def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", "One", "a b", "A b\tc d\x0be é", "x " * 40):
        assert simhash.fingerprint(text) == _fingerprint(text)


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)  # so that blocks meet blocks
    rng = random.Random(1)
    base = rng.getrandbits(64)
    found = {base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for _ in range(80)} | {rng.getrandbits(64) for _ in range(30)}
    found = sorted(x - 2**64 if x >> 63 else x for x in found)

    def roots(pairs):
        at = {x: x for x in found}

        def top(x):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            at[max(a, b)] = min(a, b)
        return [top(x) for x in found]

    near = [(a, b) for a in found for b in found if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in found], "fp long")).collect()]
    assert set(tuple(sorted(x)) for x in got) <= set(near)
    assert roots(got) == roots(near)


def test_near_groups_edge_cases(spark):
    out = {(r.doc_id, r.component_id) for r in simhash.near_groups(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {(1, 1), (2, 2), (3, 2), (4, 1)} <= out


def test_word_hashes_tell_words_and_texts_apart():
    hashes, owners = lm_scoring.word_hashes([b"a B a", b"", b" b\tab "])
    assert owners.tolist() == [0, 0, 0, 2, 2]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


def test_line_dedup_finds_passages_of_fifty_words_wherever_chunks_end(spark):
    rng = random.Random(5)

    def line(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    passages = [[line(n) for n in sizes] for sizes in ([30, 25], [12, 20, 20], [60], [3, 14, 3, 33], [25, 25])]
    short = [line(15)]  # a frequent line alone is no passage
    own = {i: ([line(rng.randrange(1, 20)) for _ in range(4)], [line(rng.randrange(1, 20)) for _ in range(4)]) for i in range(60)}
    docs = [(i, "\n".join(a + passages[i % 5] + b)) for i, (a, b) in own.items()]
    docs += [(1000 + i, "\n".join([line(9), short[0], line(9)])) for i in range(20)]
    out = {r.doc_id: r.text for r in line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        expected = text if i < 5 or i >= 1000 else "\n".join(own[i][0] + own[i][1])
        assert out[i] == expected


def test_line_dedup_keeps_the_first_copy(spark):
    passage = "\n".join(f"line {i} of a passage that comes back" for i in range(12))
    long_line = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"start one\n{passage}\nend one"), (2, f"other\nstart\n{passage}\nfin"), (3, "clean\ntext\nhere"), (4, f"q\n{long_line}"), (5, f"{long_line}\nz"), (6, None)]
    out = {r.doc_id: r.text for r in line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1] == docs[0][1] and out[3] == docs[2][1] and out[4] == docs[3][1] and out[6] is None
    assert out[2] == "other\nstart\nfin" and out[5] == "z"


def test_triple_weights_are_the_subsequence_kernel():
    def kernel(s, t):
        spots = lambda x: [(x[i] + x[j] + x[k], k - i + 1) for i in range(len(x)) for j in range(i + 1, len(x)) for k in range(j + 1, len(x))]
        return sum(toxicity.LAMBDA ** (p + q) for a, p in spots(s) for b, q in spots(t) if a == b)

    for s, t in (("idiot", "idixot"), ("aaaa", "aaa"), ("abc", "xyz")):
        a, b = toxicity.triple_weights(s), toxicity.triple_weights(t)
        assert sum(v * b.get(k, 0) for k, v in a.items()) == pytest.approx(kernel(s, t))


def test_broken_words_are_joined():
    assert {"idiot", "moron"} <= set(toxicity.words_of("an i-d-i-o-t and m o r o n"))


def test_words_rated_together_have_the_margins_of_the_kernel():
    rng = np.random.default_rng(3)
    known = ["idiot", "moron", "grüße", "clownish", "табак", "a" * 16]
    model = toxicity.Model({t: float(rng.normal()) for w in known for t in toxicity.triple_weights(w)}, -0.3)

    def plain(word):
        if len(word) > toxicity.LENGTH:
            step = toxicity.LENGTH // 2
            return max(plain(word[i : i + toxicity.LENGTH]) for i in range(0, len(word) - step, step))
        f = toxicity.triple_weights(word)
        norm = sum(v * v for v in f.values()) ** 0.5
        return sum(v * model.triples.get(t, 0.0) for t, v in f.items()) / norm + model.bias if norm else model.bias

    words = ["", "a", "ab", "idiot", "idixot", "ab" * 5000, "x" * 17, "日本語", "\U0001f600ab", "grüßen", *("".join(rng.choice(list("idotmrn"), n)) for n in range(3, 40))]
    want = [plain(w) for w in words]
    assert np.allclose(toxicity.Rater(model).margins(words), want)
    dense, toxicity.DENSE_LETTERS = toxicity.DENSE_LETTERS, 2
    try:
        assert np.allclose(toxicity.Rater(model).margins(words), want)
    finally:
        toxicity.DENSE_LETTERS = dense
    assert (toxicity.Rater(toxicity.Model({}, 0.5)).margins(words) == 0.5).all()


def test_chunks_keep_all_texts_in_order():
    texts = ["a" * n for n in (0, 5, 999_999, 1, 1_500_000, 0, 3)]
    parts = list(toxicity.chunks(texts))
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= toxicity.CHUNK for p in parts)
