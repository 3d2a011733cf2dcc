"""Line dedup against plain loops over lines."""

from __future__ import annotations

import random

import pytest
from xxhash import xxh64_intdigest

from lexiform.llm import line_dedup

M = (1 << 64) - 1


def _spans(lines):
    """The chunks of a text by plain loops."""
    hashes, words = [xxh64_intdigest(x.encode()) for x in lines], [len(x.encode().split()) for x in lines]
    ends = []
    for i, h in enumerate(hashes):
        rolling = (h + (hashes[i - 1] * line_dedup._ODD[0] if i else 0)) & M
        content = (rolling ^ rolling >> 31) % line_dedup.DIVISOR == 0
        ends.append(content or words[i] >= 50 or i + 1 == len(lines) or words[i + 1] >= 50)
    out, start = set(), 0
    for i, end in enumerate(ends):
        if end:
            if sum(words[start : i + 1]) and (i + 1 - start >= 2 or sum(words[start : i + 1]) >= 50):
                out.add((start, i + 1))
            start = i + 1
    for i in range(len(lines)):
        if words[i]:
            out |= {next(((i, j) for j in range(i + 1, len(lines) + 1) if sum(words[i:j]) >= 50), None)}
            out |= {next(((j, i + 1) for j in range(i, -1, -1) if sum(words[j : i + 1]) >= 50), None)}
    return out - {None}


def _plain(docs):
    """What stays of each document: lines go that lie in a chunk which stands earlier, and behind it in the same text."""
    order = sorted({(i is None, i or 0, t) for i, t in docs if t})
    first, spans = {}, {}
    for n, (_, _, t) in enumerate(order):
        lines = t.split("\n")
        spans[n] = sorted(_spans(lines))
        for a, b in spans[n]:
            first.setdefault(tuple(lines[a:b]), (n, a))
    out = {}
    for n, (late, i, t) in enumerate(order):
        lines, gone = t.split("\n"), set()
        for a, b in spans[n]:
            m, at = first[tuple(lines[a:b])]
            if (m, at) != (n, a):
                gone |= set(range(max(a, at + b - a) if m == n else a, b))
        out[None if late else i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def _line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def _corpus(rng):
    passages = [[_line(rng, w) for _ in range(n)] for n, w in ((5, 11), (6, 9), (7, 8), (8, 7), (10, 6), (12, 8), (13, 4), (60, 1), (25, 3), (2, 26), (1, 50), (1, 300), (40, 30))]
    passages.append([_line(rng, 4) for _ in range(9)] + [_line(rng, 14)])  # a long line behind many short ones
    docs = []
    for i in range(150):
        p = passages[i % len(passages)]
        docs.append((i + 100, "\n".join([_line(rng, rng.randrange(1, 20)) for _ in range(3)] + p + [_line(rng, rng.randrange(1, 20)) for _ in range(3)])))
    # Lines of passages that stand elsewhere before, alone.
    docs += [(n, f"{_line(rng, 5)}\n{x}\n{_line(rng, 7)}") for n, x in enumerate(x for p in passages[:4] for x in p[:2])]
    docs += [(1000, "\n".join(["the same ten words in every line of this text"] * 100)), (1001, "\n".join([*passages[0], *passages[0], *passages[1], "", *passages[1]])), (1002, None), (1003, ""), (1004, "\n\n\n"), (1005, " \t\n \n" * 60)]
    docs += [(None, "\n".join(passages[2])), (None, "\n".join(passages[2])), (1006, docs[0][1]), (1006, docs[0][1]), (1007, docs[3][1] + "\nend"), (1006, "\n".join(passages[12]))]
    return docs, passages


def test_passages_go_as_in_plain_loops(spark):
    docs, passages = _corpus(random.Random(3))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((repr(r.doc_id), r.text) for r in line_dedup.deduplicate(table).collect())
    want = _plain(docs)
    assert got == sorted((repr(i), want.get((i, t), t)) for i, t in docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # every join is a shuffle
    try:
        assert got == sorted((repr(r.doc_id), r.text) for r in line_dedup.deduplicate(table).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Every copy of a passage but the first is gone, whole, whatever its lines.
    texts = {r.doc_id: r.text for r in line_dedup.deduplicate(table).collect() if r.doc_id is not None}
    for i in range(100 + len(passages), 250):
        assert not set(passages[(i - 100) % len(passages)]) & set(texts[i].split("\n")), i


def test_every_passage_of_fifty_words_is_found(spark):
    rng = random.Random(9)
    docs, first = [], 200 * 2
    for n in range(200):
        sizes = []
        while sum(sizes) < 50:
            sizes.append(rng.randrange(1, 25))
        passage = [_line(rng, s) for s in sizes]
        for i in (n, n + first):
            docs.append((i, "\n".join([_line(rng, 8), *passage, _line(rng, 8)]), passage))
    out = {r.doc_id: r.text for r in line_dedup.deduplicate(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()}
    for i, text, passage in docs:
        lines = text.split("\n")
        assert out[i] == (text if i < first else f"{lines[0]}\n{lines[-1]}")


def test_clean_lines_stay_and_stretches_of_other_bytes_are_seen(spark):
    rng = random.Random(4)
    clean = [(i, "\n".join(["short", _line(rng, 30), "a heading of the page", _line(rng, 9)])) for i in range(30)]
    docs = spark.createDataFrame(clean, "doc_id long, text string")
    assert {(r.doc_id, r.text, r.removed_lines) for r in line_dedup.deduplicate(docs).collect()} == {(*x, 0) for x in clean}
    keys = {r.doc_id: r.row_hash for r in line_dedup._rows(docs).collect()}
    runs = [(1, keys[1], 0, 1, 0, keys[0], 0, 1), (2, keys[2], 1, 2, 0, keys[0], 1, 1)]  # "short" is equal, the lines after it are not
    runs = spark.createDataFrame(runs, "doc_id long, row_hash long, first int, behind int, of_id long, of_hash long, of_first int, length int")
    assert [tuple(r) for r in line_dedup.unequal(docs, runs).collect()] == [(0, keys[0], 1, 1)]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "a")]])
def test_small_tables(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, line_dedup.deduplicate(table).select("doc_id", "text").collect())) == sorted(map(repr, table.collect()))


def test_a_passage_in_a_third_of_all_rows_and_a_very_long_text(spark):
    rng = random.Random(6)
    passage = [_line(rng, 9) for _ in range(8)]
    docs = [(i, "\n".join([_line(rng, 12), *(passage if i % 3 == 0 else []), _line(rng, 12)])) for i in range(3000)]
    docs.append((5000, "\n".join(x for n in range(4000) for x in (_line(rng, 6), *(passage if n % 9 == 0 else [])))))
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage == out[0][1:-1] and all(len(out[i]) == 2 for i in range(1, 3000)) and len(out[5000]) == 4000
