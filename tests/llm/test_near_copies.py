"""Near copies by five-word shingles against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from lexiform.llm import near_copies


def _shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _edited(rng, base, edits):
    words = base.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_copies_of_similarity_from_0_8_go_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 1000)  # so that blocks meet blocks
    rng = random.Random(7)
    docs = []
    for g in range(40):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200)))
        docs += [base] + [_edited(rng, base, rng.randrange(1, 7)) for _ in range(5)]
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
    docs += [_edited(rng, base, rng.randrange(1, 6)) for _ in range(60)]  # a group whose ends don't connect all
    docs += ["one two three", "ONE  two\tthree", "one two four", "a b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n z"]
    sets = [_shingles(t) for t in docs]
    near = [(a, b) for b in range(len(docs)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    least = list(range(len(docs)))
    for _ in docs:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert sum(x != i for i, x in enumerate(least)) > 50
    table = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect())
    assert got == [i for i, x in enumerate(least) if x == i]
