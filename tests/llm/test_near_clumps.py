"""The pipeline's near-dedup on a large group of near copies that mostly don't reach the similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from lexiform.llm import near_copies


def _shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_a_group_of_near_copies_makes_rows_in_proportion_to_its_nodes(spark, monkeypatch):
    made = []

    def written(df, name, real=near_copies.written):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(near_copies, "written", written)
    monkeypatch.setattr(near_copies, "BLOCK", 4000)  # so that blocks meet blocks
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for _ in range(240):
        words = list(base)
        for i in rng.sample(range(150), rng.randrange(2, 6)):
            words[i] = f"x{rng.randrange(10**9)}"
        docs.append(" ".join(words))
    sets = [_shingles(t) for t in docs]
    near = [(a, b) for b in range(len(docs)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    least = list(range(len(docs)))
    for _ in docs:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(table).collect()}
    assert got == dict(enumerate(least))
    assert len(docs) / 10 < sum(x != i for i, x in enumerate(least)) < len(docs) * 9 / 10
    assert max(n for _, n in made) <= 8 * len(docs), made


def test_links_of_a_piece_connect_its_roots_once():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    sets = [np.sort(np.append(base, np.uint64(i))) for i in range(20)] + [np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))]
    found = near_copies.linked([*range(21)], [*range(20), 99], sets, [True] * 21, 0.8)
    assert len(found) == 19 and {x for pair in found for x in pair} == set(range(20))
    assert near_copies.linked([0, 1], [7, 7], sets[:2], [True, True], 0.8) == []


@pytest.mark.parametrize("words, kept", [(7, [0, 1]), (8, [0])])  # sets of 3 and 4 hashes, of 4 and 5: 0.75 and 0.8
def test_the_smallest_sets_that_can_be_that_similar_are_looked_for(spark, words, kept):
    text = " ".join(f"w{i}" for i in range(words))
    table = spark.createDataFrame([(0, text, None, None, 0), (1, f"{text} more", None, None, 0), (2, text.upper(), None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()) == kept
