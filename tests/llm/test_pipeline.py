"""The pipeline's stages against plain Python, on a table with nulls, copies, leaks and columns of clashing names."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiform.llm import common, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, removed_lines long, _gone long, _leak long, _row string, component_id long, _doc long, hash long"
ITEM = "which river runs through the old town and past the two mills before the sea"


def _texts():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "sa", "te") for b in ("rot", "sim", "lun", "gar", "pel", "dov")]
    plain = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    toxic = [" ".join([*rng.choice(words, 12), "blimflag", *rng.choice(words, 9), "grotzwurm", "blimflag"]) for _ in range(30)]
    return plain, toxic


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    plain, toxic = _texts()
    passage = "\n".join(f"line {i} of a passage that comes back in many texts" for i in range(12))
    rows = [(i, t) for i, t in enumerate(plain)] + [(100 + i, t) for i, t in enumerate(toxic)]
    rows += [(200, f"one\n{plain[0][::-1]}\n{passage}\nend"), (201, f"other\n{plain[1][::-1]}\n{passage}\nfin"), (300, plain[5]), (301, plain[5] + " "), (302, plain[5])]
    rows += [(400, f"{plain[7][::-1]} {ITEM.upper()} {plain[8][::-1]}"), (500, None), (501, ""), (502, " \n "), (None, plain[9][::-1]), (503, "word " * 30000), (504, None), (504, None)]
    d = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, None, None, None if t is None else len(t), 0.25, 7, i, i, "r", 1, 2, 3) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 0, 1) for i in range(30)] + [(i, 1, 0) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _kept(spark, sf, stage):
    docs = _docs(spark, sf)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all((r.toxicity, r._row, r._gone, r._leak) == (0.25, "r", r.doc_id, r.doc_id) for r in rows)
    return rows


def test_toxic_documents_go(spark, sf):
    model = toxicity.fit(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    rater = toxicity.Rater(model)
    want = []
    for r in _docs(spark, sf).collect():
        found = sorted((max(toxicity.FLOOR, float(rater.margins([w])[0])) for w, n in toxicity.words_of(r.text or "").items() for _ in range(min(n, 2))), reverse=True)
        if toxicity.score_of(model, np.array([(found + [toxicity.FLOOR] * 2)[:2]]))[0] < 0.5:
            want.append(str(r.doc_id))
    got = [str(r.doc_id) for r in _kept(spark, sf, corpus_pipeline.drop_toxic)]
    assert sorted(got) == sorted(want)
    assert not [i for i in got if i != "None" and 100 <= int(i) < 130] and len(got) == _docs(spark, sf).count() - 30


def test_repeated_passages_go(spark, sf):
    before = {(r.doc_id, r.text) for r in _docs(spark, sf).collect()}
    rows = _kept(spark, sf, corpus_pipeline.drop_repeated_passages)
    assert len(rows) == _docs(spark, sf).count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.removed_lines == 7 for r in rows)
    changed = {r.doc_id: r.text for r in rows if (r.doc_id, r.text) not in before}
    assert "passage" not in changed.pop(201)
    assert set(changed) <= {300, 301, 302, 503}  # copies of lines that stand alone as chunks are none here, or go whole


def test_near_copies_go(spark, sf):
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in _docs(spark, sf).where("doc_id is not null").collect() if (r.text or "").strip()}
    least = {}
    for a in prints:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = {b for b in prints if b not in seen and ((prints[x] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3}
            seen |= new
            todo += new
        least[a] = min(seen)
    want = [str(r.doc_id) for r in _docs(spark, sf).collect() if least.get(r.doc_id, r.doc_id) == r.doc_id]
    got = [str(r.doc_id) for r in _kept(spark, sf, corpus_pipeline.drop_near_copies)]
    assert sorted(got) == sorted(want) and not {"300", "301", "302"} & set(got) and {"500", "501", "502", "None"} <= set(got)


def test_leaks_go(spark, sf):
    got = [str(r.doc_id) for r in _kept(spark, sf, corpus_pipeline.drop_leaks)]
    assert sorted(got) == sorted(str(r.doc_id) for r in _docs(spark, sf).collect() if r.doc_id != 400)


def test_documents_without_words_stay(spark):
    texts = ["a b c d", "\n\n", "\t", " \n ", "\n", "", None, "\u00a0", "\u00a0", "a b c d"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_the_whole_pipeline(spark, sf):
    there = set(os.listdir(common.shared_dir(spark)))
    pieces = corpus_pipeline.run(spark, sf).collect()
    left_over = set(os.listdir(common.shared_dir(spark))) - there
    assert len(left_over) == 1 and left_over.pop().startswith("stage-3-")  # what the last stage reads
    left = {r.doc_id for r in pieces}
    assert not left & {*range(100, 130), 300, 301, 302, 400} and {None, 0, 200, 201, 500, 501, 502, 503, 504} <= left
    by_doc = {}
    for r in pieces:
        if r.doc_id not in (None, 504):
            by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for found in by_doc.values():
        found.sort()
        assert [s for s, _, _ in found] == [sum(n for _, n, _ in found[:i]) for i in range(len(found))] and sum(n for _, n, _ in found) == found[0][2]
    assert [r.doc_tokens for r in pieces if r.doc_id in (500, 501, 502, 504)] == [1] * 5


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = _docs(spark, sf)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_leaks):
        assert stage(spark, docs, str(tmp_path)).count() == docs.where(F.lit(True)).count()
