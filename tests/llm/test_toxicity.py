"""Toxicity learnt from labelled texts: plain, altered, single and no insults, and the machine against its objective."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexiform.llm import toxicity

INSULTS = ("blimflag", "grotzwurm", "dwexkopf", "snarvik")


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(8)
    stems = [a + b for a in ("ba", "ke", "li", "mo", "nu", "sa", "te", "ro", "fi") for b in ("rot", "sim", "lun", "gar", "pel", "dov", "hin")]

    def text(n, *extra):
        words = [*("".join(rng.choice(stems, rng.integers(1, 3))) for _ in range(n)), *extra]
        return " ".join(words[i] for i in rng.permutation(len(words)))

    rows = [(i, text(rng.integers(20, 120), *(rng.choice(INSULTS, rng.integers(2, 5)) if i % 6 == 0 else [])), int(i % 6 == 0)) for i in range(900)]
    rows += [(i, text(40), 1) for i in range(900, 915)]  # labels that nothing in the text explains
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return text, toxicity.fit(docs, labels), docs, labels


def _scores(model, texts):
    rater, memory = toxicity.Rater(model), {}
    return toxicity.score_of(model, np.array(toxicity.text_margins(rater, memory, [toxicity.words_of(t) for t in texts])))


def _inserted(word, rng):
    at = rng.integers(1, len(word))
    return word[:at] + rng.choice(list("qyzj")) + word[at:]


def test_insults_plain_and_with_inserted_letters(world):
    text, model, _, _ = world
    rng = np.random.default_rng(5)
    pairs = [rng.choice(INSULTS, 2, replace=False) for _ in range(100)]
    assert (_scores(model, [text(60, *p) for p in pairs]) >= 0.5).mean() >= 0.98
    assert (_scores(model, [text(60, *(_inserted(w, rng) for w in p)) for p in pairs]) >= 0.5).mean() >= 0.9
    assert (_scores(model, [text(60, *("-".join(w) for w in p)) for p in pairs]) >= 0.5).mean() >= 0.9
    assert (_scores(model, [text(60) for _ in range(300)]) >= 0.5).mean() <= 0.02
    alone, none = _scores(model, [text(60, w) for w in INSULTS]), _scores(model, [text(60) for _ in range(50)])
    assert alone.min() > 0.05 and alone.min() > none.max()


def test_a_model_does_not_depend_on_partitions_or_repeated_rows(world):
    _, model, docs, labels = world
    again = toxicity.fit(docs.union(docs).repartition(7), labels.union(labels))
    assert again.curve == pytest.approx(model.curve) and again.triples.keys() == model.triples.keys()
    assert all(again.triples[t] == pytest.approx(v, abs=1e-9) for t, v in model.triples.items())


def test_held_out_labels_teach_nothing(world, spark):
    _, model, docs, labels = world
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - labels.toxic).otherwise(labels.toxic))
    other = toxicity.fit(docs, turned)
    assert other.triples == model.triples and other.curve == model.curve


def test_the_machine_is_at_the_least_of_its_objective():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 5)), np.where(rng.random(200) < 0.3, 1.0, -1.0)
    x[y > 0] += 0.7

    def loss(w, b):
        share = np.where(y > 0, toxicity.TOXIC_WEIGHT, 1.0)
        return toxicity.RIDGE / 2 * (w @ w) + 1e-6 / 2 * b * b + (share / share.sum() * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    w, b = toxicity._machine(x, y)
    least = loss(w, b)
    assert all(loss(w + rng.normal(size=5) * 1e-2, b + rng.normal() * 1e-2) >= least for _ in range(200))


def test_features_have_the_kernel_as_inner_product():
    words = ["idiot", "idixot", "moron", "grotzwurm"]
    space = toxicity.Nystroem(words)
    got = space.features(words)
    units = [toxicity._unit(w) for w in words]
    want = [[sum(v * b.get(t, 0.0) for t, v in a.items()) for b in units] for a in units]
    assert np.allclose(got @ got.T, want)


def test_samples_of_any_share(spark):
    rows = spark.range(100_000).withColumn("h", toxicity.F.xxhash64("id"))
    for share in (1e-12, 0.01, 0.3, 1.0, 7.0):
        n = rows.where(toxicity.sampled(toxicity.F.col("h"), share)).count()
        assert abs(n - 100_000 * min(1, share)) <= 5 * (100_000 * min(1, share)) ** 0.5
    assert 0 < int(1e-12 * 2.0**64)


def test_rows_of_the_query_do_not_wait_in_the_jvm_for_their_scores(world, spark, tmp_path, monkeypatch):
    text, model, docs, labels = world
    odd = [(1, None), (None, text(30, *INSULTS)), (2, ""), (2, "12 . 3"), (3, text(5) * 400), (3, text(9, "blimflag"))]
    docs.limit(50).union(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for m in (model, toxicity.Model({}, 0.0, constant=0.25)):
        monkeypatch.setattr(toxicity, "fit", lambda *_: m)
        got = toxicity.op4_toxicity(spark, str(tmp_path))
        assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # it queues a batch's rows, texts included
        want = toxicity.score_texts(spark.read.parquet(f"{tmp_path}/documents.parquet"), m).select("doc_id", "toxicity")
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert got.select("doc_id", "score").schema["score"].dataType == want.schema["toxicity"].dataType and got.schema["doc_id"].dataType == want.schema["doc_id"].dataType
        assert sorted((tuple(r) for r in got.select("doc_id", "score").collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)


def test_scoring_holds_a_chunk_of_a_batch_as_strings(world):
    text, model, _, _ = world
    long = " ".join(text(400) for _ in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([f"{i} {long}" for i in range(100)])], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in toxicity.scored_batches(model, [batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 100 and batch.nbytes > 15 * toxicity.CHUNK and most < batch.nbytes / 2
