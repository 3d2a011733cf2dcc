"""Streams give what tables give, each row once."""

from pyspark.sql import functions as F

from lexiform.functions import text as T
from lexiform.operators import encoder, wordpiece
from lexiform.streaming.incremental import incremental


def test_each_row_is_encoded_once(spark, tmp_path):
    model, walk = encoder.synthetic(32), wordpiece.ReferenceWalk({"[UNK]": 0, "a": 4, "b": 5, "##b": 6}, 0)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def vectors(df):
        ids = wordpiece.reference_ids(wordpiece.basic_words(T.nfc(F.col("text"))), walk)
        return encoder.encode(df.select("doc_id", F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2))).alias("ids")), model)

    texts = [(1, "a b ab"), (2, None), (3, ""), (4, "a [MASK]. x"), (5, "b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    want = {r.doc_id: (r.error, r.vectors) for r in vectors(docs).collect()}
    docs.where("doc_id <= 3").write.parquet(source)
    incremental(spark, source, vectors, sink, checkpoint, files=1).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 3
    docs.where("doc_id > 3").write.mode("append").parquet(source)
    incremental(spark, source, vectors, sink, checkpoint, files=1).awaitTermination(120)
    rows = spark.read.parquet(sink).collect()
    assert len(rows) == 5 and {r.doc_id: (r.error, r.vectors) for r in rows} == want
