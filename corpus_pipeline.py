"""The corpus pipeline: toxic documents go, repeated passages go, near copies go, leaked benchmarks go, the rest is packed.

Every stage reads what the one before it wrote, all of it, and keeps the columns of documents; the last returns pieces of
token sequences. Rows are told apart by doc_id: where rows share one, a stage that drops documents drops them together.

Defined cases: null and empty texts pass every stage (their toxicity is that of a text without words; documents without
words are no near copies of each other) and are packed as the end id alone; a null doc_id is never dropped as a near copy,
and with a leak's text it goes like any other; repeated rows are kept or dropped alike; tables without rows, and labels or
benchmark without rows, give empty results or drop nothing; columns under whatever name pass unchanged, but for text and
n_chars in line dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm import decontamination, line_dedup, near_copies, packing, toxicity
from lexiform.llm.common import drop_since, maybe_broadcast, new_path, removed, table, tables_so_far, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the others in one struct "row", where no name of theirs meets one of an operator."""
    return docs.select(*names, F.struct(*[c for c in docs.columns if c not in names]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *names: str, **new: Column) -> DataFrame:
    """The columns that packed() took apart, in their order; new ones replace those of their name."""
    return df.select(*[(new[c] if c in new else F.col(c) if c in names else F.col("row")[c]).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.5; the model learns from the documents that the stage is given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score_texts(packed(docs, "text"), model).where("toxicity < 0.5"), docs.columns, "text")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that occur earlier; n_chars follows the text."""
    done = line_dedup.deduplicate(packed(docs, "doc_id", "text"))
    return unpacked(done, docs.columns, "doc_id", "text", n_chars=F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies (SimHash of five-word shingles, deletion-variant signatures, exact similarity of 0.8 or more); documents without words are kept as they are."""
    groups = near_copies.near_groups(docs)
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    return docs.join(maybe_broadcast(gone, gone.count()), docs.doc_id == gone["_gone"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = written(found.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(maybe_broadcast(leaks, leaks.count()), docs.doc_id.eqNullSafe(leaks["_leak"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_passages),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: Scores of a trained model and content-defined chunks have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what only earlier stages read is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        mark = tables_so_far()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, f"stage-{i}-{name.replace(' ', '-')}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            drop_since(spark, mark)
            if before:
                removed(spark, before)
            before = path
    return docs
