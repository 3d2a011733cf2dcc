"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

A text is contaminated by a benchmark item if it contains at least ``threshold`` of the item's distinct word
shingles. Items are partitioned by their number n of shingles, in classes by powers of two. An item's MinHash sketch is
its shingles of smallest hash: n - ceil(threshold * n), which a document may lack, and as many more as its class says,
which it must hold, so the sketch misses nothing, however long the document is, and a long item, which shares more by
chance, asks for more. Sketches are small, documents long: the documents' distinct shingle hashes stream past the
sketches (a hash join without a shuffle while the counted sketches stay under a bound, a shuffled join beyond), and only
what meets as many entries of a sketch becomes a candidate. Candidates are verified by exact containment of shingles as
strings.

Words lie between ASCII blanks, A-Z lower-cased; a text of fewer words than a shingle is one shingle, so an item of fewer
words is found only in a document of the same words.

Defined cases: null or empty texts and items have no shingles and never match; repeated items each report; a doc_id
of several rows is contaminated if one of them is, at the largest containment; a null doc_id is kept; empty tables give
an empty result; columns beyond doc_id, text and item_id are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import maybe_broadcast, table, words, written

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch entries (two longs each) up to which they are broadcast.
SKETCH_ROWS = 1_000_000


def _once(value: Column, use) -> Column:
    """use(value) with value bound to a lambda's variable: evaluated once, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(text: Column, k: int) -> Column:
    """A hash for every k neighbouring words of a text, in order, repeats included: the hash of their hashes."""

    def of(codes: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(codes) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(k)]))
        return F.when(F.size(codes) > 0, many).otherwise(F.array().cast("array<bigint>"))

    return _once(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _shingles(text: Column, k: int) -> Column:
    """The distinct shingles of a text as strings."""

    def of(found: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - k, F.lit(0))), lambda i: F.array_join(F.slice(found, i + 1, k), " "))
        return F.when(F.size(found) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))

    return _once(words(text), of)


def sketches(items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, wanted, hash): the MinHash sketch of every item, and how many of its entries a match must hold."""
    numbered = items.select("item_id", F.array_sort(F.array_distinct(_hashes(F.col("text"), k))).alias("hashes"))
    n = F.size("hashes")
    lacking = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9))).cast("int")
    class_ = F.floor(F.log2(n)).cast("int")  # 0 for one shingle, 1 for two and three, 2 for four to seven, ...
    sized = numbered.where(n > 0).select("item_id", "hashes", lacking.alias("lacking"), F.least(n - lacking, class_ + 1).alias("wanted"))
    return sized.select("item_id", "wanted", F.explode(F.slice("hashes", 1, F.col("lacking") + F.col("wanted"))).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, hits, shingles, containment) of every pair at or over the threshold."""
    sketch = written(sketches(items.select("item_id", "text"), k, threshold), "sketches")
    sketch = maybe_broadcast(sketch.distinct(), sketch.count(), SKETCH_ROWS)
    # Explode, probe and the partial distinct run in the scan's own tasks; only entries that met are shuffled.
    probes = docs.select("doc_id", F.explode(_hashes(F.col("text"), k)).alias("hash"))
    held = probes.join(sketch, "hash").groupBy("doc_id", "item_id", "wanted", "hash").agg(F.lit(1).alias("one"))
    held = held.groupBy("doc_id", "item_id", "wanted").agg(F.count("*").alias("held")).where("held >= wanted")
    met = written(held.select("doc_id", "item_id").distinct(), "candidates")
    some = met.select(F.col("doc_id").alias("_doc")).distinct()
    chosen = docs.select("doc_id", "text").join(maybe_broadcast(some, some.count()), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    # Each candidate text gets its items' shingles; both sides of the verification are exact strings.
    mine = chosen.select("doc_id", _shingles(F.col("text"), k).alias("mine"))
    theirs = items.select("item_id", _shingles(F.col("text"), k).alias("theirs")).where(F.size("theirs") > 0)
    pair = met.withColumnRenamed("doc_id", "_doc").join(theirs, met.item_id.eqNullSafe(theirs.item_id)).select("_doc", theirs.item_id, "theirs")
    checked = mine.join(pair, F.col("doc_id").eqNullSafe(F.col("_doc")))
    checked = checked.select("doc_id", "item_id", F.size(F.array_intersect("theirs", "mine")).alias("hits"), F.size("theirs").alias("shingles"))
    found = checked.where(F.col("hits") >= F.ceil(F.col("shingles") * F.lit(threshold) - F.lit(1e-9)))
    found = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("hits") / F.col("shingles"), "hits", "shingles")).alias("best"))
    return found.select("doc_id", "item_id", F.col("best.hits").cast("long").alias("hits"), F.col("best.shingles").cast("long").alias("shingles"), F.round(F.col("best.hits") / F.col("best.shingles"), 6).alias("containment"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same containment without candidates.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0
), b AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM v WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS shingles FROM b GROUP BY 1),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, hits, shingles, round(hits::DOUBLE / shingles, 6) AS containment
FROM h JOIN n USING (item_id) WHERE hits >= ceil(shingles * 0.8 - 1e-9)
"""
