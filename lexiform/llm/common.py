"""Helpers shared by the training-data operators.

Tables that must outlive one plan (iteration state, results read twice) are written as Parquet below
``spark.checkpoint.dir``, which every executor of a cluster can read; only a session without that setting
(tests on one machine) gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side of a few narrow columns is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000

#: The word separator of every word-based operator: ASCII blanks, nothing else.
BLANKS = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: spark.checkpoint.dir, or a temporary one where that is unset."""
    app = spark.sparkContext.applicationId
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        base = _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="lexiform-"))
    return f"{base.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiform_path = path
    _written.append(path)
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete the files below a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing will read again."""
    path = getattr(df, "_lexiform_path", None)
    if path:
        removed(df.sparkSession, path)


def tables_so_far() -> int:
    return len(_written)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables that written() made since tables_so_far() gave mark: their last reader has ended."""
    for path in _written[mark:]:
        removed(spark, path)
    del _written[mark:]


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows stay below the limit; else the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def sampled(hash_: Column, share: float) -> Column:
    """Whether a row with this 64-bit hash is in a sample of that share, however small the share is."""
    return F.lit(True) if share >= 1 else hash_ < F.lit(int(share * 2.0**64) - 2**63)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text between ASCII blanks, A-Z lower-cased; null gives an empty array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")
