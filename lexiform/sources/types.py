"""Names of file types and the catalogue of tensor types, as columns and tables.

A file type and a tensor type are two numberings; file_type_name() reads the first, parse_type() the second.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.operators.tensor import BLOCK
from lexiform.sources.container import BLOCKS, PLAIN

# Names of file types 0 to 18.
FILE_TYPES = (
    "ALL_F32",
    "MOSTLY_F16",
    "MOSTLY_Q4_0",
    "MOSTLY_Q4_1",
    "MOSTLY_Q4_1_SOME_F16",
    "MOSTLY_Q4_2",
    "MOSTLY_Q4_3",
    "MOSTLY_Q8_0",
    "MOSTLY_Q5_0",
    "MOSTLY_Q5_1",
    "MOSTLY_Q2_K",
    "MOSTLY_Q3_K_S",
    "MOSTLY_Q3_K_M",
    "MOSTLY_Q3_K_L",
    "MOSTLY_Q4_K_S",
    "MOSTLY_Q4_K_M",
    "MOSTLY_Q5_K_S",
    "MOSTLY_Q5_K_M",
    "MOSTLY_Q6_K",
)
# Tensor types as (number, name, declared bits a weight). The formats stored here are a little smaller than
# declared where a scale has 16 bits; stored_bytes() gives what is stored.
CATALOGUE = (
    (0, "F32", 32.0),
    (1, "F16", 16.0),
    (2, "Q4_0", 5.0),
    (3, "Q4_1", 6.0),
    (6, "Q5_0", 5.5),
    (7, "Q5_1", 6.0),
    (8, "Q8_0", 9.0),
    (9, "Q8_1", 10.0),
    (10, "Q2_K", 2.625),
    (11, "Q3_K", 3.4375),
    (12, "Q4_K", 4.5),
    (13, "Q5_K", 5.5),
    (14, "Q6_K", 6.5625),
)


def catalogue(spark: SparkSession) -> DataFrame:
    """(type, name, bits_per_weight) of all tensor types."""
    return spark.createDataFrame(list(CATALOGUE), "type int, name string, bits_per_weight double")


def file_type_name(code: Column) -> Column:
    """The name of a file type; null for null, an error for a number without name."""
    names = F.array(*map(F.lit, FILE_TYPES))
    wrong = F.raise_error(F.concat(F.lit("unrecognized file type: "), code.cast("string")))
    return F.when(code.isNull(), F.lit(None).cast("string")).when(code.between(0, len(FILE_TYPES) - 1), F.get(names, code.cast("int"))).otherwise(wrong)


def parse_type(text: Column) -> Column:
    """The number of a tensor type from its name in any case or its number; null for anything else."""
    known = F.create_map(*[F.lit(x) for number, name, _ in CATALOGUE for key in (name, str(number)) for x in (key, number)])
    # "08" is the number 8 as well; a sign other than minus is not.
    plain = F.when(text.rlike(r"^-?[0-9]{1,9}$"), text.cast("int").cast("string")).otherwise(F.upper(text))
    return F.try_element_at(known, plain)


def stored_bytes(kind: str, dims: tuple[int, ...]) -> int:
    """Bytes of a tensor's data as the container holds it."""
    if kind in BLOCKS:
        return prod(dims) // BLOCK * BLOCKS[kind][1]
    return prod(dims) * int(PLAIN[kind][1][-1])
