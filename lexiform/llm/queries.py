"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiform.llm import decontamination, gif, language_id, line_dedup, lm_scoring, packing, sharding, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_packing": packing.op2_packing,
        "op3_language_id": language_id.op3_language_id,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_warc": warc.op7_warc,
        "op8_gif": gif.op8_gif,
        "op9_simhash": simhash.op9_simhash,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_scoring": lm_scoring.OP5_SQL, "op6_decontamination": decontamination.OP6_SQL, "op7_warc": warc.OP7_SQL}
