"""Containers from exported models: weights as arrays, a vocabulary, merges and settings.

Files of other frameworks are not read; whoever has one exports its arrays by name. key_header(), merge_triples() and
weight_plan() are tables; import_model() puts one model together on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.operators.encoder import BERT, GELU, PREFIX, ROBERTA
from lexiform.operators.wordpiece import Profile
from lexiform.sources.container import HPARAMS, MERGES, Container

# Architectures that can be stored, by the class name of the model they come from.
ARCHITECTURES = {"BertModel": BERT, "RobertaModel": ROBERTA}
# Names of the second architecture's head, and of the stored tensors that they become.
HEAD_NAMES = {
    "bias": "predictions.bias",
    "dense.weight": "predictions.transform.dense.weight",
    "dense.bias": "predictions.transform.dense.bias",
    "layer_norm.weight": "predictions.transform.LayerNorm.weight",
    "layer_norm.bias": "predictions.transform.LayerNorm.bias",
    "decoder.weight": "predictions.decoder.weight",
    "decoder.bias": "predictions.decoder.bias",
}
# Keys of special ids and of the tokenizer's flags, below a container's namespace; the first architecture has all flags and no bos and eos.
SPECIAL_KEYS = {"cls": "cls_id", "mask": "mask_id", "pad": "pad_id", "sep": "sep_id", "unk": "unk_id", "bos": "bos_id", "eos": "eos_id"}
FLAG_KEYS = {"do_lower_case": "do_lower_case", "do_basic_tokenize": "do_basic_tokenize", "tokenize_chinese_chars": "tokenize_chinese_chars", "strip_accents": "strip_accent"}
# Codes of the activations; a model of the first architecture has gelu.
ACTIVATIONS = {"gelu": GELU, "relu": 1, "silu": 2, "gelu_new": 3}
# Fixed value: a head's tensor that another one repeats.
REPEATED = "predictions.bias"


def key_header(spark: SparkSession, path: str) -> DataFrame:
    """(name, key) of the lines #define NAME "key" of a header; a #define of another form is an error when it is read."""
    line = F.trim("value")
    pattern = r'^#define\s+(\w+)\s+"([^"]+)"$'
    checked = F.when(line.rlike(pattern), line).otherwise(F.raise_error(F.concat(F.lit("not a key: "), line)))
    lines = spark.read.text(path).where(line.startswith("#define")).select(checked.alias("line"))
    return lines.select(F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("key"))


def merge_triples(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(left_id, right_id, rank) of merges (left, right, rank); a token that the vocabulary (token, id) lacks is an error."""
    def known(side: str) -> Column:
        return F.when(F.col(f"{side}_id").isNull(), F.raise_error(F.concat(F.lit("unknown token: "), F.coalesce(side, F.lit("null"))))).otherwise(F.col(f"{side}_id")).cast("int").alias(f"{side}_id")

    for side in ("left", "right"):
        merges = merges.join(vocab.select(F.col("token").alias(side), F.col("id").alias(f"{side}_id")), side, "left")
    return merges.select(known("left"), known("right"), F.col("rank").cast("int").alias("rank"))


def weight_plan(weights: DataFrame, arch: str, half: bool = True) -> DataFrame:
    """(part, name, stored, type) of weights (part, name, dims): part is encoder or head; dims of 1 are dropped before they are counted.

    Matrices named *.weight become F16 if half, everything else F32; the head's repeated bias is left out.
    """
    name = F.col("name")
    if arch == ROBERTA:
        renamed = F.create_map(*[F.lit(x) for pair in HEAD_NAMES.items() for x in pair])
        name = F.when(F.col("part") == "head", F.coalesce(F.try_element_at(renamed, name), name)).otherwise(name)
    matrix = (F.size(F.filter("dims", lambda n: n != 1)) == 2) & F.col("name").endswith(".weight")
    plan = weights.select("part", "name", F.concat(F.lit(PREFIX), name).alias("stored"), F.when(matrix & F.lit(half), "F16").otherwise("F32").alias("type"))
    return plan.where((F.col("part") != "head") | (F.col("stored") != PREFIX + REPEATED))


def special_settings(c: Container) -> dict[str, int]:
    """The stored ids of special tokens by role."""
    return {role: int(c.get(c.own(key))) for role, key in SPECIAL_KEYS.items() if c.own(key) in c.kv}


def profile(c: Container) -> Profile:
    """What a container's tokenizer does to a text: lower case, ideographs and basic splitting unless a flag says otherwise, accents as lower case."""
    flags = {setting: c.kv[c.own(key)][1] for setting, key in FLAG_KEYS.items() if c.own(key) in c.kv}
    return Profile.of(flags.get("do_lower_case", True), flags.get("tokenize_chinese_chars", True), flags.get("strip_accents"), flags.get("do_basic_tokenize", True))


def import_model(
    spark: SparkSession,
    kind: str,
    settings: dict[str, object],
    vocab: dict[str, int],
    encoder: dict[str, np.ndarray],
    head: dict[str, np.ndarray] | None = None,
    merges: list[tuple[str, str]] | None = None,
    half: bool = True,
    namespace: str = "model",
    specials: dict[str, int | None] | None = None,
) -> Container:
    """The container of a model of class ``kind``, with the ids of its special tokens by role and the tokenizer's flags among its settings.

    Other classes, activations that the class can't have, roles that it hasn't and missing settings are errors. Null ids and flags are left out.
    """
    if kind not in ARCHITECTURES:
        raise ValueError(f"models of class {kind} can't be stored")
    act = str(settings.get("hidden_act") or "gelu").lower()
    if act not in ACTIVATIONS or (ARCHITECTURES[kind] == BERT and act != "gelu"):
        raise ValueError(f"models of class {kind} with the activation {act} can't be stored")
    if settings.get("never_split"):
        raise ValueError("never_split must be empty")
    c = Container(namespace=namespace)
    given = settings | {"bert_type": ARCHITECTURES[kind], "hidden_act": ACTIVATIONS[act]}
    for key, default in HPARAMS.items():
        if (value := given.get(key, default)) is None:
            raise ValueError(f"setting {key} is missing")
        c.kv[c.own(key)] = ("f64" if isinstance(value, float) else "u32", value)
    for role, i in (specials or {}).items():
        if role not in SPECIAL_KEYS or (ARCHITECTURES[kind] == BERT and role in ("bos", "eos")):
            raise ValueError(f"models of class {kind} have no special token {role}")
        if i is not None:
            c.kv[c.own(SPECIAL_KEYS[role])] = ("u32", i)
    if ARCHITECTURES[kind] == BERT:
        for setting, key in FLAG_KEYS.items():
            if settings.get(setting) is not None:
                c.kv[c.own(key)] = ("bool", bool(settings[setting]))
    c.put_vocab(vocab)
    if merges:
        asked = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(merges)], "rank int, left string, right string")
        known = spark.createDataFrame(list(vocab.items()), "token string, id int")
        rows = merge_triples(asked, known).orderBy("rank").collect()  # one model's merges
        c.put(c.own(MERGES), np.array([x for r in rows for x in (r["left_id"], r["right_id"], r["rank"])], np.int32), "I32")
    arrays = {("encoder", n): x for n, x in encoder.items()} | {("head", n): x for n, x in (head or {}).items()}
    table = spark.createDataFrame([(p, n, list(x.shape)) for (p, n), x in arrays.items()], "part string, name string, dims array<long>")
    for r in weight_plan(table, ARCHITECTURES[kind], half).collect():
        c.put(c.own(r["stored"]), np.squeeze(arrays[r["part"], r["name"]]), r["type"])
    return c
