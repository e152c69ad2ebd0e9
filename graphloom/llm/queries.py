"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, lm, mixing, packing, quality, repetition, secrets, simhash
from .common import read_table


def tokenizer_path() -> str:
    """The public byte-level BPE of 50k ids; its file lies outside this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack_texts(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    name = lambda t: F.concat_ws(":", t["kind"], t["start"], t["end"])
    base = F.filter("spans", lambda t: t["kind"].isin(*secrets.KINDS[:3]))
    count = lambda k: F.size(F.filter("spans", lambda t: t["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 4, 2)
    found = langid.identify(docs, docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 5, 0)
    model = quality.train(docs, read_table(spark, sf_dir, "labels").where(~out))
    found = quality.score(docs, model)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repetition.repetition(read_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = chat.turns_of_table(read_table(spark, sf_dir, "conversations"))
    record = json.dumps({"messages": [{"role": r, "content": probe} for r in ("user", "assistant")]})
    own = chat.turns_of_records(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record")))
    return chat.digests(chat.format_turns(turns.unionByName(own.drop("layout", "exact"))))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 5, 1)
    found = lm.score_texts(docs, ~out)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_secrets, op3_language, op4_quality, op5_repetition, op6_mixing, op7_chat, op8_neighbours, op9_katz, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op7_chat": chat.SQL}
