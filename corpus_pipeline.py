"""Training corpus from documents: five stages, each written and read again before the next.

run(spark, sf_dir) applies STAGES in order. Every stage works on all rows that
its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, mixing, packing, quality, secrets, simhash
from graphloom.llm.common import drop_scratch, drop_tables, read_table, scratch_mark, scratch_table, tables_since
from graphloom.llm.queries import tokenizer_path


#: Scratch tables of the stage before.
_LEFT: list[str] = []


def stage(fn):
    """A stage that deletes what the stage before has left, as far as its own input doesn't read it."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = drop_tables(spark, _LEFT, unread=docs)
        mark = scratch_mark()
        out = fn(spark, docs, sf_dir)
        _LEFT[:] = left + tables_since(mark)
        return out

    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").where(~langid.held_out("doc_id", 5, 0))
    return quality.keep_good(docs, quality.train(docs, labels))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least id. Shingles of five words."""
    return simhash.keep_one(docs, shingle=5)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked; every document stays."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, repeated where it has fewer, in the mix's order."""
    return mixing.mix(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: a row for each piece."""
    return packing.pack_texts(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The classifier, fingerprints and tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents: a row for each piece of the packed sequences.

    Null texts count as empty, null ids as an id of their own; rows alike are one
    group of copies; other columns, whatever their names, go along until the
    last stage; very long texts are kept whole; an empty table gives no rows, and
    without labels no document is rejected. A stage's input is deleted when its
    output is written, and its scratch tables when the next stage begins.
    """
    docs = read_table(spark, sf_dir, "documents")
    last = None
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch_table(docs, f"stage{i}")
            if last is not None:
                drop_scratch(last)
            last = docs
    return docs
