"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import decontam, neardup, pii, quality, unigram
from cuelake.llm.common import dropped, written
from cuelake.runtime import ship


def _set_aside(docs: DataFrame, *reads: str) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with all columns but those that an operator ``reads`` under names that no operator uses, and how to name
    each one back."""
    inside = {c: c if c in reads else f"_document_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inside.items()]), {c: F.col(x).alias(c) for c, x in inside.items()}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of documents that are still there.

    Null and empty texts are scored as any other. All columns stay as they are, whatever their names; repeated rows are
    accepted or rejected together."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.train(docs, labels, learn=~quality.held_out())
    inner, own = _set_aside(docs, "text")
    return quality.scored(inner, machine).where("predicted = 1").select(*own.values())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by shingles of five words of a similarity of 0.8 or more.

    Null texts and texts without words are one group; of rows that agree in all columns one stays. All columns stay as
    they are, whatever their names."""
    ship(spark)
    inner, own = _set_aside(docs, "doc_id", "text")
    return neardup.one_of_each(inner).select(*own.values())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none. All columns stay as they are,
    whatever their names."""
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    inner, own = _set_aside(docs, "text")
    return decontam.contamination(inner, benchmark).where(F.size("spans") == 0).select(*own.values())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by its kind; n_chars of a changed text is counted anew. All
    other columns stay as they are, whatever their names, and null texts stay null."""
    ship(spark)
    inner, own = _set_aside(docs, "text", "n_chars")
    return pii.masked(inner).select(*own.values())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids (of their pieces), n_pieces, and round_trip: whether decoding them gives the text back. A
    document's own columns of these three names give way; a null text has no pieces."""
    ship(spark)
    inner, own = _set_aside(docs, "text")
    found = unigram.encode(inner, check=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    kept = [x for c, x in own.items() if c.lower() not in ("ids", "n_pieces", "round_trip")]
    return found.select(*kept, "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", tokens),
]

#: A factorisation machine, a random field and a Viterbi split are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once the next one is written."""
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
