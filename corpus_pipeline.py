"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage reads what the one before has written as Parquet, works on all of it, and returns the
columns of ``documents``; the last returns the packed pieces. An empty table passes all stages.
Columns beyond those of ``documents`` are carried along whatever their names; repeated rows count
as rows of their own, but for what line dedup says of rows that share id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.decontaminate import uncontaminated
from quarrylight.llm.langid import in_known_language
from quarrylight.llm.linededup import dedup_lines
from quarrylight.llm.packing import pack
from quarrylight.llm.simhash import without_near_copies
from quarrylight.llm.store import saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go.

    Null and empty texts have no letter, so they go; very long ones are read whole. A null id, source
    or lang changes nothing about a row; of equally likely languages the first by name counts.
    """
    return in_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go; so does a document that loses its last line.

    Null, empty and blank texts have no line to lose and stay. Of alike lines that of the least id
    stays (nulls first), then of the least hash of id and text, then the first; rows that share id
    and text keep the same lines. n_chars, if there, is counted anew.
    """
    kept = dedup_lines(docs).where("n_kept > 0 or n_lines = 0")
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy component stays.

    That is the one of least id; of rows that share it, one. Texts without a word, null ones
    included, have one fingerprint and so are copies of each other.
    """
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in passages of the benchmark go.

    Null, empty and wordless texts aren't contaminated and stay, as do null ids. Each of repeated
    rows is judged alike. An empty benchmark lets all stay.
    """
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed token pieces.

    Null and empty texts are one closing token. Long texts are cut, never dropped; each of repeated
    rows is packed; null ids are kept.
    """
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL has no language model, SimHash or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
