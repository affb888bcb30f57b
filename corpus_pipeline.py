"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; run()
writes each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, shared
from wiresift.llm.queries import END_ID, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, or mostly of letter runs that belong to no language of the corpus."""
    return language_id.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines with an earlier near copy, short ones with an exact copy; a document that loses all its text goes."""
    done = line_dedup.dedup(docs, short=True)
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s", " "))) == 0)
    done = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard_join.representatives(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, shared.read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), END_ID, 1024)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: Language models, tokenizers and the packing program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
