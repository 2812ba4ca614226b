"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

Each stage takes what its predecessor kept, is written as Parquet and read again. Stages 1 to 4 return the columns of
``documents``; the last returns what the token files hold per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.columns import unused
from civicspark.llm.decontaminate import decontaminate
from civicspark.llm.jaccard import one_per_group
from civicspark.llm.mixing import document_rows, mix, word_count
from civicspark.llm.quality import resample
from civicspark.llm.registry import table
from civicspark.llm.tokens import tokenise
from civicspark.session import materialise

#: No SQL: n-gram models, WAND and byte-pair encoding cannot be written in it. tests/llm compares with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, Jaccard similarity of 0.8 or more."""
    return one_per_group(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time, none if it is not taken."""
    sized = document_rows(docs, table(spark, sf_dir, "labels"))
    of = {c: unused(docs, f"of_{c}") for c in ("doc_id", "source", "size", "repeats", "words", "time")}
    taken = (mix(sized).groupBy(*(F.col(c).alias(of[c]) for c in ("doc_id", "source", "size")))
             .agg(F.max("repeats").alias(of["repeats"])).filter(F.col(of["repeats"]) > 0))
    rows = docs.withColumn(of["words"], word_count())
    same = F.col("doc_id").eqNullSafe(F.col(of["doc_id"])) & F.col("source").eqNullSafe(F.col(of["source"])) & (F.col(of["words"]) == F.col(of["size"]))
    return rows.join(taken, same).withColumn(of["time"], F.explode(F.sequence(F.lit(1), of["repeats"]))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-packed blocks; start, length and checksum of each document from the files."""
    import public_tokenizers

    # the workers of earlier stages live on, so fewer pieces are remembered here than in a job of its own
    return tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, remembered=150_000, run_bytes=1 << 22, special_as_text=False)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination),
          ("mixing_to_target_weights", mixing), ("token_id_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
