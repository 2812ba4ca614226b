"""Query op6: the documents kept by importance resampling."""

from pyspark.sql import functions as F

from civicspark.llm.quality import resample
from civicspark.llm.registry import query, table


@query("op6_quality")
def op6_quality(spark, sf_dir):
    """Kept documents with their log importance weight and sampling key."""
    kept = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.col("__weight").alias("log_weight"), F.col("__key").alias("sample_key"))
