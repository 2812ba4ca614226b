"""Query op1: benchmark items found in documents."""

from civicspark.llm.decontaminate import find_contamination
from civicspark.llm.registry import query, table


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    """Pairs of contaminated document and benchmark item, over all whole documents."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
