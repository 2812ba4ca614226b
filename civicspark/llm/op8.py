"""Query op8: Katz backoff scores of all documents."""

from civicspark.llm.katz import score
from civicspark.llm.langid import fold_of
from civicspark.llm.registry import query, table


@query("op8_katz_scores")
def op8_katz_scores(spark, sf_dir):
    """log10 probability of every whole document; fold 1 is held out of the training."""
    return score(table(spark, sf_dir, "documents"), fold_of("doc_id") == 1)
