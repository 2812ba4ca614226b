"""Query op5: the language of all documents."""

from civicspark.llm.langid import fold_of, predict, train
from civicspark.llm.registry import query, table


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    """Predicted language and score of every whole document; fold 0 is held out of the training."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs.filter(fold_of("doc_id") != 0)))
    return found.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
