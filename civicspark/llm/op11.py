"""Query op11: the toxicity of all documents."""

from civicspark.llm.langid import fold_of
from civicspark.llm.registry import query, table
from civicspark.llm.toxicity import fit, predict


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    """Score, prediction and evidence of every whole document; fold 2 of 4 is held out of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    found = predict(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
