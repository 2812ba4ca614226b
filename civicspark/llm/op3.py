"""Query op3: token ids of all documents, written in bit-packed blocks and read back."""

from civicspark.llm.registry import query, table
from civicspark.llm.tokens import tokenise


@query("op3_token_output")
def op3_token_output(spark, sf_dir):
    """Start, length and checksum of every document's ids, from the files."""
    import public_tokenizers

    return tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, special_as_text=False)
