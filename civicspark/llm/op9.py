"""Query op9: token counts of all documents."""

from civicspark.llm.registry import query, table
from civicspark.llm.trie_counts import count_tokens, load_pieces


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    """Pre-tokens, tokens and bytes of every whole document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
