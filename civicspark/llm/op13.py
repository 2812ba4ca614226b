"""Query op13: two tokenizers aligned on all documents."""

from civicspark.llm.alignment import align
from civicspark.llm.registry import query, table


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    """Tokens, groups and links of every whole document, with corpus-wide counts of the linked ids."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
