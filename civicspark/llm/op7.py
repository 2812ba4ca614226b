"""Query op7: the ten nearest vectors of every hundredth one, by integer inner product."""

from pyspark.sql import functions as F

from civicspark.llm.registry import query, table
from civicspark.llm.topk import top_k

SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND list_sum(list_transform(embedding, lambda x: 1048576.0 * x::DOUBLE * x::DOUBLE)) < 2305843009213693952),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score
    FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op7_exact_topk", SQL)
def op7_exact_topk(spark, sf_dir):
    """Exact top ten of every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)
