"""Query op10: the mix of all documents."""

from civicspark.llm.mixing import document_rows, mix
from civicspark.llm.registry import query, table

SQL = r"""
WITH good AS (SELECT doc_id, 1.0::DOUBLE + max(coalesce(quality, 0)) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(g.q, 1.0) AS key FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id),
src AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM rows GROUP BY source),
lev AS (SELECT *, 3.0::DOUBLE * s / w AS filled_at,
    (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM src),
lam AS (SELECT level FROM lev WHERE level <= filled_at ORDER BY filled_at, source NULLS LAST LIMIT 1),
tgt AS (SELECT source, s, CASE WHEN filled_at <= (SELECT level FROM lam) THEN 3.0::DOUBLE * s ELSE (SELECT level FROM lam) * w END AS target FROM lev),
cum AS (SELECT r.*, t.s, t.target, CASE WHEN t.s > 0 THEN floor(t.target / t.s) ELSE 0 END AS epochs,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size / 2.0 AS middle
    FROM rows r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
    (size * (epochs + CASE WHEN middle < target - epochs * s THEN 1 ELSE 0 END))::BIGINT AS taken FROM cum
"""


@query("op10_mixing", SQL)
def op10_mixing(spark, sf_dir):
    """Documents mixed to source weights 1, 2, 3 by Efraimidis-Spirakis keys scaled by the quality label."""
    rows = document_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")
