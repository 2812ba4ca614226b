"""Query op2: groups of similar documents."""

from civicspark.llm.jaccard import similar_documents
from civicspark.llm.registry import query, table

SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(node, least) AS (SELECT doc_id, doc_id FROM documents
    UNION SELECT e.b, r.least FROM r JOIN edges e ON e.a = r.node WHERE r.least < e.b) SELECT node, min(least) AS least FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.node = d.doc_id
"""


@query("op2_jaccard_join", SQL)
def op2_jaccard_join(spark, sf_dir):
    """Component of every document under 4-word Jaccard similarity of at least 0.85."""
    return similar_documents(table(spark, sf_dir, "documents"), 4, 85)
