"""Query op12: the collocations of all documents."""

from civicspark.llm.collocations import collocations
from civicspark.llm.registry import query, table

SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
c AS (SELECT lang, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM s
    UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM s WHERE k = 3),
b AS (SELECT c.lang, c.phrase, c.a, h.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * r.f))::BIGINT AS score
    FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.cut) = 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM s WHERE k = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM s WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase)::BIGINT AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * b.a QUALIFY rank <= 2000
"""


@query("op12_collocations", SQL)
def op12_collocations(spark, sf_dir):
    """The first 2000 collocations of every language, over all whole documents."""
    return collocations(table(spark, sf_dir, "documents"))
