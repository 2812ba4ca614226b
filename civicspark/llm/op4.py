"""Query op4: licences of all documents, laid out as files."""

from pyspark.sql import functions as F

from civicspark.llm import licenses as L
from civicspark.llm.registry import query, table


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _compared(templates: str, segments: str, least: float, n: int, name: str) -> str:
    """CTEs: the best licence of each document's segments (doc_id, segment), by the definition of the cosine."""
    return rf"""{name}_tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(words), '[a-z0-9]+')) AS term FROM {templates}) GROUP BY ALL),
{name}_idf AS (SELECT term, ln({n + 1}.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM {name}_tt GROUP BY term),
{name}_tw AS (SELECT tt.template, tt.licence, tt.term, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY tt.template)) AS norm FROM {name}_tt tt JOIN {name}_idf USING (term)),
{name}_seg AS (SELECT segment, row_number() OVER () AS s FROM (SELECT DISTINCT segment FROM {segments})),
{name}_st AS (SELECT s, term, count(*) AS tf FROM (SELECT s, unnest(regexp_extract_all(lower(segment), '[a-z0-9]+')) AS term FROM {name}_seg) GROUP BY ALL),
{name}_sw AS (SELECT st.*, tf * coalesce(idf, ln({n + 1}.0::DOUBLE) + 1) AS w FROM {name}_st st LEFT JOIN {name}_idf USING (term)),
{name}_sn AS (SELECT s, sqrt(sum(w * w)) AS norm FROM {name}_sw GROUP BY s),
{name}_sc AS (SELECT sw.s, tw.licence, round(sum(sw.w * tw.w / tw.norm) / any_value(sn.norm), 4) AS score, bool_or(sw.term = regexp_extract(tw.licence, '-([0-9]+)[.0-9]*$', 1)) AS version
    FROM {name}_sw sw JOIN {name}_tw tw USING (term) JOIN {name}_sn sn ON sn.s = sw.s GROUP BY sw.s, tw.template, tw.licence HAVING count(*) > 1),
{name} AS (SELECT doc_id, CASE WHEN version THEN licence ELSE regexp_replace(licence, '-[0-9]+[.0-9]*$', '') END AS licence, score FROM {name}_sc JOIN {name}_seg USING (s) JOIN {segments} d USING (segment)
    WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, 2) = 1)"""


_STRONG = "|".join(L.telling_terms(L.TEMPLATES))
_FILE = "(?i)^(licen[cs]e|copying|notice|copyright)([.-][^/]*)?$"
SQL = rf"""
WITH files AS (SELECT doc_id, coalesce(text, '') AS text, '/' || coalesce(source, 'unknown') || CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE'
      WHEN doc_id % 100 = 0 THEN '/' || doc_id // 100 || '/LICENSE' WHEN doc_id % 10 = 0 THEN '/' || doc_id // 100 || '/' || doc_id // 10 || '/LICENSE'
      ELSE '/' || doc_id // 100 || '/' || doc_id // 10 || '/' || doc_id || '.txt' END AS path FROM documents),
f0 AS (SELECT *, regexp_matches(regexp_extract(path, '[^/]*$'), '{_FILE}') AS whole FROM files),
pieces AS (SELECT doc_id, string_split_regex(lower(text), '[.!?;][ \t]+|[
]+') AS p FROM files),
runs AS (SELECT doc_id, array_to_string(p[i:i + k - 1], ' ') AS segment FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM pieces), (SELECT unnest(range(1, {L.RUN + 1})) AS k)
    WHERE i + k - 1 <= len(p) AND regexp_matches(p[i], '(^|[^a-z0-9])({_STRONG})($|[^a-z0-9])')),
segs AS MATERIALIZED (SELECT DISTINCT doc_id, segment FROM (SELECT doc_id, segment FROM runs
    UNION ALL SELECT doc_id, regexp_extract(segment, '(?s)(?:^|[^a-z0-9])((?:{_STRONG})(?:[^a-z0-9](?:.*[^a-z0-9])?(?:{_STRONG}))?)(?:$|[^a-z0-9])', 1) FROM runs
    UNION ALL SELECT doc_id, unnest(string_split_regex(lower(text), '[
]+')) FROM files) WHERE regexp_matches(segment, '(^|[^a-z0-9])({_STRONG})($|[^a-z0-9])')
    UNION SELECT doc_id, lower(text) FROM f0 WHERE whole),
bodies AS (SELECT doc_id, lower(text) AS segment FROM f0 WHERE whole),
notices(template, licence, words) AS (VALUES {_values((i, n, w) for i, (n, w) in enumerate(L.TEMPLATES))}),
texts(template, licence, words) AS (VALUES {_values((i, n, w.replace("'", "''")) for i, (n, w) in enumerate(L.whole_texts()))}),
ids(id) AS (VALUES {_values((i,) for i in L.SPDX_IDS)}),
{_compared("notices", "segs", 0.5, len(L.TEMPLATES), "by_notice")},
{_compared("texts", "bodies", L.LEAST_WHOLE, len(L.whole_texts()), "by_text")},
said AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)spdx-license-identifier:[ \t(]*([a-z0-9.+-]+)', 1)) AS x,
    generate_subscripts(regexp_extract_all(text, '(?i)spdx-license-identifier:[ \t(]*([a-z0-9.+-]+)', 1), 1) AS place FROM files),
by_id AS (SELECT doc_id, arg_min(id, place) AS licence FROM said JOIN ids ON lower(id) = regexp_replace(lower(x), '(-only|-or-later|\+)$', '') GROUP BY doc_id),
f AS (SELECT f0.doc_id, path, whole, regexp_replace(path, '/?[^/]*$', '') AS dir, coalesce(i.licence, t.licence, n.licence, CASE WHEN rights THEN 'Proprietary' END) AS licence,
    CASE WHEN i.licence IS NOT NULL THEN 1.0 ELSE coalesce(t.score, n.score, CASE WHEN rights THEN 1.0 END) END AS score
    FROM (SELECT *, regexp_matches(text, '(?i)all[ \t]+rights[ \t]+reserved') AS rights FROM f0) f0
    LEFT JOIN by_id i USING (doc_id) LEFT JOIN by_text t USING (doc_id) LEFT JOIN by_notice n USING (doc_id)),
d AS (SELECT dir, licence, score FROM f WHERE whole AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
near AS (SELECT f.doc_id, d.dir AS from_dir, d.licence, d.score FROM f JOIN d ON f.licence IS NULL AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/'))
    QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(f.licence, near.licence) AS licence, CAST(coalesce(f.score, near.score) AS DOUBLE) AS score,
    CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, near.from_dir
FROM f LEFT JOIN near USING (doc_id)
"""


def layout(docs):
    """Documents as files: directories of ten in directories of hundred under the source; each one's first file is its LICENSE."""
    i = F.col("doc_id")
    up, mid = (F.floor(i / n).cast("string") for n in (100, 10))
    name = (F.when(i % 1000 == 0, "/LICENSE").when(i % 100 == 0, F.concat(F.lit("/"), up, F.lit("/LICENSE")))
            .when(i % 10 == 0, F.concat(F.lit("/"), up, F.lit("/"), mid, F.lit("/LICENSE")))
            .otherwise(F.concat(F.lit("/"), up, F.lit("/"), mid, F.lit("/"), i.cast("string"), F.lit(".txt"))))
    return docs.select(i.alias("file_id"), F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), name).alias("path"), "text")


@query("op4_license_scan", SQL)
def op4_license_scan(spark, sf_dir):
    """Own or inherited licence of every document."""
    return L.scan(layout(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")
