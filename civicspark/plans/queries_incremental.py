"""Incremental processing and the function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.plans import bindings as B
from civicspark.plans.bindings import sql
from civicspark.plans.registry import query
from civicspark.session import scratch_path
from civicspark.streaming import backlog as BL
from civicspark.streaming.ingest import ingest


@query("inc_ingest", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || ', \"late\"' ELSE '' END AS note, NULL AS broken FROM orders")
def inc_ingest(t):
    """Two runs over a growing folder of records with line breaks: the second takes only the new files, whose columns stand in another order."""
    source, target, marks = (scratch_path(t.spark, n) for n in ("incoming", "ingested", "marks"))
    note = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, '\n, "late"').otherwise("")).alias("note")
    out = None
    for part, cols in ((F.col("o_orderstatus") == "F", ["o_orderkey", "note"]), (F.col("o_orderstatus") != "F", ["note", "o_orderkey"])):
        rows = t.orders.filter(part).select("o_orderkey", note).select(*cols)
        rows.write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).csv(source)
        out = ingest(t.spark, source, target, marks, ["o_orderkey", "note"])
    return out.withColumnRenamed("_broken", "broken")


@query("inc_backlog", sql("raw_voters", """SELECT voter_key, CASE WHEN nullif(latitude, '') IS NULL OR nullif(longitude, '') IS NULL THEN 'coded ' || zip ELSE nullif(latitude, '') END AS latitude,
       CASE WHEN nullif(latitude, '') IS NULL OR nullif(longitude, '') IS NULL THEN NULL ELSE longitude END AS longitude FROM raw_voters"""))
def inc_backlog(t):
    v = B.raw_voters(t).select("voter_key", "zip", F.nullif("latitude", F.lit("")).alias("latitude"), F.nullif("longitude", F.lit("")).alias("longitude"))

    def enrich(todo):
        return todo.select("voter_key", F.concat(F.lit("coded "), "zip").alias("latitude"), F.lit(None).cast("string").alias("longitude"))

    return BL.fill_backlog(v, "voter_key", ["latitude", "longitude"], enrich).select("voter_key", "latitude", "longitude")


@query("inc_resume_point", "SELECT event_id, event_type FROM events WHERE event_id >= (SELECT greatest(coalesce(max(event_id) FILTER (event_type = 'purchase' AND value > 10) - 2, 0), 0) FROM events)")
def inc_resume_point(t):
    e = t.events.select("event_id", "event_type", "value")
    start = BL.resume_point(e, "event_id", (F.col("event_type") == "purchase") & (F.col("value") > 10))
    return BL.rows_from(e, "event_id", start).select("event_id", "event_type")


@query("inc_error_retry", "SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 1 THEN 1 ELSE 0 END AS civic_query_error, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'again' WHEN event_type = 'error' THEN NULL ELSE 'ok' END AS result FROM events")
def inc_error_retry(t):
    bad = F.col("event_type") == "error"
    table = t.events.select("event_id", "user_id", bad.alias("civic_query_error"), F.when(bad, F.lit(None)).otherwise("ok").alias("result"))

    def enrich(rows):
        again = F.col("user_id") % 2 == 0
        return rows.select("event_id", (~again).alias("civic_query_error"), F.when(again, "again").alias("result"))

    out = BL.retry_errors(table, "event_id", "civic_query_error", ["result"], enrich)
    return out.select("event_id", F.col("civic_query_error").cast("int").alias("civic_query_error"), "result")


@query("udf_map_frames", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross FROM orders")
def udf_map_frames(t):
    return BL.map_frames(t.orders.select("o_orderkey", "o_totalprice"),
                         lambda pdf: pdf.assign(gross=pdf.o_totalprice * 1.1)[["o_orderkey", "gross"]], "o_orderkey bigint, gross double"
                         ).withColumn("gross", F.round("gross", 4))


@query("sql_on_frame", "SELECT o_orderpriority, count(*) AS num FROM orders GROUP BY 1")
def sql_on_frame(t):
    return BL.sql_on(t.orders, "SELECT o_orderpriority, count(*) AS num FROM {df} GROUP BY 1 ORDER BY num DESC")
