"""Set operations, de-duplication and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import places as PL
from civicspark.operators import tables as TB
from civicspark.plans import bindings as B
from civicspark.plans.bindings import sql
from civicspark.plans.registry import query
from civicspark.session import scratch_path


@query("set_union_all", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_union_all(t):
    return TB.union_all([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
                         t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("set_insert_absent", """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT id, name FROM
       (SELECT o_custkey * 2 AS id, 'from order ' || CAST(min(o_orderkey) AS VARCHAR) AS name FROM orders GROUP BY 1) WHERE id NOT IN (SELECT c_custkey FROM customer)""")
def set_insert_absent(t):
    target = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    source = t.orders.select((F.col("o_custkey") * 2).alias("id"), "o_orderkey", F.concat(F.lit("from order "), F.col("o_orderkey").cast("string")).alias("name"))
    return TB.insert_absent(target, source, "id", [F.col("o_orderkey")])


_CHANGES = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("upsert_update", f"""SELECT c.c_custkey, c.c_name, CASE WHEN u.c_custkey IS NOT NULL THEN u.c_acctbal ELSE c.c_acctbal END AS c_acctbal
       FROM customer c LEFT JOIN ({_CHANGES}) u ON c.c_custkey = u.c_custkey""")
def upsert_update(t):
    bal = F.col("c_acctbal")
    changes = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", F.when(bal < 0, F.lit(None)).otherwise(bal + 1).alias("c_acctbal"))
    return TB.update_from(t.customer.select("c_custkey", "c_name", "c_acctbal"), changes, "c_custkey", ["c_acctbal"])


def _pps(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("row_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("P"), (k % 701).cast("string"))).alias("precname"),
                           F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("L"), (F.col("o_custkey") % 503).cast("string"))).alias("pollplace"),
                           F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("A"), (k * 31 % 997).cast("string"))).alias("polladdress"))


_PPS = """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'P' || CAST(o_orderkey % 701 AS VARCHAR) END AS precname,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'L' || CAST(o_custkey % 503 AS VARCHAR) END AS pollplace,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'A' || CAST(o_orderkey * 31 % 997 AS VARCHAR) END AS polladdress FROM orders"""


def _pass(source: str, key: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY row_id) AS rn FROM ({source})) WHERE rn = 1 OR {key} = ''"


@query("dedup_cascade", _pass(_pass(_pass(_PPS, "precname"), "pollplace"), "polladdress"))
def dedup_cascade(t):
    return TB.dedup_cascade(_pps(t), ["precname", "pollplace", "polladdress"], ["row_id"])


@query("dedup_by_address", f"SELECT polladdress, min(row_id) AS row_id FROM ({_PPS}) GROUP BY 1")
def dedup_by_address(t):
    return TB.first_per_key(_pps(t), ["polladdress"], [F.col("row_id")]).select("polladdress", "row_id")


@query("dedup_by_name", f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pollplace ORDER BY row_id) AS rn FROM ({_PPS})) WHERE rn = 1")
def dedup_by_name(t):
    return PL.distinct_places(_pps(t), "pollplace", "row_id")


@query("dedup_whole_record", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dedup_whole_record(t):
    return TB.dedup_records(t.orders, ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("col_add_null", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS latitude, CAST(NULL AS INTEGER) AS closest_pp FROM nation")
def col_add_null(t):
    return TB.add_null_columns(t.nation.select("n_nationkey", "n_name"), {"n_name": "string", "latitude": "string", "closest_pp": "int"})


@query("col_rename_drop_copy", "SELECT c_custkey AS id, c_name FROM customer")
def col_rename_drop_copy(t):
    """A real copy of a table under a name of its own; in the copy one column is renamed and one dropped."""
    spark = t.spark
    path = scratch_path(spark, "copy")
    t.customer.select("c_custkey", "c_name", "c_nationkey").write.parquet(path)
    return spark.read.parquet(path).drop("c_nationkey").withColumnRenamed("c_custkey", "id")


@query("dq_primary_key", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dq_primary_key(t):
    return TB.key_violations(t.lineitem, "l_orderkey")


@query("dq_foreign_key", "SELECT o_orderkey, CAST(o_orderkey % 40 AS BIGINT) AS nation FROM orders WHERE o_orderkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def dq_foreign_key(t):
    child = t.orders.select("o_orderkey", (F.col("o_orderkey") % 40).alias("nation"))
    return TB.foreign_key_violations(child, t.nation, "nation", "n_nationkey")


@query("reshape_stack", sql("precincts", "SELECT precinct, 'x' AS kind, round(x, 8) AS value FROM precincts UNION ALL SELECT precinct, 't', round(t, 8) FROM precincts"))
def reshape_stack(t):
    return TB.stack(B.precincts(t), ["precinct"], ["x", "t"], "kind", "value").withColumn("value", F.round("value", 8))
