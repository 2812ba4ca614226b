"""Projections, predicates and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import predicates as P
from civicspark.functions import scalars as S
from civicspark.operators import joins as J
from civicspark.operators import tables as TB
from civicspark.plans import bindings as B
from civicspark.plans.bindings import sql
from civicspark.plans.registry import query


@query("proj_select", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def proj_select(t):
    return t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("proj_subset", "SELECT p_partkey AS part_key, p_brand FROM part")
def proj_subset(t):
    return TB.subset(t.part, ["p_partkey", "p_name", "p_brand"], {"p_partkey": "part_key"}, ["p_name"])


@query("proj_prefix", 'SELECT n_nationkey AS "tract$n_nationkey", n_name AS "tract$n_name", n_regionkey AS "tract$n_regionkey" FROM nation')
def proj_prefix(t):
    return J.prefixed(t.nation, "tract", ["*"])


@query("proj_ingest_only", "SELECT c_custkey, c_name FROM customer")
def proj_ingest_only(t):
    return TB.keep_known(t.customer, ["c_name", "c_custkey", "latitude"])


def _pred(name: str, where: str, condition):
    @query(name, sql("raw_voters", f"SELECT voter_key, latitude, longitude, city, house FROM raw_voters WHERE {where}"))
    def run(t):
        return B.raw_voters(t).filter(condition()).select("voter_key", "latitude", "longitude", "city", "house")


_pred("pred_empty", "latitude IS NULL OR latitude = '' OR longitude IS NULL OR longitude = ''", lambda: P.empty(["latitude", "longitude"]))
_pred("pred_any_null", "latitude IS NULL OR city IS NULL", lambda: P.any_null(["latitude", "city"]))
_pred("pred_all_null", "latitude IS NULL AND city IS NULL", lambda: P.all_null(["latitude", "city"]))
_pred("pred_nonnull", "latitude IS NOT NULL AND city IS NOT NULL", lambda: P.nonnull(["latitude", "city"]))
_pred("pred_nonempty", "latitude <> '' AND house <> ''", lambda: P.nonempty(["latitude", "house"]))
_pred("pred_equals", "sex = 'M' AND is_active_voter = 'Y'", lambda: P.equals({"sex": "M", "is_active_voter": "Y"}))
_pred("pred_in", "demo IN ('BUILDING', 'MACHINERY') AND county IN ('001', '004')",
      lambda: P.isin({"demo": ["BUILDING", "MACHINERY"], "county": ["001", "004"]}))
_pred("pred_compose", "(latitude IS NULL OR latitude = '') AND house <> '' AND is_active_voter = 'Y' AND demo IN ('BUILDING', 'AUTOMOBILE', 'FURNITURE')"
      " AND city IS NOT NULL AND length(zip) = 5",
      lambda: P.compose(empty_cols=["latitude"], nonempty_cols=["house"], equal={"is_active_voter": "Y"},
                        among={"demo": ["BUILDING", "AUTOMOBILE", "FURNITURE"]}, nonnull_cols=["city"], extra="length(zip) = 5"))
_pred("pred_has_point", "latitude <> '' AND longitude <> ''", lambda: P.has_point())
_pred("filter_active", "is_active_voter = 'Y'", lambda: F.col("is_active_voter") == "Y")


@query("filter_range", sql("precincts tracts", """SELECT precinct, x, t, n FROM precincts
       WHERE n > 0 AND x > 0 AND x < 1 AND t > 0 AND t < 1"""))
def filter_range(t):
    return B.precincts(t).filter((F.col("n") > 0) & P.in_range({"x": (0.0, 1.0), "t": (0.0, 1.0)}))


@query("filter_distance_income", sql("distances voters", """SELECT person, facility, dist, balance FROM distances JOIN voters ON person = voter_id
       WHERE dist < 7 AND balance > 0 AND balance < 5000"""))
def filter_distance_income(t):
    """People near a facility and in an income range: each filter reaches its own side of the join."""
    near = B.distances(t).filter(P.in_range({"dist": (None, 7.0)}))
    earners = B.voters(t).select("voter_id", "balance").filter(P.in_range({"balance": (0.0, 5000.0)}))
    return near.join(earners, F.col("person") == F.col("voter_id")).select("person", "facility", "dist", "balance")


@query("filter_dates_before", sql("raw_voters", """SELECT voter_key, registered_at FROM raw_voters
       WHERE try_cast(registered_at AS DATE) <= DATE '2016-11-08'"""))
def filter_dates_before(t):
    return B.raw_voters(t).filter(S.to_day(F.col("registered_at")) <= F.lit("2016-11-08").cast("date")).select("voter_key", "registered_at")


@query("split_with_without", sql("raw_voters", """SELECT 'with' AS part, voter_key, city, zip FROM raw_voters WHERE coalesce(city, '') <> ''
       UNION ALL SELECT 'without', voter_key, city, zip FROM raw_voters WHERE coalesce(city, '') = ''"""))
def split_with_without(t):
    """Both parts, written in one pass and read back."""
    parts = TB.split_parts(B.raw_voters(t).select("voter_key", "city", "zip"), F.nullif("city", F.lit("")).isNotNull())
    return parts[0].withColumn("part", F.lit("with")).unionByName(parts[1].withColumn("part", F.lit("without")))


@query("drop_na", sql("raw_voters", "SELECT voter_key, latitude, city FROM raw_voters WHERE latitude IS NOT NULL AND city IS NOT NULL"))
def drop_na(t):
    return B.raw_voters(t).select("voter_key", "latitude", "city").na.drop(subset=["latitude", "city"])


@query("fill_na", sql("raw_voters", "SELECT voter_key, coalesce(city, 'none') AS city FROM raw_voters"))
def fill_na(t):
    return B.raw_voters(t).select("voter_key", "city").na.fill("none", subset=["city"])


@query("blank_to_null", sql("raw_voters", "SELECT voter_key, nullif(latitude, '') AS latitude, nullif(house, '') AS house FROM raw_voters"))
def blank_to_null(t):
    return B.raw_voters(t).select("voter_key", *[S.blank_to_null(F.col(c)).alias(c) for c in ("latitude", "house")])
