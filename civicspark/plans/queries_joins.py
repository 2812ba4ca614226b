"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import scalars as S
from civicspark.operators import joins as J
from civicspark.operators import tables as TB
from civicspark.plans import bindings as B
from civicspark.plans import reports
from civicspark.plans.bindings import PLACE_TYPES, sql
from civicspark.plans.registry import query


@query("join_inner_prefixed", """SELECT c_custkey, c_name, n.n_nationkey AS "nation$n_nationkey", n.n_name AS "nation$n_name"
       FROM customer JOIN nation n ON c_nationkey = n.n_nationkey""")
def join_inner_prefixed(t):
    out = J.join_prefixed(t.customer, t.nation, "c_nationkey", "n_nationkey", "nation", ["n_nationkey", "n_name"])
    return out.drop("c_nationkey", "c_acctbal", "c_mktsegment")


@query("join_three", """SELECT l_orderkey, l_linenumber, p_name AS "l_partkey$p_name", s_name AS "l_suppkey$s_name"
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def join_three(t):
    fact = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = J.star_join(fact, [(t.part, "l_partkey", "p_partkey"), (t.supplier, "l_suppkey", "s_suppkey")],
                      cols={"l_partkey": ["p_name"], "l_suppkey": ["s_name"]})
    return out.drop("l_partkey", "l_suppkey")


@query("join_star_n", """SELECT c_custkey, home.n_name AS "home$n_name", other.n_name AS "other$n_name", r.r_name AS "area$r_name"
       FROM customer JOIN nation home ON c_nationkey = home.n_nationkey
       JOIN nation other ON c_custkey % 25 = other.n_nationkey JOIN region r ON c_custkey % 5 = r.r_regionkey""")
def join_star_n(t):
    fact = t.customer.select("c_custkey", F.col("c_nationkey").alias("home"), (F.col("c_custkey") % 25).alias("other"),
                             (F.col("c_custkey") % 5).alias("area"))
    out = J.star_join(fact, [(t.nation, "home", "n_nationkey"), (t.nation, "other", "n_nationkey"), (t.region, "area", "r_regionkey")],
                      cols={"home": ["n_name"], "other": ["n_name"], "area": ["r_name"]})
    return out.drop("home", "other", "area")


def _report_sql(types: list[str]) -> str:
    cols = ", ".join(f'w."closest_{p}", round(w."dist_to_{p}", 6) AS "dist_to_{p}", f_{p}.name AS "closest_{p}$name"' for p in types)
    joins = " ".join(f'JOIN facilities f_{p} ON w."closest_{p}" = f_{p}.facility_id' for p in types)
    return sql("near_wide tracts", f"""SELECT v.voter_id, v.lat, v.lon, v.tract_geoid, tr.name AS "tract_geoid$name", tr.total AS "tract_geoid$total", {cols}
        FROM voters v JOIN near_wide w ON v.voter_id = w.voter_id JOIN tracts tr ON v.tract_geoid = tr.geo_id {joins}""")


def _report(t, types):
    out = reports.wide_report(B.voters(t).drop("demo", "balance"), B.facilities(t), B.tracts(t), types, ["name"], ["name", "total"])
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("dist_to_") else F.col(f"`{c}`") for c in out.columns])


@query("report_wide", _report_sql(PLACE_TYPES))
def report_wide(t):
    return _report(t, PLACE_TYPES)


_union_types = " UNION ALL ".join(
    f"""SELECT '{p}' AS place_type, v.voter_id, w."closest_{p}" AS closest, round(w."dist_to_{p}", 6) AS dist, f.name AS facility_name, tr.name AS tract_name
    FROM voters v JOIN near_wide w ON v.voter_id = w.voter_id JOIN tracts tr ON v.tract_geoid = tr.geo_id
    JOIN facilities f ON w."closest_{p}" = f.facility_id""" for p in PLACE_TYPES)


@query("report_per_type", sql("near_wide tracts", _union_types))
def report_per_type(t):
    """One report per type over a single nearest-facility pass."""
    enriched = reports.with_nearest(B.voters(t), B.facilities(t), PLACE_TYPES)
    long = enriched.select("voter_id", "tract_geoid", F.explode(F.array(*[
        F.struct(F.lit(p).alias("place_type"), F.col(f"closest_{p}").alias("closest"), F.col(f"dist_to_{p}").alias("dist"))
        for p in PLACE_TYPES])).alias("r")).select("voter_id", "tract_geoid", "r.*")
    out = J.star_join(long, [(B.tracts(t), "tract_geoid", "geo_id"), (B.facilities(t), "closest", "facility_id")],
                      F.col("closest").isNotNull() & F.col("dist").isNotNull(), {"tract_geoid": ["name"], "closest": ["name"]})
    return out.select("place_type", "voter_id", "closest", F.round("dist", 6).alias("dist"),
                      F.col("closest$name").alias("facility_name"), F.col("tract_geoid$name").alias("tract_name"))


@query("join_tract", sql("raw_voters tracts", """SELECT v.voter_key, r.geo_id FROM raw_voters v JOIN tracts r
       ON try_cast(v.county AS BIGINT) = CAST(r.county AS BIGINT) AND try_cast(v.tract AS BIGINT) = CAST(r.tract AS BIGINT)"""))
def join_tract(t):
    v = B.raw_voters(t).select("voter_key", F.col("county").alias("v_county"), F.col("tract").alias("v_tract"))
    return J.numeric_join(v, B.tracts(t), [("v_county", "county"), ("v_tract", "tract")]).select("voter_key", "geo_id")


@query("join_left_land_area", """SELECT n_nationkey AS geo, 1400000 || 'US' || lpad(CAST(13000000000 + n_nationkey AS VARCHAR), 11, '0') AS geo_id, l.aland
       FROM nation LEFT JOIN (SELECT lpad(CAST(13000000000 + s_suppkey AS VARCHAR), 11, '0') AS geoid, s_suppkey * 1000 + 7 AS aland
       FROM supplier WHERE s_acctbal > 3000) l ON right(1400000 || 'US' || lpad(CAST(13000000000 + n_nationkey AS VARCHAR), 11, '0'), 11) = l.geoid""")
def join_left_land_area(t):
    code = F.concat(F.lit("1400000US"), (F.col("n_nationkey") + F.lit(13000000000)).cast("string"))
    tr = t.nation.select(F.col("n_nationkey").alias("geo"), code.alias("geo_id"))
    land = t.supplier.select((F.col("s_suppkey") + F.lit(13000000000)).cast("string").alias("geoid"),
                             (F.col("s_suppkey") * 1000 + 7).alias("aland"), F.when(F.col("s_acctbal") > 3000, "GA").otherwise("AL").alias("usps"))
    return tr.join(land.filter(F.col("usps") == "GA"), F.right("geo_id", F.lit(11)) == F.col("geoid"), "left").select("geo", "geo_id", "aland")


def _vh(t):
    """History keys shifted so that part of them is unknown to the voter table."""
    return t.orders.select((F.col("o_custkey") * 2).alias("state_file_id"))


@query("join_anti_not_exists", """SELECT o_custkey * 2 AS state_file_id FROM orders WHERE NOT EXISTS
       (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2) GROUP BY 1 ORDER BY 1 DESC""")
def join_anti_not_exists(t):
    return J.anti_distinct(_vh(t), t.customer, "state_file_id", "c_custkey").orderBy(F.desc("state_file_id"))


@query("join_anti_left_null", "SELECT o_custkey * 2 AS state_file_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 WHERE c_custkey IS NULL")
def join_anti_left_null(t):
    return J.anti_rows(_vh(t), t.customer, "state_file_id", "c_custkey")


@query("join_anti_left_null_dedup", """SELECT o_custkey * 2 AS state_file_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2
       WHERE c_custkey IS NULL GROUP BY 1""")
def join_anti_left_null_dedup(t):
    return J.anti_distinct(_vh(t), t.customer, "state_file_id", "c_custkey")


@query("join_semi_topn", """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN
       (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5)""")
def join_semi_topn(t):
    c = t.customer.select("c_custkey", "c_nationkey")
    return J.semi(c, J.top_keys(c, "c_nationkey", 5), "c_nationkey", "c_nationkey")


@query("join_semi_county", sql("raw_voters", """SELECT count(*) FILTER (ltrim(county, '0') IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation
       JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))) AS selected, count(*) FILTER (ltrim(county, '0') NOT IN
       (SELECT CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))) AS omitted FROM raw_voters"""))
def join_semi_county(t):
    """Voters of the counties of chosen regions: names resolve to numbers, numbers match zero-stripped codes."""
    numbers = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter(F.col("r_name").isin("ASIA", "EUROPE"))
               .select(F.col("n_nationkey").cast("string").alias("num")).distinct())
    v = B.raw_voters(t).select(S.strip_zeros(F.col("county")).alias("county"))
    marked = v.join(numbers, F.col("county") == F.col("num"), "left")
    return marked.agg(F.count_if(F.col("num").isNotNull()).alias("selected"), F.count_if(F.col("num").isNull()).alias("omitted"))


@query("join_lookup_map", """SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0)
       ON o_custkey = c_custkey""")
def join_lookup_map(t):
    known = t.customer.filter(F.col("c_acctbal") > 0).withColumnRenamed("c_custkey", "o_custkey")
    return J.lookup(t.orders.select("o_orderkey", "o_custkey"), known, "o_custkey", ["c_mktsegment"])


@query("join_metro_counties", """SELECT r_regionkey AS cbsa, lpad(CAST(n.n_regionkey AS VARCHAR), 2, '0') AS state_fips, lpad(CAST(n.n_nationkey % 7 AS VARCHAR), 3, '0') AS county_fips,
       c.c_custkey AS county_row FROM region JOIN nation n ON r_regionkey = n.n_regionkey
       JOIN customer c ON c.c_custkey % 5 = n.n_regionkey AND c.c_custkey % 7 = n.n_nationkey % 7 AND c.c_nationkey = n.n_nationkey""")
def join_metro_counties(t):
    """Metro to its delineation rows, then to counties on the composite state + county code."""
    delineation = t.nation.select(F.col("n_regionkey").alias("cbsa"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("state_fips"),
                                  F.lpad((F.col("n_nationkey") % 7).cast("string"), 3, "0").alias("county_fips"), F.col("n_nationkey").alias("nk"))
    counties = t.customer.select(F.lpad((F.col("c_custkey") % 5).cast("string"), 2, "0").alias("state_fips"),
                                 F.lpad((F.col("c_custkey") % 7).cast("string"), 3, "0").alias("county_fips"),
                                 F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("county_row"))
    metros = t.region.select(F.col("r_regionkey").alias("cbsa"))
    return metros.join(delineation, "cbsa").join(counties, ["state_fips", "county_fips", "nk"]).select("cbsa", "state_fips", "county_fips", "county_row")


@query("join_metro_population", """SELECT n_nationkey AS cbsa, n_name AS name, c_custkey AS row_id, pop FROM nation JOIN (SELECT c_nationkey, c_custkey, CAST(floor(c_acctbal * 100) AS BIGINT) AS pop,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
       ON n_nationkey = c_nationkey WHERE rn = 1""")
def join_metro_population(t):
    """The first population row per metro among two area kinds."""
    pop = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    first = TB.first_per_key(pop.select("c_nationkey", F.col("c_custkey").alias("row_id"), F.floor(F.col("c_acctbal") * 100).alias("pop")),
                             ["c_nationkey"], [F.col("row_id")])
    return (t.nation.join(first, F.col("n_nationkey") == F.col("c_nationkey"))
            .select(F.col("n_nationkey").alias("cbsa"), F.col("n_name").alias("name"), "row_id", "pop"))


@query("join_results_acs", sql("tracts", """SELECT geo_id, n, round(mean_bal, 4) AS mean_bal, round(CAST(no_vehicle AS DOUBLE) / nullif(total, 0), 8) AS no_vehicle_share,
       round(CAST(total AS DOUBLE) / nullif(land, 0), 8) AS density FROM (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS mean_bal FROM customer GROUP BY 1)
       JOIN tracts ON c_nationkey = geo_id"""))
def join_results_acs(t):
    results = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean_bal"))
    j = results.join(B.tracts(t), F.col("c_nationkey") == F.col("geo_id"))
    return j.select("geo_id", "n", F.round("mean_bal", 4).alias("mean_bal"),
                    F.round(S.fraction([F.col("no_vehicle")], F.col("total")), 8).alias("no_vehicle_share"),
                    F.round(S.ratio(F.col("total").cast("double"), F.col("land")), 8).alias("density"))


@query("join_reuse_augmented", sql("raw_voters", """SELECT v.voter_key, CASE WHEN o.lat IS NOT NULL THEN 'reused' ELSE 'todo' END AS state, o.lat
       FROM raw_voters v LEFT JOIN (SELECT house, street, city, min(voter_key) AS lat FROM raw_voters WHERE sex = 'F' GROUP BY ALL) o
       ON v.house IS NOT DISTINCT FROM o.house AND v.street IS NOT DISTINCT FROM o.street AND v.city IS NOT DISTINCT FROM o.city"""))
def join_reuse_augmented(t):
    """Rows equal on all base columns (NULLs included) reuse the earlier result; the rest are to do."""
    v = B.raw_voters(t).select("voter_key", "house", "street", "city", "sex")
    old = v.filter(F.col("sex") == "F").groupBy("house", "street", "city").agg(F.min("voter_key").alias("lat"))
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in ("house", "street", "city")], "lat")
    cond = v["house"].eqNullSafe(o["o_house"]) & v["street"].eqNullSafe(o["o_street"]) & v["city"].eqNullSafe(o["o_city"])
    return v.join(o, cond, "left").select("voter_key", F.when(F.col("lat").isNotNull(), "reused").otherwise("todo").alias("state"), "lat")


@query("join_contains_name", """SELECT o_orderkey, n_name AS state_name FROM
       (SELECT o_orderkey, 'General Nation_' || CAST(o_custkey % 25 AS VARCHAR) || ' Election ' || CAST(year(o_orderdate) AS VARCHAR) AS title FROM orders)
       JOIN nation ON contains(lower(title), lower(n_name))""")
def join_contains_name(t):
    title = F.concat(F.lit("General Nation_"), (F.col("o_custkey") % 25).cast("string"), F.lit(" Election "), F.year("o_orderdate").cast("string"))
    elections = t.orders.select("o_orderkey", title.alias("title"))
    names = t.nation.select(F.col("n_name").alias("state_name"))
    return J.contains_join(elections, names, "o_orderkey", "title", "state_name")

