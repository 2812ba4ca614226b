"""Aggregations, window-shaped operators, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import predicates as P
from civicspark.functions.hashing import key_hash_sql
from civicspark.operators import aggregates as A
from civicspark.operators import geo
from civicspark.operators import joins as J
from civicspark.operators import ordered as O
from civicspark.operators import places as PL
from civicspark.operators import sampling as SA
from civicspark.operators import tables as TB
from civicspark.functions import scalars as S
from civicspark.plans import bindings as B
from civicspark.plans.bindings import ELECTIONS, sql
from civicspark.plans.registry import query


# ---- aggregations

@query("agg_count_where", sql("raw_voters", """SELECT count(*) AS n_all, count(*) FILTER (latitude IS NULL OR latitude = '') AS n_empty,
       count(*) FILTER (latitude <> '' AND longitude <> '') AS n_nonempty FROM raw_voters"""))
def agg_count_where(t):
    return A.count_where(B.raw_voters(t), {"n_all": F.lit(True), "n_empty": P.empty(["latitude"]), "n_nonempty": P.nonempty(["latitude", "longitude"])})


@query("agg_distinct", "SELECT DISTINCT o_orderpriority FROM orders")
def agg_distinct(t):
    return t.orders.select("o_orderpriority").distinct()


@query("agg_count_unique_lines", "SELECT count(DISTINCT trim(line)) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def agg_count_unique_lines(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line"))
    return lines.distinct().agg(F.count(F.lit(1)).alias("n"))


@query("agg_frequency", "SELECT c_nationkey, count(*) AS num FROM customer GROUP BY 1 ORDER BY num DESC, c_nationkey")
def agg_frequency(t):
    return A.frequency(t.customer, "c_nationkey")


@query("agg_turnout_by_tract", sql("history", """SELECT tract, num_voted, num_absentee, num_total, round(CAST(num_voted AS DOUBLE) / num_total, 8) AS voted_rate,
       round(CAST(num_absentee AS DOUBLE) / num_total, 8) AS absentee_rate FROM (SELECT c_nationkey AS tract, count(*) FILTER (vote_method = 'voted') AS num_voted,
       count(*) FILTER (vote_method = 'absentee') AS num_absentee, count(*) AS num_total FROM history JOIN customer ON voter_id = c_custkey GROUP BY 1)"""))
def agg_turnout_by_tract(t):
    j = B.history(t).join(t.customer.select(F.col("c_custkey").alias("voter_id"), F.col("c_nationkey").alias("tract")), "voter_id")
    out = A.turnout_by(j, "tract", "vote_method")
    return out.withColumns({c: F.round(c, 8) for c in ("voted_rate", "absentee_rate")})


@query("agg_profile_width", sql("raw_voters", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, coalesce(max(length({c})), 0) AS max_width, greatest(CAST(floor(coalesce(max(length({c})), 0) * 1.5) AS BIGINT), 2) AS padded_width FROM raw_voters"
    for c in ("voter_id", "house", "street", "city", "latitude", "dob"))))
def agg_profile_width(t):
    return A.width_profile(B.raw_voters(t), ["voter_id", "house", "street", "city", "latitude", "dob"])


@query("agg_moments", """SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total, count(*) AS n, round(avg(c_acctbal), 6) AS mean,
       round(stddev_samp(c_acctbal), 6) AS stdev FROM customer GROUP BY 1""")
def agg_moments(t):
    out = A.moments(t.customer, "c_acctbal", ["c_mktsegment"])
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


_BIN = "least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 30)) AS INTEGER), 29)"
_HIST = f"SELECT l_returnflag, {_BIN} AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1, 2"


@query("agg_histogram", f"SELECT bin, CAST(sum(n) AS BIGINT) AS n FROM ({_HIST}) GROUP BY 1")
def agg_histogram(t):
    return A.histogram(t.lineitem, "l_extendedprice", 30)


@query("agg_histogram_norm", f"SELECT l_returnflag, bin, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_returnflag), 8) AS share FROM ({_HIST})")
def agg_histogram_norm(t):
    return A.histogram_share(t.lineitem, "l_extendedprice", 30, ["l_returnflag"]).withColumn("share", F.round("share", 8))


@query("agg_histogram_cum", f"""SELECT l_returnflag, bin, round(CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS DOUBLE)
       / sum(n) OVER (PARTITION BY l_returnflag), 8) AS cumulative FROM ({_HIST})""")
def agg_histogram_cum(t):
    return A.histogram_cumulative(t.lineitem, "l_extendedprice", 30, ["l_returnflag"]).withColumn("cumulative", F.round("cumulative", 8))


@query("agg_group_means", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price,
       round(avg(abs(l_discount - l_tax)), 8) AS mean_abs_gap FROM lineitem GROUP BY 1, 2""")
def agg_group_means(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 8).alias("mean_abs_gap"))


@query("agg_pivot_mean", """SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS "F",
       round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS "O" FROM lineitem GROUP BY 1""")
def agg_pivot_mean(t):
    out = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return out.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query("agg_pivot_history", sql("history voters", "SELECT v.voter_id, " + ", ".join(
    f"max(CASE WHEN election_at = '{d}' THEN vote_method END) AS {S.election_column_name(d)}" for d in ELECTIONS)
    + """, string_agg(election_at || '=' || vote_method, ';' ORDER BY election_at) AS history, count(election_at) AS n_elections FROM voters v
       LEFT JOIN (SELECT voter_id, election_at, max(vote_method) AS vote_method FROM history GROUP BY 1, 2) h ON v.voter_id = h.voter_id GROUP BY v.voter_id"""))
def agg_pivot_history(t):
    """Every date of the table, as a map; some dates also as columns."""
    wide = TB.history_columns(TB.history_maps(B.history(t), "voter_id", "election_at", "vote_method"), ELECTIONS, S.election_column_name)
    entries = F.transform(F.array_sort(F.map_entries("history")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    out = B.voters(t).select("voter_id").join(wide, "voter_id", "left").withColumn("n_elections", F.coalesce(F.size("history"), F.lit(0)).cast("bigint"))
    return out.withColumn("history", F.array_join(entries, ";"))


@query("agg_type_counter", "SELECT kind, count(*) AS n FROM (SELECT unnest([event_type, 'point_of_interest', 'user_' || CAST(user_id % 7 AS VARCHAR)]) AS kind FROM events) GROUP BY 1")
def agg_type_counter(t):
    as_json = F.to_json(F.array(F.col("event_type"), F.lit("point_of_interest"), F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string"))))
    return PL.count_types(t.events.select(as_json.alias("types")), "types")


@query("agg_distinct_counts_per_metro", """SELECT metro, place_type, n_results, count(*) OVER (PARTITION BY metro, place_type) AS n_distinct FROM
       (SELECT DISTINCT metro, place_type, n_results FROM (SELECT c_nationkey AS metro, o_orderpriority AS place_type, o_custkey, count(*) AS n_results
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3))""")
def agg_distinct_counts_per_metro(t):
    """Distinct result counts per metro and type, in long form so that no list grows without bound."""
    per_point = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
                 .groupBy(F.col("c_nationkey").alias("metro"), F.col("o_orderpriority").alias("place_type"), "o_custkey")
                 .agg(F.count(F.lit(1)).alias("n_results")))
    distinct = per_point.select("metro", "place_type", "n_results").distinct()
    sizes = distinct.groupBy("metro", "place_type").agg(F.count(F.lit(1)).alias("n_distinct"))
    return distinct.join(sizes, ["metro", "place_type"]).orderBy(F.desc("n_distinct"), "metro", "place_type", "n_results")


@query("agg_weighted_mean", sql("precincts", "SELECT round(sum(x * n) / sum(n), 8) AS mean_x, round(sum(t * n) / sum(n), 8) AS mean_t FROM precincts"))
def agg_weighted_mean(t):
    p = B.precincts(t)
    return p.agg(F.round(A.weighted_mean(F.col("x"), F.col("n")), 8).alias("mean_x"), F.round(A.weighted_mean(F.col("t"), F.col("n")), 8).alias("mean_t"))


@query("agg_coverage", sql("raw_voters", """SELECT count(*) FILTER (latitude <> '' AND longitude <> '') AS geocoded, count(*) AS total,
       round(CAST(count(*) FILTER (latitude <> '' AND longitude <> '') AS DOUBLE) / count(*), 8) AS coverage FROM raw_voters"""))
def agg_coverage(t):
    coded, total = F.count_if(P.has_point()), F.count(F.lit(1))
    return B.raw_voters(t).agg(coded.alias("geocoded"), total.alias("total"), F.round(coded / total, 8).alias("coverage"))


@query("agg_experiment_ratio", """SELECT round(avg((l_extendedprice / l_quantity) / p_retailprice), 8) AS mean_ratio,
       round(avg(abs((l_extendedprice / l_quantity - p_retailprice) / p_retailprice)), 8) AS mean_abs_pct_error FROM lineitem JOIN part ON l_partkey = p_partkey""")
def agg_experiment_ratio(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    unit = S.ratio(F.col("l_extendedprice"), F.col("l_quantity"))
    price = F.col("p_retailprice")
    return j.agg(F.round(F.avg(S.ratio(unit, price)), 8).alias("mean_ratio"),
                 F.round(F.avg(F.abs(S.ratio(unit - price, price))), 8).alias("mean_abs_pct_error"))


# ---- window-shaped operators

@query("win_ecdf", """SELECT o_orderstatus, o_orderkey, o_totalprice, round(CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS DOUBLE)
       / count(*) OVER (PARTITION BY o_orderstatus), 8) AS ecdf FROM orders""")
def win_ecdf(t):
    return PL.ecdf(t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "o_orderkey").withColumn("ecdf", F.round("ecdf", 8))


@query("win_nearby_rank", """SELECT user_id AS point_id, event_id AS place_id, value AS km, rk AS nearby_rank FROM (SELECT *, row_number() OVER
       (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rk FROM events) WHERE rk < 5""")
def win_nearby_rank(t):
    pairs = t.events.select(F.col("user_id").alias("point_id"), F.col("event_id").alias("place_id"), F.col("value").alias("km"))
    return geo.rank_nearby(pairs, 5)


@query("win_first_seen", """SELECT point, place_type, count(rn) AS total, count(*) FILTER (rn = 1) AS unseen FROM (SELECT DISTINCT l_orderkey AS point FROM lineitem)
       CROSS JOIN (VALUES ('A'), ('N'), ('R')) k(place_type) LEFT JOIN
       (SELECT o_orderkey AS point, l_returnflag AS place_type, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) USING (point, place_type) GROUP BY 1, 2""")
def win_first_seen(t):
    seen = t.lineitem.select(F.col("l_orderkey").alias("point"), F.col("l_returnflag").alias("place_type"), F.col("l_suppkey").alias("name"))
    return PL.first_seen_counts(seen, ["A", "N", "R"])


@query("win_fill_same_address", sql("raw_voters", """SELECT voter_key, coalesce(city, max_city) AS city FROM (SELECT voter_key, city,
       first_value(CASE WHEN coalesce(house, '') <> '' OR coalesce(street, '') <> '' THEN city END IGNORE NULLS) OVER (PARTITION BY house, street ORDER BY voter_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_city FROM raw_voters)"""))
def win_fill_same_address(t):
    return PL.fill_same_address(B.raw_voters(t), ["house", "street"], "voter_key", ["city"]).select("voter_key", "city")


@query("win_mask_repeats", """SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) > 1 THEN '' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) > 1 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def win_mask_repeats(t):
    return PL.mask_repeats(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("win_surrogate_key", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pp_identifier FROM orders")
def win_surrogate_key(t):
    return O.row_numbers(t.orders.select("o_orderkey", "o_totalprice"), [], [F.col("o_totalprice"), F.col("o_orderkey")], "pp_identifier")


# ---- sorts, limits, samples

@query("sort_multi", "SELECT p_partkey, p_type, p_retailprice FROM part ORDER BY p_type, p_retailprice DESC, p_partkey")
def sort_multi(t):
    return t.part.select("p_partkey", "p_type", "p_retailprice").orderBy("p_type", F.desc("p_retailprice"), "p_partkey")


@query("topk_by_population", sql("tracts", """SELECT geo_id, name, total, round(CAST(total AS DOUBLE) / nullif(land + no_vehicle, 0) * 1000000, 6) AS density
       FROM tracts ORDER BY total DESC, geo_id LIMIT 10"""))
def topk_by_population(t):
    top = B.tracts(t).orderBy(F.desc("total"), "geo_id").limit(10)
    area = F.col("land") + F.col("no_vehicle")
    return top.select("geo_id", "name", "total", F.round(S.ratio(F.col("total").cast("double"), area) * 1_000_000, 6).alias("density"))


@query("topn_keys", "SELECT o_custkey, count(*) AS num FROM orders GROUP BY 1 ORDER BY num DESC, o_custkey LIMIT 20")
def topn_keys(t):
    return J.top_keys(t.orders, "o_custkey", 20)


@query("limit_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def limit_preview(t):
    return t.customer.orderBy("c_custkey").limit(20)


@query("sample_bernoulli", f"SELECT o_orderkey FROM orders WHERE {key_hash_sql('o_orderkey')} < {int(0.1 * 2147483648)} AND o_orderstatus = 'F'")
def sample_bernoulli(t):
    return t.orders.filter(P.compose(sample=("o_orderkey", 0.1), equal={"o_orderstatus": "F"})).select("o_orderkey")


@query("sample_exact", f"SELECT o_orderkey FROM orders ORDER BY {key_hash_sql('o_orderkey')}, o_orderkey LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM orders)")
def sample_exact(t):
    return SA.sample_exact(t.orders.select("o_orderkey"), "o_orderkey", 0.05)


@query("sample_backlog", sql("raw_voters", f"""SELECT voter_key FROM raw_voters WHERE latitude IS NULL OR latitude = '' OR longitude IS NULL OR longitude = ''
       ORDER BY {key_hash_sql('voter_key')}, voter_key LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM raw_voters)"""))
def sample_backlog(t):
    v = B.raw_voters(t).select("voter_key", "latitude", "longitude")
    return SA.sample_backlog(v, P.empty(["latitude", "longitude"]), "voter_key", 0.05).select("voter_key")


@query("sample_stratified_exact", " UNION ALL ".join(f"""SELECT {s} AS scenario, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
       ORDER BY {key_hash_sql('o_orderkey', s)}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) // 3 AS want FROM orders) WHERE rn <= want""" for s in range(3)))
def sample_stratified_exact(t):
    o = t.orders.select("o_orderkey", "o_orderpriority")
    sizes = o.groupBy("o_orderpriority").agg(F.floor(F.count(F.lit(1)) / 3).alias("want"))
    parts = [SA.sample_stratified(o, "o_orderkey", "o_orderpriority", sizes, "want", s).select(F.lit(s).alias("scenario"), "o_orderkey", "o_orderpriority")
             for s in range(3)]
    return TB.union_all(parts)


@query("sample_disjoint", f"""SELECT o_orderkey, CASE WHEN rn <= 100 THEN 0 WHEN rn <= 350 THEN 1 ELSE 2 END AS subset FROM
       (SELECT o_orderkey, row_number() OVER (ORDER BY {key_hash_sql('o_orderkey')}, o_orderkey) AS rn FROM orders) WHERE rn <= 400""")
def sample_disjoint(t):
    return SA.sample_disjoint(t.orders.select("o_orderkey"), "o_orderkey", [100, 250, 50])


@query("split_train_test", f"SELECT doc_id, CASE WHEN {key_hash_sql('doc_id')} < {int(0.8 * 2147483648)} THEN 1 ELSE 0 END AS is_train FROM documents")
def split_train_test(t):
    return SA.hash_split(t.documents.select("doc_id"), "doc_id")


