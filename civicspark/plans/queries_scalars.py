"""Scalar functions: strings, dates, numbers, conditions, stored JSON."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from civicspark.functions import scalars as S
from civicspark.operators import features as FE
from civicspark.operators import places as PL
from civicspark.plans import bindings as B
from civicspark.plans.bindings import CTES, sql
from civicspark.plans.registry import query


@query("str_join_address", sql("raw_voters", """SELECT voter_key, concat_ws(' ', nullif(house, ''), nullif(street, ''), nullif(city, ''), 'Georgia', nullif(zip, '')) AS address FROM raw_voters"""))
def str_join_address(t):
    parts = [F.col(c) for c in ("house", "street", "city")]
    return B.raw_voters(t).select("voter_key", S.join_address(parts, "Georgia", F.col("zip")).alias("address"))


@query("str_sanitize", sql("raw_voters", """SELECT voter_key, replace(street, ',', ' ') AS spaced, trim(regexp_replace(replace(street, ',', ' '), '\\s+', ' ', 'g')) AS collapsed FROM raw_voters"""))
def str_sanitize(t):
    return B.raw_voters(t).select("voter_key", S.sanitize(F.col("street")).alias("spaced"), S.sanitize(F.col("street"), True).alias("collapsed"))


_LABEL = "'Total population: Estimate!!Total:!!' || p_type || ' (' || p_name || '):  of all the people in households'"


@query("str_clean_label", f"""SELECT p_partkey, substring(replace(replace(replace(replace(replace(replace(string_split({_LABEL}, 'Estimate!!')[-1], '!', ''), ':', '_'), ' ', '_'), '(', '_'), ')', '_'), '__', '_'), 1, 42) AS label FROM part""")
def str_clean_label(t):
    raw = F.concat(F.lit("Total population: Estimate!!Total:!!"), "p_type", F.lit(" ("), "p_name", F.lit("):  of all the people in households"))
    return t.part.select("p_partkey", S.clean_label(raw).alias("label"))


@query("str_pad_code", """SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS padded,
       ltrim('00' || CAST(c_custkey AS VARCHAR), '0') AS stripped FROM customer""")
def str_pad_code(t):
    k = F.col("c_custkey").cast("string")
    return t.customer.select("c_custkey", S.pad_code(k, 3).alias("padded"), S.strip_zeros(F.concat(F.lit("00"), k)).alias("stripped"))


_METRO = "c_mktsegment || ' City, ' || CASE WHEN c_custkey % 3 = 0 THEN 'GA-AL' WHEN c_custkey % 3 = 1 THEN 'OH' ELSE 'NY-NJ-PA' END"


def _metro():
    k = F.col("c_custkey") % 3
    return F.concat("c_mktsegment", F.lit(" City, "), F.when(k == 0, "GA-AL").when(k == 1, "OH").otherwise("NY-NJ-PA"))


@query("str_state_of_metro", f"""SELECT c_custkey, CASE WHEN NOT contains(st, '-') THEN st ELSE 'multiple' END AS state, len(string_split(st, '-')) AS n_states
       FROM (SELECT c_custkey, trim(string_split({_METRO}, ',')[-1]) AS st FROM customer)""")
def str_state_of_metro(t):
    return t.customer.select("c_custkey", S.metro_state(_metro()).alias("state"), F.size(S.metro_states(_metro())).cast("bigint").alias("n_states"))


_STATES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.STATE_NAMES.items()) + ") s(code, state_name)"


@query("str_state_names", f"""SELECT c_custkey, code, state_name, CASE WHEN state_name IS NOT NULL THEN code END AS code_again
       FROM (SELECT c_custkey, unnest(string_split(trim(string_split({_METRO}, ',')[-1]), '-')) AS code FROM customer) LEFT JOIN {_STATES} USING (code)""")
def str_state_names(t):
    """Codes to names and back; codes that no state has stay, without a name."""
    codes = t.customer.select("c_custkey", F.explode(S.metro_states(_metro())).alias("code"))
    return codes.withColumn("state_name", S.state_name(F.col("code"))).withColumn("code_again", S.state_code(F.col("state_name")))


@query("str_date_colname", sql("history", "SELECT DISTINCT election_at, 'voted_' || replace(election_at, '-', '_') AS name FROM history"))
def str_date_colname(t):
    return B.history(t).select("election_at", S.election_column(F.col("election_at")).alias("name")).distinct()


_D = "try_cast({c} AS DATE)"


@query("date_days_to", sql("raw_voters", f"SELECT voter_key, date_diff('day', {_D.format(c='registered_at')}, DATE '2021-02-18') AS days FROM raw_voters"))
def date_days_to(t):
    return B.raw_voters(t).select("voter_key", S.days_to(F.col("registered_at"), "2021-02-18").cast("bigint").alias("days"))


@query("date_age_years", sql("raw_voters", f"SELECT voter_key, round(date_diff('day', {_D.format(c='dob')}, DATE '2021-02-18') * (1 / 365.0::DOUBLE), 8) AS age FROM raw_voters"))
def date_age_years(t):
    return B.raw_voters(t).select("voter_key", F.round(S.age_years(F.col("dob"), "2021-02-18"), 8).alias("age"))


@query("num_year_to_age", sql("raw_voters", "SELECT voter_key, 2021 - try_cast(nullif(substring(dob, 1, 4), '') AS DOUBLE) AS age FROM raw_voters"))
def num_year_to_age(t):
    return B.raw_voters(t).select("voter_key", S.year_to_age(F.substring("dob", 1, 4), 2021).alias("age"))


@query("num_cast", sql("raw_voters", """SELECT voter_key, try_cast(nullif(latitude, '') AS DOUBLE) AS latitude, try_cast(tract AS BIGINT) AS tract, try_cast(nullif(house, '') AS BIGINT) AS house FROM raw_voters"""))
def num_cast(t):
    return FE.cast_columns(B.raw_voters(t).select("voter_key", "latitude", "tract", "house"), {"latitude": "double", "tract": "bigint", "house": "bigint"})


@query("num_affine", "SELECT o_orderkey, round(o_totalprice * 2 + 100, 4) AS scaled FROM orders")
def num_affine(t):
    return t.orders.select("o_orderkey", F.round(FE.affine(F.col("o_totalprice"), 2.0, 100.0), 4).alias("scaled"))


@query("num_threshold", sql("raw_voters", f"""SELECT voter_key, CASE WHEN date_diff('day', {_D.format(c='registered_at')}, DATE '2021-02-18') < 4000.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recent FROM raw_voters"""))
def num_threshold(t):
    return B.raw_voters(t).select("voter_key", S.threshold(S.days_to(F.col("registered_at"), "2021-02-18"), 4000).alias("recent"))


@query("cond_nonnull_flag", sql("raw_voters", "SELECT voter_key, CASE WHEN city IS NOT NULL THEN 1 ELSE 0 END AS has_city FROM raw_voters"))
def cond_nonnull_flag(t):
    return B.raw_voters(t).select("voter_key", S.nonnull_flag(F.col("city")).alias("has_city"))


@query("cond_relabel", sql("history", "SELECT vote_method, CASE vote_method WHEN 'voted' THEN 1 ELSE 0 END AS outcome, CASE vote_method WHEN 'voted' THEN 'V' WHEN 'absentee' THEN 'A' END AS short, count(*) AS n FROM history GROUP BY ALL"))
def cond_relabel(t):
    m = F.col("vote_method")
    return (B.history(t).select(m, S.relabel(m, {"voted": 1}, 0).alias("outcome"), S.relabel(m, {"voted": "V", "absentee": "A"}).alias("short"))
            .groupBy("vote_method", "outcome", "short").agg(F.count(F.lit(1)).alias("n")))


@query("num_fraction", sql("tracts", """SELECT geo_id, round(CAST(no_vehicle AS DOUBLE) / total, 8) AS fraction_no_vehicle, round(CAST(one_vehicle + two_vehicles AS DOUBLE) / total, 8) AS fraction_some_vehicle FROM tracts"""))
def num_fraction(t):
    cols = {"fraction_no_vehicle": ["no_vehicle"], "fraction_some_vehicle": ["one_vehicle", "two_vehicles"]}
    out = FE.share_columns(B.tracts(t), cols, "total")
    return out.select("geo_id", *[F.round(c, 8).alias(c) for c in cols])


@query("num_density", sql("tracts", "SELECT geo_id, round(CAST(total AS DOUBLE) / nullif(land, 0), 8) AS density FROM tracts"))
def num_density(t):
    return B.tracts(t).select("geo_id", F.round(S.ratio(F.col("total").cast("double"), F.col("land")), 8).alias("density"))


@query("num_age_bands", sql("tracts", """SELECT geo_id, round(CAST(male_under_5_years + male_15_to_17_years AS DOUBLE) / total, 8) AS male_0_18, round(CAST(male_18_and_19_years AS DOUBLE) / total, 8) AS male_18_62,
       round(CAST(male_62_to_64_years AS DOUBLE) / total, 8) AS male_62_1000 FROM tracts"""))
def num_age_bands(t):
    tr = B.tracts(t)
    bands = FE.age_bands([c for c in tr.columns if c.startswith("male_")], "male_", [0, 18, 62, 1000])
    out = FE.share_columns(tr, bands, "total")
    return out.select("geo_id", *[F.round(c, 8).alias(c) for c in bands])


_Z = "(0.5::DOUBLE + 1.5 * x - 2.0 * t)"


@query("math_logistic", sql("precincts", f"SELECT precinct, round(1 / (1 + exp(-{_Z})), 8) AS p, round(-ln(1 + exp(-{_Z})), 8) + 0.0 AS log_p FROM precincts"))
def math_logistic(t):
    beta, one = (0.5, 1.5, -2.0), F.lit(1.0)
    return B.precincts(t).select("precinct", F.round(S.logistic(one, F.col("x"), F.col("t"), beta), 8).alias("p"),
                                 (F.round(S.log_logistic(one, F.col("x"), F.col("t"), beta), 8) + F.lit(0.0)).alias("log_p"))


@query("math_log_binom", """SELECT o_orderkey, round(lgamma(o_custkey + 1.0) - lgamma(o_custkey // 3 + 1.0) - lgamma(o_custkey - o_custkey // 3 + 1.0), 5) + 0.0 AS log_ways FROM orders""")
def math_log_binom(t):
    n = F.col("o_custkey")
    return t.orders.select("o_orderkey", (F.round(S.log_binom(n, F.floor(n / 3)), 5) + F.lit(0.0)).alias("log_ways"))


# ---- stored responses: built from the event properties as JSON text, then read back

CTES["ek"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def _responses(t):
    base = t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    k = F.col("k")

    def text(*parts):
        return F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])

    def place(i):
        sources = F.slice(F.array(F.struct(F.lit("src0").alias("name"), F.lit(True).alias("official")),
                                  F.struct(F.lit("src1").alias("name"), F.lit(False).alias("official"))), F.lit(1), (k % 3).cast("int"))
        address = F.struct(text("Hall ", k + i).alias("locationName"), text(k * 7 + i, " Main St").alias("line1"), text("City ", k % 10).alias("city"),
                           F.lit("ST").alias("state"), text(k % 100).alias("zip"))
        return F.struct(address.alias("address"), sources.alias("sources"), text("7-", k % 5 + 15).alias("pollingHours"))

    polls = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 2), place)
    early = F.array(F.struct(F.struct(text("Early ", k).alias("locationName"), F.lit(None).cast("string").alias("line1"), text("City ", k % 10).alias("city"),
                                          F.lit("ST").alias("state"), text(k % 100).alias("zip")).alias("address"),
                             F.array().cast("array<struct<name:string,official:boolean>>").alias("sources"), F.lit(None).cast("string").alias("pollingHours")))
    entries = F.array(F.struct(F.lit("pollingLocations"), polls), F.struct(F.lit("earlyVoteSites"), early))
    kept = F.slice(entries, F.lit(1), F.when(k % 4 == 0, 2).otherwise(1))
    return base.select("event_id", F.to_json(F.map_from_entries(kept)).alias("response"))


_POLL = """SELECT event_id, k, 'pollingLocations' AS place_type, CAST(i AS INTEGER) AS place_index, '7-' || (k % 5 + 15) AS hours, 'Hall ' || (k + i) AS name, (k * 7 + i) || ' Main St' AS line1, 'City ' || (k % 10) AS city, k % 3 AS ns
    FROM (SELECT event_id, k, unnest(range(0, k % 2 + 1)) AS i FROM ek) UNION ALL SELECT event_id, k, 'earlyVoteSites', 0, NULL, 'Early ' || k, NULL, 'City ' || (k % 10), 0 FROM ek WHERE k % 4 = 0"""


@query("json_flatten_place", sql("ek", f"""SELECT event_id, place_type, place_index, hours AS "Pollinghours", name AS "AddressLocationname", line1 AS "AddressLine1", city AS "AddressCity",
       CAST(j AS INTEGER) AS source_index, NULL AS "Startdate", NULL AS "Enddate", NULL AS "Notes", NULL AS "AddressLine2", NULL AS "AddressLine3", 'ST' AS "AddressState", CAST(k % 100 AS VARCHAR) AS "AddressZip", CASE WHEN name LIKE 'Early%' THEN NULL ELSE 'oak ' || name END AS "AddressLandmark",
       CASE WHEN name LIKE 'Early%' THEN NULL ELSE '["ramp","desk"]' END AS "Voterservices", 'src' || j AS "SourcesName", CASE j WHEN 0 THEN 1 WHEN 1 THEN 0 END AS "SourcesOfficial" FROM ({_POLL}) LEFT JOIN (SELECT unnest(range(0, 2)) AS j) ON j < ns"""))
def json_flatten_place(t):
    """Two fields that are not among the usual ones come through."""
    odd = F.regexp_replace("response", r'"locationName":"(Hall \d+)"', '"landmark":"oak $1","locationName":"$1"')
    odd = F.regexp_replace(odd, r'"pollingHours":', '"voterServices":["ramp","desk"],"pollingHours":')
    return PL.flatten_places(_responses(t).withColumn("response", odd), "response", ["event_id"])


CTES["first_place"] = f"SELECT *, left(place_type, -1) AS p FROM ({_POLL}) WHERE place_index = 0"
CTES["numbers"] = "SELECT unnest(range(0, 2)) AS j"


@query("json_sample_first", sql("ek first_place numbers", """SELECT event_id, attribute, value FROM (SELECT event_id, p || 'Pollinghours' AS attribute, hours AS value FROM first_place
       UNION ALL SELECT event_id, p || 'AddressLocationname', name FROM first_place UNION ALL SELECT event_id, p || 'AddressLine1', line1 FROM first_place
       UNION ALL SELECT event_id, p || 'AddressCity', city FROM first_place UNION ALL SELECT event_id, p || 'AddressState', 'ST' FROM first_place
       UNION ALL SELECT event_id, p || 'AddressZip', CAST(k % 100 AS VARCHAR) FROM first_place UNION ALL SELECT event_id, p || 'Sources' || j || 'Name', 'src' || j FROM first_place, numbers WHERE j < ns
       UNION ALL SELECT event_id, p || 'Sources' || j || 'Official', CASE j WHEN 0 THEN 'true' ELSE 'false' END FROM first_place, numbers WHERE j < ns) WHERE value IS NOT NULL"""))
def json_sample_first(t):
    return PL.sample_first_place(_responses(t), "response", ["event_id"])


@query("json_pick_component", """SELECT c_custkey, n_name AS state_long, substring(n_name, 1, 2) AS state_short, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment || ' County' END AS county_long
       FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def json_pick_component(t):
    def component(kind, long, short):
        return F.struct(F.array(F.lit(kind), F.lit("political")).alias("types"), long.alias("long_name"), short.alias("short_name"))

    state = component("administrative_area_level_1", F.col("n_name"), F.substring("n_name", 1, 2))
    county = component("administrative_area_level_2", F.concat("c_mktsegment", F.lit(" County")), F.col("c_mktsegment"))
    other = component("country", F.lit("Country"), F.lit("C"))
    parts = F.when(F.col("c_custkey") % 4 > 0, F.array(other, county, state)).otherwise(F.array(other, state))
    stored = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.to_json(parts).alias("components"))
    c = F.from_json("components", "array<struct<types:array<string>,long_name:string,short_name:string>>")
    read = stored.select("c_custkey", c.alias("c"))
    return read.select("c_custkey", S.pick_component(F.col("c"), "administrative_area_level_1", "long_name").alias("state_long"),
                       S.pick_component(F.col("c"), "administrative_area_level_1", "short_name").alias("state_short"),
                       S.pick_component(F.col("c"), "administrative_area_level_2", "long_name").alias("county_long"))


@query("vec_to_columns", """SELECT l_orderkey, l_linenumber, l_quantity AS "f[quantity]", l_discount AS "f[discount]", l_tax AS "f[tax]" FROM lineitem""")
def vec_to_columns(t):
    packed = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="f").transform(t.lineitem)
    return FE.vector_to_columns(packed.select("l_orderkey", "l_linenumber", "f"), "f", ["quantity", "discount", "tax"])


@query("lit_constant", "SELECT s_suppkey, 'pollingLocation' AS \"placeType\" FROM supplier")
def lit_constant(t):
    return t.supplier.select("s_suppkey", F.lit("pollingLocation").alias("placeType"))
