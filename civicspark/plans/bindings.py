"""Domain tables derived from the given tables, in DataFrame form and as SQL for the checks.

Keys become coordinates, codes and blanks by integer arithmetic, so every engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.plans.registry import Tables
from civicspark.session import dealt

PLACE_TYPES = ["pollingLocation", "dropOffLocation", "earlyVoteSite"]
ELECTIONS = [f"{y}-11-08" for y in range(1995, 2002)]


def _s(c: Column) -> Column:
    return c.cast("string")


def _hundredths(a: Column) -> Column:
    return F.concat(_s(F.floor(a / 100)), F.lit("."), F.lpad(_s(a % 100), 2, "0"))


def voters(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("voter_id"), F.col("c_nationkey").cast("bigint").alias("tract_geoid"),
        ((k * 7919 % 18000).cast("double") / 100.0 - 90.0).alias("lat"),
        ((k * 104729 % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
        F.col("c_mktsegment").alias("demo"), F.col("c_acctbal").alias("balance"))


def facilities(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(p) for p in PLACE_TYPES]), (k % 3 + 1).cast("int"))
    return t.supplier.select(
        k.alias("facility_id"), kind.alias("place_type"),
        ((k * 15485863 % 18000).cast("double") / 100.0 - 90.0).alias("lat"),
        ((k * 32452843 % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
        F.col("s_name").alias("name"), F.concat(F.lit("ADDR "), _s(k % 40)).alias("address"))


def tracts(t: Tables) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(k.alias("geo_id"), F.col("n_name").alias("name"), F.col("r_name").alias("state_name"),
                    F.col("n_regionkey").cast("bigint").alias("state"), _s(k % 7 + 1).alias("county"), _s(k).alias("tract"),
                    (k * 97 + 1000).alias("total"), (k * 7919 % 9000 * (k % 6)).alias("land"),
                    (k * 31 % 200).alias("no_vehicle"), (k * 53 % 400).alias("one_vehicle"), (k * 71 % 300).alias("two_vehicles"),
                    (k * 17 % 500).alias("male_15_to_17_years"), (k * 19 % 500).alias("male_18_and_19_years"),
                    (k * 23 % 500).alias("male_62_to_64_years"), (k * 29 % 500).alias("male_under_5_years"),
                    (k * 37 % 500 + 20000).alias("income")))


def raw_voters(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    lat = _hundredths(k * 7919 % 18000)
    lon = _hundredths(k * 104729 % 36000)
    day = F.date_add(F.lit("1990-01-01").cast("date"), (k * 13 % 12000).cast("int")).cast("string")
    dob = F.date_add(F.lit("1930-01-01").cast("date"), (k * 17 % 25000).cast("int")).cast("string")
    return t.customer.select(
        k.alias("voter_key"), _s(k).alias("voter_id"), F.lpad(_s(n % 7 + 1), 3, "0").alias("county"),
        F.when(k % 29 == 0, "n/a").otherwise(F.lpad(_s(n), 6, "0")).alias("tract"),
        F.when(k % 5 == 0, "").otherwise(_s(k % 90 + 1)).alias("house"),
        F.concat("c_mktsegment", F.lit(",  ST")).alias("street"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("NATION_"), _s(n))).alias("city"),
        F.lpad(_s(k * 37 % 100000), 5, "0").alias("zip"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, F.lit(None)).otherwise(lat).alias("latitude"),
        F.when(k % 11 == 0, "").when(k % 17 == 0, F.lit(None)).otherwise(lon).alias("longitude"),
        F.when(k % 10 < 8, "Y").otherwise("N").alias("is_active_voter"),
        F.when(k % 9 == 0, "").when(k % 3 == 0, "M").otherwise("F").alias("sex"),
        F.when(k % 19 == 0, "").when(k % 23 == 0, "unknown").otherwise(day).alias("registered_at"),
        F.when(k % 31 == 0, "").otherwise(dob).alias("dob"), F.col("c_mktsegment").alias("demo"), n.alias("tract_geoid"))


def history(t: Tables) -> DataFrame:
    method = F.when(F.col("o_orderstatus") == "F", "voted").when(F.col("o_orderstatus") == "O", "absentee").otherwise("provisional")
    return t.orders.select(F.col("o_custkey").alias("voter_id"),
                           F.concat(_s(F.year("o_orderdate")), F.lit("-11-08")).alias("election_at"), method.alias("vote_method"))


def precincts(t: Tables) -> DataFrame:
    return (t.lineitem.groupBy(F.col("l_partkey").alias("precinct"))
            .agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("x"),
                 F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("t"),
                 F.count(F.lit(1)).alias("n")))


def draws(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    long = t.embeddings.select(v, F.posexplode("embedding").alias("pos", "e"))
    return long.select(F.floor(v / 6).alias("precinct"), F.col("pos").cast("bigint").alias("draw"),
                       F.floor(v % 6 / 3).alias("grp"), (v % 3).alias("cand"),
                       F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("e").cast("double") + 0.5)).alias("b"))


def draw_precincts(t: Tables) -> DataFrame:
    p = F.floor(F.col("vec_id") / 6)
    return (t.embeddings.select(p.alias("precinct")).distinct()
            .select("precinct", (F.col("precinct") * 37 % 400 + 100).alias("n"),
                    ((F.col("precinct") * 13 % 97 + 1).cast("double") / 100.0).alias("x"),
                    ((F.col("precinct") * 29 % 89 + 1).cast("double") / 100.0).alias("truth")))


def scored(t: Tables) -> DataFrame:
    """Labelled rows with a score: outcome ``quality``, score from the text length."""
    return (t.documents.join(t.labels, "doc_id")
            .select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 997).cast("double").alias("score"), "lang", "source",
                    F.col("n_chars").cast("double").alias("distance")))


def distances(t: Tables) -> DataFrame:
    """Person-facility distances: the pairs that meet in the order lines, at most one per line."""
    rows = t.lineitem.count()
    lines = dealt(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("facility")), rows, "l_orderkey")
    met = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("person"), "facility")
    pairs = dealt(met, rows, "person", "facility").distinct()
    return pairs.withColumn("dist", ((F.col("person") * 7919 + F.col("facility") * 104729) % 1000).cast("double") / 100.0)


def membership(t: Tables) -> DataFrame:
    """Candidate facility sets: each facility opens a set with two others, spread by arithmetic on the count."""
    k = F.col("s_suppkey")
    count = t.supplier.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = t.supplier.select(k).withColumn("_n", count)
    members = F.array_distinct(F.array(k, (k * 3 + 1) % F.col("_n"), (k * 7 + 2) % F.col("_n")))
    return sized.select(k.alias("set_id"), F.explode(members).alias("facility"))


def people(t: Tables) -> DataFrame:
    """Group value theta: 1 for odd keys (the high group), 0 otherwise."""
    return t.customer.select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 2).cast("double").alias("theta"))


CORNERS = [[(-20.0, -8.0), (5.0, -12.0), (25.0, -6.0), (22.0, 9.0), (0.0, 4.0), (-24.0, 11.0)], [(26.5, -13.0), (30.0, -12.5), (29.0, -9.0), (27.0, -9.5)]]


def polygons(t: Tables) -> DataFrame:
    """A six-sided region per nation, on a 5 x 5 board of the globe, and for every third one a second part of four sides: a row per part."""
    k = F.col("n_nationkey")
    x, y = (k % 5 * 60 - 150).cast("double"), (F.floor(k / 5) * 30 - 75).cast("double")
    rings = [F.array(*[F.struct((x + dx).alias("lon"), (y + dy).alias("lat")) for dx, dy in corners]) for corners in CORNERS]
    parts = F.when(k % 3 == 0, F.array(*rings)).otherwise(F.array(rings[0]))
    return t.nation.select(k.cast("bigint").alias("poly_id"), F.col("n_name").alias("name"), F.posexplode(parts).alias("part", "ring"))


_H = "(CAST({a} // 100 AS VARCHAR) || '.' || lpad(CAST({a} % 100 AS VARCHAR), 2, '0'))"

CTES: dict[str, str] = {
    "voters": """SELECT c_custkey AS voter_id, CAST(c_nationkey AS BIGINT) AS tract_geoid,
        CAST(c_custkey * 7919 % 18000 AS DOUBLE) / 100.0 - 90.0 AS lat,
        CAST(c_custkey * 104729 % 36000 AS DOUBLE) / 100.0 - 180.0 AS lon, c_mktsegment AS demo, c_acctbal AS balance
        FROM customer""",
    "facilities": """SELECT s_suppkey AS facility_id,
        CASE s_suppkey % 3 WHEN 0 THEN 'pollingLocation' WHEN 1 THEN 'dropOffLocation' ELSE 'earlyVoteSite' END AS place_type,
        CAST(s_suppkey * 15485863 % 18000 AS DOUBLE) / 100.0 - 90.0 AS lat,
        CAST(s_suppkey * 32452843 % 36000 AS DOUBLE) / 100.0 - 180.0 AS lon, s_name AS name,
        'ADDR ' || CAST(s_suppkey % 40 AS VARCHAR) AS address FROM supplier""",
    "tracts": """SELECT CAST(n_nationkey AS BIGINT) AS geo_id, n_name AS name, r_name AS state_name,
        CAST(n_regionkey AS BIGINT) AS state, CAST(n_nationkey % 7 + 1 AS VARCHAR) AS county, CAST(n_nationkey AS VARCHAR) AS tract,
        CAST(n_nationkey * 97 + 1000 AS BIGINT) AS total, CAST(n_nationkey * 7919 % 9000 * (n_nationkey % 6) AS BIGINT) AS land,
        CAST(n_nationkey * 31 % 200 AS BIGINT) AS no_vehicle, CAST(n_nationkey * 53 % 400 AS BIGINT) AS one_vehicle,
        CAST(n_nationkey * 71 % 300 AS BIGINT) AS two_vehicles, CAST(n_nationkey * 17 % 500 AS BIGINT) AS male_15_to_17_years,
        CAST(n_nationkey * 19 % 500 AS BIGINT) AS male_18_and_19_years, CAST(n_nationkey * 23 % 500 AS BIGINT) AS male_62_to_64_years,
        CAST(n_nationkey * 29 % 500 AS BIGINT) AS male_under_5_years, CAST(n_nationkey * 37 % 500 + 20000 AS BIGINT) AS income
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw_voters": f"""SELECT c_custkey AS voter_key, CAST(c_custkey AS VARCHAR) AS voter_id,
        lpad(CAST(c_nationkey % 7 + 1 AS VARCHAR), 3, '0') AS county,
        CASE WHEN c_custkey % 29 = 0 THEN 'n/a' ELSE lpad(CAST(c_nationkey AS VARCHAR), 6, '0') END AS tract,
        CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 90 + 1 AS VARCHAR) END AS house,
        c_mktsegment || ',  ST' AS street,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'NATION_' || CAST(c_nationkey AS VARCHAR) END AS city,
        lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS zip,
        CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE {_H.format(a='(c_custkey * 7919 % 18000)')} END AS latitude,
        CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN NULL ELSE {_H.format(a='(c_custkey * 104729 % 36000)')} END AS longitude,
        CASE WHEN c_custkey % 10 < 8 THEN 'Y' ELSE 'N' END AS is_active_voter,
        CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS sex,
        CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN 'unknown'
             ELSE strftime(DATE '1990-01-01' + CAST(c_custkey * 13 % 12000 AS INTEGER), '%Y-%m-%d') END AS registered_at,
        CASE WHEN c_custkey % 31 = 0 THEN ''
             ELSE strftime(DATE '1930-01-01' + CAST(c_custkey * 17 % 25000 AS INTEGER), '%Y-%m-%d') END AS dob,
        c_mktsegment AS demo, CAST(c_nationkey AS BIGINT) AS tract_geoid FROM customer""",
    "history": """SELECT o_custkey AS voter_id, CAST(year(o_orderdate) AS VARCHAR) || '-11-08' AS election_at,
        CASE o_orderstatus WHEN 'F' THEN 'voted' WHEN 'O' THEN 'absentee' ELSE 'provisional' END AS vote_method FROM orders""",
    "precincts": """SELECT l_partkey AS precinct, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x,
        avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t, count(*) AS n FROM lineitem GROUP BY l_partkey""",
    "draws": """SELECT vec_id // 6 AS precinct, CAST(pos - 1 AS BIGINT) AS draw, vec_id % 6 // 3 AS grp, vec_id % 3 AS cand,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(e AS DOUBLE) + 0.5::DOUBLE)) AS b
        FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""",
    "draw_precincts": """SELECT DISTINCT vec_id // 6 AS precinct, (vec_id // 6) * 37 % 400 + 100 AS n,
        CAST((vec_id // 6) * 13 % 97 + 1 AS DOUBLE) / 100.0 AS x, CAST((vec_id // 6) * 29 % 89 + 1 AS DOUBLE) / 100.0 AS truth FROM embeddings""",
    "scored": """SELECT d.doc_id, quality AS label, CAST(n_chars % 997 AS DOUBLE) AS score, lang, source, CAST(n_chars AS DOUBLE) AS distance
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "distances": """SELECT DISTINCT o_custkey AS person, l_suppkey AS facility,
        CAST((o_custkey * 7919 + l_suppkey * 104729) % 1000 AS DOUBLE) / 100.0 AS dist
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "membership": """SELECT DISTINCT set_id, facility FROM (SELECT s_suppkey AS set_id, unnest([s_suppkey,
        (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier), (s_suppkey * 7 + 2) % (SELECT count(*) FROM supplier)]) AS facility FROM supplier)""",
    "people": "SELECT c_custkey AS person, CAST(c_custkey % 2 AS DOUBLE) AS theta FROM customer",
    "corners": "SELECT * FROM (VALUES " + ", ".join(
        f"({p}, {i}, {len(ring)}, {dx}::DOUBLE, {dy}::DOUBLE)" for p, ring in enumerate(CORNERS) for i, (dx, dy) in enumerate(ring)) + ") c(part, i, n, dx, dy)",
    "rings": """SELECT CAST(n_nationkey AS BIGINT) AS poly_id, part, i, n, CAST(n_nationkey % 5 * 60 - 150 AS DOUBLE) + dx AS lon,
        CAST(n_nationkey // 5 * 30 - 75 AS DOUBLE) + dy AS lat FROM nation JOIN corners ON part = 0 OR n_nationkey % 3 = 0""",
    "edges": """SELECT a.poly_id, a.part, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM rings a
        JOIN rings b ON a.poly_id = b.poly_id AND a.part = b.part AND b.i = (a.i + 1) % a.n""",
    # grid points every 200 km over the box of each part, from 30 km north and east of its corner
    "grid": """SELECT poly_id, part, "row", unnest(range(0, CAST(floor((lon_max - lon0) / dlon) AS BIGINT) + 1)) AS col, lat, lon0 + col * dlon AS lon FROM
        (SELECT *, lat0 + "row" * (200.0 / (6371.0088 * pi() / 180)) AS lat,
            200.0 / (6371.0088 * pi() / 180 * cos(radians(lat0 + "row" * (200.0 / (6371.0088 * pi() / 180))))) AS dlon FROM
          (SELECT *, unnest(range(0, CAST(floor((lat_max - lat0) / (200.0 / (6371.0088 * pi() / 180))) AS BIGINT) + 1)) AS "row" FROM
            (SELECT *, lon_min + 30.0 / (6371.0088 * pi() / 180 * cos(radians(lat0))) AS lon0 FROM
              (SELECT poly_id, part, min(lon) AS lon_min, max(lon) AS lon_max, max(lat) AS lat_max, min(lat) + 30.0 / (6371.0088 * pi() / 180) AS lat0
               FROM rings GROUP BY 1, 2)) WHERE lat0 <= lat_max AND lon0 <= lon_max))""",
}

HAVERSINE_SQL = ("2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat))"
                 " * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))")

# per voter and place type: nearest by squared degrees
CTES["near"] = f"""SELECT v.voter_id, f.place_type,
    arg_min({{'id': f.facility_id, 'km': {HAVERSINE_SQL.format(a='v', b='f')}}},
            {{'d': (v.lat - f.lat) * (v.lat - f.lat) + (v.lon - f.lon) * (v.lon - f.lon), 'id': f.facility_id}}) AS best
    FROM voters v, facilities f GROUP BY v.voter_id, f.place_type"""
CTES["near_wide"] = """SELECT voter_id, """ + ", ".join(
    f"max(CASE WHEN place_type = '{p}' THEN best.id END) AS \"closest_{p}\", max(CASE WHEN place_type = '{p}' THEN best.km END) AS \"dist_to_{p}\""
    for p in PLACE_TYPES) + " FROM near GROUP BY voter_id"

NEEDS = {"near": ["voters", "facilities"], "near_wide": ["near"], "rings": ["corners"], "edges": ["rings"], "grid": ["rings"],
         "district": ["draws", "draw_precincts"], "prefs": ["district"], "set_dist": ["distances", "membership", "people"],
         "set_reach": ["set_dist"], "set_scores": ["set_reach"]}


def sql(needs: str, body: str) -> str:
    """``body`` after the named derived tables and whatever they rest on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for n in needs.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + body.strip()
