"""Geospatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import geometry as G
from civicspark.functions import scalars as S
from civicspark.functions.hashing import key_hash_sql
from civicspark.operators import geo
from civicspark.operators import places as PL
from civicspark.operators import tables as TB
from civicspark.plans import bindings as B
from civicspark.plans.bindings import HAVERSINE_SQL, PLACE_TYPES, sql
from civicspark.plans.registry import query


def _pairs(t):
    """Voters with the facilities their order lines name."""
    v = B.voters(t).select("voter_id", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    f = B.facilities(t).select("facility_id", F.col("lat").alias("flat"), F.col("lon").alias("flon"))
    d = B.distances(t).select(F.col("person").alias("voter_id"), F.col("facility").alias("facility_id"))
    return d.join(v, "voter_id").join(f, "facility_id")


_PAIR_SQL = "FROM distances d JOIN voters v ON d.person = v.voter_id JOIN facilities f ON d.facility = f.facility_id"


def _cols():
    return [F.col(c) for c in ("vlat", "vlon", "flat", "flon")]


@query("geo_distance_km", sql("distances voters facilities", f"SELECT voter_id, facility_id, round({HAVERSINE_SQL.format(a='v', b='f')}, 4) AS km {_PAIR_SQL}"))
def geo_distance_km(t):
    return _pairs(t).select("voter_id", "facility_id", F.round(G.haversine_km(*_cols()), 4).alias("km"))


@query("geo_distance_ft", sql("distances voters facilities", f"SELECT voter_id, facility_id, round({HAVERSINE_SQL.format(a='v', b='f')} * 3280.839895013123, 2) AS ft {_PAIR_SQL}"))
def geo_distance_ft(t):
    return _pairs(t).select("voter_id", "facility_id", F.round(G.haversine_ft(*_cols()), 2).alias("ft"))


@query("geo_distance_sq", sql("distances voters facilities", f"""SELECT voter_id, facility_id,
       round((v.lat - f.lat) * (v.lat - f.lat) + (v.lon - f.lon) * (v.lon - f.lon), 6) AS d2 {_PAIR_SQL}"""))
def geo_distance_sq(t):
    return _pairs(t).select("voter_id", "facility_id", F.round(G.planar_sq(*_cols()), 6).alias("d2"))


def _points(t):
    return B.voters(t).select(F.col("voter_id").alias("point_id"), "lat", "lon")


def _places(t):
    return B.facilities(t).select(F.col("facility_id").alias("place_id"), "place_type", "lat", "lon")


@query("geo_nearest", sql("near", "SELECT voter_id, place_type, best.id AS facility_id, round(best.km, 6) AS km FROM near"))
def geo_nearest(t):
    found = geo.nearest(_points(t), _places(t))
    return found.select(F.col("point_id").alias("voter_id"), "place_type", F.col("place_id").alias("facility_id"), F.round("km", 6).alias("km"))


@query("geo_nearest_many_places", sql("near", "SELECT voter_id, place_type, best.id AS facility_id, round(best.km, 6) AS km FROM near"))
def geo_nearest_many_places(t):
    """The search through several levels of cells, as large facility tables need."""
    found = geo.nearest(_points(t), _places(t), leaf=4)
    return found.select(F.col("point_id").alias("voter_id"), "place_type", F.col("place_id").alias("facility_id"), F.round("km", 6).alias("km"))


@query("geo_nearest_wide", sql("near_wide", "SELECT voter_id, " + ", ".join(
    f'"closest_{p}", round("dist_to_{p}", 6) AS "dist_to_{p}"' for p in PLACE_TYPES) + " FROM near_wide"))
def geo_nearest_wide(t):
    wide = geo.nearest_wide(geo.nearest(_points(t), _places(t)), PLACE_TYPES)
    return wide.select(F.col("point_id").alias("voter_id"), *[c for p in PLACE_TYPES for c in (
        F.col(f"closest_{p}"), F.round(f"dist_to_{p}", 6).alias(f"dist_to_{p}"))])


_GEODESIC = f"""SELECT v.voter_id, arg_min({{'id': f.facility_id, 'km': {HAVERSINE_SQL.format(a='v', b='f')}, 'lat': f.lat, 'lon': f.lon}},
    {{'d': {HAVERSINE_SQL.format(a='v', b='f')}, 'id': f.facility_id}}) AS best FROM voters v, facilities f GROUP BY v.voter_id"""


@query("geo_nearest_geodesic", sql("voters facilities", f"SELECT voter_id, best.id AS facility_id, round(best.km * 3280.839895013123, 2) AS ft FROM ({_GEODESIC})"))
def geo_nearest_geodesic(t):
    places = _places(t).withColumn("place_type", F.lit("any"))
    found = geo.nearest(_points(t), places, "geodesic")
    return found.select(F.col("point_id").alias("voter_id"), F.col("place_id").alias("facility_id"), F.round(F.col("km") * G.FEET_PER_KM, 2).alias("ft"))


@query("geo_assigned_is_closest", sql("raw_voters voters facilities", f"""SELECT g.voter_id, r.voter_key % (SELECT count(*) FROM supplier) AS assigned, best.id AS true_id,
       round(best.km, 6) AS true_km, CASE WHEN try_cast(r.latitude AS DOUBLE) IS NULL THEN 'ERROR' WHEN r.voter_key % (SELECT count(*) FROM supplier) = best.id THEN 'closest'
       ELSE 'not_closest' END AS status FROM raw_voters r JOIN ({_GEODESIC}) g ON r.voter_key = g.voter_id"""))
def geo_assigned_is_closest(t):
    count = t.supplier.agg(F.count(F.lit(1)).alias("n")).scalar()
    assigned = (B.raw_voters(t).select(F.col("voter_key").alias("point_id"), F.col("latitude").alias("dist_text")).withColumn("_n", count)
                .select("point_id", "dist_text", (F.col("point_id") % F.col("_n")).alias("place_id")))
    found = geo.nearest(_points(t), _places(t).withColumn("place_type", F.lit("any")), "geodesic")
    out = geo.assigned_vs_nearest(assigned, found)
    return out.select(F.col("point_id").alias("voter_id"), F.col("place_id").alias("assigned"), "true_id", F.round("true_km", 6).alias("true_km"), "status")


@query("geo_within_radius", sql("voters facilities", f"""SELECT voter_id, facility_id, round(km, 6) AS km, rk AS nearby_rank FROM (SELECT *, row_number() OVER (PARTITION BY voter_id ORDER BY km, facility_id) - 1 AS rk
       FROM (SELECT v.voter_id, f.facility_id, {HAVERSINE_SQL.format(a='v', b='f')} AS km FROM voters v, facilities f) WHERE km <= 800) WHERE rk < 20"""))
def geo_within_radius(t):
    near = geo.nearest_n(_points(t), _places(t), 20, 800.0)
    return near.select(F.col("point_id").alias("voter_id"), F.col("place_id").alias("facility_id"), F.round("km", 6).alias("km"), "nearby_rank")


@query("geo_bbox", sql("rings", "SELECT poly_id, CAST(part AS BIGINT) AS part, min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max FROM rings GROUP BY 1, 2 UNION ALL SELECT poly_id, -1, min(lon), min(lat), max(lon), max(lat) FROM rings GROUP BY 1"))
def geo_bbox(t):
    """Boxes of the parts, and of whole polygons (part -1)."""
    polys = B.polygons(t).withColumn("part", F.col("part").cast("bigint"))
    return geo.bounding_box(polys, ["poly_id", "part"]).unionByName(geo.bounding_box(polys).withColumn("part", F.lit(-1).cast("bigint")))


@query("geo_polygon_centre", sql("rings", "SELECT poly_id, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM rings GROUP BY 1"))
def geo_polygon_centre(t):
    return geo.polygon_centre(B.polygons(t)).select("poly_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


_INSIDE = """JOIN edges e ON {poly} ((e.y1 > {p}.lat) <> (e.y2 > {p}.lat)) AND {p}.lon < (e.x2 - e.x1) * ({p}.lat - e.y1) / (e.y2 - e.y1) + e.x1"""


@query("geo_point_in_polygon", sql("voters edges", f"SELECT v.voter_id AS point_id, e.poly_id FROM voters v {_INSIDE.format(p='v', poly='')} GROUP BY 1, 2 HAVING count(*) % 2 = 1"))
def geo_point_in_polygon(t):
    return geo.points_in_polygons(_points(t), B.polygons(t), 5.0)


_OWN_PART = "e.poly_id = g.poly_id AND e.part = g.part AND"


def _grid_columns(grid):
    return grid.select("poly_id", F.col("part").cast("bigint").alias("part"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"),
                       F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("geo_grid", sql("edges grid", f"""SELECT g.poly_id, CAST(g.part AS BIGINT) AS part, g."row", g.col, round(g.lat, 6) AS lat, round(g.lon, 6) AS lon FROM grid g
       {_INSIDE.format(p='g', poly=_OWN_PART)} GROUP BY ALL HAVING count(*) % 2 = 1"""))
def geo_grid(t):
    """Points of a shifted grid inside their own part of a polygon."""
    return _grid_columns(geo.region_grid(B.polygons(t), 200.0, 30.0, cell=5.0))


_NUMBER = '(((poly_id * 1000 + part) * 100000 + "row") * 100000 + col)'
_U = [f"({key_hash_sql(_NUMBER, s)})" for s in (1, 2, 3)]


@query("geo_grid_jitter", sql("edges grid", f"""SELECT g.poly_id, CAST(g.part AS BIGINT) AS part, g."row", g.col, round(g.lat, 6) AS lat, round(g.lon, 6) AS lon FROM (SELECT poly_id, part, "row", col, degrees(p2) AS lat, degrees(CASE WHEN abs(cos(p1)) < 1e-9 THEN radians(lon) ELSE radians(lon) + d * sin(b) / CASE WHEN abs(psi) > 1e-11 THEN dp / psi ELSE cos(p1) END END) AS lon FROM
       (SELECT *, CASE WHEN abs(cos(p1)) < 1e-9 THEN 0 ELSE ln(tan(p2 / 2 + pi() / 4) / tan(p1 / 2 + pi() / 4)) END AS psi FROM (SELECT *, CASE WHEN p1 + dp > pi() / 2 THEN pi() - (p1 + dp) WHEN p1 + dp < -pi() / 2 THEN -pi() - (p1 + dp) ELSE p1 + dp END AS p2 FROM (SELECT *, d * cos(b) AS dp FROM (SELECT poly_id, part, "row", col, lon, radians(lat) AS p1,
        abs(sqrt(-2.0 * ln(({_U[0]} + 1) / 2147483649.0::DOUBLE)) * cos(2 * pi() * ({_U[1]} / 2147483648.0::DOUBLE))) * 60.0 / 6371.0088 AS d, radians({_U[2]} / 2147483648.0::DOUBLE * 360.0 - 180.0) AS b
        FROM grid))))) g {_INSIDE.format(p='g', poly=_OWN_PART)} GROUP BY ALL HAVING count(*) % 2 = 1"""))
def geo_grid_jitter(t):
    """Grid points moved by normal distances along uniform bearings, as far as they stay in their part."""
    return _grid_columns(geo.region_grid(B.polygons(t), 200.0, 30.0, 60.0, cell=5.0))


@query("geo_destination", sql("voters", """SELECT voter_id, round(degrees(asin(s2)), 6) AS lat, round(degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * s2)), 6) AS lon
       FROM (SELECT *, sin(p) * cos(d) + cos(p) * sin(d) * cos(b) AS s2 FROM (SELECT voter_id, lon, radians(lat) AS p, 100.0 / 6371.0088 AS d, radians(CAST(voter_id % 360 AS DOUBLE)) AS b FROM voters))"""))
def geo_destination(t):
    lat, lon = G.destination(F.col("lat"), F.col("lon"), F.lit(100.0), (F.col("voter_id") % 360).cast("double"))
    return B.voters(t).select("voter_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("geo_region_by_props", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def geo_region_by_props(t):
    f = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    features = f.withColumn("properties", F.create_map(F.lit("NAME"), "n_name", F.lit("REGION"), "r_name"))
    return geo.regions_by_properties(features, {"REGION": "ASIA"}).select("n_nationkey", "n_name")


@query("geo_region_counties", sql("voters edges", f"""SELECT v.voter_id, n.n_regionkey AS metro FROM voters v {_INSIDE.format(p='v', poly='')} JOIN nation n ON n.n_nationkey = e.poly_id
       GROUP BY v.voter_id, n.n_regionkey, e.poly_id HAVING count(*) % 2 = 1"""))
def geo_region_counties(t):
    """A metro is the set of its counties: membership is membership in any of them."""
    inside = geo.points_in_polygons(_points(t), B.polygons(t), 5.0)
    j = inside.join(t.nation, F.col("poly_id") == F.col("n_nationkey"))
    return j.select(F.col("point_id").alias("voter_id"), F.col("n_regionkey").alias("metro")).distinct()


def _address_tables(t):
    """Reference addresses: each table knows part of them, the first voter of an address gives its coordinates."""
    v = B.raw_voters(t)
    a = v.select(PL.normalise_address([F.col("house"), F.col("street")]).alias("address"), "voter_key", "tract_geoid", "sex")
    first = TB.first_per_key(a, ["address"], [F.col("voter_key")])
    cols = ["address", F.col("voter_key").alias("lat"), (F.col("voter_key") * 2).alias("lon"), F.col("tract_geoid").alias("tract")]
    return v, first.filter(F.col("sex") == "M").select(*cols), first.filter(F.col("sex") == "F").select(*cols)


_ADDR = """SELECT voter_key, upper(trim(regexp_replace(replace(concat_ws(' ', nullif(house, ''), nullif(street, '')), ',', ' '), '\\s+', ' ', 'g'))) AS address, tract_geoid, sex FROM raw_voters"""
_GEOCODE = f"""SELECT a.voter_key, a.address, CASE WHEN f.sex IN ('M', 'F') THEN f.voter_key END AS latitude, CASE WHEN f.sex IN ('M', 'F') THEN f.voter_key * 2 END AS longitude,
    CASE WHEN f.sex IN ('M', 'F') THEN f.tract_geoid END AS census_tract, CASE WHEN f.sex = 'M' THEN 1 ELSE 0 END AS match,
    CASE f.sex WHEN 'M' THEN 'primary' WHEN 'F' THEN 'fallback' END AS geocode_source FROM ({_ADDR}) a
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY voter_key) AS rn FROM ({_ADDR})) WHERE rn = 1) f ON a.address = f.address"""


def _geocoded(t):
    v, primary, fallback = _address_tables(t)
    rows = v.select("voter_key", PL.normalise_address([F.col("house"), F.col("street")]).alias("address"))
    return PL.geocode(rows, "address", primary, fallback)


@query("geo_geocode_lookup", sql("raw_voters", _GEOCODE))
def geo_geocode_lookup(t):
    return _geocoded(t)


@query("geo_geocode_distinct", sql("raw_voters", f"SELECT address, max(latitude) AS latitude, max(geocode_source) AS geocode_source, count(*) AS residents FROM ({_GEOCODE}) GROUP BY 1"))
def geo_geocode_distinct(t):
    return _geocoded(t).groupBy("address").agg(F.max("latitude").alias("latitude"), F.max("geocode_source").alias("geocode_source"),
                                                F.count(F.lit(1)).alias("residents"))


@query("geo_parse_coordinate", sql("raw_voters", """SELECT voter_key, CASE WHEN latitude <> '' AND longitude <> '' THEN CAST(longitude AS DOUBLE) END AS lon,
       CASE WHEN latitude <> '' AND longitude <> '' THEN CAST(latitude AS DOUBLE) END AS lat FROM raw_voters"""))
def geo_parse_coordinate(t):
    text = F.concat(F.col("longitude"), F.lit(","), F.col("latitude"))
    lon, lat = S.parse_coordinate(text)
    return B.raw_voters(t).select("voter_key", lon.alias("lon"), lat.alias("lat"))
