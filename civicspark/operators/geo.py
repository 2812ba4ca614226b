"""Nearest place, places within a radius, grids and point-in-polygon."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.geometry import KM_PER_DEGREE, chord, haversine_km, rhumb_destination
from civicspark.functions.hashing import HASH_SPACE, key_hash
from civicspark.operators.nearest import LEAF_PLACES, Tree, spots_of

def nearest(points: DataFrame, places: DataFrame, metric: str = "planar", leaf: int = LEAF_PLACES) -> DataFrame:
    """Per point (point_id, lat, lon) and place type: the nearest place and its great-circle distance.

    ``metric="planar"`` compares squared degrees, ``"geodesic"`` true distance; ties take the smallest id. The
    search serves any number of places. Points or places without coordinates take no part.
    """
    points = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    tried = Tree(places, metric, leaf, 1).search(spots_of(points), 1, None)
    best = tried.groupBy("lat", "lon", "place_type").agg(F.min(F.struct("_d", "place_id", "place_lat", "place_lon")).alias("b"))
    best = best.select("lat", "lon", "place_type", "b.place_id", "b.place_lat", "b.place_lon")
    found = points.join(best, ["lat", "lon"]).select("point_id", "lat", "lon", "place_type", "place_id", "place_lat", "place_lon")
    return found.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")))


def nearest_wide(found: DataFrame, types: Sequence[str]) -> DataFrame:
    """``closest_<type>`` and ``dist_to_<type>`` per point; a type with no place gives NULL columns."""
    picks = []
    for t in types:
        here = F.col("place_type") == t
        picks += [F.max(F.when(here, F.col("place_id"))).alias(f"closest_{t}"),
                  F.max(F.when(here, F.col("km"))).alias(f"dist_to_{t}")]
    return found.groupBy("point_id").agg(*picks)


def attach_nearest(people: DataFrame, key: str, places: DataFrame, types: Sequence[str], metric: str = "planar") -> DataFrame:
    """People (key, lat, lon, ...) with ``closest_<type>`` and ``dist_to_<type>``; NULL without a point or a place.

    Each distinct point is searched once and joined back by its coordinates.
    """
    spots = spots_of(people).select(F.struct("lat", "lon").alias("point_id"), "lat", "lon")
    wide = nearest_wide(nearest(spots, places, metric), types)
    wide = wide.select(F.col("point_id.lat").alias("_lat"), F.col("point_id.lon").alias("_lon"), *[c for c in wide.columns if c != "point_id"])
    return people.join(wide, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left").drop("_lat", "_lon")


def _one_type(places: DataFrame) -> DataFrame:
    return places.select("place_id", F.lit("").alias("place_type"), "lat", "lon")


def within_radius(points: DataFrame, places: DataFrame, km: float, leaf: int = LEAF_PLACES) -> DataFrame:
    """All (point, place) pairs at most ``km`` apart, with their distance, of any place type; exact at the poles and across the date line.

    Only cells of the place tree whose box is within the radius are looked into.
    """
    reach = chord(km) * (1 + 1e-9) + 1e-12
    tried = Tree(_one_type(places), "geodesic", leaf, None).search(spots_of(points), None, reach)
    return points.select("point_id", "lat", "lon").join(_with_km(tried, km), ["lat", "lon"])


def nearest_n(points: DataFrame, places: DataFrame, n: int, km: float | None = None, leaf: int = LEAF_PLACES) -> DataFrame:
    """The ``n`` nearest places of each point, of any type and not beyond ``km``, with distance and ``nearby_rank`` from 0 (ties by id).

    The distance of the n-th place is bounded before any place is compared, so a dense region costs a point no more than some n
    places.
    """
    reach = None if km is None else chord(km) * (1 + 1e-9) + 1e-12
    tried = _with_km(Tree(_one_type(places), "geodesic", max(leaf, n), n).search(spots_of(points), n, reach), km)
    spot = Window.partitionBy("lat", "lon").orderBy("km", "place_id")
    near = tried.withColumn("nearby_rank", F.row_number().over(spot)).filter(F.col("nearby_rank") <= n)  # in this form the limit runs before the shuffle
    near = near.withColumn("nearby_rank", F.col("nearby_rank") - 1)
    return points.select("point_id", "lat", "lon").join(near, ["lat", "lon"])


def _with_km(tried: DataFrame, km: float | None) -> DataFrame:
    rows = tried.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))).drop("_d", "place_type")
    return rows if km is None else rows.filter(F.col("km") <= F.lit(float(km)))


def assigned_vs_nearest(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """Flag rows whose assigned place (point_id, place_id, dist_text) is not the nearest one.

    ``status`` is ERROR when the recorded distance is blank or unreadable.
    """
    best = found.select(F.col("point_id").alias("_p"), F.col("place_id").alias("true_id"), F.col("km").alias("true_km"),
                        F.col("place_lat").alias("true_lat"), F.col("place_lon").alias("true_lon"))
    rows = assigned.join(best, F.col("point_id") == F.col("_p"), "left").drop("_p")
    unread = F.col("dist_text").try_cast("double").isNull()
    same = F.col("place_id") == F.col("true_id")
    return rows.withColumn("status", F.when(unread, "ERROR").when(same, "closest").otherwise("not_closest"))


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Edges of each ring: (poly_id, x1, y1, x2, y2) from ``ring``, an array of (lon, lat); closed if need be."""
    closed = polygons.withColumn("ring", F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring"))
                                 .otherwise(F.concat("ring", F.slice("ring", 1, 1))))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring") - 1),
                        lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b")))
    e = closed.select("poly_id", F.explode(pairs).alias("e"))
    return e.select("poly_id", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
                    F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def bounding_box(polygons: DataFrame, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Box of each polygon, over all its parts; of each part if ``keys`` name it."""
    pts = polygons.select(*keys, F.explode("ring").alias("p"))
    return pts.groupBy(*keys).agg(F.min("p.lon").alias("lon_min"), F.min("p.lat").alias("lat_min"),
                                  F.max("p.lon").alias("lon_max"), F.max("p.lat").alias("lat_max"))


def polygon_centre(polygons: DataFrame) -> DataFrame:
    """Mean of the ring's coordinates as given."""
    pts = polygons.select("poly_id", F.explode("ring").alias("p"))
    return pts.groupBy("poly_id").agg(F.avg("p.lat").alias("lat"), F.avg("p.lon").alias("lon"))


def polygon_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """Polygons clipped to square cells: (cx, cy, poly_id, corner, edges), a row for every cell that a polygon reaches into.

    ``edges`` are the edges that touch the cell, NULL in cells wholly inside. ``corner``: whether the cell's lower right corner is
    inside; from there a point is reached by going up the cell's right side and then left, so that only the cell's own edges are
    crossed. Rings of one ``poly_id`` (parts and holes) count by the even-odd rule.
    """
    edges = ring_edges(polygons).filter("x1 <> x2 or y1 <> y2")
    edge = F.struct("x1", "y1", "x2", "y2")

    def bands(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))

    # an edge is cut at the rows it passes, then at the columns between its ends in a row
    rows = edges.select("poly_id", edge.alias("e"), bands(F.least("y1", "y2"), F.greatest("y1", "y2")).alias("cy"))
    slope = (F.col("e.x2") - F.col("e.x1")) / F.nullif(F.col("e.y2") - F.col("e.y1"), F.lit(0.0))

    def x_at(y: Column, flat: Column) -> Column:
        return F.coalesce(F.col("e.x1") + (y - F.col("e.y1")) * slope, flat)

    low, high = F.greatest(F.col("cy") * cell, F.least("e.y1", "e.y2")), F.least((F.col("cy") + 1) * cell, F.greatest("e.y1", "e.y2"))
    ends = [x_at(low, F.col("e.x1")), x_at(high, F.col("e.x2"))]
    room = F.lit(cell * 1e-9)  # rounding must not keep an edge from a cell that it touches
    left, right = F.greatest(F.least(*ends) - room, F.least("e.x1", "e.x2") - room), F.least(F.greatest(*ends) + room, F.greatest("e.x1", "e.x2") + room)
    touched = rows.select("poly_id", "cy", "e", bands(left, right).alias("cx"))
    clipped = touched.groupBy("poly_id", "cx", "cy").agg(F.collect_list("e").alias("edges"))
    # the rows' lower borders: edges that cross them, and the columns between the outermost touched cells of a row
    border = F.col("cy") * cell
    crossing = rows.filter((F.col("e.y1") > border) != (F.col("e.y2") > border)).groupBy("poly_id", "cy").agg(F.collect_list("e").alias("crossing"))
    spans = clipped.groupBy("poly_id", "cy").agg(F.min("cx").alias("_from"), F.max("cx").alias("_to")).join(crossing, ["poly_id", "cy"], "left")
    cells = spans.select("poly_id", "cy", "crossing", F.explode(F.sequence("_from", "_to")).alias("cx"))
    beyond = F.filter("crossing", lambda e: _crosses_right(e, (F.col("cx") + 1) * cell, border))
    cells = cells.select("poly_id", "cx", "cy", (F.coalesce(F.size(beyond), F.lit(0)) % 2 == 1).alias("corner"))
    return cells.join(clipped, ["poly_id", "cx", "cy"], "left").filter(F.col("corner") | F.col("edges").isNotNull())


def _side_of(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _crosses_right(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge crosses the horizontal line through a point to the right of it."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (_side_of(e, x, y) != 0.0) & ((_side_of(e, x, y) > 0.0) == (e["y2"] > e["y1"]))


def _crosses_above(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge crosses the vertical line through a point above it; told by the same product as ``_crosses_right``.

    There a point on an edge counts as a little to the right of it, hence below a rising edge and above a falling or level one.
    """
    rising = (e["y1"] != e["y2"]) & ((e["y2"] > e["y1"]) == (e["x2"] > e["x1"]))
    side = _side_of(e, x, y)
    return ((e["x1"] > x) != (e["x2"] > x)) & F.when(side == 0.0, rising).otherwise((side < 0.0) == (e["x2"] > e["x1"]))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point_id, poly_id) pairs inside, by ray casting; a polygon of several parts, or with holes, has one row (poly_id, ring) for each ring.

    One equi-join of points with the clipped cells of ``polygon_cells``: a point in a cell wholly inside meets no edge, any other only the
    edges that touch its own cell. Repeated points give one pair.
    """
    right, border = (F.col("cx") + 1) * cell, F.col("cy") * cell
    p = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "point_id", "lat", "lon", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    met = p.join(polygon_cells(polygons, cell), ["cx", "cy"])

    def crossed(e: Column) -> Column:
        lat, lon = F.col("lat"), F.col("lon")
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        leftwards = ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < at) & ~_crosses_right(e, right, lat)
        upwards = _crosses_above(e, right, border) != _crosses_above(e, right, lat)
        return leftwards.cast("int") + upwards.cast("int")

    times = F.aggregate("edges", F.col("corner").cast("int"), lambda n, e: n + crossed(e))
    return met.filter(F.when(F.col("edges").isNull(), F.col("corner")).otherwise(times % 2 == 1)).select("point_id", "poly_id").distinct()


def grid_points(boxes: DataFrame, km: float, shift_km: float = 0.0, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Points every ``km`` over each box, from its south-west corner (moved north and then east if asked): keys, row, col, lat, lon.

    Closed form: the latitude step is constant, the longitude step follows each row's latitude; all rows start at the same longitude.
    """
    dlat = km / KM_PER_DEGREE

    def degrees_east(lat: str, distance: float) -> Column:
        return F.lit(distance) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))

    rows = boxes.withColumn("_lat0", F.col("lat_min") + F.lit(shift_km / KM_PER_DEGREE))
    rows = rows.withColumn("_lon0", F.col("lon_min") + degrees_east("_lat0", shift_km)).filter("_lat0 <= lat_max and _lon0 <= lon_max")
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.floor((F.col("lat_max") - F.col("_lat0")) / dlat).cast("int"))))
    rows = rows.withColumn("lat", F.col("_lat0") + F.col("row") * F.lit(dlat)).withColumn("_dlon", degrees_east("lat", km))
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((F.col("lon_max") - F.col("_lon0")) / F.col("_dlon")).cast("int"))))
    return rows.select(*keys, "row", "col", "lat", (F.col("_lon0") + F.col("col") * F.col("_dlon")).alias("lon"))


def region_grid(polygons: DataFrame, km: float, shift_km: float = 0.0, sd_km: float = 0.0, cell: float = 1.0) -> DataFrame:
    """Grid points of every part (poly_id, part, ring) that lie inside that part: poly_id, part, row, col, lat, lon.

    With ``sd_km`` the points are moved by noise first (see ``jitter``), and those that leave their part are dropped.
    """
    own = ["poly_id", "part"]
    grid = grid_points(bounding_box(polygons, own), km, shift_km, own).withColumn("point_id", F.struct(*own, "row", "col"))
    if sd_km > 0:
        number = ((F.col("poly_id") * 1000 + F.col("part")) * 100_000 + F.col("row")) * 100_000 + F.col("col")
        grid = jitter(grid.withColumn("_number", number), "_number", sd_km).drop("_number")
    parts = polygons.select(F.struct(*own).alias("poly_id"), "ring")
    inside = points_in_polygons(grid, parts, cell).filter((F.col("point_id.poly_id") == F.col("poly_id.poly_id")) & (F.col("point_id.part") == F.col("poly_id.part")))
    return grid.join(inside.select("point_id"), "point_id").select(*own, "row", "col", "lat", "lon")


def jitter(points: DataFrame, key: str, sd_km: float) -> DataFrame:
    """Move every point by |normal(0, sd)| km along a uniform bearing.

    The noise comes from the key's hash (Box-Muller), so a re-run task moves a point the same way.
    """
    u1 = (key_hash(key, 1) + F.lit(1)) / F.lit(HASH_SPACE + 1.0)
    u2 = key_hash(key, 2) / F.lit(float(HASH_SPACE))
    normal = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    bearing = key_hash(key, 3) / F.lit(float(HASH_SPACE)) * 360.0 - 180.0
    moves = points.withColumns({"_km": F.abs(normal) * F.lit(float(sd_km)), "_bearing": bearing})  # columns, so that no expression holds them twice
    lat, lon = rhumb_destination(F.col("lat"), F.col("lon"), F.col("_km"), F.col("_bearing"))
    return moves.withColumns({"lat": lat, "lon": lon}).drop("_km", "_bearing")


def regions_by_properties(features: DataFrame, wanted: dict[str, str], column: str = "properties") -> DataFrame:
    """Features whose properties agree with every given entry."""
    cond = F.lit(True)
    for k, v in wanted.items():
        cond = cond & (F.col(column)[k] == F.lit(v))
    return features.filter(cond)


def rank_nearby(pairs: DataFrame, n: int) -> DataFrame:
    """0-based rank of the places of each point by distance (ties by id), the first ``n`` kept."""
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("km", "place_id"))
    near = pairs.withColumn("nearby_rank", rank).filter(F.col("nearby_rank") <= n)  # in this form the limit runs before the shuffle
    return near.withColumn("nearby_rank", F.col("nearby_rank") - 1)

