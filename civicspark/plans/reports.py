"""The wide voter report: nearest facility per type, census tract, star join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.functions import predicates as P
from civicspark.operators import geo
from civicspark.operators.joins import star_join


def with_nearest(voters: DataFrame, facilities: DataFrame, types: Sequence[str]) -> DataFrame:
    """Voters with ``closest_<type>`` and ``dist_to_<type>``."""
    places = facilities.select(F.col("facility_id").alias("place_id"), "place_type", "lat", "lon")
    return geo.attach_nearest(voters, "voter_id", places, types)


def wide_report(voters: DataFrame, facilities: DataFrame, tracts: DataFrame, types: Sequence[str],
                facility_cols: Sequence[str], tract_cols: Sequence[str]) -> DataFrame:
    """Voters with every key and distance present, joined to their tract and to the nearest facility of each type."""
    located = voters.filter(P.nonnull(["lat", "lon", "tract_geoid"]))  # before the search, not after it
    enriched = with_nearest(located, facilities, types)
    keys = [f"closest_{t}" for t in types]
    where = P.nonnull([*keys, *[f"dist_to_{t}" for t in types]])
    dims = [(tracts, "tract_geoid", "geo_id"), *[(facilities, k, "facility_id") for k in keys]]
    cols = {"tract_geoid": tract_cols, **{k: facility_cols for k in keys}}
    return star_join(enriched, dims, where, cols)
