"""Readers for dirty delimited text, GeoJSON, stored responses, HTML tables and file series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.sources.charsets import CHARSETS
from civicspark.sources.records import read_records


def text_schema(cols: Sequence[str]) -> T.StructType:
    """Every ingested column is text; typed views come later."""
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header fields: one line is read, nothing is inferred."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def read_delimited(spark: SparkSession, path: str | list[str], cols: Sequence[str] | None = None, sep: str = ",",
                   quoting: str = "minimal", quote: str = '"', escape: str = '"', header: bool = True) -> DataFrame:
    """Clean delimited text, one record a line, by Spark's own reader. ``quoting="none"`` takes quote characters as data; ``header=False``
    needs ``cols``. Files with line breaks in fields, uneven rows or mixed charsets are for ``read_records``.
    """
    first = path[0] if isinstance(path, list) else path
    # with a header, names are checked in every file: columns in another order fail the read instead of changing places
    reader = (spark.read.schema(text_schema(cols or header_of(spark, first, sep))).option("header", header).option("sep", sep)
              .option("mode", "PERMISSIVE").option("enforceSchema", not header))
    if quoting == "none":
        reader = reader.option("quote", "").option("escape", "\u0000")
    else:
        reader = reader.option("quote", quote).option("escape", escape)
    return reader.csv(path)


def read_mixed_encoding(spark: SparkSession, path: str | Sequence[str], cols: Sequence[str] | None = None, sep: str = ",",
                        charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """Delimited text whose lines are in mixed encodings; every file's columns are mapped by its own header."""
    return read_records(spark, path if isinstance(path, str) else list(path), cols, sep, charsets=charsets)


def read_many(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Any number of files with their own headers: columns in first-seen order, missing ones NULL; headers come from one distributed job."""
    return read_records(spark, list(paths), sep=sep)


def with_path(df: DataFrame, name: str = "filename") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path"))


def filename_features(path: Column) -> dict[str, Column]:
    """Metro, spacing and version from ``civicAPI_points_<metro>_spacing_<km>_version_<v>``."""
    pattern = r"civicAPI_points_(.+?)_spacing_([0-9.]+)_version_([0-9]+)"
    return {"metro": F.translate(F.regexp_extract(path, pattern, 1), "_", " "), "spacing": F.regexp_extract(path, pattern, 2),
            "query_version": F.regexp_extract(path, pattern, 3)}


def metro_from_filename(path: Column) -> Column:
    """Metro between ``_unique_places_`` and ``_spacing_``."""
    return F.translate(F.regexp_extract(path, r"_unique_places_(.+?)_spacing_", 1), "_", " ")


FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
RINGS = "array<array<array<double>>>"


def polygon_parts(kind: Column, coordinates: Column) -> Column:
    """Rings of every part of a Polygon or MultiPolygon (its coordinates as JSON text): part, ring, corner, (lon, lat)."""
    one = F.array(F.from_json(coordinates, RINGS))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{RINGS}>"))


def read_geojson(spark: SparkSession, path: str, properties_only: bool = False, multiline: bool = True) -> DataFrame:
    """One row per feature: ``geometry`` (type, and ``parts`` of a Polygon or MultiPolygon) and ``properties``.

    ``properties_only`` never parses the geometry.
    """
    feature = "struct<properties:map<string,string>>" if properties_only else FEATURE
    docs = spark.read.schema(f"features array<{feature}>").option("multiLine", multiline).json(path)
    rows = docs.select(F.explode("features").alias("f"))
    if properties_only:
        return rows.select("f.properties")
    parts = polygon_parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return rows.select(F.struct(F.col("f.geometry.type").alias("type"), parts.alias("parts")).alias("geometry"), "f.properties")


def read_delineation(spark: SparkSession, path: str, cols: Sequence[str], code: str) -> DataFrame:
    """A code table under title and header lines: only rows whose ``code`` is a number are data."""
    return read_delimited_raw(spark, path, cols).filter(F.col(code).rlike("^[0-9]+$"))


def read_delimited_raw(spark: SparkSession, path: str, cols: Sequence[str], sep: str = ",") -> DataFrame:
    return spark.read.schema(text_schema(cols)).option("header", False).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def census_rows(responses: DataFrame, col: str, keys: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """JSON arrays with a header row: keep the keys and the coded variables, renamed to their labels."""
    cells = responses.withColumn("_m", F.from_json(col, "array<array<string>>"))
    rows = cells.select(F.get("_m", F.lit(0)).alias("_h"), F.posexplode_outer("_m").alias("_i", "_r")).filter(F.col("_i") > 0)
    named = rows.select(F.map_from_arrays("_h", "_r").alias("_v"))
    return named.select(*[F.col("_v")[k].alias(k) for k in keys], *[F.col("_v")[c].alias(n) for c, n in labels.items()])


def html_rows(pages: DataFrame, col: str, keep: Sequence[str], row_tag: str = "tr", cell_tag: str = "td",
              junk: Sequence[str] = ()) -> DataFrame:
    """Cells of the table rows in an HTML column: (row_index, cells), markup and junk parts removed."""
    row = F.lit(f"(?s)<{row_tag}\\b[^>]*>(.*?)</{row_tag}>")
    cell = F.lit(f"(?s)<{cell_tag}\\b[^>]*>(.*?)</{cell_tag}>")
    rows = pages.select(*keep, F.posexplode_outer(F.regexp_extract_all(col, row, F.lit(1))).alias("row_index", "_row"))
    rows = rows.filter(F.col("_row").isNotNull())

    def clean(c: Column) -> Column:
        text = F.regexp_replace(c, "<[^>]+>", "")
        for part in junk:
            text = F.replace(text, F.lit(part), F.lit(" "))
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    return rows.select(*keep, "row_index", F.transform(F.regexp_extract_all("_row", cell, F.lit(1)), clean).alias("cells"))


def polling_table(pages: DataFrame, col: str, keep: Sequence[str], junk: Sequence[str] = (" Bldg ", " Apt ")) -> DataFrame:
    """The four fields of a county's table of polling places: precinct, precname, pollplace, polladdress.

    Two layouts occur. Where the last cell holds a place in bold and an address link, the first two cells are code and name, and line breaks
    of the address become "; ". Else the row's id is the code, the first cell the name, and the second the place and its address in parts
    divided by NUL, of which junk ones are left out. Rows without data cells, such as headers, give no row.
    """
    row, cell = F.lit(r"(?s)(<tr\b[^>]*>.*?)</tr>"), F.lit(r"(?s)<td\b[^>]*>(.*?)</td>")
    rows = pages.select(*keep, F.posexplode_outer(F.regexp_extract_all(col, row, F.lit(1))).alias("row_index", "_row")).withColumn("_cells", F.regexp_extract_all("_row", cell, F.lit(1)))
    rows = rows.filter(F.size("_cells") >= 2)

    def text(html: Column) -> Column:
        return F.regexp_replace(html, "<[^>]+>", "")

    def inside(tag: str) -> Column:
        return F.nullif(F.regexp_extract(F.element_at("_cells", -1), rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))

    cells = [F.get("_cells", F.lit(i)) for i in (0, 1)]
    bold = inside("strong").isNotNull()
    parts = F.filter(F.split(text(cells[1]), "\u0000"), lambda x: ~x.isin(list(junk)))
    row_id = F.nullif(F.regexp_extract("_row", r"""^<tr\b[^>]*\bid=["']([^"']*)["']""", 1), F.lit(""))
    return rows.select(*keep, "row_index", F.when(bold, text(cells[0])).otherwise(row_id).alias("precinct"), F.when(bold, text(cells[1])).otherwise(text(cells[0])).alias("precname"),
                       F.when(bold, text(inside("strong"))).otherwise(F.get(parts, F.lit(0))).alias("pollplace"),
                       F.when(bold, F.replace(text(inside("a")), F.lit("\n"), F.lit("; "))).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")).alias("polladdress"))


def newest_stamp(spark: SparkSession, path: str | Sequence[str], stamp: str) -> str | None:
    """The greatest stamp in the names of the files below ``path``: one distributed job over the file table, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path if isinstance(path, str) else list(path))
    found = F.regexp_extract("path", stamp, 1)
    return files.select(F.max(F.nullif(found, F.lit("")))).first()[0]


def latest_snapshot(spark: SparkSession, path: str | Sequence[str], read: Callable[[], DataFrame], stamp: str = r"([^/]+)/?[^/]*$") -> DataFrame:
    """Rows of the newest snapshot of a series (``read`` gives all of them), or none when there is no file.

    The filter on the path leaves the other files unread.
    """
    newest = newest_stamp(spark, path, stamp)
    if newest is None:
        return read().limit(0)
    return read().filter(F.regexp_extract(F.col("_metadata.file_path"), stamp, 1) == F.lit(newest))
