"""Sources and sinks, checked by round trip through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.plans import bindings as B
from civicspark.plans.bindings import sql
from civicspark.plans.registry import query
from civicspark.session import scratch_path
from civicspark.sources.charsets import encode_single_byte
from civicspark.sources import files as FI
from civicspark.sources import sinks as SK


def _write_csv(df, name, sep=",", **options):
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).options(**options).csv(path)
    return path


_PEOPLE = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer"


def _people(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def _write_lines(df, name, header=None):
    """Raw lines (text, or bytes in any charset) as one file, after a header line."""
    path = scratch_path(df.sparkSession, name)
    lines = df.select(F.col("value").cast("string").alias("value"))
    if header is not None:
        lines = df.sparkSession.range(1).select(F.lit(header).alias("value")).unionAll(lines).coalesce(1)
    lines.write.text(path)
    return path


@query("src_csv", """SELECT CAST(c_custkey AS VARCHAR) AS id,
       CASE WHEN c_custkey % 7 = 0 THEN c_name || chr(10) || 'c/o "' || c_mktsegment || '"|x' ELSE c_name END AS name,
       CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN c_custkey || '|' || c_name
            WHEN c_custkey % 11 = 0 THEN c_custkey || '|' || c_name || '|' || c_mktsegment || '|surplus 5" x' END AS broken FROM customer""")
def src_csv(t):
    """Records over several lines, short and long rows; the files are read in splits, rows of another width keep their text."""
    k = F.col("c_custkey")
    value = (F.when(k % 7 == 0, F.format_string('%d|"%s\nc/o ""%s""|x"|%s', k, "c_name", "c_mktsegment", "c_mktsegment"))
             .when(k % 13 == 0, F.format_string("%d|%s", k, "c_name")).when(k % 11 == 0, F.format_string('%d|%s|%s|surplus 5" x', k, "c_name", "c_mktsegment"))
             .otherwise(F.format_string("%d|%s|%s", k, "c_name", "c_mktsegment")))
    path = _write_lines(t.customer.select(value.alias("value")), "src_csv", "id|name|segment")
    return FI.read_records(t.spark, path, sep="|", broken="broken")


@query("src_csv_quoting", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' \"' || p_type || '\", ' || chr(10) || p_brand AS label, 'quoted' AS mode FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), '\"' || p_name, 'none' FROM part")
def src_csv_quoting(t):
    """Quoted fields hold separators, quotes and line breaks; without quoting a quote is data."""
    key = F.col("p_partkey").cast("string").alias("id")
    quoted = t.part.select(key, F.concat("p_name", F.lit(' "'), "p_type", F.lit('", \n'), "p_brand").alias("label"))
    a = FI.read_records(t.spark, _write_csv(quoted, "quoted", escape='"', quoteAll=True))
    lines = t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit('|"'), "p_name").alias("value"))
    b = FI.read_records(t.spark, _write_lines(lines, "unquoted"), ["id", "label"], sep="|", quote=None, header=False)
    return a.withColumn("mode", F.lit("quoted")).unionByName(b.withColumn("mode", F.lit("none"))).drop("_broken")


_SPELT = ["Zoë Ångström à São Paulo", "Łukasz Żółć, Gdańsk", "Příliš žluťoučký kůň", "Привет из Москвы", "日本 — Zoë"]
_WRITTEN_IN = ["windows-1252", "windows-1250", "windows-1250", "ISO-8859-5", None]


@query("src_csv_encoding_fallback", f"SELECT CAST(s_suppkey AS VARCHAR) AS id, {_SPELT!r}[s_suppkey % 5 + 1] || ' ' || s_name AS name, NULL AS broken FROM supplier")
def src_csv_encoding_fallback(t):
    """Each line in a charset of its own; two files with their columns in different orders."""
    k = F.col("s_suppkey")
    paths = []
    for odd, header in enumerate(("id|name", "name|id")):
        cells = [k.cast("string"), F.concat(F.element_at(F.array(*[F.lit(x) for x in _SPELT]), (k % 5 + 1).cast("int")), F.lit(" "), "s_name")]
        line = F.concat_ws("|", *(cells[::-1] if odd else cells))
        raw = F.when(k % 5 == 4, F.encode(line, "UTF-8"))
        for i, charset in enumerate(_WRITTEN_IN[:4]):
            raw = raw.when(k % 5 == i, encode_single_byte(line, charset))
        paths.append(_write_lines(t.supplier.filter(k % 2 == odd).select(raw.alias("value")), f"mixed{odd}", header))
    return FI.read_mixed_encoding(t.spark, paths, sep="|").withColumnRenamed("_broken", "broken")


@query("src_multi_file_union", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 'x, ' || chr(10) || 'y', NULL FROM nation")
def src_multi_file_union(t):
    """Files with other columns, and the same ones in another order."""
    a = _write_csv(_people(t), "file_a")
    b = _write_csv(t.supplier.select(F.col("s_nationkey").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "file_b")
    c = _write_csv(t.nation.select(F.lit("x, \ny").alias("segment"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "file_c")
    return FI.read_many(t.spark, [a, b, c]).drop("_broken")


def _named(t, names):
    """Write the nations of each name's slice under a folder that carries the name."""
    root = scratch_path(t.spark, "named")
    paths = []
    for i, name in enumerate(names):
        path = f"{root}/{name}"
        t.nation.filter(F.col("n_regionkey") == i).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.option("header", True).csv(path)
        paths.append(path)
    return paths


_METROS = ["Los_Angeles", "New_York", "Atlanta", "Iowa_City", "Akron"]


@query("src_filename_features", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, ['Los Angeles', 'New York', 'Atlanta', 'Iowa City', 'Akron'][n_regionkey + 1] AS metro, (n_regionkey + 1) || '.5' AS spacing, CAST(n_regionkey AS VARCHAR) AS query_version FROM nation")
def src_filename_features(t):
    paths = _named(t, [f"civicAPI_points_{m}_spacing_{i + 1}.5_version_{i}" for i, m in enumerate(_METROS)])
    df = FI.with_path(FI.read_delimited(t.spark, paths, ["id", "name"]))
    return df.select("id", "name", *[c.alias(n) for n, c in FI.filename_features(F.col("filename")).items()])


@query("src_metro_from_filename", "SELECT CAST(n_nationkey AS VARCHAR) AS id, ['Los Angeles', 'New York', 'Atlanta', 'Iowa City', 'Akron'][n_regionkey + 1] AS metro FROM nation")
def src_metro_from_filename(t):
    paths = _named(t, [f"places_unique_places_{m}_spacing_{i}" for i, m in enumerate(_METROS)])
    return FI.with_path(FI.read_delimited(t.spark, paths, ["id", "name"])).select("id", FI.metro_from_filename(F.col("filename")).alias("metro"))


@query("src_geojson", sql("rings", "SELECT poly_id, n_name AS name, count(*) AS corners, round(min(lon), 4) AS lon_min, round(max(lat), 4) AS lat_max, count(DISTINCT part) AS parts FROM rings JOIN nation ON poly_id = n_nationkey GROUP BY 1, 2"))
def src_geojson(t):
    ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    shapes = B.polygons(t).groupBy("poly_id", "name").agg(F.array_sort(F.collect_list(F.struct("part", ring.alias("ring")))).alias("parts"))
    several = F.size("parts") > 1
    shape = F.struct(F.when(several, "MultiPolygon").otherwise("Polygon").alias("type"),
                     F.when(several, F.to_json(F.transform("parts", lambda p: F.array(p["ring"])))).otherwise(F.to_json(F.array(F.col("parts")[0]["ring"]))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"),
                       F.struct(F.col("poly_id").cast("string").alias("GEOID"), F.col("name").alias("NAME")).alias("properties"))
    path = scratch_path(t.spark, "geojson")
    docs = shapes.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))
    # coordinates were put in as text: take their quotes off again
    docs.select(F.regexp_replace("value", '"(\\[[^"]*\\])"', "$1").alias("value")).write.text(path)
    f = FI.read_geojson(t.spark, path, multiline=False)
    part = f.select(F.col("properties")["GEOID"].cast("bigint").alias("poly_id"), F.col("properties")["NAME"].alias("name"), F.posexplode("geometry.parts").alias("part", "rings"))
    corner = part.select("poly_id", "name", "part", F.explode(F.flatten("rings")).alias("c"))
    return corner.groupBy("poly_id", "name").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("corners"), F.round(F.min(F.col("c")[0]), 4).alias("lon_min"),
                                                 F.round(F.max(F.col("c")[1]), 4).alias("lat_max"))


@query("src_delineation", "SELECT CAST(10000 + n_nationkey AS VARCHAR) AS cbsa, n_name AS title, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS state_fips FROM nation")
def src_delineation(t):
    rows = t.nation.select(F.concat((F.col("n_nationkey") + 10000).cast("string"), F.lit(","), "n_name", F.lit(","), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("value"))
    titles = t.region.limit(1).select(F.explode(F.array(F.lit("List 1. Areas and counties"), F.lit("(titles)"), F.lit("CBSA Code,CBSA Title,State"))).alias("value"))
    path = scratch_path(t.spark, "delineation")
    titles.unionByName(rows).write.text(path)
    return FI.read_delineation(t.spark, path, ["cbsa", "title", "state_fips"], "cbsa")


@query("src_census_matrix", """SELECT CAST(n_regionkey AS VARCHAR) AS state, CAST(n_nationkey AS VARCHAR) AS tract, CAST(n_nationkey * 97 + 1000 AS VARCHAR) AS "Total", CAST(n_nationkey * 31 % 200 AS VARCHAR) AS "Total_No_vehicle" FROM nation""")
def src_census_matrix(t):
    k = F.col("n_nationkey")
    header = F.array(F.lit("NAME"), F.lit("B01003_001E"), F.lit("B08201_002E"), F.lit("B99999_001E"), F.lit("state"), F.lit("tract"))
    row = F.array("n_name", (k * 97 + 1000).cast("string"), (k * 31 % 200).cast("string"), F.lit("0"), F.col("n_regionkey").cast("string"), k.cast("string"))
    responses = t.nation.select(F.to_json(F.array(header, row)).alias("response"))  # one response per area
    return FI.census_rows(responses, "response", ["state", "tract"], {"B01003_001E": "Total", "B08201_002E": "Total_No_vehicle"})


@query("src_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src_parquet(t):
    """Cache-or-compute: the second read comes from the stored table, filters pushed into its scan."""
    path = scratch_path(t.spark, "orders_cache")
    for _ in range(2):
        df = SK.cached(t.spark, path, lambda: t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return df.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("sink_parquet", "SELECT * FROM nation")
def sink_parquet(t):
    path = scratch_path(t.spark, "nation")
    t.nation.write.parquet(path)
    return t.spark.read.parquet(path)


@query("sink_csv_report", f"SELECT 'report.csv' AS file, * FROM ({_PEOPLE}) UNION ALL SELECT 'report_.csv', * FROM ({_PEOPLE})")
def sink_csv_report(t):
    """Written twice under one name: the second report takes a free name."""
    base = scratch_path(t.spark, "reports")
    frames = []
    for _ in range(2):
        path = SK.write_report(_people(t), f"{base}/report.csv")
        frames.append(FI.read_delimited(t.spark, path).select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), "*"))
    return frames[0].unionByName(frames[1])


@query("sink_ctas", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def sink_ctas(t):
    """Two bucketed copies of a query: the aggregation on the bucket key needs no shuffle."""
    path = scratch_path(t.spark, "ctas")
    name = "report_" + path.rsplit("-", 1)[-1]
    SK.write_table(t.orders.select("o_custkey", "o_orderkey"), name, path, ["o_custkey"])
    return t.spark.table(name).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("sink_union_headers", "SELECT c_custkey AS id, c_name AS name, NULL AS phone FROM customer UNION ALL SELECT s_suppkey, NULL, 'p' || s_suppkey FROM supplier")
def sink_union_headers(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("_seen"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("phone"))
    path = scratch_path(t.spark, "union_headers")
    SK.public_columns(a.unionByName(b, allowMissingColumns=True)).write.parquet(path)
    return t.spark.read.parquet(path)


@query("sink_split_files", "SELECT count(*) AS total_rows, 1 AS all_small FROM orders")
def sink_split_files(t):
    path = scratch_path(t.spark, "split")
    SK.write_split(t.orders.select("o_orderkey", "o_custkey"), path, 1000)
    back = FI.with_path(FI.read_delimited(t.spark, path))
    sizes = back.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("total_rows"), (F.max("n") <= 1000).cast("int").alias("all_small"))


@query("src_html_table", """SELECT page_id, row_index, CAST(j - 1 AS INTEGER) AS cell_index, trim(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS cell FROM
       (SELECT page_id, CAST(i - 1 AS INTEGER) AS row_index, unnest(regexp_extract_all(r, '(?s)<a\\b[^>]*>(.*?)</a>', 1)) AS c, unnest(range(1, len(regexp_extract_all(r, '(?s)<a\\b[^>]*>(.*?)</a>', 1)) + 1)) AS j
       FROM (SELECT page_id, unnest(rows) AS r, unnest(range(1, len(rows) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1) AS rows FROM pages)))""")
def src_html_table(t):
    """The pages' item lists stand in for table rows: items are rows, links are cells, all of them."""
    rows = FI.html_rows(t.pages, "html", ["page_id"], "li", "a", [" Bldg ", " Apt "])
    return rows.select("page_id", "row_index", F.posexplode("cells").alias("cell_index", "cell"))


@query("src_polling_table", """SELECT s_nationkey AS county, 'P' || s_suppkey AS precinct, 'Precinct ' || s_suppkey AS precname, s_name AS pollplace,
       s_suppkey || ' Main St' || CASE WHEN s_nationkey % 2 = 0 THEN '; City ' || s_nationkey ELSE ' City ' || s_nationkey END AS polladdress FROM supplier""")
def src_polling_table(t):
    """Pages of two counties' layouts, one page per nation."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    bold = F.concat(F.lit("<tr><td>P"), k, F.lit("</td><td>Precinct "), k, F.lit('</td><td>x</td><td><strong>'), "s_name", F.lit("</strong><br><a href='#'>"), k, F.lit(" Main St\nCity "), n, F.lit("</a></td></tr>"))
    plain = F.concat(F.lit('<tr class="r" id="P'), k, F.lit('"><td>Precinct '), k, F.lit("</td><td>"), "s_name", F.lit("\0 Bldg \0"), k, F.lit(" Main St\0 Apt \0City "), n, F.lit("</td></tr>"))
    rows = t.supplier.select("s_nationkey", F.when(F.col("s_nationkey") % 2 == 0, bold).otherwise(plain).alias("row"))
    pages = rows.groupBy(F.col("s_nationkey").alias("county")).agg(F.concat(F.lit("<table class='grid'><tr><th>Code</th></tr>\n"), F.array_join(F.collect_list("row"), "\n"), F.lit("</table>")).alias("html"))
    return FI.polling_table(pages, "html", ["county"]).drop("row_index")


@query("src_latest_snapshot", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey = 4")
def src_latest_snapshot(t):
    paths = _named(t, [f"vf_2021-0{i + 1}-01" for i in range(5)])
    return FI.latest_snapshot(t.spark, paths, lambda: FI.read_delimited(t.spark, paths, ["id", "name"]), r"vf_([0-9-]+)")
