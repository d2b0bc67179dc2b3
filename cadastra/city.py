"""Views of the driver's tables as a city of integer rectangles, and the same views in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.spatial import Grid

#: Side of the finest grid cell: parcels are at most 16 wide.
CELL = 16
#: Levels of the city's tables: parcels, lots and points touch the finest cells, zones and padded parcels the next.
GRID = Grid(CELL, (0, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    return df.selectExpr("*", f"{x0} AS xmin", f"{y0} AS ymin").selectExpr("*", f"{x1} AS xmax", f"{y1} AS ymax")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tax parcels."""
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "lpad(cast(o_orderkey AS string), 11, '0') AS roll", "o_custkey AS cust", "cast(o_totalprice AS decimal(18,2)) AS value", "o_orderpriority AS zoning", "year(o_orderdate) AS year")
    return _box(df, "(id * 37) % 2000", "(id * 53) % 2000", "xmin + 5 + cust % 7", "ymin + 5 + cust % 11").drop("cust")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as zoning polygons."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS zone_id", "p_brand AS zone")
    return _box(df, "(zone_id * 91) % 2000", "(zone_id * 17) % 2000", "xmin + 60", "ymin + 40")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of orders as lots of parcels."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("parcel"), F.col("l_linenumber").cast("bigint").alias("n")).agg(F.min("l_partkey").alias("lot"), F.min("l_suppkey").alias("plan"))
    return df.withColumn("block", F.col("plan") % 5)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as civic addresses."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS addr_id", "c_name AS address", "(c_custkey * 29) % 2000 AS x", "(c_custkey * 71) % 2000 AS y")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as quarter-hour counts."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 50 AS street", "user_id % 7 AS a", "user_id % 5 AS b", "event_type AS kind", "ts", "cast(floor(value) AS bigint) AS n")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as straight roads: even ones run along x, odd ones along y."""
    df = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS road", "s_suppkey % 2 AS vertical", "(s_suppkey * 13) % 1000 AS at", "(s_suppkey * 7) % 400 AS lo")
    return df.selectExpr("*", "lo + 300 AS hi")


SQL = {
    "parcels": """parcels AS (SELECT *, xmin + 5 + cust % 7 AS xmax, ymin + 5 + cust % 11 AS ymax FROM (SELECT o_orderkey AS id, lpad(o_orderkey::VARCHAR, 11, '0') AS roll,
 o_custkey AS cust, o_totalprice::DECIMAL(18,2) AS value, o_orderpriority AS zoning, year(o_orderdate) AS year, (o_orderkey * 37) % 2000 AS xmin, (o_orderkey * 53) % 2000 AS ymin FROM orders))""",
    "zones": "zones AS (SELECT *, xmin + 60 AS xmax, ymin + 40 AS ymax FROM (SELECT p_partkey AS zone_id, p_brand AS zone, (p_partkey * 91) % 2000 AS xmin, (p_partkey * 17) % 2000 AS ymin FROM part))",
    "lots": "lots AS (SELECT *, plan % 5 AS block FROM (SELECT l_orderkey AS parcel, l_linenumber::BIGINT AS n, min(l_partkey) AS lot, min(l_suppkey) AS plan FROM lineitem GROUP BY 1, 2))",
    "points": "points AS (SELECT c_custkey AS addr_id, c_name AS address, (c_custkey * 29) % 2000 AS x, (c_custkey * 71) % 2000 AS y FROM customer)",
    "counts": "counts AS (SELECT event_id, user_id % 50 AS street, user_id % 7 AS a, user_id % 5 AS b, event_type AS kind, ts, floor(value)::BIGINT AS n FROM events)",
    "roads": "roads AS (SELECT *, lo + 300 AS hi FROM (SELECT s_suppkey AS road, s_suppkey % 2 AS vertical, (s_suppkey * 13) % 1000 AS at, (s_suppkey * 7) % 400 AS lo FROM supplier))",
}


def sql(*names: str) -> str:
    """WITH and the views named."""
    return "WITH " + ", ".join(SQL[n] for n in names)


def degrees(df: DataFrame) -> DataFrame:
    """Boxes of integers as boxes of lon and lat, with their polygon."""
    from .functions import geometry as g

    east = {c: F.lit(-99.0) + F.col(c) * F.lit(1e-5) for c in ("xmin", "xmax")}
    north = {c: F.lit(49.0) + F.col(c) * F.lit(1e-5) for c in ("ymin", "ymax")}
    return df.withColumns({**east, **north}).withColumn("geom", g.rectangle("xmin", "ymin", "xmax", "ymax"))


def sources(spark: SparkSession, sf_dir: str):
    """The city's tables in the shape that searches take."""
    from .functions import geometry as g
    from .plans.search import Sources
    from .sources import files

    p = parcels(spark, sf_dir)
    strips = lots(spark, sf_dir).join(p.select(F.col("id").alias("parcel"), "xmin", "ymin", "ymax"), "parcel")
    survey = strips.selectExpr("parcel * 8 + n AS _ord", "cast(parcel * 8 + n AS string) AS id", "cast(lot AS string) AS lot", "cast(block AS string) AS block", "cast(plan AS string) AS plan", "'' AS description", "xmin + 2 * (n - 1) AS xmin", "ymin", "xmin + 2 * n AS xmax", "ymax")
    cx, cy = g.center(F.col)
    assess = degrees(p.selectExpr("id AS _ord", "roll AS roll_number", "id AS street_number", "'MAIN ST' AS street_name", "concat(id, ' MAIN ST') AS full_address", "zoning", "cast(value AS string) AS total_assessed_value", "cast(year AS string) AS current_assessment_year", "xmin", "ymin", "xmax", "ymax"))
    assess = assess.withColumns({"property_use_code": F.lit("RES"), "centroid_lon": cx.cast("string"), "centroid_lat": cy.cast("string"), "assessed_land_area": ((F.col("street_number") % 90 + 10) * 100).cast("string"), "dwelling_units": (F.col("street_number") % 4).cast("string"), "detail_url": F.lit(None).cast("string")})
    pts = points(spark, sf_dir).selectExpr("concat(addr_id, ' SIDE ST') AS full_address", "addr_id AS street_number", "'SIDE ST' AS street_name", "-99.0D + x * 1e-5D AS lon", "49.0D + y * 1e-5D AS lat")
    zs = degrees(zones(spark, sf_dir).withColumns({"_ord": F.col("zone_id"), "zoning": F.col("zone")}))
    # written once a session, as a search's sources are tables and not views
    root = f"{files.shared_dir(spark)}/city-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    kept = lambda name, df: files.cached_table(spark, root, name, lambda: df, files.DAY)
    grid = Grid(CELL * 1e-5, (0, 1, 2, 3, 4))
    return Sources(kept("survey", degrees(survey)), kept("assess", assess), kept("addresses", pts), kept("zones", zs), grid, "https://records.example/", "https://walk.example/", "", "https://flood.example/", Grid(CELL * 1e-5, (0,)))
