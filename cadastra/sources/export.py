"""Writers: CSV exports and GeoJSON layers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Headings of the export, and the columns they hold.
EXPORT = [
    ("Lot", "survey.lot"),
    ("Block", "survey.block"),
    ("Plan", "survey.plan"),
    ("Description", "survey.description"),
    ("Roll Number", "assess.roll_number"),
    ("Full Address", "assess.full_address"),
    ("Zoning", "zoning"),
    ("Zoning %", "zoning_pct"),
    ("Zoning 2", "zoning_2"),
    ("Zoning 2 %", "zoning_2_pct"),
    ("Lot Size (sf)", "assess.assessed_land_area"),
    ("Lat", "assess.centroid_lat"),
    ("Lon", "assess.centroid_lon"),
    ("Total Assessed Value", "assess.total_assessed_value"),
    ("Assessment Year", "assess.current_assessment_year"),
    ("Assessment URL", "assess.detail_url"),
    ("Walkscore URL", "walk_url"),
    ("Flood URL", "flood_url"),
]


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[t.csv_cell(c) for c in columns])


def csv_lines(df: DataFrame, columns: dict[str, str], order: str | None = None) -> Iterator[str]:
    """Heading and rows, built by the executors, fetched one partition at a time, in order."""
    header = ",".join('"' + h.replace('"', '""') + '"' if any(c in h for c in '",\r\n') else h for h in columns)
    yield header
    there = [F.col(c) for c in columns.values()]
    rows = df.orderBy(order) if order else df
    for r in rows.select(csv_line(there).alias("line")).toLocalIterator():
        yield r["line"]


def write_csv(df: DataFrame, path: str, columns: dict[str, str], order: str | None = None) -> int:
    """One local file: UTF-8 with a byte order mark, lines ended by CRLF, rows in input order. Returns the number of rows."""
    n = -1
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        for n, line in enumerate(csv_lines(df, columns, order)):
            f.write(line + "\r\n")
    return max(n, 0)


def write_csv_folder(df: DataFrame, path: str) -> None:
    """Any size: many files, each with a heading; an existing folder is left alone and is an error."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def dated(name: str, suffix: str = ".csv", day: dt.date | None = None) -> str:
    return f"{name}_{(day or dt.date.today()).isoformat()}{suffix}"


def polygon_json(geom: str = "geom", digits: int = 10) -> Column:
    """A MultiPolygon as GeoJSON text."""
    num = lambda v: F.round(v, digits)
    rings = F.transform(F.col(geom), lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(num(q["x"]), num(q["y"])))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))


def point_json(lon: str = "lon", lat: str = "lat", digits: int = 7) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, digits), F.round(lat, digits)).alias("coordinates")))


def feature_lines(df: DataFrame, properties: list[str], geometry: Column) -> DataFrame:
    """One GeoJSON feature per row, nulls kept."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str, properties: list[str], geometry: Column) -> None:
    """Line-delimited GeoJSON, any size."""
    feature_lines(df, properties, geometry).write.mode("errorifexists").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Line-delimited JSON rows, nulls kept, any size."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_collection(df: DataFrame, path: str, properties: list[str], geometry: Column) -> None:
    """One local FeatureCollection file, streamed partition by partition."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for k, r in enumerate(feature_lines(df, properties, geometry).toLocalIterator()):
            f.write(("," if k else "") + r["value"])
        f.write("]}")
