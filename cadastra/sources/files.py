"""Readers: GeoJSON, JSON rows, CSV, snapshots by date; a cache with an age limit."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

DAY = 86400.0
ZONING_TTL, SITES_TTL, TRAFFIC_TTL = 7 * DAY, 7 * DAY, 30 * DAY

#: The reference system of GeoJSON where a file names none.
LON_LAT = "OGC:CRS84"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cadastra-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Frames that ``written`` gave, and where they are.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: what reads it plans no more than a scan."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def discard(df: DataFrame) -> None:
    """Remove what ``written`` wrote for a frame that nothing reads any more."""
    path = _WRITTEN.pop(df, None)
    if path:
        there = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


# -- files -------------------------------------------------------------------------------------------------------------


def read_geojson(spark: SparkSession, path: str, properties: str, kind: str = "polygon", lines: bool = False) -> DataFrame:
    """Features of a collection as rows: properties (DDL, texts stay texts) and geom, lines or lon and lat, with boxes.

    Polygon and MultiPolygon become multipolygons, LineString and MultiLineString multilines. Points need two coordinates.
    With ``lines`` each line of the files is a feature, so large files are split over tasks.
    """
    feature = f"geometry:struct<type:string,coordinates:string>,properties:struct<{_struct(properties)}>"
    if lines:
        rows = spark.read.schema(feature.replace("geometry:", "geometry ", 1).replace(",properties:", ", properties ", 1)).json(path).select(F.struct("geometry", "properties").alias("f"))
    else:
        rows = spark.read.schema(f"features array<struct<{feature}>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rows = rows.select("f.properties.*", F.col("f.geometry.type").alias("_type"), F.col("f.geometry.coordinates").alias("_raw"))
    if kind == "point":
        xy = F.from_json("_raw", "array<double>")
        rows = rows.withColumn("_xy", xy).where((F.col("_type") == "Point") & (F.size("_xy") == 2))
        return rows.withColumns({"lon": F.col("_xy")[0], "lat": F.col("_xy")[1]}).drop("_xy", "_raw", "_type")
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda r: F.transform(r, pt)
    if kind == "line":
        many = F.transform(F.from_json("_raw", "array<array<array<double>>>"), line)
        one = F.array(line(F.from_json("_raw", "array<array<double>>")))
        return g.with_box(rows.withColumn("lines", F.when(F.col("_type") == "MultiLineString", many).when(F.col("_type") == "LineString", one)).drop("_raw", "_type"), "lines", 2)
    poly = lambda p: F.transform(p, line)
    many = F.transform(F.from_json("_raw", "array<array<array<array<double>>>>"), poly)
    one = F.array(poly(F.from_json("_raw", "array<array<array<double>>>")))
    return g.with_box(rows.withColumn("geom", F.when(F.col("_type") == "MultiPolygon", many).when(F.col("_type") == "Polygon", one)).drop("_raw", "_type"))


def _struct(ddl: str) -> str:
    return ",".join(f"{n}:{k}" for n, k in (f.strip().rsplit(" ", 1) for f in ddl.split(",")))


def geojson_crs(spark: SparkSession, path: str) -> str:
    """The reference system that a collection names, else LON_LAT."""
    named = spark.read.schema("crs struct<properties:struct<name:string>>").option("multiLine", True).json(path).select("crs.properties.name").first()
    return named[0] if named and named[0] else LON_LAT


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of flat rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts; quoted fields may hold commas, line ends and doubled quotes; blank lines are skipped."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)


# -- snapshots ---------------------------------------------------------------------------------------------------------


def write_snapshot(df: DataFrame, root: str, date: str, *, skip_existing: bool = True) -> bool:
    """A dated snapshot; one that is there stays. False if it was."""
    if date in snapshots(df.sparkSession, root):
        if skip_existing:
            return False
        raise FileExistsError(f"{root}/snapshot_date={date}")
    df.write.mode("errorifexists").parquet(f"{root}/snapshot_date={date}")
    return True


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Dates of snapshots, the newest first; unfinished ones have no _SUCCESS and are left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for p in [s.getPath() for s in fs.listStatus(path)]:
        m = re.fullmatch(r"snapshot_date=(\d{8})", p.getName())
        if m and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
            found.append(m[1])
    return sorted(found, reverse=True)


def snapshot_labels(spark: SparkSession, root: str) -> dict[str, str]:
    """Date -> label, the newest marked."""
    return {d: f"{d[:4]}-{d[4:6]}-{d[6:]}" + (" (latest)" if k == 0 else "") for k, d in enumerate(snapshots(spark, root))}


def read_snapshot(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    found = snapshots(spark, root)
    date = date or (found[0] if found else None)
    if date not in found:
        raise FileNotFoundError(f"no snapshot {date} in {root}")
    return spark.read.parquet(f"{root}/snapshot_date={date}")


def table_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the finished tables in a folder, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_snapshot_if_any(spark: SparkSession, root: str, date: str) -> DataFrame | None:
    return read_snapshot(spark, root, date) if date in snapshots(spark, root) else None


# -- caches ------------------------------------------------------------------------------------------------------------


def cached_table(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame], ttl: float, now: dt.datetime | None = None) -> DataFrame:
    """A table written at most ``ttl`` seconds ago, else made and written anew under the time of writing."""
    now = now or dt.datetime.now(dt.timezone.utc)
    stamp = lambda d: d.strftime("%Y%m%d%H%M%S")
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = stamp(now - dt.timedelta(seconds=ttl))
    if fs.exists(base):
        fresh = sorted(p for p in (s.getPath().getName() for s in fs.listStatus(base)) if p.startswith("written_at=") and oldest <= p[11:] <= stamp(now) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{p}/_SUCCESS")))
        if fresh:
            return spark.read.parquet(f"{root}/{name}/{fresh[-1]}")
    path = f"{root}/{name}/written_at={stamp(now)}"
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def traffic_lines(spark: SparkSession, root: str, make: Callable[[], DataFrame], now: dt.datetime | None = None) -> DataFrame:
    """The lines layer of traffic volumes, made anew when it is older than TRAFFIC_TTL."""
    return cached_table(spark, root, "traffic_lines", make, TRAFFIC_TTL, now)


class FrameCache:
    """At most ``size`` persisted frames by key; the first in is the first out. One maker per key at a time; failures leave nothing."""

    def __init__(self, size: int = 8):
        self.size, self._held, self._lock = size, OrderedDict(), threading.Lock()

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if key not in self._held:
                self._held[key] = make().persist()
                while len(self._held) > self.size:
                    self._held.popitem(last=False)[1].unpersist()
            return self._held[key]

    def __len__(self) -> int:
        return len(self._held)


def parcel_set_key(parcels: DataFrame) -> str:
    """A digest of the boxes of a set of parcels, in any order: a sum over rows, so nothing is gathered."""
    h = F.conv(F.substring(F.md5(g.box_key(5).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    row = parcels.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return f"{row[0]}-{row[1]}"


def contaminated_csv(spark: SparkSession, path: str, municipality: str) -> DataFrame:
    from ..operators.overlays import contaminated_sites

    return contaminated_sites(read_csv(spark, path), municipality)


def typed_assessment(df: DataFrame) -> DataFrame:
    """Numbers of the text columns of assessments, next to them."""
    return df.withColumns({f"{c}_num": t.number(c) for c in ("dwelling_units", "assessed_land_area", "centroid_lat", "centroid_lon") if c in df.columns} | ({"value": F.col("total_assessed_value").try_cast("decimal(18,2)")} if "total_assessed_value" in df.columns else {}))
