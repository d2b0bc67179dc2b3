"""Readers, snapshots, caches and exports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cadastra.functions import geometry as g
from cadastra.sources import export, files
from cadastra.operators import overlays


def test_read_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes(b'x,y\r\na,"b,""c"""\r\n\r\nd,"e\nf"\r\ng,h')
    got = files.read_csv(spark, str(p)).collect()
    assert [tuple(r) for r in got] == [("a", 'b,"c"'), ("d", "e\nf"), ("g", "h")]


def test_sites(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('municipality,LATITUDE,LONGITUDE,OPERATION NAME,CSGroup\nHere ,49.1,-97,"A, ""B""",Designated Impacted Site\nThere,1,1,x,\nHERE,,-97,y,\nhere,49,-97,,\n')
    got = files.contaminated_csv(spark, str(p), "here").orderBy(F.desc("lat")).collect()
    assert [(r["OPERATION NAME"], r["colour"]) for r in got] == [('A, "B"', "#e67e22"), ("", "#7f8c8d")]


def test_geojson(spark, tmp_path):
    p = tmp_path / "f.json"
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    feats = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"id": "007", "lot": "1"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": {"id": "8"}},
    ]
    p.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    got = files.read_geojson(spark, str(p), "id string, lot string").orderBy("id").collect()
    assert [(r["id"], len(r["geom"]), r["xmax"], r["ymax"]) for r in got] == [("007", 1, 2.0, 1.0), ("8", 2, 2.0, 1.0)]
    p.write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": "a"}}, {"geometry": {"type": "Point", "coordinates": [1]}, "properties": {"id": "b"}}]}))
    assert [(r["id"], r["lon"], r["lat"]) for r in files.read_geojson(spark, str(p), "id string", "point").collect()] == [("a", 1.0, 2.0)]
    p.write_text(json.dumps({"features": [{"geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"id": "a"}}]}))
    assert files.read_geojson(spark, str(p), "id string", "line").first()["xmax"] == 3.0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert files.snapshots(spark, root) == []
    assert files.write_snapshot(spark.range(2), root, "20240101")
    assert files.write_snapshot(spark.range(3), root, "20240201")
    assert not files.write_snapshot(spark.range(9), root, "20240201")
    with pytest.raises(FileExistsError):
        files.write_snapshot(spark.range(9), root, "20240201", skip_existing=False)
    assert files.snapshot_labels(spark, root) == {"20240201": "2024-02-01 (latest)", "20240101": "2024-01-01"}
    assert files.read_snapshot(spark, root).count() == 3
    assert files.read_snapshot_if_any(spark, root, "19990101") is None


def test_cache_has_an_age_limit(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    get = lambda t: files.cached_table(spark, str(tmp_path), "z", make, files.ZONING_TTL, t).count()
    assert get(now) == 1 and get(now + dt.timedelta(days=6)) == 1 and get(now + dt.timedelta(days=8)) == 2


def test_frame_cache_is_first_in_first_out(spark):
    c = files.FrameCache(2)
    for k in "aba":
        c.get(k, lambda: spark.range(1))
    c.get("c", lambda: spark.range(1))
    assert len(c) == 2
    with pytest.raises(RuntimeError):
        c.get("bad", lambda: (_ for _ in ()).throw(RuntimeError("x")))
    assert "bad" not in c._held


def test_parcel_set_key(spark):
    a = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 3.0, 1.0)], list(g.BOX))
    assert files.parcel_set_key(a) == files.parcel_set_key(a.orderBy(F.desc("xmin"))) != files.parcel_set_key(a.limit(1))


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(2, "x\ny", None), (1, 'q"', "1")], "_ord int, a string, b string")
    p = tmp_path / "o.csv"
    assert export.write_csv(df, str(p), {"A": "a", "B, c": "b"}, "_ord") == 2
    assert p.read_bytes() == '﻿A,"B, c"\r\n"q""",1\r\n"x\ny",\r\n'.encode()
    assert len(export.EXPORT) == 18
    assert export.dated("parcels", day=dt.date(2024, 1, 2)) == "parcels_2024-01-02.csv"


def test_features(spark, tmp_path):
    df = spark.createDataFrame([("1", None, 1.0, 2.0)], "id string, v string, lon double, lat double").withColumn("geom", g.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    got = json.loads(export.feature_lines(df, ["id", "v"], export.point_json()).first()[0])
    assert got == {"type": "Feature", "properties": {"id": "1", "v": None}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}
    export.write_collection(df, str(tmp_path / "c.json"), ["id"], export.polygon_json())
    assert json.loads((tmp_path / "c.json").read_text())["features"][0]["geometry"]["coordinates"][0][0][2] == [1.0, 1.0]


def test_shape_digest(spark):
    df = spark.range(1).select(g.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("geom"))
    assert len(df.select(overlays.shape_digest()).first()[0]) == 32


def test_reference_systems(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"crs": {"properties": {"name": "EPSG:26914"}}, "features": []}))
    assert files.geojson_crs(spark, str(p)) == "EPSG:26914"
    p.write_text('{"features": []}')
    g.crs_matches(files.geojson_crs(spark, str(p)), "EPSG:4326")
    with pytest.raises(ValueError):
        g.crs_matches("EPSG:26914", files.LON_LAT)


def test_tables_of_a_folder(spark, tmp_path):
    for name in ("b", "a"):
        spark.range(1).write.parquet(str(tmp_path / name))
    (tmp_path / "unfinished").mkdir()
    assert files.table_names(spark, str(tmp_path)) == ["a", "b"] and files.table_names(spark, str(tmp_path / "none")) == []
    lines = files.traffic_lines(spark, str(tmp_path / "kept"), lambda: spark.range(3))
    assert lines.count() == files.traffic_lines(spark, str(tmp_path / "kept"), lambda: spark.range(9)).count() == 3
