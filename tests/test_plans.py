"""Searches and jobs from end to end."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cadastra.functions import geometry as g
from cadastra.operators import tables
from cadastra.plans import search as s
from cadastra.plans import xref
from cadastra.sources import export

CELL = 0.001


def shaped(df):
    return df.withColumn("geom", g.rectangle(*g.BOX))


@pytest.fixture(scope="module")
def city(spark):
    """Two lots and a third next to them; one roll on two lots, two rolls on the third."""
    box = "xmin double, ymin double, xmax double, ymax double"
    lots = [(0.0, 0.0, 0.001, 0.001, 1, "L1", "21", "3", "129"), (0.001, 0.0, 0.002, 0.001, 2, "L2", "22", "3", "129"), (0.002, 0.0, 0.003, 0.001, 3, "L3", "7", None, "55")]
    survey = shaped(spark.createDataFrame(lots, f"{box}, _ord int, id string, lot string, block string, plan string")).withColumn("description", F.lit("d"))
    rolls = [
        (0.0, 0.0, 0.002, 0.001, 1, "01000000001", "400 H STREET", "R1M - RES", "0.0005", "0.001", "5000", "0"),
        (0.002, 0.0, 0.0025, 0.001, 2, "01000000002", "500 K ST", "C2", "0.0005", "0.00225", "100", "2"),
        (0.0025, 0.0, 0.003, 0.001, 3, "01000000003", "502 K ST", "C2", "0.0005", "0.00275", "200", "3"),
    ]
    assess = shaped(spark.createDataFrame(rolls, f"{box}, _ord int, roll_number string, full_address string, zoning string, centroid_lat string, centroid_lon string, assessed_land_area string, dwelling_units string"))
    assess = assess.withColumns({"property_use_code": F.lit("P"), "total_assessed_value": F.lit("723000"), "detail_url": F.lit(None).cast("string"), "current_assessment_year": F.lit("2024")})
    assess = assess.withColumns({"street_number": F.substring_index("full_address", " ", 1).cast("bigint"), "street_name": F.substring_index("full_address", " ", -2)})
    addresses = spark.createDataFrame([("440 H ST", 440, "H ST", 0.0012, 0.0005), ("500 K ST", 500, "K ST", 0.0021, 0.0004)], "full_address string, street_number bigint, street_name string, lon double, lat double")
    zones = shaped(spark.createDataFrame([(0.0, 0.0, 0.0014, 0.001, 1, "R1-M"), (0.0014, 0.0, 0.01, 0.001, 2, "C2")], f"{box}, _ord int, zoning string"))
    return s.Sources(survey, assess, addresses, zones, CELL, "https://r/", "https://w/", ", T", "https://f/")


def test_legal_search(city):
    got = s.search(city, plan="129")
    rows = {r["survey"]["id"]: r for r in got.rows.collect()}
    assert got.flow == "legal" and set(rows) == {"L1", "L2"}
    assert rows["L1"]["assess"]["roll_number"] == "01000000001" and not rows["L1"]["partial"]
    assert rows["L1"]["assess"]["full_address"] == "400 H STREET, 440 H ST"
    assert (rows["L1"]["assess"]["zoning_top1"], rows["L1"]["assess"]["zoning_top1_pct"], rows["L1"]["assess"]["zoning_top2"]) == ("R1-M", 70.0, "C2")
    assert [r["_rowKey"] for r in got.assess.collect()] == ["s:L1"]
    split = s.search(city, lot="7").rows.first()
    assert split["partial"] and split["assess"]["roll_number"] == "01000000002, 01000000003" and split["assess"]["assessed_land_area"] == "300"


def test_assessment_search(city):
    got = s.search(city, roll="01000000001", plan="55")
    row = got.rows.first()
    assert got.flow == "assessment" and got.notes and row["survey"]["lot"] == "21-22" and row["survey"]["plan"] == "129"
    # the lot's other roll is not in the search, and still makes it partial
    one = s.search(city, roll="01000000002").rows.first()
    assert one["survey"]["lot"] == "7 (partial)"
    assert sorted(r["id"] for r in got.survey.collect()) == ["L1", "L2"]


def test_search_by_address_points(city):
    got = s.search(city, address_from="440", address_to="440", address_street="h st")
    assert [r["assess"]["roll_number"] for r in got.rows.collect()] == ["01000000001"]
    assert s.search(city, address_from="440", du_mode="min", du_min=1, address_street="h").rows.count() == 0


def test_search_without_a_table_that_fails(city):
    from dataclasses import replace

    got = s.search(replace(city, zones=city.zones.drop("zoning")), plan="129")
    assert len(got.notes) == 1 and got.notes[0].startswith("zones are left out")
    assert {r["assess"]["zoning_top1"] for r in got.rows.collect()} == {None}
    both = s.layers(got)
    assert sorted(r["parcel_layer"] for r in both.collect()) == ["assess", "survey", "survey"]
    got.release()


def test_parts_read_what_was_written(spark, city):
    """parts of a result scan what was written once, and a table of the rows alone needs no matches (F2)"""
    got = s.search(city, roll="01000000002")
    assert got.kept == []
    assert got.alone.select("assess.roll_number", "survey").collect() == [("01000000002", None)]
    assert len(got.kept) == 2 and "JOIN" not in got.alone._jdf.queryExecution().optimizedPlan().toString().upper()
    plan = got.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Python" not in plan and len(plan) < 60_000
    paths = [df.inputFiles()[0] for df in got.kept if df.inputFiles()]
    got.release()
    assert paths and not any(Path(p.removeprefix("file://")).exists() for p in paths)


def test_no_input(city):
    with pytest.raises(ValueError):
        s.search(city, lot="", roll=None, du_mode="any")
    assert s.missing_rolls("1, 2 3", 1) == 2 and s.missing_rolls("1", 0) == 0


def test_display_and_export(spark, city, tmp_path):
    rows = s.display(city, s.search(city, du_mode="zero").rows)
    r = rows.first()
    assert (r["zoning_code"], r["zoning_pct_text"], r["zoning_2_text"], r["area"], r["value"]) == ("R1-M", "70%", "C2 (30%)", "5,000", "$723,000")
    assert r["walk_url"] == "https://w/400%20H%20STREET%2C%20T" and r["flood_url"].startswith("https://f/?lat=0.000500&lon=0.001000&label=400")
    assert tables.sort_rows(rows.withColumn("roll_number", F.col("roll_number")), "roll").count() == 1
    assert export.write_csv(rows, str(tmp_path / "x.csv"), dict(export.EXPORT), "_ord") == 1
    assert (tmp_path / "x.csv").read_text("utf-8-sig").splitlines()[1].startswith("21-22,3,129,d,01000000001,")


def test_cross_reference(spark, city, tmp_path):
    got = xref.ordered(xref.cross_reference(xref.pairs(city.survey, city.assess, CELL))).collect()
    assert len(got[0]) == 15
    assert [(r["Roll_Number"], r["Survey_ID"]) for r in got] == [("01000000001", "L1"), ("01000000001", "L2"), ("01000000002", "L3"), ("01000000003", "L3")]
    assert got[0]["Overlap_Pct_Survey"] == 100.0 and got[0]["Overlap_Pct_Assess"] == 50.0


def test_trivial_overlaps_go(spark):
    base = {c: None for c in ("r_full_address", "r_zoning", "r_centroid_lat", "r_centroid_lon", "l_lot", "l_block", "l_plan", "l_description")}
    rows = [base | {"r_roll_number": "a", "l_id": "1", "l_m2": 10000.0, "r_m2": 10000.0, "shared": 4.0}, base | {"r_roll_number": "b", "l_id": "2", "l_m2": 10000.0, "r_m2": 2000.0, "shared": 4.0}]
    ddl = ", ".join(f"{k} {'double' if k in ('l_m2', 'r_m2', 'shared') else 'string'}" for k in rows[0])
    assert [r["Roll_Number"] for r in xref.cross_reference(spark.createDataFrame(rows, ddl)).collect()] == ["b"]


def test_snapshot_search(spark):
    survey = spark.createDataFrame([("1", "5", None, "P1", "x"), ("2", "6", "B", "P1", "y")], "id string, lot string, block string, plan string, description string").withColumns({c: F.lit(0) for c in ("geom", *g.BOX)})
    x = spark.createDataFrame([("r", "5", None, "P1"), ("r", "5", None, "P1")], "Roll_Number string, Lot string, Block string, Plan string")
    got = s.search_snapshot(survey, x, plan="P1").rows.collect()
    assert [(r["id"], r["x_Roll_Number"]) for r in got] == [("1", "r"), ("2", None)]
    assert s.search_snapshot(survey, None, plan="p1").rows.count() == 0
    assert s.search_snapshot(survey).rows.count() == 0


def test_streams(spark, tmp_path):
    import datetime as dt

    from cadastra.streaming import counts

    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", "M", "A", "B", None, t0 + dt.timedelta(minutes=15 * k), 1, "x", 2) for k in range(200)]
    ddl = "study_id string, street string, street_from string, street_to string, location_description string, ts timestamp, count_15_minutes bigint, site string, total bigint"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    for name, f, want in (("daily", counts.daily, 2), ("trail", counts.trailing_day, 200 - 2)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name)
        assert got.count() > 0
    assert spark.table("daily").where("intervals = 96").count() == 2
    assert spark.table("trail").agg(F.max("interval_count")).first()[0] == 96
