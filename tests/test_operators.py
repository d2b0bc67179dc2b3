"""Relational fixtures: matches, merges, zoning, traffic, order, unions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadastra.functions import geometry as g
from cadastra.operators import merge, overlays, predicates, spatial, tables, traffic, zoning


def rects(spark, rows, names):
    """Rows that begin with x0, y0, x1, y1."""
    df = spark.createDataFrame([(*map(float, r[:4]), *r[4:]) for r in rows], [*g.BOX, *names])
    return df.withColumn("geom", g.rectangle(*g.BOX))


def test_wildcards_and_backslash(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a\\b",), ("100%",)], "v string")
    hits = lambda v: {r[0] for r in df.where(predicates.contains("v", v)).collect()}
    assert hits("A_B") == {"a_b", "axb", "a\\b"}
    assert hits("a\\b") == {"a\\b"}


def test_predicates_of_nothing(spark):
    df = spark.createDataFrame([("300", "R1-M"), ("01000001000", "R1M")], "roll_number string, zoning string")
    assert predicates.rolls("abc, def") is None and predicates.zoning("--") is None and predicates.dwelling_units("min", 0) is None
    assert predicates.select_all(df, [predicates.rolls("abc, def"), None]).count() == 0
    assert df.where(predicates.rolls("300")).count() == 1
    assert df.where(predicates.rolls("1000001000, 03093017710")).count() == 1
    assert df.where(predicates.zoning("R-1-M")).count() == 2


@pytest.mark.parametrize(("value", "want"), [("12abc", 12), ("-5", None), ("x", None), (None, None), (" +7", 7)])
def test_street_number(value, want):
    assert predicates.street_number(value) == want


def test_roll_list_is_whole(spark):
    df = spark.range(700).select(F.lpad(F.col("id").cast("string"), 11, "0").alias("roll_number"))
    asked = " ".join(map(str, range(600)))
    assert df.where(predicates.rolls(asked)).count() == 600
    assert df.where(predicates.rolls(asked, most=predicates.MOST_ROLLS)).count() == predicates.MOST_ROLLS


def test_numbered_is_a_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = {r["v"]: r["pos"] for r in tables.numbered(df, [F.desc("v")]).collect()}
    assert got == {v: k for k, v in enumerate(sorted((i * 7919 % 1009 for i in range(1000)), reverse=True), 1)}


def test_truncation(spark):
    df = spark.range(1001)
    assert not tables.limited(df.where("id < 1000"), 1000, ["id"]).truncated
    got = tables.limited(df, 1000, ["id"])
    assert got.truncated and got.rows.count() == 1000 and tables.any_truncated([got])
    with pytest.raises(tables.TooManyRows):
        got.whole()


def test_sort_blanks_last(spark):
    df = spark.createDataFrame([(0, None), (1, "9"), (2, "10"), (3, ""), (4, "x")], "_ord int, roll_number string")
    up = [r["_ord"] for r in tables.sort_rows(df).collect()]
    down = [r["_ord"] for r in tables.sort_rows(df, ascending=False).collect()]
    assert up == [1, 2, 4, 0, 3] and down == [4, 2, 1, 0, 3]
    assert len(tables.SORT_KEYS) == 15


def test_union_first_seen(spark):
    a = spark.createDataFrame([("k", "direct", 5), (None, "n1", 1)], "k string, v string, _ord int")
    b = spark.createDataFrame([("k", "other", 0), (None, "n2", 2), ("j", "j", 3)], "k string, v string, _ord int")
    assert sorted(r["v"] for r in tables.union_first_seen([a, b], "k").collect()) == ["direct", "j", "n1", "n2"]


def test_condo_stack(spark):
    rows = [(i, "same", f"{i:02d} A ST") for i in range(52)] + [(99, None, "lost")]
    got = tables.dedupe_by_key(spark.createDataFrame(rows, "_ord int, key string, full_address string"), "key", "_ord").collect()
    assert len(got) == 1 and got[0]["_unitCount"] == 52 and got[0]["_addresses"] == [f"{i:02d} A ST" for i in range(5)] and got[0]["_ord"] == 0


def test_mode_ties(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, "a")], "_ord int, y string")
    assert tables.mode_first(df, "y", "_ord").first()["y"] == "a"


def test_title_case(spark):
    assert tables.title_case(spark.range(1).withColumn("roll_number", F.lit(1)), ["roll_number", "nope"]).columns == ["Roll Number"]


def test_grid_join_is_the_nested_loop(spark):
    import random

    rng = random.Random(3)
    box = lambda most: (x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.choice([0, rng.uniform(0, most)]), y + rng.uniform(0, most))
    left, right = [(*box(4), i) for i in range(150)], [(*box(rng.choice([3, 90])), i) for i in range(150)]
    met = lambda a, b: a[2] >= b[0] and a[0] <= b[2] and a[3] >= b[1] and a[1] <= b[3]
    want = sorted((a[4], b[4]) for a in left for b in right if met(a, b))
    got = spatial.grid_join(rects(spark, left, ["id"]), rects(spark, right, ["id"]), 2.0).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == want


def test_containment_and_intersection(spark):
    parcel = rects(spark, [(50, 50, 51, 51, 1)], ["id"])
    zone = rects(spark, [(0, 0, 100, 100, 7)], ["id"])
    assert spatial.box_semi_join(zone, parcel, 1.0, "id", mode="compat").count() == 0
    assert spatial.box_semi_join(zone, parcel, 1.0, "id").count() == 1
    assert spatial.union_box_filter(zone, parcel).count() == 1


def match_set(spark, lots, rolls, centroid=True):
    s = rects(spark, lots, ["_ord"])
    a = rects(spark, rolls, ["_ord"])
    cx, cy = g.center(F.col)
    a = a.withColumns({"centroid_lon": cx.cast("string") if centroid else F.lit(None).cast("string"), "centroid_lat": cy.cast("string")})
    m = spatial.parcel_matches(s, a, 4.0)
    return sorted((r["s_id"], r["a_id"]) for r in m.collect()), m


def test_matches(spark):
    three, m = match_set(spark, [(0, 0, 10, 10, 1), (10, 0, 20, 10, 2), (20, 0, 30, 10, 3)], [(0, 0, 30, 10, 9)])
    assert three == [(1, 9), (2, 9), (3, 9)] and spatial.partial_lots(m).count() == 0
    two, m = match_set(spark, [(0, 0, 10, 10, 1)], [(0, 0, 4, 10, 8), (5, 0, 10, 10, 9)])
    assert two == [(1, 8), (1, 9)] and [r[0] for r in spatial.partial_lots(m).collect()] == [1]
    assert match_set(spark, [(0, 0, 10, 10, 1)], [(10, 0, 20, 10, 9)])[0] == []
    assert match_set(spark, [(0, 0, 10, 10, 1)], [(10, 0, 20, 10, 9)], centroid=False)[0] == [(1, 9)]


def merge_lots(spark, rows):
    df = spark.createDataFrame([(1, i, str(i), lot, None, plan, "d", part) for i, (lot, plan, part) in enumerate(rows)], "grp int, _ord int, id string, lot string, block string, plan string, description string, partial boolean")
    return merge.merge_lots(df, "grp").first()["survey"]["lot"]


def test_merge_lots(spark):
    many = [(str(n), "129", False) for n in [*range(21, 26), *range(68, 76), 120, 121]] + [(str(n), "24208", False) for n in (39, 41, 44, 45, 46)]
    assert merge_lots(spark, many) == "21-25, 68-75, 120-121 (Pl 129); 39, 41, 44-46 (Pl 24208)"
    assert merge_lots(spark, [("7", "1", True)]) == "7 (partial)"
    assert merge_lots(spark, [("7", "1", False)]) == "7"
    assert merge_lots(spark, [("1", "1", False), ("2", "1", False), ("5", "1", True)]) == "1-2, 5 (partial)"


def test_merge_rolls(spark):
    cols = ["roll_number", "full_address", "zoning", "assessed_land_area", "centroid_lat", "centroid_lon", "total_assessed_value"]
    rows = [(1, 2, "b", "X", "R2", "10", "1", "2", "5"), (1, 1, "a", "Y", "R1", "5.5", "3", "4", "6"), (2, 3, "c", "Z", None, None, "7", "8", "9")]
    df = spark.createDataFrame(rows, ["grp", "_ord", *cols])
    got = {r["grp"]: r["assess"] for r in merge.merge_rolls(df, "grp", cols).collect()}
    assert tuple(got[1]) == ("a, b", "Y, X", "R1, R2", "15.5", "3", "4", None)
    assert tuple(got[2]) == ("c", "Z", None, None, "7", "8", "9")


def test_address_list(spark):
    df = spark.createDataFrame([("400 H STREET", ["440 H ST"]), ("400 H", []), (None, ["2 B", "1 A "]), ("1 A", ["2 B", "1 A"])], "p string, f array<string>")
    assert [r[0] for r in df.select(merge.address_list(F.col("p"), F.col("f"))).collect()] == ["400 H STREET, 440 H ST", "400 H", "1 A, 2 B", "1 A, 2 B"]


def test_zoning_split(spark):
    parcel = rects(spark, [(0, 0, 10, 10, 1)], ["_ord"])
    zones = lambda cut: rects(spark, [(0, 0, cut, 10, 1, "A"), (cut, 0, 10, 10, 2, "B")], ["_ord", "zoning"])
    got = lambda cut: zoning.enrich(parcel, zones(cut), 4.0).select("zoning_top1", "zoning_top1_pct", "zoning_top2", "zoning_top2_pct").first()
    assert tuple(got(7.0)) == ("A", 70.0, "B", 30.0)
    assert tuple(got(9.95))[2:] == (None, None)


def test_zoning_null_code_and_ties(spark):
    rows = [(1, None, 5.0, 10.0, 2), (1, "B", 5.0, 10.0, 1)]
    got = zoning.top_two(spark.createDataFrame(rows, "p int, code string, m double, whole double, z int"), "p", "code", "m", "whole", "z").first()
    assert tuple(got) == (1, "B", 50.0, "?", 50.0)


def test_stations_take_96_quarters(spark):
    end = dt.datetime(2024, 5, 2, 12)
    rows = [("s", -97.0, 49.0, end - dt.timedelta(minutes=15 * k), 1 if k < 96 else 1000) for k in range(97)] + [("t", None, 49.0, end, 5)]
    got = traffic.station_rows(spark.createDataFrame(rows, "site string, lon double, lat double, timestamp timestamp_ntz, total bigint")).collect()
    assert len(got) == 1 and got[0]["interval_count"] == 96 and got[0]["avg_daily_volume"] == 96


def study(i, total, day, street="Main St", a="A Ave", b="B Ave", days=1):
    return (i, street, a, b, None, dt.datetime(2024, 1, day), dt.datetime(2024, 1, day), total, 96, days)


STUDY = "study_id string, street string, street_from string, street_to string, location_description string, min_count_date timestamp_ntz, max_count_date timestamp_ntz, total bigint, intervals bigint, sample_days bigint"


def test_latest_valid_study(spark):
    df = spark.createDataFrame([study("old", 500, 1), study("new", 0, 9), study("back", 400, 2, a="B Ave", b="A Ave")], STUDY)
    got = traffic.latest_per_corridor(df).collect()
    assert [(r["study_id"], r["avg_daily_volume"]) for r in got] == [("back", 400)]


def road(i, name, pts):
    return (i, str(i), name, None, None, None, [[{"x": float(x), "y": float(y)} for x, y in pts]])


ROAD = f"_ord int, segment_id string, full_name string, st_name string, st_type string, st_dir string, lines {g.LINES}"


def test_corridors(spark):
    roads = [road(1, "Main Street", [(0, 0), (0.01, 0)]), road(2, "Main St", [(0.01, 0), (0.02, 0)]), road(3, "A Ave", [(0, -0.01), (0, 0.01)]), road(4, "B Ave", [(0.02, 0.001), (0.02, 0.02)]), road(5, "C Ave", [(0.02, 0.002), (0.02, 0.02)])]
    r = spark.createDataFrame(roads, ROAD)
    rows = spark.createDataFrame([study("1", 500, 1), study("2", 500, 1, b="C Ave")], STUDY)
    got = traffic.corridors(traffic.latest_per_corridor(rows), r).collect()
    # the exact crossing at A, the snap at B; C is too far away
    assert sorted((x["study_id"], x["segment_id"], x["match_type"]) for x in got) == [("1", "1", "road segment"), ("1", "2", "road segment")]
    best = traffic.best_per_segment(traffic.corridors(traffic.latest_per_corridor(rows), r))
    assert best.count() == 2


def test_dimensions(spark):
    df = rects(spark, [(-97.14, 49.89, -97.1398, 49.8901, 1), (-97.1398, 49.89, -97.1396, 49.8901, 2)], ["_ord"])
    got = overlays.edge_dimensions(df).collect()
    assert len(got) == 7 and {r["label"] for r in got} == {"36 ft", "47 ft"}
    tiny = rects(spark, [(0, 0, 0.1, 0.00001, 1)], ["_ord"])
    assert overlays.edge_dimensions(tiny).count() == 2


def test_overlays(spark):
    one = spark.createDataFrame([("P",)], "precinct_name string")
    two = spark.createDataFrame([("F",)], "feature_name string")
    got = {(r["plan_kind"], r["label"], r["fill"]) for r in overlays.secondary_plans(one, two).collect()}
    assert got == {("Precinct", "P", "#8e6cb3"), ("Major Redevelopment", "F", "#c47bd6")}
    assert [r["fill"] for r in overlays.malls_and_corridors(two, two, two).collect()] == ["#2c8aa8", "#4fb3c7", "#1f6680"]


def test_tile_layers(spark):
    df = rects(spark, [(0, 0, 4, 4, "2"), (0, 0, 4, 4, "1"), (5, 5, 6, 6, "3")], ["roll_number"]).withColumns({c: F.lit("x") for c in overlays.TILE_COLUMNS[1:]})
    polygons, labels = overlays.tile_layers(df)
    assert sorted(r["roll_number"] for r in polygons.collect()) == ["1", "3"]
    assert all(0 < r["lon"] < 6 and 0 < r["lat"] < 6 for r in labels.collect())


def test_volumes_of_one_branch(spark):
    def broken():
        raise OSError("away")

    one = spark.createDataFrame([("a", 1)], "site string, v int")
    rows, said = traffic.volumes(broken, lambda: one)
    assert rows.collect() == one.collect() and said == ["stations are left out: OSError"]
    with pytest.raises(RuntimeError):
        traffic.volumes(broken, broken)


def test_days_of_a_study_without_sample_days(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(2, t0, t0), (0, t0, t0 + dt.timedelta(days=3)), (None, None, t0)], "d int, a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(traffic.study_days(F.col("d"), F.col("a"), F.col("b"))).collect()] == [2.0, 3.01, 1.0]


def test_known_grids_give_the_same_pairs(spark):
    boxes = spark.createDataFrame([(k, k * 7 % 90, k * 13 % 90, k * 7 % 90 + 1 + k * k % 300, k * 13 % 90 + 2) for k in range(40)], "id long, xmin long, ymin long, xmax long, ymax long")
    pairs = lambda grid: sorted(tuple(r) for r in spatial.grid_join(boxes, boxes, grid).select("l_id", "r_id").collect())
    want = pairs(8)
    assert len(want) > 40
    for meet in ((0,), (0, 1), (0, 2), (0, 1, 2, 3)):
        assert pairs(spatial.Grid(8, meet)) == want
