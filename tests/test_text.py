"""Golden values of text, number and date functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadastra.functions import style
from cadastra.functions import text as t


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_street_names(spark):
    got = values(spark, t.street_name, ["St. Mary's Road", "SAINT MARYS RD", "Rue Désmeurons", "King Edward St & Main Street", "Court  Street-West", "Øst Way", None, ""])
    assert got == ["ST MARYS RD", "ST MARYS RD", "RUE DESMEURONS", "KING EDWARD ST AND MAIN ST", "CRT ST WEST", "ST WY", "", ""]


def test_corridor_key(spark):
    df = spark.createDataFrame([("Main St", "B Ave", "A Ave"), ("Main St", "A Ave", "B Ave"), ("Main St", "", "B Ave")], "s string, a string, b string")
    assert [r[0] for r in df.select(t.corridor_key("s", "a", "b")).collect()] == ["MAIN ST|A AVE|B AVE"] * 2 + [None]


def test_rolls(spark):
    assert values(spark, t.normalize_roll, ["1000001000", "01-000-001-000", "123456789012", "abc", None]) == ["01000001000", "01000001000", "123456789012", None, None]
    assert t.normalize_roll_text("1000001000") == "01000001000"
    assert t.normalize_roll_text("123456789012") == "123456789012"
    assert t.normalize_roll_text("abc") is None


def test_lot_lists(spark):
    lots = [["21", "22", "23", "24", "25"], ["21", "22", "25", "26"], ["3", "1", "2", "2"], ["10", "9", "RL10"], ["", None], []]
    assert values(spark, t.lot_list, lots, "array<string>") == ["21-25", "21-22, 25-26", "1-3", "9, 10, RL10", "", ""]


def test_lists(spark):
    assert values(spark, t.sorted_list, [["10", " 9", "9"], ["b", "a", ""], ["-1.5", "2"]], "array<string>") == ["9, 10", "a, b", "-1.5, 2"]
    assert values(spark, t.first_seen_list, [["b", "a", " b", None]], "array<string>") == ["b, a"]


@pytest.mark.parametrize(("value", "label"), [(999, "999"), (1000, "1k"), (1234, "1.2k"), (9999, "10k"), (12500, "13k"), (31499, "31k")])
def test_volume_label(spark, value, label):
    assert values(spark, t.volume_label, [value], "bigint") == [label]


def test_labels(spark):
    assert values(spark, t.zoning_code, ["R1M - RES - S F - MEDIUM", "C2", None]) == ["R1M", "C2", None]
    assert values(spark, t.street_number_text, ["1129 FIFE STREET", "12A MAIN", "12 1/2 MAIN", "MAIN"]) == ["1129", "12A", "12 1/2", ""]
    assert values(spark, t.csv_cell, ["a,b", 'q"x', None, "a\nb", "plain"]) == ['"a,b"', '"q""x"', "", '"a\nb"', "plain"]
    assert values(spark, t.dollars, ["723000", "0", "", "x", "1234.5"]) == ["$723,000", None, None, None, "$1,235"]
    assert values(spark, t.percent_text, ["0.9", "99.5", None]) == [None, "100%", None]
    assert values(spark, t.coordinate_text, ["49.123456789", ""]) == ["49.123457", None]
    assert values(spark, t.size_text, ["43560", "0"]) == ["43,560 sf (1.00 ac)", None]
    assert values(spark, lambda c: t.shortened(c, 3), ["abcd", "abc"]) == ["abc…", "abc"]
    assert values(spark, t.safe_url, ["HTTPS://x/y", "javascript:alert(1)", "nothing"]) == ["HTTPS://x/y", None, None]
    assert values(spark, t.date_text, ["2024-03-05T10:00:00", "soon", None]) == ["2024-03-05", "soon", ""]


def test_percent_and_rounding(spark):
    assert values(spark, lambda c: t.percent(c, F.lit(1.0)), [0.12345, 0.0095, 0.0094], "double") == [12.3, 1.0, 0.9]
    assert values(spark, t.round_half_up, [-2.5, 2.5, -2.6], "double") == [-2, 3, -3]


def test_numbers_are_finite(spark):
    assert values(spark, t.number, ["", " 7 ", "NaN", "Infinity", "x", None]) == [None, 7.0, None, None, None, None]


def test_links(spark):
    df = spark.createDataFrame([("1 A B, 2 C", "49.1", "-97.2"), ("", "", None)], "a string, lat string, lon string")
    got = df.select(t.address_url("https://w/", "a", ", T"), t.point_url("https://f/", "lat", "lon", "a"), t.record_url("https://r/", "a")).collect()
    assert tuple(got[0]) == ("https://w/1%20A%20B%2C%20T", "https://f/?lat=49.100000&lon=-97.200000&label=1+A+B", "https://r/1%20A%20B%2C%202%20C")
    assert tuple(got[1]) == (None, None, None)


def test_sample_days(spark):
    a = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(a, a), (a, a + dt.timedelta(hours=23, minutes=45)), (None, a)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(t.sample_days("a", "b")).collect()] == [0.01, 1.0, 1.0]


def test_styles(spark):
    assert values(spark, lambda c: style.category(c, style.SITE, style.SITE_OTHER), ["Designated Impacted Site", None]) == ["#e67e22", "#7f8c8d"]
    assert values(spark, lambda c: style.ramp(c, style.POINT_RADIUS), ["0", "2500", "99999", "x"]) == [4.0, 5.0, 14.0, 4.0]
    assert values(spark, style.ramp_color, ["0", "60000"]) == ["#4f9d69", "#7b3f98"]
    assert values(spark, style.zone_label, ["R1-M", "LONGER", None]) == ["R1-M", "", ""]
    assert len(style.ZONING) == 13


def test_popups(spark):
    df = spark.createDataFrame([("1", "A & B", "x", "43560", "2", 3)], "roll_number string, full_address string, property_use_code string, assessed_land_area string, dwelling_units string, u int")
    assert df.select(style.assessment_popup("u")).first()[0] == "<strong>Roll #</strong> 1<br>A &amp; B<br><em>x</em><br><strong>Size</strong> 43,560 sf (1.00 ac)<br><strong>DU</strong> 2<br><small>+ 2 more units</small>"
    s = spark.createDataFrame([("1", None, "3", "")], "lot string, block string, plan string, description string")
    assert s.select(style.survey_popup()).first()[0] == "<strong>Lot</strong> 1&nbsp;<strong>Block</strong> &nbsp;<strong>Plan</strong> 3"
