"""Geometry against closed forms and brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.functions import geometry as g


def poly(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]


SQUARE = poly([(0, 0), (10, 0), (10, 10), (0, 10)])
TRIANGLE = poly([(0, 0), (10, 0), (0, 10)])
HOLED = poly([(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)])
ELL = poly([(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)])


@pytest.mark.parametrize(("a", "b", "want"), [(SQUARE, SQUARE, 100), (SQUARE, TRIANGLE, 50), (HOLED, SQUARE, 64), (ELL, SQUARE, 75), (ELL, TRIANGLE, 50), (HOLED, TRIANGLE, 32)])
def test_overlap(a, b, want):
    assert g.overlap(g._edges_of(a), g._edges_of(b)) == pytest.approx(want)
    assert g.overlap(g._edges_of(b), g._edges_of(a)) == pytest.approx(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=7, unique=True), st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 15), st.integers(1, 15)))
def test_overlap_is_bounded_and_symmetric(pts, box):
    cx, cy = np.mean(pts, axis=0)
    ring = sorted(pts, key=lambda p: math.atan2(p[1] - cy, p[0] - cx))
    x, y, w, h = box
    a, b = g._edges_of(poly(ring)), g._edges_of(poly([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    one, two = g.overlap(a, b), g.overlap(b, a)
    assert one == pytest.approx(two, abs=1e-9)
    assert one <= min(g.area(a), g.area(b)) + 1e-9


def test_inside(spark):
    cases = [(SQUARE, 5, 5, True), (SQUARE, 0, 5, True), (SQUARE, 10, 10, True), (SQUARE, 11, 5, False), (HOLED, 5, 5, False), (HOLED, 2, 5, True), (ELL, 7, 7, False), (ELL, 2, 7, True)]
    df = spark.createDataFrame([(i, p, float(x), float(y)) for i, (p, x, y, _) in enumerate(cases)], f"i int, geom {g.GEOM}, x double, y double")
    got = {r["i"]: r["ok"] for r in df.select("i", g.point_in_polygon("geom", "x", "y").alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
    assert [g.contains(g._edges_of(p), x, y) for p, x, y, _ in cases] == [c[3] for c in cases]


def test_touching():
    far = poly([(20, 20), (30, 20), (30, 30)])
    side = poly([(10, 0), (20, 0), (20, 10), (10, 10)])
    e = g._edges_of
    assert g.touching(e(SQUARE), e(side)) and not g.touching(e(SQUARE), e(far))
    inner = poly([(3, 3), (4, 3), (4, 4)])
    assert g.touching(e(SQUARE), e(inner)) and not g.touching(e(HOLED), e(inner))


def test_point_on_surface():
    for shape in (SQUARE, TRIANGLE, HOLED, ELL):
        e = g._edges_of(shape)
        assert g.contains(e, *g.inner_point(e))


def test_haversine(spark):
    df = spark.createDataFrame([(-97.14, 49.89, -97.14, 49.8901), (-97.14, 49.89, -97.1398, 49.89)], "a double, b double, c double, d double")
    assert [round(r[0], 3) for r in df.select(g.haversine_ft("a", "b", "c", "d")).collect()] == [36.481, 47.007]


def test_geodesic_area_matches_sphere(spark):
    shape = poly([(-97.14, 49.89), (-97.13, 49.89), (-97.13, 49.90), (-97.14, 49.90)])
    df = spark.createDataFrame([(shape,)], f"geom {g.GEOM}")
    want = math.radians(0.01) * (math.sin(math.radians(49.90)) - math.sin(math.radians(49.89))) * g.EARTH_M**2
    row = df.select(g.geodesic_area(F.col("geom")), g.overlap_area_sphere("geom", "geom"), g.area_utm("geom")).first()
    assert row[0] == pytest.approx(want, rel=1e-9)
    assert row[1] == pytest.approx(want, rel=1e-6)
    assert row[2] == pytest.approx(want, rel=0.01)


def test_utm_known_point():
    # on the central meridian of zone 14 at the equator, and a degree east of it: the scale is 0.9996 on the meridian
    east, north = g.utm(np.array([-99.0, -98.0]), np.array([0.0, 0.0]))
    assert east[0] == pytest.approx(500000) and north[0] == pytest.approx(0)
    assert east[1] == pytest.approx(611280.5, abs=5)


def test_crossing_and_nearest(spark):
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    got = spark.range(1).select(
        g.crossing(pt(-1, 0), pt(1, 0), pt(0, -1), pt(0, 1)).alias("hit"),
        g.crossing(pt(-1, 0), pt(1, 0), pt(-1, 1), pt(1, 1)).alias("parallel"),
        g.crossing(pt(-1, 0), pt(1, 0), pt(5, -1), pt(5, 1)).alias("apart"),
        g.nearest_of_main(pt(-1, 0), pt(1, 0), pt(0, 1), pt(0, 2)).alias("near"),
    ).first()
    assert (got["hit"]["x"], got["hit"]["y"]) == (0, 0)
    assert got["parallel"] is None and got["apart"] is None
    assert (got["near"]["dist"], got["near"]["pt"]["x"], got["near"]["pt"]["y"]) == (1.0, 0.0, 0.0)


def test_failed_rows_do_not_fail_the_batch(spark):
    df = spark.createDataFrame([(SQUARE, None), (SQUARE, [[]]), (SQUARE, SQUARE)], f"a {g.GEOM}, b {g.GEOM}")
    assert [r[0] for r in df.select(g.overlap_area("a", "b")).collect()] == [None, 0.0, 100.0]


def test_rectangles_of_a_batch_are_known():
    box = poly([(0, 0), (2, 0), (2, 3), (0, 3), (0, 0)])
    turned = poly([(0, 0), (0, 3), (2, 3), (2, 0), (0, 0)])
    two = [*box, *box]
    bent = poly([(0, 0), (2, 0), (2, 3), (1, 3), (0, 0)])
    ring = pa.array([box, None, turned, two, HOLED, bent, [], [[]], poly([(0, 0), (1, 1)]), box], g._GEOM_TYPE)
    for geom in (ring, ring.slice(2, 3), ring.slice(9, 1)):
        ok, corners = g._rectangles(geom)
        want = [v in (box, turned) for v in geom.to_pylist()]
        assert ok.tolist() == want
        assert all((corners["xmax"][k], corners["ymax"][k]) == (2, 3) for k in np.flatnonzero(ok))
