"""Geometry: points, boxes, lines and multipolygons as nested arrays.

A polygon column is ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>> (polygons, rings, points;
rings count by the even-odd rule, so holes and slightly invalid shapes need no
repair), a line column ARRAY<ARRAY<STRUCT<x, y>>>. What Catalyst can express
stays an expression; polygon tests and areas are Arrow functions that work on
whole batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINES = f"array<array<{POINT}>>"
GEOM = f"array<array<array<{POINT}>>>"
BOX = ("xmin", "ymin", "xmax", "ymax")
EARTH_M, EARTH_HAVERSINE_M, FEET = 6378137.0, 6371000.0, 3.28084
SQFT = 10.7639

# -- expressions -------------------------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rectangle(x0, y0, x1, y1) -> Column:
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return F.array(F.array(ring))


def with_box(df: DataFrame, geom: str = "geom", depth: int = 3) -> DataFrame:
    """xmin, ymin, xmax and ymax of a column of polygons (depth 3) or lines (depth 2)."""
    points = F.col(geom)
    for _ in range(depth - 1):
        points = F.flatten(points)
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return df.withColumns({"xmin": side(F.array_min, "x"), "ymin": side(F.array_min, "y"), "xmax": side(F.array_max, "x"), "ymax": side(F.array_max, "y")})


def extent(df: DataFrame) -> DataFrame:
    """One row: the box of all boxes."""
    return df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def boxes_overlap(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Boxes that meet, touching included; a and b give the columns of either side."""
    return (a("xmax") >= b("xmin")) & (a("xmin") <= b("xmax")) & (a("ymax") >= b("ymin")) & (a("ymin") <= b("ymax"))


def box_within(inner: Callable[[str], Column], outer: Callable[[str], Column], pad: float = 0.0) -> Column:
    """A box wholly inside another one that is padded."""
    return (inner("xmin") >= outer("xmin") - pad) & (inner("xmax") <= outer("xmax") + pad) & (inner("ymin") >= outer("ymin") - pad) & (inner("ymax") <= outer("ymax") + pad)


def center(df_col: Callable[[str], Column]) -> tuple[Column, Column]:
    return (df_col("xmin") + df_col("xmax")) / 2, (df_col("ymin") + df_col("ymax")) / 2


def box_key(digits: int = 6) -> Column:
    """A text that boxes equal to ``digits`` decimals share."""
    return F.format_string(",".join([f"%.{digits}f"] * 4), *[F.col(c).cast("double") for c in BOX])


def distance_sq(ax, ay, bx, by) -> Column:
    return (_c(ax) - _c(bx)) * (_c(ax) - _c(bx)) + (_c(ay) - _c(by)) * (_c(ay) - _c(by))


def haversine_ft(lon1, lat1, lon2, lat2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return F.lit(2 * EARTH_HAVERSINE_M * FEET) * F.asin(F.sqrt(half))


def edges(line: Column) -> Column:
    """Array of (a, b): neighbouring points of an array of points."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>"))


def segments(lines: Column) -> Column:
    """All edges of lines, one after the other."""
    return F.flatten(F.transform(lines, edges))


def edge_key(ax, ay, bx, by, digits: int = 6) -> Column:
    """The same text for both directions of an edge."""
    p = F.format_string(f"%.{digits}f,%.{digits}f", _c(ax).cast("double"), _c(ay).cast("double"))
    q = F.format_string(f"%.{digits}f,%.{digits}f", _c(bx).cast("double"), _c(by).cast("double"))
    return F.concat_ws("|", F.least(p, q), F.greatest(p, q))


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point that segments a-b and c-d share, null if parallel or apart."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - d["x"], c["y"] - d["y"]
    den = ux * vy - uy * vx
    p, q = a["x"] * b["y"] - a["y"] * b["x"], c["x"] * d["y"] - c["y"] * d["x"]
    ok = F.abs(den) >= 1e-14
    x, y = F.try_divide(p * vx - ux * q, den), F.try_divide(p * vy - uy * q, den)
    for lo, hi in ((a, b), (c, d)):
        ok &= x.between(F.least(lo["x"], hi["x"]) - 1e-10, F.greatest(lo["x"], hi["x"]) + 1e-10)
        ok &= y.between(F.least(lo["y"], hi["y"]) - 1e-10, F.greatest(lo["y"], hi["y"]) + 1e-10)
    return F.when(ok, F.struct(x.alias("x"), y.alias("y")))


def nearest_on_segment(p: Column, a: Column, b: Column) -> Column:
    """The point of a-b nearest to p."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.struct((a["x"] + dx * t).alias("x"), (a["y"] + dy * t).alias("y"))


def nearest_of_main(ma: Column, mb: Column, ca: Column, cb: Column) -> Column:
    """(dist, rank, pt): the point of the main segment nearest to the cross segment; ends are tried in turn, the first wins ties."""
    tried = []
    for end in (ca, cb):
        at = nearest_on_segment(end, ma, mb)
        tried.append((distance_sq(at["x"], at["y"], end["x"], end["y"]), at))
    for end in (ma, mb):
        at = nearest_on_segment(end, ca, cb)
        tried.append((distance_sq(end["x"], end["y"], at["x"], at["y"]), end))
    return F.array_min(F.array(*[F.struct(d.alias("dist"), F.lit(k).alias("rank"), pt.alias("pt")) for k, (d, pt) in enumerate(tried)]))


def corridor_tolerance(ax, ay, bx, by) -> Column:
    return F.least(F.lit(0.01), F.greatest(F.lit(0.002), F.sqrt(distance_sq(ax, ay, bx, by)) * 0.18))


def within_corridor(cx: Column, cy: Column, a: Column, b: Column, most: Column) -> Column:
    """A centre beside the line a-b, at most ``most`` away from it."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.try_divide((cx - a["x"]) * dx + (cy - a["y"]) * dy, dx * dx + dy * dy)
    away = F.sqrt(distance_sq(cx, cy, a["x"] + dx * t, a["y"] + dy * t))
    return F.coalesce((t >= -0.04) & (t <= 1.04) & (away <= most), F.lit(False))


def geodesic_area(geom: Column) -> Column:
    """Square metres on the sphere; holes count negative. Lon and lat in degrees."""

    def ring(points: Column) -> Column:
        pair = lambda e: (F.radians(e["b"]["x"]) - F.radians(e["a"]["x"])) * (F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
        return F.abs(F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + pair(e))) * (EARTH_M**2 / 2)

    def polygon(rings: Column) -> Column:
        total = F.aggregate(rings, F.lit(0.0), lambda s, r: s + ring(r))
        return 2 * ring(rings[0]) - total

    return F.aggregate(geom, F.lit(0.0), lambda s, p: s + polygon(p))


# -- numpy on single shapes --------------------------------------------------------------------------------------------


def _edges_of(poly: list) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of all rings of one shape, closed."""
    return next(_shapes(pa.array([poly], _GEOM_TYPE)))


_GEOM_TYPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _points_of(geom: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all points of a column of shapes: x, y, the place of the next one in its ring, and the row."""
    n = len(geom)
    polys = geom.fill_null([]) if geom.null_count else geom
    rings = polys.flatten()
    lines = rings.flatten()
    points = lines.flatten()
    count = lambda a: np.asarray(a.value_lengths().fill_null(0))
    ring_rows = np.repeat(np.repeat(np.arange(n), count(polys)), count(rings))
    size = count(lines)
    last = np.repeat(np.cumsum(size) - 1, size)
    at = np.arange(len(points))
    nxt = np.where(at == last, np.repeat(np.cumsum(size) - size, size), at + 1)
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)) if len(points) else (np.zeros(0), np.zeros(0))
    row = np.repeat(ring_rows, size)
    whole = np.repeat(size >= 3, size)
    return x, y, nxt, np.where(whole, row, -1)


def _shapes(geom: pa.Array) -> Iterator[np.ndarray]:
    """The edges of each row's shape, from the batch's points at once."""
    x, y, nxt, row = _points_of(geom)
    e = np.stack([x, y, x[nxt], y[nxt]], axis=1) if len(x) else np.zeros((0, 4))
    keep = (row >= 0) & ((e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3]))
    e, row = e[keep], row[keep]
    bounds = np.searchsorted(row, np.arange(len(geom) + 1))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        yield e[lo:hi]


def _is_box(e: np.ndarray) -> bool:
    return len(e) == 4 and bool(np.all((e[:, 0] == e[:, 2]) | (e[:, 1] == e[:, 3])))


def _crossing_ys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which an edge of a crosses one of b."""
    ax, ay, bx, by = (a[:, k, None] for k in range(4))
    cx, cy, dx, dy = (b[None, :, k] for k in range(4))
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
        u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
        ok = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return (ay + t * (by - ay))[ok]


def _spans(e: np.ndarray, y: float) -> np.ndarray:
    """Where a scanline enters and leaves a shape."""
    lo, hi = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    c = e[(lo <= y) & (y < hi)]
    return np.sort(c[:, 0] + (y - c[:, 1]) * (c[:, 2] - c[:, 0]) / (c[:, 3] - c[:, 1]))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area common to two shapes given by their edges: between neighbouring heights of vertices and crossings, widths are linear."""
    if not len(a) or not len(b):
        return 0.0
    if _is_box(a) and _is_box(b):
        w = min(a[:, 0].max(), b[:, 0].max()) - max(a[:, 0].min(), b[:, 0].min())
        h = min(a[:, 1].max(), b[:, 1].max()) - max(a[:, 1].min(), b[:, 1].min())
        return float(max(w, 0.0) * max(h, 0.0))
    low, high = max(a[:, [1, 3]].min(), b[:, [1, 3]].min()), min(a[:, [1, 3]].max(), b[:, [1, 3]].max())
    if low >= high:
        return 0.0
    ys = np.concatenate([a[:, 1], b[:, 1], _crossing_ys(a, b), _crossing_ys(a, a), _crossing_ys(b, b), [low, high]])
    ys = np.unique(ys[(ys >= low) & (ys <= high)])
    total = 0.0
    for y0, y1 in zip(ys, ys[1:], strict=False):
        mid = (y0 + y1) / 2
        p, q = _spans(a, mid).reshape(-1, 2), _spans(b, mid).reshape(-1, 2)
        if len(p) and len(q):
            w = np.minimum(p[:, None, 1], q[None, :, 1]) - np.maximum(p[:, None, 0], q[None, :, 0])
            total += float(np.clip(w, 0, None).sum()) * (y1 - y0)
    return total


def contains(e: np.ndarray, x: float, y: float) -> bool:
    """Inside by the even-odd rule, or on an edge."""
    if not len(e):
        return False
    cross = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0])
    on = (cross == 0) & (x >= np.minimum(e[:, 0], e[:, 2])) & (x <= np.maximum(e[:, 0], e[:, 2])) & (y >= np.minimum(e[:, 1], e[:, 3])) & (y <= np.maximum(e[:, 1], e[:, 3]))
    return bool(on.any() or (_spans(e, y) > x).sum() % 2)


def touching(a: np.ndarray, b: np.ndarray) -> bool:
    """Shapes that share a point."""
    if not len(a) or not len(b):
        return False
    if contains(a, b[0, 0], b[0, 1]) or contains(b, a[0, 0], a[0, 1]) or len(_crossing_ys(a, b)):
        return True
    return any(contains(a, x, y) for x, y in b[:, :2]) or any(contains(b, x, y) for x, y in a[:, :2])


def inner_point(e: np.ndarray) -> tuple[float, float] | None:
    """A point inside: the middle of the widest span near half the height."""
    if not len(e):
        return None
    ys = np.unique(e[:, 1])
    mid = (ys[0] + ys[-1]) / 2
    k = min(max(int(np.searchsorted(ys, mid)), 1), max(len(ys) - 1, 1))
    y = mid if mid not in ys else (ys[k - 1] + ys[k]) / 2 if len(ys) > 1 else mid
    spans = _spans(e, y).reshape(-1, 2)
    if not len(spans):
        return float(e[0, 0]), float(e[0, 1])
    s = spans[np.argmax(spans[:, 1] - spans[:, 0])]
    return float(s.mean()), float(y)


def utm(lon: np.ndarray, lat: np.ndarray, zone: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by Krueger's series, WGS 84, northern half."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = np.radians(lat), np.radians(lon) - math.radians(6 * zone - 183)
    k = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - k * np.arctanh(k * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east, north = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        east += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        north += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def _project_utm(e: np.ndarray, zone: int) -> np.ndarray:
    if not len(e):
        return e
    x0, y0 = utm(e[:, 0], e[:, 1], zone)
    x1, y1 = utm(e[:, 2], e[:, 3], zone)
    return np.stack([x0, y0, x1, y1], axis=1)


def _project_sphere(e: np.ndarray) -> np.ndarray:
    """Equal-area: lon and the sine of lat, in metres."""
    return np.stack([np.radians(e[:, 0]), np.sin(np.radians(e[:, 1])), np.radians(e[:, 2]), np.sin(np.radians(e[:, 3]))], axis=1) * EARTH_M


def area(e: np.ndarray) -> float:
    return overlap(e, e)


# -- Arrow functions ---------------------------------------------------------------------------------------------------


def _rectangles(geom: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which rows of a column of shapes are one ring of five points along the axes, and the corners of those (else NaN)."""
    x, y, _, row = _points_of(geom)
    n = len(geom)
    size = np.bincount(row[row >= 0], minlength=n)
    polys = geom.fill_null([]) if geom.null_count else geom
    one = np.asarray(polys.value_lengths().fill_null(0)) == 1
    rings = np.zeros(n, np.int64)
    rings[one] = np.asarray(polys.flatten().value_lengths().fill_null(0))[(np.cumsum(np.asarray(polys.value_lengths())) - 1)[one]]
    ok = one & (rings == 1) & (size == 5)
    first = np.searchsorted(np.where(row >= 0, row, -1), np.flatnonzero(ok)) if (row >= 0).all() else np.array([np.flatnonzero(row == k)[0] for k in np.flatnonzero(ok)], np.int64)
    px, py = (v[first[:, None] + np.arange(5)] if len(first) else np.zeros((0, 5)) for v in (x, y))
    same = lambda v, a, b: v[:, a] == v[:, b]
    along = same(py, 0, 1) & same(px, 1, 2) & same(py, 2, 3) & same(px, 3, 4)
    across = same(px, 0, 1) & same(py, 1, 2) & same(px, 2, 3) & same(py, 3, 4)
    fits = (along | across) & same(px, 0, 4) & same(py, 0, 4)
    at = np.flatnonzero(ok)[fits]
    ok = np.zeros(n, bool)
    ok[at] = True
    corners = {}
    for name, v, f in (("xmin", px, np.min), ("ymin", py, np.min), ("xmax", px, np.max), ("ymax", py, np.max)):
        corners[name] = np.full(n, np.nan)
        if len(at):
            corners[name][at] = f(v[fits], axis=1)
    return ok, corners


def _by_row(kind: str, one: Callable, boxes: Callable | None = None) -> Callable:
    """An Arrow function of columns of shapes; null where a shape is, or where ``one`` fails: that is no answer, not 0.

    ``boxes`` does all rows at once where all shapes are rectangles.
    """

    def work(*cols: pa.Array) -> pa.Array:
        left = np.logical_and.reduce([np.asarray(c.is_valid()) for c in cols])
        out = np.full(len(left), None, object)
        if boxes is not None:
            found = [_rectangles(c) for c in cols]
            plain = np.logical_and.reduce([left, *(ok for ok, _ in found)])
            if plain.any():
                out[plain] = boxes(*({k: v[plain] for k, v in corners.items()} for _, corners in found)).tolist()
            left &= ~plain
        if left.any():
            for k, shapes in enumerate(zip(*map(_shapes, cols), strict=True)):
                if left[k]:
                    try:
                        out[k] = one(*shapes)
                    except (ValueError, IndexError, TypeError, ZeroDivisionError, FloatingPointError):
                        out[k] = None
        return pa.array(out.tolist(), _TYPES[kind])

    return work


_TYPES = {"double": pa.float64(), "boolean": pa.bool_(), POINT: pa.struct([("x", pa.float64()), ("y", pa.float64())])}


def _two(kind: str, one: Callable, boxes: Callable | None = None) -> Callable:
    work = _by_row(kind, one, boxes)

    @F.arrow_udf(kind)
    def call(a: pa.Array, b: pa.Array) -> pa.Array:
        return work(a, b)

    return call


def _one(kind: str, one: Callable, boxes: Callable | None = None) -> Callable:
    work = _by_row(kind, one, boxes)

    @F.arrow_udf(kind)
    def call(a: pa.Array) -> pa.Array:
        return work(a)

    return call


def _common(p: dict, q: dict, high: Callable = lambda y: y, wide: Callable = lambda x: x) -> np.ndarray:
    """The area common to pairs of boxes, after their coordinates are mapped."""
    w = wide(np.minimum(p["xmax"], q["xmax"])) - wide(np.maximum(p["xmin"], q["xmin"]))
    h = high(np.minimum(p["ymax"], q["ymax"])) - high(np.maximum(p["ymin"], q["ymin"]))
    return np.maximum(w, 0.0) * np.maximum(h, 0.0)


def _quads_utm(p: dict, zone: int) -> np.ndarray:
    """The corners of boxes of lon and lat after projection, in turn: an array of (box, corner, x or y)."""
    lon = np.stack([p["xmin"], p["xmax"], p["xmax"], p["xmin"]], axis=1)
    lat = np.stack([p["ymin"], p["ymin"], p["ymax"], p["ymax"]], axis=1)
    return np.stack(utm(lon, lat, zone), axis=2)


def _quad_overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``overlap`` of pairs of quadrilaterals at once; those that are not convex go one by one."""
    out = np.zeros(len(p))
    convex = np.ones(len(p), bool)
    for v in (p, q):
        e = np.roll(v, -1, axis=1) - v
        turn = e[:, :, 0] * np.roll(e, -1, axis=1)[:, :, 1] - e[:, :, 1] * np.roll(e, -1, axis=1)[:, :, 0]
        convex &= (turn >= 0).all(axis=1)
    for k in np.flatnonzero(~convex):
        out[k] = overlap(*(np.concatenate([v[k], np.roll(v[k], -1, axis=0)], axis=1) for v in (p, q)))
    for lo in range(0, len(p), 2000):
        at = lo + np.flatnonzero(convex[lo : lo + 2000])
        out[at] = _convex_overlap(p[at], q[at])
    return out


def _convex_overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between neighbouring heights of corners and crossings the common width is linear, so its value half-way counts."""
    ends = [(v, np.roll(v, -1, axis=1)) for v in (p, q)]
    (a, b), (c, d) = ((s[:, :, None], t[:, :, None]) if k == 0 else (s[:, None], t[:, None]) for k, (s, t) in enumerate(ends))
    u, v, w = b - a, d - c, c - a
    low, high = (f(g(p[:, :, 1], axis=1), g(q[:, :, 1], axis=1)) for f, g in ((np.maximum, np.min), (np.minimum, np.max)))
    high = np.maximum(low, high)
    with np.errstate(divide="ignore", invalid="ignore"):
        den = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
        y = a[..., 1] + (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / den * u[..., 1]
        ys = np.concatenate([p[:, :, 1], q[:, :, 1], np.where(np.isfinite(y), y, low[:, None, None]).reshape(len(p), 16)], axis=1)
        ys = np.sort(np.clip(ys, low[:, None], high[:, None]), axis=1)
        mid = ((ys[:, 1:] + ys[:, :-1]) / 2)[:, :, None]
        spans = []
        for s, t in ends:
            x0, y0, x1, y1 = (z[:, None] for z in (s[:, :, 0], s[:, :, 1], t[:, :, 0], t[:, :, 1]))
            on = (np.minimum(y0, y1) <= mid) & (mid < np.maximum(y0, y1))
            x = x0 + (mid - y0) * (x1 - x0) / (y1 - y0)
            spans.append((np.where(on, x, np.inf).min(axis=2), np.where(on, x, -np.inf).max(axis=2)))
    (l0, r0), (l1, r1) = spans
    width = np.minimum(r0, r1) - np.maximum(l0, l1)
    return (np.where(width > 0, width, 0.0) * np.diff(ys, axis=1)).sum(axis=1)


def overlap_area(a, b) -> Column:
    """Planar area common to two polygons, in units of their coordinates; null where one of them fails."""
    return _two("double", overlap, _common)(_c(a), _c(b))


def overlap_area_sphere(a, b) -> Column:
    """Square metres on the sphere common to two polygons of lon and lat; null where one of them fails."""
    boxes = lambda p, q: _common(p, q, lambda y: np.sin(np.radians(y)), np.radians) * EARTH_M**2
    return _two("double", lambda p, q: overlap(_project_sphere(p), _project_sphere(q)), boxes)(_c(a), _c(b))


def overlap_area_utm(a, b, zone: int = 14) -> Column:
    """Square metres after projection common to two polygons of lon and lat; null where one of them fails."""
    one = lambda p, q: overlap(_project_utm(p, zone), _project_utm(q, zone))
    return _two("double", one, lambda p, q: _quad_overlap(_quads_utm(p, zone), _quads_utm(q, zone)))(_c(a), _c(b))


def area_utm(a, zone: int = 14) -> Column:
    def boxes(p: dict) -> np.ndarray:
        quads = _quads_utm(p, zone)
        return _quad_overlap(quads, quads)

    return _one("double", lambda p: area(_project_utm(p, zone)), boxes)(_c(a))


def polygons_touch(a, b) -> Column:
    """Whether two polygons share a point; null where one of them fails."""
    boxes = lambda p, q: boxes_overlap(p.get, q.get)
    return _two("boolean", touching, boxes)(_c(a), _c(b))


def point_on_surface(a) -> Column:
    def one(e: np.ndarray) -> dict | None:
        at = inner_point(e)
        return None if at is None else {"x": at[0], "y": at[1]}

    return _one(POINT, one)(_c(a))


def is_simple(a) -> Column:
    """False where edges of a polygon cross each other away from their ends."""

    def one(e: np.ndarray) -> bool:
        n = len(e)
        for i in range(n):
            others = e[[j for j in range(n) if j not in (i, (i + 1) % n, (i - 1) % n)]]
            if len(others) and len(_crossing_ys(e[i : i + 1], others)):
                return False
        return bool(n)

    return _one("boolean", one)(_c(a))


def _contains(geom: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """All rows of a batch at once: edges with their row, crossings counted by row."""
    n = len(geom)
    qx, qy = (c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
    px, py, nxt, row = _points_of(geom)
    if not len(px):
        return pa.array(np.zeros(n, bool))
    ok = row >= 0
    x0, y0, x1, y1, row = px[ok], py[ok], px[nxt][ok], py[nxt][ok], row[ok]
    qx, qy = qx[row], qy[row]
    cross = (x1 - x0) * (qy - y0) - (y1 - y0) * (qx - x0)
    on = (cross == 0) & (qx >= np.minimum(x0, x1)) & (qx <= np.maximum(x0, x1)) & (qy >= np.minimum(y0, y1)) & (qy <= np.maximum(y0, y1))
    up = (y0 <= qy) != (y1 <= qy)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = up & (x0 + (qy - y0) * (x1 - x0) / (y1 - y0) > qx)
    return pa.array((np.bincount(row, hit, n) % 2 == 1) | (np.bincount(row, on, n) > 0))


def point_in_polygon(geom, x, y) -> Column:
    """Inside or on the boundary."""
    return F.arrow_udf(_contains, "boolean")(_c(geom), _c(x).cast("double"), _c(y).cast("double"))


def crs_matches(left: str, right: str) -> None:
    """Raise unless two layers have one reference system, of lon and lat, by their names; None is unknown."""
    known = {"EPSG:4326", "OGC:CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84", "URN:OGC:DEF:CRS:EPSG::4326"}
    for name in (left, right):
        if name.upper() not in known:
            raise ValueError(f"the reference system {name} is not lon and lat")
