"""Traffic counts: daily and study sums, latest study per corridor, corridors on the road network, stations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from .tables import first_by

SNAP = 0.0012
NAMES = ["study_id", "street", "street_from", "street_to", "location_description"]


def daily(counts: DataFrame) -> DataFrame:
    """Sum and number of quarter-hour counts by study, names and day."""
    day = F.date_trunc("DAY", "count_date").alias("day")
    return counts.groupBy(*NAMES, day).agg(F.sum("count_15_minutes").alias("total"), F.count(F.lit(1)).alias("intervals"))


def studies(days: DataFrame) -> DataFrame:
    """Sums by study and normalised names; the names are those of the newest day."""
    keys = [F.col("study_id").alias("_study"), *[t.street_name(c).alias(f"_{c}") for c in NAMES[1:4]], F.coalesce("location_description", F.lit("")).alias("_where")]
    newest = F.max_by(F.struct(*NAMES), F.struct(F.coalesce("day", F.lit("0001-01-01").cast("timestamp_ntz")), *[F.coalesce(c, F.lit("")) for c in NAMES]))
    out = days.groupBy(*keys).agg(
        newest.alias("names"),
        F.min("day").alias("min_count_date"),
        F.max("day").alias("max_count_date"),
        F.sum("total").alias("total"),
        F.sum("intervals").alias("intervals"),
        F.greatest(F.count_distinct("day"), F.lit(1)).alias("sample_days"),
    )
    return out.select("names.*", "min_count_date", "max_count_date", "total", "intervals", "sample_days")


def study_days(days: Column, first: Column, last: Column) -> Column:
    """Sample days where they are known and positive, else the days from the first count to the last."""
    return F.coalesce(F.when(days > 0, days.cast("double")), t.sample_days(first, last))


def average_daily(total: Column, days: Column) -> Column:
    return F.when(days > 0, F.try_divide(total, days))


def latest_per_corridor(rows: DataFrame) -> DataFrame:
    """Of each corridor, either way round, the newest study with a positive average."""
    avg = average_daily(F.col("total"), study_days(F.col("sample_days"), F.col("min_count_date"), F.col("max_count_date")))
    rows = rows.withColumns({"corridor": t.corridor_key("street", "street_from", "street_to"), "avg": avg}).where("corridor is not null and avg > 0")
    newest = first_by(rows, ["corridor"], [F.desc("max_count_date"), "study_id", "street", "street_from", "street_to", "location_description"])
    return newest.withColumn("avg_daily_volume", F.floor(F.col("avg") + 0.5)).drop("avg")


def road_aliases(roads: DataFrame) -> DataFrame:
    """segment_id and each name its road goes by."""
    parts = lambda *cs: t.street_name(F.concat_ws(" ", *cs))
    names = F.array(t.street_name("full_name"), parts("st_name", "st_type", "st_dir"), parts("st_name", "st_type"), t.street_name("st_name"))
    return roads.withColumn("alias", F.explode(F.array_except(F.array_distinct(names), F.array(F.lit("")))))


def road_index(roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By alias: roads with their centres, and segments with their order."""
    roads = g.with_box(roads, "lines", 2)
    named = road_aliases(roads)
    cx, cy = g.center(lambda c: F.col(c))
    features = named.select("alias", "segment_id", "full_name", cx.alias("cx"), cy.alias("cy"), "_ord")
    segs = named.select("alias", "_ord", F.posexplode(g.segments(F.col("lines"))).alias("k", "seg")).select("alias", F.struct("_ord", "k").alias("at"), "seg")
    return features, segs


def crossings(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """main, cross, pt of distinct pairs of street names: the first shared point, else the nearest one within SNAP."""
    a = segs.select(F.col("alias").alias("main"), F.col("at").alias("at_m"), F.col("seg").alias("m"))
    b = segs.select(F.col("alias").alias("cross"), F.col("at").alias("at_c"), F.col("seg").alias("c"))
    met = pairs.distinct().join(a, "main").join(b, "cross")
    m, c = F.col("m"), F.col("c")
    exact = g.crossing(m["a"], m["b"], c["a"], c["b"])
    near = g.nearest_of_main(m["a"], m["b"], c["a"], c["b"])
    met = met.withColumns({"exact": exact, "near": near})
    # one point per pair of segments is kept while aggregating: first exact ones in order, then the nearest
    rank = F.struct(F.col("exact").isNull().alias("no"), F.when(F.col("exact").isNull(), F.col("near.dist")).alias("dist"), "at_m", "at_c")
    best = met.groupBy("main", "cross").agg(F.min(F.struct(rank.alias("rank"), F.coalesce("exact", "near.pt").alias("pt"))).alias("best"))
    return best.where(~F.col("best.rank.no") | (F.col("best.rank.dist") <= SNAP * SNAP)).select("main", "cross", F.col("best.pt").alias("pt"))


def line_columns() -> list[Column]:
    """Columns of a matched study."""
    v = F.col("avg_daily_volume")
    return [
        F.lit("midblock").alias("traffic_kind"),
        *NAMES,
        v,
        t.volume_label(v).alias("volume_label"),
        t.thousands(v).alias("volume_text"),
        F.col("min_count_date").alias("count_start"),
        F.col("max_count_date").alias("count_end"),
        "sample_days",
        F.nullif(F.col("intervals"), F.lit(0)).alias("interval_count"),
        F.lit("Midblock Traffic Counts").alias("source_name"),
    ]


def corridors(latest: DataFrame, roads: DataFrame) -> DataFrame:
    """Studies on the road segments between their cross streets; a straight line where no segment lies there."""
    features, segs = road_index(roads)
    rows = latest.withColumns({"main": t.street_name("street"), "from_key": t.street_name("street_from"), "to_key": t.street_name("street_to")})
    wanted = rows.select("main", F.col("from_key").alias("cross")).union(rows.select("main", F.col("to_key").alias("cross"))).where("main <> '' and cross <> ''")
    found = crossings(wanted, segs)
    rows = rows.join(found.select("main", F.col("cross").alias("from_key"), F.col("pt").alias("p")), ["main", "from_key"]).join(found.select("main", F.col("cross").alias("to_key"), F.col("pt").alias("q")), ["main", "to_key"])
    p, q = F.col("p"), F.col("q")
    rows = rows.where(g.distance_sq(p["x"], p["y"], q["x"], q["y"]) >= 1e-12)
    tolerance = g.corridor_tolerance(p["x"], p["y"], q["x"], q["y"])
    near = g.within_corridor(F.col("f.cx"), F.col("f.cy"), p, q, tolerance)
    f = features.select(F.col("alias").alias("main"), F.struct("segment_id", "full_name", "cx", "cy", "_ord").alias("f"))
    on_road = rows.join(f, "main").where(near).select(*line_columns(), "p", "q", F.col("f.segment_id").alias("segment_id"), F.coalesce("f.full_name", "street").alias("road_name"), F.lit("road segment").alias("match_type"))
    hit = on_road.select("study_id", "street", "street_from", "street_to").distinct()
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}")) for c in hit.columns]
    lone = rows.alias("r").join(hit.alias("h"), same, "left_anti").select(*line_columns(), "p", "q", F.lit(None).cast("string").alias("segment_id"), F.col("street").alias("road_name"), F.lit("approximate corridor").alias("match_type"))
    return on_road.unionByName(lone)


def best_per_segment(lines: DataFrame) -> DataFrame:
    """Of each segment (of each study without one) the newest line, then the busiest."""
    key = F.when(t.blank_to_null("segment_id").isNotNull(), F.concat(F.lit("segment:"), "segment_id")).otherwise(F.concat(F.lit("study:"), F.col("study_id")))
    w = Window.partitionBy("_key").orderBy(F.desc("count_end"), F.desc("avg_daily_volume"), "study_id")
    return lines.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")


def stations(counts: DataFrame, site: list[str], ts: str = "timestamp", total: str = "total") -> DataFrame:
    """Sites' sums over the 96 quarter hours that end with the newest time of all."""
    newest = counts.agg(F.max(ts).alias("_end"))
    window = F.col(ts).between(F.col("_end") - F.expr("INTERVAL '23:45' HOUR TO MINUTE"), F.col("_end"))
    rows = counts.join(F.broadcast(newest), window)  # newest is one row
    out = rows.groupBy(*site).agg(F.min(ts).alias("count_start"), F.max(ts).alias("count_end"), F.sum(total).alias("sum_total"), F.count(F.lit(1)).alias("interval_count"))
    days = F.greatest(t.sample_days("count_start", "count_end"), F.lit(1.0))
    return out.withColumn("avg_daily_volume", F.floor(F.try_divide("sum_total", days) + 0.5).cast("bigint"))


def station_rows(counts: DataFrame) -> DataFrame:
    """Stations with a point, as rows of the overlay."""
    rows = stations(counts.where("lon is not null and lat is not null"), ["site", "lon", "lat"])
    v = F.col("avg_daily_volume")
    return rows.select(F.lit("station").alias("traffic_kind"), "site", "lon", "lat", v, t.volume_label(v).alias("volume_label"), t.thousands(v).alias("volume_text"), "count_start", "count_end", "interval_count", F.lit("Permanent Count Station Traffic Counts").alias("source_name"))


def volumes(stations_of: Callable[[], DataFrame], corridors_of: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Stations and corridors as one layer, and what is missing: one branch may fail to be read, not both."""
    parts, failed = {}, {}
    for name, make in (("stations", stations_of), ("corridors", corridors_of)):
        try:
            parts[name] = make()
        except (PySparkException, OSError) as e:
            failed[name] = e
    if not parts:
        raise RuntimeError("neither stations nor corridors can be read") from failed["stations"]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values()), [f"{name} are left out: {type(e).__name__}" for name, e in failed.items()]


def volume_lines(counts: DataFrame, roads: DataFrame) -> DataFrame:
    """The lines layer: of each segment the newest corridor study."""
    return best_per_segment(corridors(latest_per_corridor(studies(daily(counts))), roads))
