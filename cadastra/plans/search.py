"""Searches: by legal description, by assessment, over a snapshot.

What several parts of a search's result read is written to the shared folder once, so plans stay small; joined rows and
layers are made when they are first asked for. Parcels of equal shape are enriched and matched as one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import merge, predicates, spatial, tables, zoning
from ..sources import files

ASSESS = ["roll_number", "full_address", "zoning", "property_use_code", "centroid_lat", "centroid_lon", "assessed_land_area", "dwelling_units", "total_assessed_value", "detail_url", "current_assessment_year"]
ENRICHED = ["zoning_top1", "zoning_top1_pct", "zoning_top2", "zoning_top2_pct"]
LEGAL_INPUTS = ("lot", "block", "plan", "description")
ASSESS_INPUTS = ("roll", "address_from", "address_to", "address_street", "zoning", "du_mode")


@dataclass
class Sources:
    """Tables of a search. Parcels and zones have geom and its box, addresses lon and lat; each has an order _ord."""

    survey: DataFrame
    assess: DataFrame
    addresses: DataFrame | None = None
    zones: DataFrame | None = None
    #: Side of the finest grid cell of the spatial joins, about a parcel's.
    cell: float | spatial.Grid = 0.001
    #: Links of the export.
    record_base: str = ""
    address_base: str = ""
    address_suffix: str = ""
    point_base: str = ""
    #: Grid for joins of parcels with each other and with points: fewer levels than zones and padded boxes need, so fewer cells.
    fine: spatial.Grid | None = None


@dataclass
class Result:
    """Joined rows (structs survey and assess, _ord, _rowKey), both layers, and what was asked for and not found."""

    found: tables.Limited
    flow: str
    #: Makes the rows of the search itself, enriched, in the form of ``rows`` but without the other layer's parcels.
    alone_of: Callable[[Result], DataFrame]
    #: Makes rows, survey and assess.
    parts_of: Callable[[Result], tuple[DataFrame, DataFrame, DataFrame]]
    notes: list[str] = field(default_factory=list)
    #: Frames written to the shared folder, as several parts of the result read them.
    kept: list[DataFrame] = field(default_factory=list)

    @cached_property
    def alone(self) -> DataFrame:
        """``rows`` without the other layer's parcels (null): for tables that show nothing of these, which need no matches then."""
        return self.alone_of(self)

    @cached_property
    def _parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.parts_of(self)

    @property
    def rows(self) -> DataFrame:
        return self._parts[0]

    @property
    def survey(self) -> DataFrame:
        return self._parts[1]

    @property
    def assess(self) -> DataFrame:
        return self._parts[2]

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(files.written(df, "search"))
        return self.kept[-1]

    def release(self) -> None:
        """Removes what was written; nothing of the result can be read after that."""
        while self.kept:
            files.discard(self.kept.pop())


def survey_rows(survey: DataFrame, plan=None, lot=None, block=None, description=None) -> tables.Limited:
    c = predicates.contains
    rows = predicates.select_all(survey, [c("plan", plan), c("lot", lot), c("block", block), c("description", description)])
    return tables.limited(rows, predicates.USER_LIMIT, ["id"], "survey parcels")


def assess_predicates(roll=None, address_from=None, address_to=None, address_street=None, zoning=None, du_mode=None, du_min=None) -> list:
    return [predicates.rolls(roll), *predicates.address(address_from, address_to, address_street), predicates.zoning(zoning), predicates.dwelling_units(du_mode, du_min)]


def assess_rows(assess: DataFrame, **inputs) -> tables.Limited:
    return tables.limited(predicates.select_all(assess, assess_predicates(**inputs)), predicates.USER_LIMIT, ["full_address", "roll_number"], "assessment parcels")


def address_points(addresses: DataFrame, address_from=None, address_to=None, address_street=None) -> tables.Limited:
    rows = predicates.select_all(addresses, predicates.address(address_from, address_to, address_street)).where("lon is not null and lat is not null")
    return tables.limited(rows, predicates.USER_LIMIT, ["full_address"], "addresses")


def with_addresses(parcels: DataFrame, addresses: DataFrame, cell: float | spatial.Grid) -> tuple[DataFrame, DataFrame]:
    """Parcels with the addresses of the points inside, and those points, each address once."""
    pts = spatial.points(addresses.where(t.blank_to_null("full_address").isNotNull()), "lon", "lat").select("full_address", "lon", "lat", *g.BOX)
    places = pts.groupBy(*g.BOX).agg(F.collect_set("full_address").alias("found"))
    met = _inside(spatial.shapes(parcels.select("geom", *g.BOX)), places, cell)
    out = spatial.by_shape(parcels, merge.by_key(met), "left")
    out = out.withColumn("full_address", merge.with_primary(F.col("full_address"), F.col("names"), F.col("text"))).drop("names", "text")
    named = pts.join(met.select(F.col("r_xmin").alias("xmin"), F.col("r_ymin").alias("ymin")), ["xmin", "ymin"], "left_semi").select(F.trim("full_address").alias("full_address"), "lon", "lat")
    points = tables.first_by(named, ["full_address"], ["lon", "lat"]).withColumn("street_num", t.street_number_text("full_address"))
    return out, points


def _inside(shapes: DataFrame, places: DataFrame, cell: float | spatial.Grid) -> DataFrame:
    """Pairs of a shape (l_...) and a place (r_..., a box of no size) inside it."""
    return spatial.shape_join(shapes, places, cell).where(g.point_in_polygon("l_geom", "r_xmin", "r_ymin"))


def by_address_points(src: Sources, inputs: dict) -> DataFrame | None:
    """Assessments that contain an address point of the search; the other inputs hold for them too."""
    if src.addresses is None:
        return None
    where = predicates.address(inputs.get("address_from"), inputs.get("address_to"), inputs.get("address_street"))
    if not where:
        return None
    pts = address_points(src.addresses, inputs.get("address_from"), inputs.get("address_to"), inputs.get("address_street")).probe  # all of them
    extra = [p for p in (predicates.rolls(inputs.get("roll")), predicates.zoning(inputs.get("zoning")), predicates.dwelling_units(inputs.get("du_mode"), inputs.get("du_min"))) if p is not None]
    assess = src.assess
    for p in extra:
        assess = assess.where(p)
    places = spatial.points(pts, "lon", "lat").select(*g.BOX).distinct()
    hit = _inside(spatial.shapes(assess.select("geom", *g.BOX)), places, src.fine or src.cell).select(F.col("l__key").alias("_key")).distinct()
    return spatial.by_shape(assess, hit, "left_semi")


STEPS = {
    "addresses": (lambda rows, src: with_addresses(rows, src.addresses, src.fine or src.cell)[0], ("full_address", "lon", "lat")),
    "zones": (lambda rows, src: zoning.enrich(rows, src.zones, src.cell), ("_ord", "zoning", "geom", *g.BOX)),
}


def usable(src: Sources, notes: list[str]) -> Sources:
    """A search goes on without a table that cannot be read or lacks a column; ``notes`` then says so."""
    for what, (_, columns) in STEPS.items():
        try:
            if getattr(src, what) is not None:
                getattr(src, what).select(*columns).schema  # noqa: B018
        except (AnalysisException, PySparkException) as e:
            notes.append(f"{what} are left out: {type(e).__name__}")
            src = replace(src, **{what: None})
    return src


def enriched(src: Sources, assess: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """Assessments with all addresses and their two main zones, as far as those tables are there and their plan can be made."""
    for what, (step, _) in STEPS.items():
        if getattr(src, what) is None:
            continue
        try:
            assess = step(assess, src)
        except (AnalysisException, PySparkException) as e:
            if notes is None:
                raise
            notes.append(f"{what} are left out: {type(e).__name__}")
    missing = [c for c in ENRICHED if c not in assess.columns]
    return assess.withColumns({c: F.lit(None).cast("double" if c.endswith("pct") else "string") for c in missing})


def join_survey(survey: DataFrame, assess: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per lot with its merged rolls; a lot with several rolls is partial."""
    columns = [c for c in ASSESS + ENRICHED if c in assess.columns]
    pairs = matches.join(assess.select(F.col("_ord").alias("a_id"), F.col("_ord"), *columns), "a_id")
    merged = merge.merge_rolls(pairs, "s_id", columns)
    many = spatial.partial_lots(matches).withColumn("_partial", F.lit(True))
    rows = survey.join(merged, survey["_ord"] == merged["s_id"], "left").drop("s_id").join(many, F.col("_ord") == many["s_id"], "left").drop("s_id")
    return rows.select("_ord", "_rowKey", F.struct(*merge.SURVEY).alias("survey"), "assess", F.coalesce("_partial", F.lit(False)).alias("partial"))


def join_assess(assess: DataFrame, survey: DataFrame, matches: DataFrame, partial: DataFrame) -> DataFrame:
    """One row per assessment with its merged lots; ``partial`` has the s_id of lots that other rolls share."""
    marks = partial.select("s_id", F.lit(True).alias("_p"))
    lots = matches.join(survey.select(F.col("_ord").alias("s_id"), F.col("_ord"), *merge.SURVEY), "s_id").join(marks, "s_id", "left").withColumn("partial", F.coalesce("_p", F.lit(False)))
    merged = merge.merge_lots(lots, "a_id")
    columns = [c for c in ASSESS + ENRICHED if c in assess.columns]
    rows = assess.join(merged, assess["_ord"] == merged["a_id"], "left").drop("a_id")
    return rows.select("_ord", "_rowKey", "survey", F.struct(*columns).alias("assess"))


def _legal_parts(src: Sources, got: Result) -> tuple[DataFrame, DataFrame, DataFrame]:
    survey = got.keep(got.found.rows.withColumn("_rowKey", tables.row_key("s", "id")))
    met = got.keep(spatial.parcel_matches(survey, src.assess, src.fine or src.cell))
    # only rolls that match are enriched, of those near the lots
    hit = src.assess.join(met.select(F.col("a_id").alias("_ord")).distinct(), "_ord", "left_semi")
    near = got.keep(spatial.box_semi_join(hit, survey, src.cell, "_ord"))
    assess = got.keep(enriched(src, near, got.notes))
    matches = met.join(near.select(F.col("_ord").alias("a_id")), "a_id", "left_semi")
    return join_survey(survey, assess, matches), survey, spatial.matched(assess, matches, "a_id", survey, "s_id")


def legal_search(src: Sources, **inputs) -> Result:
    found = survey_rows(src.survey, **{k: inputs.get(k) for k in LEGAL_INPUTS})
    notes: list[str] = []
    src = usable(src, notes)
    nothing = F.struct(*[F.lit(None).cast(src.assess.schema[c].dataType).alias(c) for c in ASSESS if c in src.assess.columns], *[F.lit(None).cast("double" if c.endswith("pct") else "string").alias(c) for c in ENRICHED])
    lone = lambda got: got.found.rows.select("_ord", tables.row_key("s", "id").alias("_rowKey"), F.struct(*merge.SURVEY).alias("survey"), F.when(F.lit(False), nothing).alias("assess"))
    return Result(found, "legal", lone, lambda got: _legal_parts(src, got), notes)


def _assessment_parts(src: Sources, assess: DataFrame, got: Result) -> tuple[DataFrame, DataFrame, DataFrame]:
    # rows without a roll number may be there twice, their matches not
    met = got.keep(spatial.parcel_matches(src.survey, assess.dropDuplicates(["_ord"]), src.fine or src.cell))
    hit = src.survey.join(met.select(F.col("s_id").alias("_ord")).distinct(), "_ord", "left_semi")
    survey = got.keep(spatial.box_semi_join(hit, assess, src.cell, "_ord"))
    matches = met.join(survey.select(F.col("_ord").alias("s_id")), "s_id", "left_semi")
    # a lot is partial when any two assessments match it, in the search or not, of those near any lot near the search
    around = got.keep(spatial.boxes_met(src.survey, spatial.padded(assess.select(*g.BOX), spatial.PAD), src.cell))
    everyone = got.keep(spatial.box_semi_join(src.assess.select("_ord", "geom", *g.BOX, "centroid_lon", "centroid_lat"), around, src.cell, "_ord"))
    partial = got.keep(spatial.shared_lots(survey, everyone, src.fine or src.cell))
    return join_assess(assess, survey, matches, partial), spatial.matched(survey, matches, "s_id", assess, "a_id"), assess


def assessment_search(src: Sources, **inputs) -> Result:
    asked = {k: inputs.get(k) for k in (*ASSESS_INPUTS, "du_min")}
    direct = assess_rows(src.assess, **asked)
    notes: list[str] = []
    other = by_address_points(src, asked)
    # direct matches first, then those found by address points, each roll once
    rows = direct.rows if other is None else tables.union_first_seen([direct.rows, other], "roll_number")
    src = usable(src, notes)
    kept: list[DataFrame] = []

    def assess(got: Result) -> DataFrame:
        if not kept:
            kept.append(got.keep(enriched(src, got.keep(rows), notes).withColumn("_rowKey", tables.row_key("a", "roll_number"))))
        return kept[0]

    nothing = F.lit(None).cast(src.survey.select(F.struct(*merge.SURVEY).alias("s")).schema["s"].dataType)
    lone = lambda got: assess(got).select("_ord", "_rowKey", nothing.alias("survey"), F.struct(*[c for c in ASSESS if c in src.assess.columns], *ENRICHED).alias("assess"))
    return Result(direct, "assessment", lone, lambda got: _assessment_parts(src, assess(got), got), notes)


def layers(found: Result) -> DataFrame:
    """Both layers of a result as one: parcel_layer, _rowKey, geom, box and what either knows of a parcel."""
    return tables.union_tagged({"survey": found.survey, "assess": found.assess}, "parcel_layer")


def missing_rolls(asked: str | None, found: int) -> int:
    """How many of several rolls asked for were not found."""
    n = len([x for x in (asked or "").replace(",", " ").replace(";", " ").split() if x])
    return max(n - found, 0) if n > 1 else 0


def search(src: Sources, **inputs) -> Result:
    """Any assessment input leads to the assessment search, and legal inputs are then ignored; no input finds nothing."""
    if not isinstance(src.cell, spatial.Grid):
        fine = src.fine or spatial.grid_of(src.cell, [src.survey, src.assess])
        src = replace(src, fine=fine, cell=fine if src.zones is None else spatial.grid_of(src.cell, [src.survey, src.assess, src.zones]))
    given = lambda k: inputs.get(k) not in (None, "", "any")
    if any(given(k) for k in ASSESS_INPUTS):
        out = assessment_search(src, **inputs)
        if any(given(k) for k in LEGAL_INPUTS):
            out.notes.append("legal inputs are ignored in an assessment search")
        return out
    if any(given(k) for k in LEGAL_INPUTS):
        return legal_search(src, **inputs)
    raise ValueError("enter something to search for")


def display(src: Sources, rows: DataFrame) -> DataFrame:
    """The result table: 15 columns for display, with those of the export."""
    a, s = (lambda c: F.col(f"assess.{c}")), (lambda c: F.col(f"survey.{c}"))
    zone = F.coalesce(a("zoning_top1"), a("zoning"))
    return rows.select(
        "_ord",
        "_rowKey",
        "survey",
        "assess",
        s("lot").alias("lot"),
        s("block").alias("block"),
        s("plan").alias("plan"),
        s("description").alias("description"),
        a("roll_number").alias("roll_number"),
        a("full_address").alias("full_address"),
        t.zoning_code(zone).alias("zoning_code"),
        t.percent_text(a("zoning_top1_pct")).alias("zoning_pct_text"),
        t.second_zone(a("zoning_top2"), a("zoning_top2_pct")).alias("zoning_2_text"),
        t.area_text(a("assessed_land_area")).alias("area"),
        t.coordinate_text(a("centroid_lat")).alias("lat"),
        t.coordinate_text(a("centroid_lon")).alias("lon"),
        t.dollars(a("total_assessed_value")).alias("value"),
        # of the export
        F.coalesce(zone, F.lit("")).alias("zoning"),
        a("zoning_top1_pct").alias("zoning_pct"),
        a("zoning_top2").alias("zoning_2"),
        a("zoning_top2_pct").alias("zoning_2_pct"),
        t.record_url(src.record_base, a("roll_number")).alias("record_url"),
        t.address_url(src.address_base, a("full_address"), src.address_suffix).alias("walk_url"),
        t.point_url(src.point_base, a("centroid_lat"), a("centroid_lon"), a("full_address")).alias("flood_url"),
    )


def search_snapshot(survey: DataFrame, xref: DataFrame | None = None, plan=None, lot=None, block=None, description=None) -> tables.Limited:
    """Contains-search over a snapshot, joined to the cross-reference of the same date; null keys match null keys."""
    c = lambda col, v: predicates.contains(col, v, fold=False)
    rows = predicates.select_all(survey, [c("plan", plan), c("lot", lot), c("block", block), c("description", description)])
    rows = rows.drop("geom", *g.BOX)
    if xref is not None:
        x = xref.select(*[F.col(k).alias(f"x_{k}") for k in xref.columns])
        on = F.col("lot").eqNullSafe(F.col("x_Lot")) & F.col("block").eqNullSafe(F.col("x_Block")) & F.col("plan").eqNullSafe(F.col("x_Plan"))
        rows = rows.join(x, on, "left").distinct()
    return tables.limited(rows, predicates.SNAPSHOT_LIMIT, [F.col(k).asc_nulls_last() for k in ("lot", "block", "plan", "id")], "snapshot")
