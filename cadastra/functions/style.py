"""Colours, widths, labels and popups as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

# Colours by category, and breaks and values of ramps.
ZONING = {
    "Single Family Residential": "#fff4a3",
    "Two Family Residential": "#ffd9a0",
    "Multi-Family Residential": "#f5b97d",
    "Commercial": "#f08d8d",
    "Parks and Recreation": "#9ccc9c",
    "Industrial": "#b5b0cc",
    "Agricultural": "#e0d596",
    "Rural Residential": "#d9c8a3",
    "Multi-Use Sector": "#c8a2c8",
    "Character Sector": "#d2b5dc",
    "Downtown Living Sector": "#ffab80",
    "Educational & Institutional": "#a3c4e8",
    "Riverbank Sector": "#99c5c5",
}
ZONING_OTHER = "#cccccc"
PLAN_FILL = {"Precinct": "#8e6cb3", "Major Redevelopment": "#c47bd6"}
PLAN_FILL_OTHER = "#a07ec5"
PLAN_LINE = {"Precinct": "#5a3d8a", "Major Redevelopment": "#7a3a92"}
PLAN_LINE_OTHER = "#5a3d8a"
CORRIDOR_FILL = {"Mall": "#2c8aa8", "Urban Corridor": "#4fb3c7", "Regional Corridor": "#1f6680"}
CORRIDOR_FILL_OTHER = "#5fa8b8"
SITE = {"Designated Contaminated Site": "#c0392b", "Designated Impacted Site": "#e67e22"}
SITE_OTHER = "#7f8c8d"
VOLUMES = (0, 5000, 15000, 30000, 60000)
VOLUME_COLOR = ("#4f9d69", "#d6c94f", "#e59a3d", "#d45a43", "#7b3f98")
LINE_WIDTH = (1.5, 2.5, 4, 6, 9)
CASING_WIDTH = (3.5, 4.5, 6, 8, 11)
POINT_RADIUS = (4, 6, 8, 11, 14)
VOLUME_CLASSES = ("<5k", "5–15k", "15–30k", "30–60k", "60k+")


def category(x, colours: dict[str, str], other: str) -> Column:
    """A colour by category; ``other`` for all that are not listed."""
    x = F.col(x) if isinstance(x, str) else x
    out = None
    for k, v in colours.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(other)


def ramp(x, values: tuple, breaks: tuple = VOLUMES) -> Column:
    """Linear between breaks, constant outside; what is no number counts as 0."""
    v = F.coalesce(t.number(x), F.lit(0.0))
    out = F.when(v <= breaks[0], F.lit(float(values[0])))
    for (b0, b1), (v0, v1) in zip(zip(breaks, breaks[1:], strict=False), zip(values, values[1:], strict=False), strict=True):
        out = out.when(v <= b1, F.lit(float(v0)) + (v - b0) * float(v1 - v0) / float(b1 - b0))
    return out.otherwise(float(values[-1]))


def ramp_color(x) -> Column:
    """The volume ramp's colour, channels interpolated."""
    channels = [[int(c[k : k + 2], 16) for c in VOLUME_COLOR] for k in (1, 3, 5)]
    return F.format_string("#%02x%02x%02x", *[F.floor(ramp(x, tuple(c)) + 0.5).cast("int") for c in channels])


def volume_class(x) -> Column:
    v = F.coalesce(t.number(x), F.lit(0.0))
    out = F.when(v < VOLUMES[1], VOLUME_CLASSES[0])
    for k in (2, 3, 4):
        out = out.when(v < VOLUMES[k], VOLUME_CLASSES[k - 1])
    return out.otherwise(VOLUME_CLASSES[-1])


def zone_label(x) -> Column:
    """Codes of at most five characters."""
    x = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return F.when(F.length(x) <= 5, x).otherwise("")


def _line(value: Column, before: str = "", after: str = "") -> Column:
    """A line of a popup, null where the value is blank."""
    value = t.blank_to_null(value)
    return F.concat(F.lit(before), t.escape_html(value), F.lit(after))


def zoning_popup(zoning="zoning", short="short_description", long="long_description") -> Column:
    return F.concat_ws("<br>", _line(F.col(zoning), "<strong>", "</strong>"), _line(F.col(short), "<em>", "</em>"), _line(F.col(long)))


def site_popup() -> Column:
    name = F.coalesce(t.blank_to_null("OPERATION NAME"), t.blank_to_null("OPRID"), F.lit("Contaminated site"))
    address = F.concat_ws(", ", _line(F.col("ADDRESS")), _line(F.col("MUNICIPALITY")))
    link = F.concat(F.lit('<a href="'), t.escape_html(t.safe_url(t.blank_to_null("Link"))), F.lit('">Registry record</a>'))
    return F.concat_ws("<br>", _line(name, "<strong>", "</strong>"), t.blank_to_null(address), _line(F.col("CSGroup")), link, _line(F.col("OPRID"), "<small>Site ID: ", "</small>"))


def traffic_popup() -> Column:
    station = F.col("traffic_kind") == "station"
    title = F.when(station, F.coalesce(t.blank_to_null("site"), F.lit("Permanent count station"))).otherwise(F.coalesce(t.blank_to_null("location_description"), t.blank_to_null("road_name"), t.blank_to_null("street"), F.lit("Traffic count")))
    volume = F.when(F.col("avg_daily_volume") != 0, F.concat(F.lit("24h avg volume: <strong>"), t.thousands("avg_daily_volume"), F.lit("</strong> vehicles/day")))
    between = F.when(~station & t.blank_to_null("street_from").isNotNull() & t.blank_to_null("street_to").isNotNull(), F.concat(t.escape_html("street_from"), F.lit(" to "), t.escape_html("street_to")))
    window = F.when(F.col("count_start").isNotNull() | F.col("count_end").isNotNull(), F.concat(F.lit("<small>Count window: "), t.date_text("count_start"), F.lit(" to "), t.date_text("count_end"), F.lit("</small>")))
    return F.concat_ws("<br>", _line(title, "<strong>", "</strong>"), volume, between, window, _line(F.col("match_type"), "<small>Match: ", "</small>"), _line(F.col("source_name"), "<small>Source: ", "</small>"))


def assessment_popup(unit_count: str | None = None) -> Column:
    """Popup of a tax parcel."""
    units = t.number("dwelling_units")
    whole = F.when(units == F.floor(units), F.floor(units).cast("string")).otherwise(units.cast("string"))
    lines = [
        _line(F.col("roll_number"), "<strong>Roll #</strong> "),
        _line(F.col("full_address")),
        _line(F.col("property_use_code"), "<em>", "</em>"),
        F.concat(F.lit("<strong>Size</strong> "), t.size_text("assessed_land_area")),
        F.concat(F.lit("<strong>DU</strong> "), whole),
    ]
    if unit_count:
        more = F.col(unit_count) - 1
        lines.append(F.when(more > 0, F.concat(F.lit("<small>+ "), more.cast("string"), F.lit(" more unit"), F.when(more == 1, "").otherwise("s"), F.lit("</small>"))))
    return F.concat_ws("<br>", *lines)


def survey_popup() -> Column:
    blank = lambda c: t.escape_html(F.coalesce(F.col(c), F.lit("")))
    head = F.concat(F.lit("<strong>Lot</strong> "), blank("lot"), F.lit("&nbsp;<strong>Block</strong> "), blank("block"), F.lit("&nbsp;<strong>Plan</strong> "), blank("plan"))
    return F.concat_ws("<br>", head, _line(F.col("description")))


def show_context(primary_roll: Column, context_roll: Column) -> Column:
    """Whether the second parcel of a popup is another one than the first."""
    return context_roll.isNotNull() & ~F.coalesce(primary_roll == context_roll, F.lit(False))
