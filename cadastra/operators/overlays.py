"""Overlay layers: policy areas, contaminated sites, edge dimensions, tile layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import style
from ..functions import text as t
from .tables import first_by, union_tagged

LEAST_EDGE_FT = 5.0
TILE_COLUMNS = ["roll_number", "full_address", "property_use_code", "dwelling_units", "assessed_land_area"]


def secondary_plans(precincts: DataFrame, redevelopment: DataFrame) -> DataFrame:
    both = union_tagged({"Precinct": precincts, "Major Redevelopment": redevelopment}, "plan_kind")
    names = [F.col(c) for c in ("precinct_name", "feature_name") if c in both.columns]
    kind = F.col("plan_kind")
    return both.withColumns({"label": F.coalesce(*names, F.lit("")), "fill": style.category(kind, style.PLAN_FILL, style.PLAN_FILL_OTHER), "line": style.category(kind, style.PLAN_LINE, style.PLAN_LINE_OTHER)})


def infill_area(communities: DataFrame) -> DataFrame:
    return communities


def malls_and_corridors(malls: DataFrame, urban: DataFrame, regional: DataFrame) -> DataFrame:
    all_ = union_tagged({"Mall": malls, "Urban Corridor": urban, "Regional Corridor": regional}, "pdo_kind")
    return all_.withColumn("fill", style.category("pdo_kind", style.CORRIDOR_FILL, style.CORRIDOR_FILL_OTHER))


def contaminated_sites(csv: DataFrame, municipality: str) -> DataFrame:
    """Sites of a municipality with finite coordinates; blanks for missing fields. Blank coordinates are missing, not 0."""
    by_name = {c.strip().upper(): c for c in csv.columns}
    town, lat, lon = (by_name[k] for k in ("MUNICIPALITY", "LATITUDE", "LONGITUDE"))
    rows = csv.where((F.lower(F.trim(F.col(town))) == municipality.lower()) & t.number(lat).isNotNull() & t.number(lon).isNotNull())
    kept = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in csv.columns]
    group = next((c for c in csv.columns if c.strip() == "CSGroup"), None)
    colour = style.category(F.col(group), style.SITE, style.SITE_OTHER) if group else F.lit(style.SITE_OTHER)
    return rows.select(*kept, t.number(lon).alias("lon"), t.number(lat).alias("lat"), colour.alias("colour"))


def edge_dimensions(parcels: DataFrame, key: str = "_ord") -> DataFrame:
    """Outer edges of at least 5 feet, each once whichever way it runs, with their length as a label."""
    rings = parcels.select(key, F.posexplode(F.transform("geom", lambda p: p[0])).alias("part", "ring"))
    rows = rings.select(key, "part", F.posexplode(g.edges(F.col("ring"))).alias("k", "e"))
    a, b = F.col("e.a"), F.col("e.b")
    rows = rows.withColumns({"feet": g.haversine_ft(a["x"], a["y"], b["x"], b["y"]), "edge": g.edge_key(a["x"], a["y"], b["x"], b["y"])}).where(F.col("feet") >= LEAST_EDGE_FT)
    first = first_by(rows, ["edge"], [key, "part", "k"])
    return first.select(key, "edge", "feet", ((a["x"] + b["x"]) / 2).alias("lon"), ((a["y"] + b["y"]) / 2).alias("lat"), F.concat(F.floor(F.col("feet") + 0.5).cast("string"), F.lit(" ft")).alias("label"))


def shape_digest(geom: str = "geom") -> Column:
    return F.md5(F.to_json(F.struct(F.col(geom).alias("g"))).cast("binary"))


def tile_layers(parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The polygon layer, one parcel per shape (the first by roll), and the layer of label points inside the shapes."""
    shaped = parcels.where(F.col("geom").isNotNull()).withColumn("_digest", shape_digest())
    polygons = first_by(shaped, ["_digest"], ["roll_number"]).drop("_digest").select(*TILE_COLUMNS, "geom")
    labels = polygons.withColumn("_pt", g.point_on_surface("geom")).select(*TILE_COLUMNS, F.round("_pt.x", 7).alias("lon"), F.round("_pt.y", 7).alias("lat"))
    return polygons, labels
