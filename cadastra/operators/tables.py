"""Order, paging, unions and distinct rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


class TooManyRows(RuntimeError):
    """A result that may not be cut short was longer than its limit."""


@dataclass
class Limited:
    """Rows up to a limit; whether there were more is looked up when asked for."""

    rows: DataFrame
    limit: int
    probe: DataFrame
    label: str = ""

    @property
    def truncated(self) -> bool:
        return self.probe.limit(self.limit + 1).count() > self.limit

    def whole(self) -> DataFrame:
        if self.truncated:
            raise TooManyRows(f"{self.label or 'result'} has more than {self.limit:,} rows")
        return self.rows


def limited(df: DataFrame, limit: int, order: list, label: str = "") -> Limited:
    """The first rows of an order: a top-k, not a sort of everything."""
    return Limited(df.orderBy(*order).limit(limit), limit, df, label)


def any_truncated(parts: list[Limited]) -> bool:
    return any(p.truncated for p in parts)


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


# -- sorting -----------------------------------------------------------------------------------------------------------


def smart_key(col: str) -> list[Column]:
    """Numbers by value, then texts in any case; blanks null."""
    v = t.blank_to_null(col)
    n = t.number(v)
    return [n, F.when(n.isNull(), F.lower(v))]


def text_key(col: str) -> list[Column]:
    return [F.lower(t.blank_to_null(col))]


def number_key(col: str) -> list[Column]:
    return [t.number(col)]


#: Result column -> its sort keys.
SORT_KEYS = {
    "lot": lambda: smart_key("lot"),
    "block": lambda: smart_key("block"),
    "plan": lambda: smart_key("plan"),
    "desc": lambda: text_key("description"),
    "roll": lambda: smart_key("roll_number"),
    "address": lambda: text_key("full_address"),
    "zoning": lambda: text_key("zoning"),
    "zoningPct": lambda: number_key("zoning_top1_pct"),
    "zoning2": lambda: text_key("zoning_top2"),
    "area": lambda: number_key("assessed_land_area"),
    "lat": lambda: number_key("centroid_lat"),
    "lon": lambda: number_key("centroid_lon"),
    "value": lambda: number_key("total_assessed_value"),
    "walk": lambda: text_key("full_address"),
    "flood": lambda: text_key("full_address"),
}


def sort_order(keys: list[Column], ascending: bool = True, tie: str | None = None) -> list[Column]:
    """Blanks last either way; ties in input order. Of a number-or-text key, numbers come first when ascending."""
    first = [] if len(keys) == 1 else [F.coalesce(*[k.cast("string") for k in keys]).isNull().asc(), keys[0].isNull().asc() if ascending else keys[0].isNull().desc()]
    order = first + [k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys]
    return order + ([F.col(tie).asc()] if tie else [])


def sort_rows(df: DataFrame, key: str = "roll", ascending: bool = True, tie: str | None = "_ord") -> DataFrame:
    return df.orderBy(*sort_order(SORT_KEYS[key](), ascending, tie))


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """df with each row's place in an order, from 1: sorted by ranges, then counted from the sizes of the ranges before."""
    rows = df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).persist()
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).select("_range", "_first", "_before")
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before")


# -- unions and distinct rows ------------------------------------------------------------------------------------------


def first_by(df: DataFrame, key: list[str], order: list, keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key; with ``keep_null_keys`` rows with a null key all stay."""
    w = Window.partitionBy(*key).orderBy(*order)
    if not keep_null_keys:
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return first_by(df.where(~null), key, order).unionByName(df.where(null))


def union_first_seen(parts: list[DataFrame], key: str, order: str = "_ord") -> DataFrame:
    """Rows of all parts; of one key the first part's first row; null keys all stay."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_by(both, [key], ["_part", order], keep_null_keys=True).drop("_part")


def union_tagged(parts: dict[str, DataFrame], kind: str) -> DataFrame:
    """All rows of all parts, with the name of their part."""
    tagged = [p.withColumn(kind, F.lit(name)) for name, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def mode_first(df: DataFrame, col: str, order: str) -> DataFrame:
    """One row: the most frequent value; of several the one seen first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(1).select(col, "n")


def dedupe_by_key(df: DataFrame, key: str, order: str, address: str = "full_address", addresses: int = 5) -> DataFrame:
    """The first row of each key with _unitCount and its first addresses; null keys are left out."""
    top = F.min_by(F.struct(*df.columns), F.col(order))
    some = F.slice(F.array_sort(F.collect_list(F.when(t.blank_to_null(address).isNotNull(), F.struct(order, address)))), 1, addresses)
    out = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(top.alias("row"), F.count(F.lit(1)).alias("_unitCount"), F.transform(some, lambda s: s[address]).alias("_addresses"))
    return out.select("row.*", "_unitCount", "_addresses")


def title_case(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, as headings."""
    there = [c for c in wanted if c in df.columns]
    return df.select(*there).toDF(*[c.replace("_", " ").title() for c in there])


def row_key(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(col))
