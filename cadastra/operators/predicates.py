"""Predicates of searches: each returns a Column, or None where an input asks for nothing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

USER_LIMIT, PAGE_SIZE, SAFETY_LIMIT, MOST_ROLLS, SNAPSHOT_LIMIT = 1000, 5000, 100_000, 500, 500


def contains(col: str, value: str | None, fold: bool = True) -> Column | None:
    """Contains, in any case; % and _ in the value stay wildcards, a backslash stands for itself."""
    if value is None or not value.strip():
        return None
    value = value.strip()
    pattern = "%" + (value.upper() if fold else value).replace("\\", "\\\\") + "%"
    return (F.upper(F.col(col)) if fold else F.col(col)).like(pattern)


def rolls(value: str | None, col: str = "roll_number", most: int | None = None) -> Column | None:
    """One token: contains; several: any of the normalised ids, with ``most`` (MOST_ROLLS, say) only the first ones."""
    found = [x for x in re.split(r"[\s,;]+", value or "") if x]
    if len(found) <= 1:
        return contains(col, found[0] if found else None)
    ids = [x for x in map(t.normalize_roll_text, found) if x][:most]
    return F.col(col).isin(ids) if ids else None


def zoning(value: str | None, col: str = "zoning") -> Column | None:
    """Contains, hyphens on neither side."""
    bare = (value or "").replace("-", "").strip()
    if not bare:
        return None
    return F.upper(F.replace(F.col(col), F.lit("-"), F.lit(""))).like("%" + bare.upper().replace("\\", "\\\\") + "%")


def street_number(value) -> int | None:
    """The whole number that a text begins with, if it is not negative."""
    m = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    n = int(m[1]) if m else None
    return n if n is not None and n >= 0 else None


def address(first=None, last=None, street: str | None = None, number_col: str = "street_number", street_col: str = "street_name") -> list[Column]:
    """Equal, between (either way round), from or up to; and the street contains."""
    lo, hi = street_number(first), street_number(last)
    n = F.col(number_col)
    out = []
    if lo is not None and hi is not None:
        out.append(n == lo if lo == hi else n.between(min(lo, hi), max(lo, hi)))
    elif lo is not None:
        out.append(n >= lo)
    elif hi is not None:
        out.append(n <= hi)
    by_street = contains(street_col, street)
    return out + ([by_street] if by_street is not None else [])


def dwelling_units(mode: str | None = None, least: float | None = None, col: str = "dwelling_units") -> Column | None:
    """'zero': none; 'min': at least so many, if above 0; else anything."""
    units = t.number(col)
    if mode == "zero":
        return units == 0
    if mode == "min" and least is not None and float(least) > 0:
        return units >= float(least)
    return None


def in_window(ts: str, start: Column, end: Column) -> Column:
    return F.col(ts).between(start, end)


def municipality(col: str, name: str) -> Column:
    return F.lower(F.trim(F.col(col))) == name.lower()


def any_overlap_worth(p1: str, p2: str, least: float = 0.1) -> Column:
    return (F.col(p1) >= least) | (F.col(p2) >= least)


def select_all(df: DataFrame, found: list[Column | None]) -> DataFrame:
    """Rows that meet all predicates; no predicate at all gives no rows."""
    asked = [p for p in found if p is not None]
    return df.where(reduce(lambda a, b: a & b, asked)) if asked else df.where(F.lit(False))
