"""Text, number and date expressions: names, lots, labels, links. All are column expressions for Catalyst."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street types and their short forms, applied to every word of a street name.
STREET_TYPES = {
    "AVENUE": "AVE",
    "AV": "AVE",
    "BAY": "BAY",
    "BOULEVARD": "BLVD",
    "BVD": "BLVD",
    "CIRCLE": "CIR",
    "CLOSE": "CL",
    "CL": "CL",
    "CRESCENT": "CRES",
    "CRESC": "CRES",
    "COURT": "CRT",
    "CT": "CRT",
    "DRIVE": "DR",
    "HIGHWAY": "HWY",
    "LANE": "LN",
    "PARKWAY": "PKWY",
    "PLACE": "PL",
    "ROAD": "RD",
    "SAINT": "ST",
    "STREET": "ST",
    "TERRACE": "TER",
    "TRAIL": "TRL",
    "WAY": "WY",
    "WY": "WY",
}

#: Letters with marks below U+0250 and their plain letters, from the Unicode tables.
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
_MARKS = "".join(map(chr, range(0x300, 0x370)))

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Cols) -> Column:
    x = _c(x).cast("string")
    return F.when(x != "", x)


def number(x: Cols) -> Column:
    """A text's finite number, else null; blank is missing, not zero."""
    d = F.trim(_c(x).cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def round_half_up(x: Cols, digits: int = 0) -> Column:
    """floor(x + 1/2) at ``digits`` decimals: halves go up, for negative numbers too."""
    if not digits:
        return F.floor(_c(x) + F.lit(0.5))
    scale = 10**digits
    return F.floor(_c(x) * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def percent(part: Cols, whole: Cols) -> Column:
    """Percent with one decimal; null where there is no whole."""
    return F.when(_c(whole) > 0, F.floor(F.try_divide(_c(part) * F.lit(1000.0), _c(whole)) + F.lit(0.5)) / F.lit(10.0))


# -- names -------------------------------------------------------------------------------------------------------------


def street_name(x: Cols) -> Column:
    """A street name without accents, apostrophes and other signs, upper-case, its types shortened; '' for nothing."""
    plain = F.translate(F.coalesce(_c(x), F.lit("")), "".join(_MARKED), "".join(_MARKED.values()))
    plain = F.translate(plain, _MARKS + "'’", "")
    plain = F.upper(F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" AND ")), "[^A-Za-z0-9]+", " ")))
    short = F.create_map(*[F.lit(v) for kv in STREET_TYPES.items() for v in kv])
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def corridor_key(street: Cols, one: Cols, other: Cols) -> Column:
    """The same for both directions of a corridor; null if a name is blank."""
    s, a, b = street_name(street), street_name(one), street_name(other)
    return F.when((s != "") & (a != "") & (b != ""), F.concat_ws("|", s, F.least(a, b), F.greatest(a, b)))


def street_number_text(address: Cols) -> Column:
    return F.regexp_extract(F.coalesce(_c(address), F.lit("")), r"^(\d+(?:[A-Za-z]|\s?1/2)?)", 1)


def zoning_code(x: Cols) -> Column:
    """What stands before the first ' - '."""
    return F.trim(F.split_part(_c(x), F.lit(" - "), F.lit(1)))


def normalize_roll(x: Cols) -> Column:
    """Digits only, padded to eleven; longer ones stay; null without digits."""
    digits = F.regexp_replace(_c(x).cast("string"), "[^0-9]", "")
    return F.when(digits == "", None).when(F.length(digits) >= 11, digits).otherwise(F.lpad(digits, 11, "0"))


def normalize_roll_text(x: str) -> str | None:
    """``normalize_roll`` for an input of a search."""
    digits = re.sub("[^0-9]", "", x)
    return digits.rjust(11, "0") if digits else None


# -- lists -------------------------------------------------------------------------------------------------------------


def natural_order(a: Column, b: Column) -> Column:
    """Comparator: numbers by value, then other texts in their order."""
    na, nb = number(a), number(b)
    both = na.isNotNull() & nb.isNotNull()
    text = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    by_number = F.when(na < nb, -1).when(na > nb, 1).otherwise(text)
    return F.when(both, by_number).when(na.isNotNull(), -1).when(nb.isNotNull(), 1).otherwise(text)


def _clean(values: Column, trim: bool) -> Column:
    texts = F.transform(values, lambda v: F.trim(v.cast("string")) if trim else v.cast("string"))
    return F.array_distinct(F.filter(texts, lambda v: v.isNotNull() & (v != "")))


def lot_list(lots: Cols) -> Column:
    """Distinct lots of an array: all digits as ranges ('21-25, 68'), else in natural order."""
    distinct = _clean(_c(lots), False)
    digits = ~F.exists(distinct, lambda v: ~v.rlike("^[0-9]+$"))
    numbers = F.array_sort(F.array_distinct(F.transform(distinct, lambda v: v.try_cast("bigint"))))
    begins = F.filter(numbers, lambda v: ~F.array_contains(numbers, v - 1))
    stops = F.filter(numbers, lambda v: ~F.array_contains(numbers, v + 1))
    span = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))
    ranges = F.array_join(F.zip_with(begins, stops, span), ", ")
    return F.when(digits, ranges).otherwise(F.array_join(F.array_sort(distinct, natural_order), ", "))


def sorted_list(values: Cols, sep: str = ", ") -> Column:
    """Distinct trimmed values of an array: by number if all are numbers, else by text."""
    distinct = _clean(_c(values), True)
    numeric = ~F.exists(distinct, lambda v: ~v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
    return F.array_join(F.when(numeric, F.array_sort(distinct, natural_order)).otherwise(F.array_sort(distinct)), sep)


def first_seen_list(values: Cols, sep: str = ", ") -> Column:
    """Distinct trimmed values of an array in their order."""
    return F.array_join(_clean(_c(values), True), sep)


def tokens(x: Cols) -> Column:
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"[\s,;]+"), lambda t: t != "")


def token_count(x: Cols) -> Column:
    return F.size(tokens(x))


# -- labels ------------------------------------------------------------------------------------------------------------


def volume_label(x: Cols) -> Column:
    v = _c(x).cast("double")
    tenths = F.floor(v / 100 + 0.5)
    one = F.when(tenths % 10 == 0, F.floor(tenths / 10).cast("string")).otherwise(F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")))
    return (
        F.when(v.isNull() | F.isnan(v), "")
        .when(v >= 10000, F.concat(F.floor(v / 1000 + 0.5).cast("string"), F.lit("k")))
        .when(v >= 1000, F.concat(one, F.lit("k")))
        .otherwise(F.floor(v + 0.5).cast("string"))
    )


def thousands(x: Cols) -> Column:
    return F.format_number(F.floor(_c(x) + 0.5).cast("bigint"), 0)


def dollars(x: Cols) -> Column:
    n = number(x)
    return F.when(n > 0, F.concat(F.lit("$"), thousands(n)))


def area_text(x: Cols) -> Column:
    n = number(x)
    return F.when(n > 0, thousands(n))


def coordinate_text(x: Cols) -> Column:
    n = number(x)
    return F.when(n.isNotNull(), F.format_string("%.6f", n))


def percent_text(x: Cols) -> Column:
    n = number(x)
    return F.when(n >= 1, F.concat(F.floor(n + 0.5).cast("string"), F.lit("%")))


def second_zone(code: Cols, pct: Cols) -> Column:
    code, n = blank_to_null(code), number(pct)
    return F.when(n.isNull(), code).otherwise(F.concat(code, F.lit(" ("), F.floor(n + 0.5).cast("string"), F.lit("%)")))


def shortened(x: Cols, most: int) -> Column:
    return F.when(F.length(_c(x)) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit("…"))).otherwise(_c(x))


def acres(square_feet: Cols) -> Column:
    return F.format_string("%.2f", _c(square_feet).cast("double") / 43560)


def size_text(square_feet: Cols) -> Column:
    n = number(square_feet)
    return F.when(n > 0, F.concat(thousands(n), F.lit(" sf ("), acres(n), F.lit(" ac)")))


def escape_html(x: Cols) -> Column:
    out = _c(x)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def csv_cell(x: Cols) -> Column:
    """Quoted only where it must be; null is empty."""
    x = F.coalesce(_c(x).cast("string"), F.lit(""))
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def result_count(n: int, what: str = "parcel", truncated: bool = False) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}{' (limit reached)' if truncated else ''}"


# -- links -------------------------------------------------------------------------------------------------------------


def encode_component(x: Cols) -> Column:
    """Percent-encoding with %20 for spaces."""
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def record_url(base: str, roll: Cols) -> Column:
    return F.when(blank_to_null(roll).isNotNull(), F.concat(F.lit(base), encode_component(roll)))


def address_url(base: str, address: Cols, suffix: str = "") -> Column:
    """A link for the first of comma-joined addresses."""
    first = F.trim(F.split_part(_c(address), F.lit(","), F.lit(1)))
    return F.when(first != "", F.concat(F.lit(base), encode_component(F.concat(first, F.lit(suffix)))))


def point_url(base: str, lat: Cols, lon: Cols, address: Cols) -> Column:
    """A link with lat, lon and label where they are known; null with none of them."""
    la, lo = number(lat), number(lon)
    at = F.when(la.isNotNull() & lo.isNotNull(), F.format_string("lat=%.6f&lon=%.6f", la, lo))
    first = F.trim(F.split_part(F.coalesce(_c(address), F.lit("")), F.lit(","), F.lit(1)))
    label = F.when(first != "", F.concat(F.lit("label="), F.url_encode(first)))
    query = F.concat_ws("&", at, label)
    return F.when(query != "", F.concat(F.lit(base), F.lit("?"), query))


def safe_url(x: Cols) -> Column:
    """http and https only."""
    return F.when(F.lower(F.regexp_extract(F.trim(_c(x)), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.trim(_c(x)))


# -- dates -------------------------------------------------------------------------------------------------------------


def iso_text(ts: Cols) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def date_text(x: Cols) -> Column:
    """yyyy-mm-dd of a text that is a time, else the text; '' for nothing."""
    x = F.coalesce(_c(x).cast("string"), F.lit(""))
    return F.coalesce(F.date_format(x.try_cast("timestamp_ntz"), "yyyy-MM-dd"), x)


def sample_days(first: Cols, last: Cols, step_minutes: int = 15) -> Column:
    """Days from first to last with one step more, at least a step, two decimals; 1 if unknown."""
    seconds = F.timestamp_diff("SECOND", _c(first), _c(last)) + 60 * step_minutes
    days = F.floor(F.greatest(seconds, F.lit(60 * step_minutes)) / 86400 * 100 + 0.5) / 100  # greatest() passes nulls over
    return F.when(seconds.isNotNull(), days).otherwise(F.lit(1.0))
