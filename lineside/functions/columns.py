"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label overrides, month abbreviations, code map, dedicated-way entities, events.
LABEL_OVERRIDES = {"MONONGAHELA INCLINE": "MI"}
RAIL_CODES = {"BLLB": "BLUE", "RED": "RED", "SLVR": "SLVR"}
BUSWAY_ROUTES = ("P1", "P2", "P3", "G2")
FLYER_PREFIXES = ("P", "G", "O")
KNOWN_EVENTS = {
    "2020-03": "COVID-19 shutdown begins",
    "2020-04": "COVID-19 reduced service",
    "2020-05": "COVID-19 reduced service",
    "2020-06": "COVID-19 partial recovery",
}
EARTH_KM = 6371.0
EARTH_M = 6_371_000.0
MERCATOR_M = 6378137.0
METRES_PER_DEGREE = 111_320.0
PROJECTION_LAT = 40.44


def lookup(key: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of ``key`` in a small fixed map, else ``default`` (NULL when not given)."""
    if not table:
        return default if default is not None else F.lit(None).cast("string")
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def entity_id(label: Column, overrides: Mapping[str, str] = LABEL_OVERRIDES) -> Column:
    """Identifier in front of the first ``" - "`` of a label, unless the label is overridden."""
    return lookup(label, overrides, F.trim(F.split(label, " - ", 2)[0]))


def entity_name(label: Column) -> Column:
    """Text after the first ``" - "`` of a label, or the whole label."""
    return F.when(F.contains(label, F.lit(" - ")), F.trim(F.get(F.split(label, " - ", 2), 1))).otherwise(label)


def month_from_header(header: Column) -> Column:
    """``2019-Jan`` as ``2019-01``."""
    return F.date_format(F.to_date(F.concat(header, F.lit("-01")), "yyyy-MMM-dd"), "yyyy-MM")


def month_from_key(key: Column) -> Column:
    """``201901`` as ``2019-01``."""
    text = key.cast("string")
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))


def month_of_year(month: Column) -> Column:
    return F.substring(month, 6, 2).cast("int")


def blank_to_null(text: Column, *markers: str) -> Column:
    """NULL for the empty string and for each further missing-value marker."""
    return F.when(~text.isin("", *markers), text)


def known_place(place: Column) -> Column:
    """True where a geography name is really there: not NULL, not ``'0'``, not empty."""
    return place.isNotNull() & ~place.isin("0", "")


def bus_subtype(entity: Column) -> Column:
    """Service class of a bus route from the form of its identifier."""
    flyer = F.lit(False)
    for prefix in FLYER_PREFIXES:
        flyer = flyer | entity.startswith(prefix)
    return (
        F.when(entity.endswith("L"), "limited")
        .when(entity.endswith("X"), "express")
        .when(entity.isin(*BUSWAY_ROUTES), "busway")
        .when(flyer, "flyer")
        .otherwise("local")
    )


def subtype_or_mode(entity: Column, mode: Column) -> Column:
    return F.when(mode == "BUS", bus_subtype(entity)).otherwise(F.lower(mode))


def indicator(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def ladder(x: Column, steps: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Tier label: the first step whose condition holds."""
    label = None
    for condition, name in steps:
        label = F.when(condition, name) if label is None else label.when(condition, name)
    return label.otherwise(otherwise)


def rounded(x: Column, digits: int = 6) -> Column:
    """Round for reports, in two steps so that summation noise cannot tip a tie.

    Adding zero turns a negative zero into a plain one.
    """
    return F.round(F.round(x.cast("double"), digits + 4), digits) + F.lit(0.0)


def stable(x: Column, digits: int = 12) -> Column:
    """A computed double cut to ``digits`` significant digits, so that ties do not depend on summation order.

    Works at any size of the values. A difference of two computed values should come from ``gap``,
    as its own digits say nothing about the noise of the operands.
    """
    x = x.cast("double") + F.lit(0.0)
    size = F.abs(x)
    finite = (size > 0) & (size < float("inf"))
    scale = F.pow(F.lit(10.0), (digits - 1) - F.floor(F.log10(F.when(finite, size))))
    return F.when(finite & (scale < float("inf")), F.round(x * scale) / scale).otherwise(x)


def gap(a: Column, b: Column, digits: int = 12) -> Column:
    """``a - b``, or zero when the two agree in their first ``digits`` significant digits."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 10.0 ** -digits, F.lit(0.0)).otherwise(a - b)


def between(x: Column, low: float, high: float) -> Column:
    """``x`` cut to a range; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


# --- aggregates -----------------------------------------------------------------------------


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum(v*w) / sum(w); a zero or absent total weight gives NULL."""
    return F.try_divide(F.sum(value * weight), F.nullif(F.sum(weight.cast("double")), F.lit(0.0)))


def weighted_or_plain_mean(value: Column, weight: Column) -> Column:
    """Weighted mean where the total weight is positive, the plain mean otherwise."""
    total = F.sum(weight.cast("double"))
    return F.when(total > 0, F.try_divide(F.sum(value * weight), total)).otherwise(F.avg(value))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; NULL when either side has no variance."""
    scale = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return between(F.try_divide(F.regr_sxy(y, x), F.nullif(scale, F.lit(0.0))), -1.0, 1.0)


# --- geometry -------------------------------------------------------------------------------


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # between antipodes the chord may round above 1
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(chord), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - chord)))


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_M))) - F.pi() / 2)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(MERCATOR_M))


def local_north(lat: Column) -> Column:
    """Metres north of the equator on a local equirectangular plane."""
    return lat * F.lit(METRES_PER_DEGREE)


def local_east(lon: Column, at_lat: float = PROJECTION_LAT) -> Column:
    """Metres east on the same plane, with the scale of the latitude ``at_lat``."""
    return lon * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(F.lit(at_lat)))


def distance_zone(km: Column, inner: float = 2.0, outer: float = 8.0) -> Column:
    return (
        F.when(km < inner, f"Downtown (< {inner:g} km)")
        .when(km < outer, f"Inner ring ({inner:g}-{outer:g} km)")
        .otherwise(f"Outer ring (> {outer:g} km)")
    )
