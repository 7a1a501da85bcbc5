"""Scalar expressions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoflow.schemas import INDEX_BITS, MAX_PERIODS, MAX_REGIONS, REGION_BITS

# Fixed values of the model.
EARTH_RADIUS_KM = 6371.0088
KERNEL_SIGMA_KM = 800.0
GRAVITY_OFFSET_KM = 1500.0
LATITUDE_LIMIT = 85.0
LAST_YEAR = 2100

_INDEX_MASK = (1 << INDEX_BITS) - 1
_PERIOD_SHIFT = REGION_BITS + INDEX_BITS


# --- packed ids -----------------------------------------------------------------

def pack_id(period: Column, region: Column, index: Column) -> Column:
    """One 64-bit id; periods from 32 on set the sign bit, so their ids are negative."""
    p = F.shiftleft(period.cast("long").bitwiseAND(F.lit(MAX_PERIODS - 1)), _PERIOD_SHIFT)
    r = F.shiftleft(region.cast("long").bitwiseAND(F.lit(MAX_REGIONS - 1)), INDEX_BITS)
    i = index.cast("long").bitwiseAND(F.lit(_INDEX_MASK))
    return p.bitwiseOR(r).bitwiseOR(i)


def period_of_id(packed: Column) -> Column:
    return F.shiftright(packed, _PERIOD_SHIFT).bitwiseAND(F.lit(MAX_PERIODS - 1)).cast("int")


def region_of_id(packed: Column) -> Column:
    return F.shiftright(packed, INDEX_BITS).bitwiseAND(F.lit(MAX_REGIONS - 1)).cast("int")


def index_of_id(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_INDEX_MASK))


def unpack_id(packed: Column) -> Column:
    return F.struct(
        period_of_id(packed).alias("period"),
        region_of_id(packed).alias("region"),
        index_of_id(packed).alias("index"),
    )


# --- numbers --------------------------------------------------------------------

def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_ratio(part: Column, total: Column) -> Column:
    """``part / total``, or ``part`` as it is where the total is zero or absent."""
    return part / F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(total)


def linear_schedule(first: float, last: float, count: int, step: Column) -> Column:
    """Value at ``step`` of ``count`` evenly spaced values from first to last."""
    return F.lit(float(first)) + F.lit(float(last) - float(first)) * step / F.lit(float(max(count - 1, 1)))


def normalise(values: Column) -> Column:
    """Array divided by its sum; unchanged where the sum is zero."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(values, lambda x: safe_ratio(x, total))


def argmax_label(values: Column, names) -> Column:
    """Name at the position of the first maximum."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.element_at(labels, F.array_position(values, F.array_max(values)).cast("int"))


# --- geometry -------------------------------------------------------------------

def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def clamp_lat(lat: Column) -> Column:
    return clip(lat, -LATITUDE_LIMIT, LATITUDE_LIMIT)


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180); floored modulo, since ``%`` keeps the sign."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def gaussian_kernel(distance_km: Column, sigma_km: float = KERNEL_SIGMA_KM) -> Column:
    return F.exp(-(distance_km * distance_km) / F.lit(2.0 * sigma_km * sigma_km))


def gravity(mass_from: Column, mass_to: Column, distance_km: Column) -> Column:
    reach = distance_km + F.lit(GRAVITY_OFFSET_KM)
    return mass_from * mass_to / (reach * reach)


def direction_score(delta_lon: Column) -> Column:
    """0 for far westward, 0.5 for neutral, 1 for far eastward."""
    return (F.tanh(delta_lon / F.lit(90.0)) + F.lit(1.0)) / F.lit(2.0)


def density_ratio(pop: Column, peak: Column) -> Column:
    return F.sqrt(F.least(F.lit(1.0), pop / F.greatest(peak, F.lit(1.0))))


# --- grid cells -----------------------------------------------------------------

def grid_rows(res: int) -> int:
    """Rows of the grid at a resolution.

    The number is chosen so that the sphere splits into about as many cells as the
    public hexagon grid has at that resolution, ``2 + 120 * 7**res``.
    """
    cells = 2 + 120 * 7**res
    square_degrees = 4 * math.pi * (180 / math.pi) ** 2
    return max(2, round(180 / math.sqrt(square_degrees / cells)))


def grid_cell_bound(res: int) -> int:
    """No grid of this resolution has more cells than this."""
    return grid_rows(res) * 2 * grid_rows(res)


def cell_id(lat: Column, lon: Column, res: int = 3) -> Column:
    """Near-equal-area cell of a point: rows of latitude, columns by the row's cosine."""
    rows = grid_rows(res)
    step = 180.0 / rows
    row = clip(F.floor((lat + F.lit(90.0)) / F.lit(step)).cast("int"), 0, rows - 1)
    middle = F.radians((row + F.lit(0.5)) * F.lit(step) - F.lit(90.0))
    columns = F.greatest(F.lit(1), F.floor(F.lit(360.0 / step) * F.cos(middle) + F.lit(0.5)).cast("int"))
    column = F.floor((wrap_lon(lon) + F.lit(180.0)) / F.lit(360.0) * columns).cast("int")
    column = F.greatest(F.lit(0), F.least(columns - F.lit(1), column))
    return (
        F.lit(res << 48).cast("long")
        + row.cast("long") * F.lit(1 << 24).cast("long")
        + column.cast("long")
    )


def cell_name(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def tile_name(kind: str, period: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.lpad(period.cast("string"), 2, "0"), F.lit(".json"))


# --- years ----------------------------------------------------------------------

def death_year(birth_year: Column, span: Column, period_year: Column) -> Column:
    total = birth_year.cast("int") + span.cast("int")
    return F.greatest(period_year.cast("int"), F.least(F.lit(LAST_YEAR), total))


def year_in_period(period_year: Column, draw: Column, width: int) -> Column:
    return (period_year + F.floor(draw * F.lit(width))).cast("int")
