"""Seeded draws per row that depend on nothing but the row's own keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoflow.functions.expr import clamp_lat, clip, wrap_lon

_SHORT, _WIDE = 8, 13


class Draws:
    """Independent draws of one row, each named by a salt and a part.

    ``xxhash64`` (default) hashes the seed, salt, part and keys once per draw and stays
    in generated code. ``md5`` takes its draws from slices of one text digest per
    salt, which any engine can recompute: parts 0 to 3, or 0 to 1 for wide draws.
    """

    def __init__(self, seed: int, *keys: Column, source: str = "xxhash64"):
        if source not in ("xxhash64", "md5"):
            raise ValueError("source is 'xxhash64' or 'md5'")
        self.seed, self.keys, self.source = seed, keys, source

    def _hashed(self, salt: str, part: int) -> Column:
        bits = F.xxhash64(F.lit(self.seed), F.lit(salt), F.lit(part), *self.keys)
        return (F.shiftrightunsigned(bits, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    def _sliced(self, salt: str, part: int, digits: int) -> Column:
        text = F.concat_ws(":", F.lit(str(self.seed)), F.lit(salt), *[k.cast("string") for k in self.keys])
        whole = F.conv(F.substring(F.md5(text), 1 + part * digits, digits), 16, 10).cast("double")
        return (whole + F.lit(0.5)) / F.lit(float(16**digits))

    def uniform(self, salt: str, part: int) -> Column:
        """Draw in (0, 1)."""
        return self._hashed(salt, part) if self.source == "xxhash64" else self._sliced(salt, part, _SHORT)

    def wide(self, salt: str, part: int) -> Column:
        """Draw in (0, 1) with 52 bits, for choosing among more than 2**32 things."""
        return self._hashed(salt, part) if self.source == "xxhash64" else self._sliced(salt, part, _WIDE)

    def standard_normal(self, salt: str, part: int) -> Column:
        """Normal draw from parts ``part`` and ``part + 1`` (Box-Muller)."""
        radius = F.sqrt(F.lit(-2.0) * F.log(self.uniform(salt, part)))
        return radius * F.cos(F.lit(2.0 * math.pi) * self.uniform(salt, part + 1))

    def normal(self, mean, deviation, salt: str, part: int) -> Column:
        return mean + deviation * self.standard_normal(salt, part)

    def gamma4(self, salt: str) -> Column:
        """Gamma(4) draw from the salt's four parts."""
        u = [self.uniform(salt, part) for part in range(4)]
        return -F.log(u[0] * u[1] * u[2] * u[3])


def lifespan(period: Column, last_period: int, draws: Draws, salt: str = "life") -> Column:
    """Years lived: a share of early deaths that shrinks over time, else an adult age."""
    # Fixed values of the model: shares, means and deviations at both ends of time.
    x = period / F.lit(float(max(last_period, 1)))
    early_share = F.lit(0.30) * (F.lit(1.0) - x) + F.lit(0.02)
    mean = F.lit(45.0) + F.lit(35.0) * x
    deviation = F.lit(12.0) - F.lit(4.0) * x
    early = F.floor(draws.uniform(salt, 1) * F.lit(8)).cast("int")
    adult = clip(draws.normal(mean, deviation, salt, 2), 10.0, 100.0).cast("int")
    return F.when(draws.uniform(salt, 0) < early_share, early).otherwise(adult)


def jitter(lat: Column, lon: Column, radius: Column, scale: float, draws: Draws, salt: str) -> tuple[Column, Column]:
    """Point around a centre; longitude noise grows as the circles of latitude shrink."""
    sigma = radius * F.lit(scale)
    shrink = F.greatest(F.cos(F.radians(lat)), F.lit(0.2))
    new_lat = clamp_lat(lat + sigma * draws.standard_normal(salt, 0))
    new_lon = wrap_lon(lon + sigma * draws.standard_normal(salt, 2) / shrink)
    return new_lat, new_lon
