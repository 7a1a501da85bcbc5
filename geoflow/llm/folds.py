"""Folds of documents by the CRC-32 of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_: Column, modulus: int) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % modulus


def held_out(id_: Column, modulus: int, rest: int) -> Column:
    """Whether an id is in the held-out fold; a null id is not."""
    return F.coalesce(remainder(id_, modulus) == rest, F.lit(False))


def first_by_hash(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` ids, those with the smallest hash: a sample that does not depend on partitions."""
    return rows.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)
