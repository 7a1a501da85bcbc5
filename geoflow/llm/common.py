"""Text helpers that several operators share."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python work holds at a time; one longer text is held alone.
SLICE_BYTES = 2 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Words between white space.
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    """``text`` with A-Z in lower case and everything else as it is."""
    return text.encode().translate(ASCII_LOWER).decode()


def lowered_column(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: str | None) -> list[str]:
    return SPACED.findall(lowered(text)) if text else []


def spaced_bytes(text: str | None) -> list[bytes]:
    """The same words in UTF-8. White space of ``bytes.split`` is what ``SPACED`` parts words at."""
    return text.encode().translate(ASCII_LOWER).split() if text else []


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches of a task; then its worker, which lives on for the next one, gives its free memory back."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of values with about ``most`` bytes each, with the place of the first."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield start, texts.slice(start, at - start).to_pylist()
            start, held = at, 0
        held += size
    if start < len(texts):
        yield start, texts.slice(start).to_pylist()


def text_key(text: Column) -> Column:
    """Sixteen bytes of the SHA-256 of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (upper or lower case alike)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
