"""Removal of byte strings that repeat anywhere in the corpus, by suffix sorting of pieces.

Every byte is removed that lies in a string of ``length`` bytes which also starts anywhere
else, in the same document or another.

1. Texts that are equal are one text with a number of copies.
2. Each window of ``length`` bytes is owned by one of its ``GRAM``-byte grams, the least by
   hash, the leftmost on ties. Equal windows have equal owners at equal places, so they meet
   under the owner's hash. A gram owns a run of windows, about one for every 85 bytes; a run is a row: text, gram,
   place, and the digest of its bytes. Rows whose gram occurs once in the corpus are dropped: their windows occur once.
3. Runs with the same bytes are one run with a number of copies. Each distinct run's bytes (a piece) are taken
   from one of its texts and shuffled by the gram's hash. Each task brings its pieces into suffix
   order by two-stage sorting and computes the prefixes that neighbours share; windows that share
   ``length`` bytes and occur twice are repeated.
4. The repeated windows of a run are joined to its places, one row for a run of a text, and the bytes they cover are taken out.

A gram that many distinct runs have would gather its pieces in one task. The more of them it has
the finer its runs are cut, into parts of 32 windows and then single windows, and each part
is shuffled by the bytes that all its windows share. Equal parts are sent once or twice per
task. The repeated windows of parts are put together by run before they are joined to places. That changes where
windows meet, not the result.

Ids may be null or repeated. Null texts are empty: 0 bytes, nothing removed. Texts shorter than ``length``
lose nothing; a text of 2^30 bytes or more fails, as places have 30 bits. An empty table gives an empty table.
Further columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import slices, text_key
from geoflow.llm.suffix_sort import repeated_windows
from geoflow.session import cut, owned, remove

LENGTH, GRAM = 200, 32
#: Distinct runs of a gram from which they are cut into parts of so many windows.
FINER = ((512, 32), (32_768, 1))
#: Bytes of pieces that are sorted together; one gram's pieces are never parted.
SORTED_BYTES = 1 << 18
#: Digests of pieces a task keeps to send equal ones no more than twice, and bytes of text that it works on together.
REMEMBERED, TOGETHER_BYTES = 1 << 16, 1 << 20
_PLACE_BITS = np.uint64(30)


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position."""
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    power, width = 0xD6E8FEB86659FD93, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & (1 << 64) - 1, width * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Least of every ``window`` values in a row."""
    width = 1
    while width * 2 <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, place of the gram, first window, number of windows) of every run of windows with one owner."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) >= 1 << 30:
        raise ValueError("a text of 2^30 bytes or more has no places for its grams")
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = grams(data)
    place = np.arange(len(h), dtype=np.uint64)
    owner = (_least((h >> _PLACE_BITS << _PLACE_BITS) | place, length - GRAM + 1) & np.uint64((1 << 30) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:len(owner)]
    inside = np.arange(len(owner)) + length <= ends[text]
    first = inside.copy()
    first[1:] &= (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    base = (ends - sizes)[text[starts]]
    return text[starts], h[owner[starts]].view(np.int64), owner[starts] - base, starts - base, np.flatnonzero(last) - starts + 1


RUN = "text long, gram long, place int, first int, windows int, run binary, copies int"


def _run_rows(length: int):
    """Rows (text number, text, copies) to the runs of each text."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in slices(batch.column(1), TOGETHER_BYTES):
                texts = [t.encode() for t in some]
                which, gram, place, first, count = runs(texts, length)
                ends = (first + count + length - 1).tolist()
                digests = [_piece_id(texts[t][a:b]) for t, a, b in zip(which.tolist(), first.tolist(), ends)]
                number, copies = (batch.column(k).slice(start, len(some)).take(pa.array(which)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [number, pa.array(gram), pa.array(place, pa.int32()), pa.array(first, pa.int32()), pa.array(count, pa.int32()),
                     pa.array(digests, pa.binary()), copies], ["text", "gram", "place", "first", "windows", "run", "copies"])

    return made


def pieces(data: bytes, found: list[dict], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(first window, key, bytes) of the pieces of one text. ``found``: its runs, with ``part``, the windows of a part."""
    for r in found:
        first, end, place, part = r["first"], r["first"] + r["windows"], r["place"], r["part"]
        if not part:
            yield first, r["gram"], data[first:end + length - 1]
            continue
        while first < end:
            number = (place - first) // part  # parts are counted from the gram, so that equal windows are in equal parts
            stop = min(end, place - number * part + 1)
            shared = data[place - number * part:place - number * part - part + 1 + length]
            key = xxhash.xxh3_64_intdigest(shared, seed=(r["gram"] ^ number) & (1 << 64) - 1)
            yield first, key - (1 << 64) if key >> 63 else key, data[first:stop + length - 1]
            first = stop


def _piece_id(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[dict]]]:
    """(text, runs) of every row, a slice of texts at a time."""
    for start, texts in slices(batch.column(0), TOGETHER_BYTES):
        yield from zip((t.encode() for t in texts), batch.column(1).slice(start, len(texts)).to_pylist())


_PIECE = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("copies", pa.int32())])


def _piece_rows(length: int):
    """Rows (text, its runs) to the pieces of these runs, equal ones no more than twice per task."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for data, found in _runs_of(batch):
                for run in found:
                    for _, key, piece in pieces(data, [run], length):
                        if run["part"]:  # whole runs differ already
                            name = _piece_id(piece)
                            times = seen.get(name, 0)
                            if times >= 2:
                                continue
                            if len(seen) > REMEMBERED:
                                seen.clear()
                            seen[name] = times + run["copies"]
                        out.append((key, piece, run["copies"]))
                        held += len(piece)
                if held > TOGETHER_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    return made


def _part_rows(length: int):
    """The same rows to (run, offset, piece_id) of the parts of runs that are cut."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, offsets, ids = [], [], []
            for data, found in _runs_of(batch):
                for run in found:
                    for first, _, piece in pieces(data, [run], length):
                        names.append(run["run"]), offsets.append(first - run["first"]), ids.append(_piece_id(piece))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(offsets, pa.int32()), pa.array(ids, pa.binary())],
                                             ["run", "offset", "piece_id"])

    return made


def spans(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive numbers."""
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.concatenate([gap, [len(starts) - 1]])].tolist()


def _sorted_rows(length: int):
    """Rows (key, piece, copies) in the order of keys to (piece_id, low, high): runs of repeated windows."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size, last = 0, None

        def out() -> pa.RecordBatch:
            names, low, high = [], [], []
            texts = list(held)
            for piece, starts in zip(texts, repeated_windows(texts, list(held.values()), length) if texts else ()):
                if len(starts):
                    a, b = spans(starts)
                    names.append(_piece_id(piece)), low.append(a), high.append(b)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32()))],
                                              ["piece_id", "low", "high"])

        for batch in batches:
            for key, piece, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size >= SORTED_BYTES:
                    yield out()
                    size = 0
                last = key
                if piece not in held:
                    size += len(piece)
                held[piece] = held.get(piece, 0) + copies
        yield out()

    return made


DIGEST = T.StructType().add("text_key", "binary").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")


def covered(size: int, low: list[int], high: list[int], length: int) -> np.ndarray:
    """Which bytes windows from ``low`` to ``high`` (starts, in pairs) cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, low, 1)
    np.add.at(steps, np.array(high, np.int64) + length, -1)
    return np.cumsum(steps)[:-1] > 0


def _kept_rows(length: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                keys, low, high = (batch.column(k).slice(start, len(texts)).to_pylist() for k in (0, 2, 3))
                rows = []
                for key, text, a, b in zip(keys, texts, low, high):
                    data = np.frombuffer(text.encode(), np.uint8)
                    gone = covered(len(data), [x for v in a for x in v], [x for v in b for x in v], length)
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((key, int(gone.sum()), n_spans, data[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], DIGEST.names)

    return made


def distinct_texts(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``number, text_key, text, copies`` of the texts that are long enough."""
    keyed = docs.where(F.octet_length(text) >= length).select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    each = keyed.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return each.select(F.monotonically_increasing_id().alias("number"), "text_key", "text", F.least("n", F.lit(2)).cast("int").alias("copies"))


def repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """One row per distinct text that loses bytes: ``text_key, n_removed, n_spans, kept`` (the bytes left)."""
    texts = cut(distinct_texts(docs, length, text))
    every = cut(texts.select("number", "text", "copies").mapInArrow(_run_rows(length), RUN))
    often = cut(every.groupBy("gram").agg(F.sum("copies").alias("n")).where("n > 1").select("gram"))  # kept apart, so that the join can split hot grams
    rows = cut(every.join(often, "gram"))
    remove(every, often)

    of_run = F.min(F.struct("text", "first", "place", "windows", "gram"))
    distinct = cut(rows.groupBy("run").agg(of_run.alias("_r"), F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies")).select("run", "_r.*", "copies"))
    several = distinct.groupBy("gram").agg(F.count("*").alias("_n")).where(F.col("_n") >= FINER[0][0])
    part = F.lit(0)
    for least, windows in FINER:
        part = F.when(F.col("_n") >= least, windows).otherwise(part)
    parted = distinct.join(several, "gram", "left").withColumn("part", F.coalesce(part, F.lit(0)))
    each = F.struct("run", "gram", "place", "first", "windows", "copies", "part")
    # A text's runs do not overlap in their first windows, so there are fewer than it has bytes.
    listed = parted.groupBy("text").agg(F.collect_list(each).alias("runs"))
    given = cut(texts.select(F.col("number").alias("text"), F.col("text").alias("data")).join(listed, "text").select("data", "runs"))

    pieces_ = given.mapInArrow(_piece_rows(length), "key long, piece binary, copies int").repartition("key").sortWithinPartitions("key")
    repeated = cut(pieces_.mapInArrow(_sorted_rows(length), "piece_id binary, low array<int>, high array<int>"))
    finer = given.select("data", F.filter("runs", lambda r: r["part"] > 0).alias("runs")).where(F.size("runs") > 0)
    parts = finer.mapInArrow(_part_rows(length), "run binary, offset int, piece_id binary").join(repeated, "piece_id")
    moved = parts.select("run", F.transform("low", lambda x: x + F.col("offset")).alias("low"), F.transform("high", lambda x: x + F.col("offset")).alias("high"))
    of_parts = moved.groupBy("run").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high"))
    whole = repeated.withColumnRenamed("piece_id", "run")  # of runs that are not cut; other pieces meet no place
    marks = cut(whole.unionByName(of_parts).groupBy("run").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high")))
    remove(given, repeated, distinct)

    placed = rows.select("run", "text", "first").join(marks, "run").select(
        "text", F.transform("low", lambda x: x + F.col("first")).alias("low"), F.transform("high", lambda x: x + F.col("first")).alias("high"))
    gathered = placed.groupBy("text").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    return (texts.select(F.col("number"), "text_key", F.col("text").alias("data")).join(gathered, F.col("number") == F.col("text"))
            .select("text_key", "data", "low", "high").mapInArrow(_kept_rows(length), DIGEST))


@owned
def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``. A kept table."""
    found = cut(repeats(docs, length, text).select("text_key", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).dropDuplicates(["text_key"]))
    value = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(id_col), text_key(F.col(text)).alias("text_key"), F.octet_length(value).cast("long").alias("n_bytes"),
                      F.sha2(value.cast("binary"), 256).alias("_sha"))
    zero = F.lit(0).cast("long")
    return own.join(found, "text_key", "left").select(id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                                                      F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "_sha").alias("kept_sha256"))
