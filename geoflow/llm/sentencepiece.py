"""SentencePiece encoding with seeded merge-dropout, and exact decoding.

A byte-pair model (pieces, scores, byte fallback) is read from its file. A text gets the
dummy space in front if the model asks for it, spaces become the space mark, and it is cut
into units between which no piece of the vocabulary can reach (checked when the model is
read). A unit is encoded by an agenda of candidate merges: the best score first, the
leftmost on ties. With a dropout above 0 a candidate is skipped if a keyed hash of its
place falls below the dropout; the candidate is back only when a neighbour has grown. The
key is (seed, document id, place of the unit in its document, unit, start, middle, end), so
that every occurrence draws by itself, and the same seed, id and text give the same pieces
wherever and whenever a row is processed.

Units of a slice are encoded together, all agendas in lock step as arrays. Work is shared
where draws agree: each distinct unit is merged once without a skip, and an occurrence that
skips none of these merges has its pieces. Those whose first skip is the same merge are
merged once more without it, and so on; where little is left to share, each occurrence is
stepped by itself. A unit longer than ``LOCK_STEP`` characters has a heap of its own. All
ways follow the same order, which the tests check against each other and, without dropout,
against the library.

Decoding gives the text back byte for byte, whatever was dropped: a literal space mark is
written as byte pieces, so that it is not taken for a space.

Null texts give null, empty texts no ids. A null id counts as 0. Equal rows are equal. Very long texts are encoded whole,
and alone. An empty table gives an empty table; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoflow.llm.common import hex_sha256, released, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LOCK_STEP = 48
#: Distinct units that are stepped at a time, and bytes of text that are encoded together.
TOGETHER, SLICE = 1 << 12, 1 << 20
#: Occurrences whose draws are made at a time.
DRAWN = 1 << 15
_NONE = np.int32(2**31 - 1)
_M = (1 << 64) - 1


def _mixed(x: int) -> int:
    """One round of a 64-bit finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def _mixed_array(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Dropout:
    """``rate`` 0 is the plain encoding."""

    rate: float = 0.1
    seed: int = 17


class Model:
    """Pieces of a byte-pair model and the tables for encoding."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.name != "identity":
            raise ValueError("a byte-pair model with byte fallback and without normalisation is needed")
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        normal, self.bytes_of, self.byte_id = {}, [], [0] * 256
        self.score = np.full(len(proto.pieces), -np.inf)
        for at, one in enumerate(proto.pieces):
            data = b""
            if one.type == 1:  # normal
                normal[one.piece] = at
                self.score[at] = one.score
                data = one.piece.replace(SPACE, " ").encode()
            elif one.type == 6:  # byte
                data = bytes([int(one.piece[3:5], 16)])
                self.byte_id[data[0]] = at
            self.bytes_of.append(data)
        self.normal = normal
        # Rank 0 is the best score; equal scores share a rank, so the leftmost is taken.
        ranks = {s: r for r, s in enumerate(sorted({self.score[i] for i in normal.values()}, reverse=True))}
        self.rank = {i: ranks[self.score[i]] for i in normal.values()}
        self.merged: dict[tuple[int, int], int] = {}
        for piece, at in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    self.merged[left, right] = at
        chars = {c for p in normal for c in p}
        # A unit ends where no piece reaches across: before a space mark, and around characters without a piece of their own.
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece of the vocabulary reaches across a space")
        self.units = re.compile(rf" +[^ \n]*|[^ \n]+|\n") if "\n" not in chars else re.compile(r" +[^ ]*|[^ ]+")
        self.char_id = -1 - np.arange(0x110000, dtype=np.int32)
        for c in chars - {SPACE}:
            if c in normal:
                self.char_id[ord(c)] = normal[c]
        if SPACE in normal:
            self.char_id[ord(" ")] = normal[SPACE]
        self._table()

    def _table(self) -> None:
        """An open-addressed table from pairs of ids to (rank, id) of the merged piece."""
        size = 1 << (4 * len(self.merged)).bit_length()
        self.mask = np.uint64(size - 1)
        keys, rank, made = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        self.probes = 1
        for (left, right), at in self.merged.items():
            key = left << 32 | right
            place, tries = _mixed(key) & (size - 1), 1
            while keys[place] >= 0:
                place, tries = (place + 1) & (size - 1), tries + 1
            keys[place], rank[place], made[place] = key, self.rank[at], at
            self.probes = max(self.probes, tries)
        self.keys, self.ranks, self.made = keys, rank, made

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``_NONE`` without a piece) and ids of what pairs merge to."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        place = (_mixed_array(key.astype(np.uint64)) & self.mask).astype(np.int64)
        rank, made = np.full(len(key), _NONE, np.int32), np.zeros(len(key), np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            at = place[open_]
            there = self.keys[at]
            hit = there == key[open_]
            rank[open_[hit]], made[open_[hit]] = self.ranks[at[hit]], self.made[at[hit]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & int(self.mask)
        return rank, made

    def start(self, text: str) -> np.ndarray:
        """Ids of single characters; below 0: the character itself, without a piece, shifted by one."""
        return self.char_id[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def finish(self, symbols: list[int]) -> list[int]:
        if min(symbols) >= 0:
            return symbols
        out = []
        for s in symbols:
            out += [s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if self.dummy and ids else data).decode()


def _key(seed: int, own: int) -> int:
    return _mixed((seed * 0x10001 + own) & _M)


def _keys(seed: int, own: np.ndarray) -> np.ndarray:
    return _mixed_array(np.uint64(seed * 0x10001 & _M) + own.astype(np.uint64))


def _skip_limit(rate: float) -> int:
    return min(_M, int(rate * 2.0**64))


def encode_unit(model: Model, unit: str, own: int, drop: Dropout) -> list[int]:
    """One unit by a heap of candidate merges; ``own`` is the key of the occurrence."""
    symbols = model.start(unit).tolist()
    n = len(symbols)
    end = list(range(1, n + 1))  # where the symbol that starts here ends
    before = list(range(-1, n - 1))
    limit, key = _skip_limit(drop.rate), _key(drop.seed, own)
    agenda: list[tuple] = []

    def offer(start: int) -> None:
        middle = end[start]
        if middle < n and symbols[start] >= 0 and symbols[middle] >= 0:
            at = model.merged.get((symbols[start], symbols[middle]))
            if at is not None:
                heapq.heappush(agenda, (model.rank[at], start, middle, end[middle], at))

    for start in range(n - 1):
        offer(start)
    gone = bytearray(n)
    while agenda:
        _, start, middle, stop, at = heapq.heappop(agenda)
        if gone[start] or end[start] != middle or gone[middle] or end[middle] != stop:
            continue
        if limit and _mixed(key ^ _mixed(start << 42 ^ middle << 21 ^ stop)) < limit:
            continue
        symbols[start], end[start], gone[middle] = at, stop, 1
        if stop < n:
            before[stop] = start
        if before[start] >= 0:
            offer(before[start])
        offer(start)
    return model.finish([s for s, g in zip(symbols, gone) if not g])


_GONE = np.int32(-(2**31))


def _lock_step(model: Model, units: list[str], skipped: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for units of at most ``LOCK_STEP`` characters, one merge of each per round.

    ``skipped`` says which candidates (row, place) are skipped. Symbols stay where they
    start; ``after`` and ``before`` link them. Returns all symbols in a row and how many
    each unit has, and the places of all merges in their order and how many each unit has.
    """
    n, width = len(units), max(map(len, units)) + 1
    lengths = np.fromiter(map(len, units), np.int32, n)
    inside = np.arange(width, dtype=np.int32)[None, :] < lengths[:, None]
    symbols = np.full((n, width), _GONE, np.int32)
    symbols[inside] = model.start("".join(units))
    symbols, lengths = symbols.ravel(), lengths.astype(np.int64)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
    rank, made = np.full((n, width), _NONE, np.int32), np.zeros(n * width, np.int32)
    flat_rank = rank.ravel()
    merges: list[tuple[np.ndarray, np.ndarray]] = []

    def offer(row: np.ndarray, start: np.ndarray) -> None:
        """Put the candidate that begins at each (row, start) on its agenda, or take it off."""
        base = row * width
        middle = after[base + start].astype(np.int64)
        has = middle < lengths[row]
        at = base + start
        flat_rank[at[~has]] = _NONE
        row, start, middle, base, at = row[has], start[has], middle[has], base[has], at[has]
        found, id_ = model.look_up(symbols[at], symbols[base + middle])
        if skipped:
            good = np.flatnonzero(found != _NONE)
            place = start[good] << 42 ^ middle[good] << 21 ^ after[base[good] + middle[good]].astype(np.int64)
            found[good[skipped(row[good], place)]] = _NONE
        flat_rank[at], made[at] = found, id_

    row, start = np.nonzero(inside)
    offer(row, start)
    live = np.arange(n)
    agenda = rank
    while True:
        best = agenda.argmin(axis=1)
        go = agenda[np.arange(len(live)), best] != _NONE
        if not go.all():
            live, best = live[go], best[go]
        if not len(live):
            break
        base = live * width
        at = base + best
        right = base + after[at]
        end = after[right].astype(np.int64)
        merges.append((live, best.astype(np.int64) << 42 ^ (right - base) << 21 ^ end))
        symbols[at], symbols[right], flat_rank[right] = made[at], _GONE, _NONE
        after[at] = end
        linked = end < lengths[live]
        before[(base + end)[linked]] = best[linked]
        offer(live, best)
        left = before[at].astype(np.int64)
        some = left >= 0
        offer(live[some], left[some])
        agenda = rank[live]
    kept = symbols != _GONE
    rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in merges)])
    places = np.concatenate([np.zeros(0, np.int64), *(p for _, p in merges)])
    return symbols[kept], kept.reshape(n, width).sum(axis=1), places[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=n)


def _ragged(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values``, whose runs have ``sizes``; and the sizes of what is returned."""
    begin, own = np.cumsum(sizes) - sizes, sizes[which]
    return values[np.repeat(begin[which] - (np.cumsum(own) - own), own) + np.arange(own.sum())], own


def _as_bytes(model: Model, got: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become bytes."""
    if not (got < 0).any():
        return got, own
    per = np.ones(len(got), np.int64)
    bare = np.flatnonzero(got < 0)
    as_bytes = [model.finish([int(x)]) for x in got[bare]]
    per[bare] = [len(x) for x in as_bytes]
    wide = np.repeat(got, per)
    begin = np.cumsum(per) - per
    for k, x in zip(begin[bare].tolist(), as_bytes):
        wide[k:k + len(x)] = x
    return wide, np.add.reduceat(per, np.cumsum(own) - own)


def _stepped(model: Model, units: list[str], skipped: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_lock_step`` for any number of units, ``TOGETHER`` of like length at a time; ``skipped`` gets rows of ``units``."""
    order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
    parts = []
    for at in range(0, len(order), TOGETHER):
        some = order[at:at + TOGETHER]
        got, own, *merges = _lock_step(model, [units[k] for k in some.tolist()], skipped and (lambda row, place, some=some: skipped(some[row], place)))
        parts.append((*_as_bytes(model, got, own), *merges))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    values, sizes, places, n_merges = map(np.concatenate, zip(*parts))
    return *_ragged(values, sizes, back), *_ragged(places, n_merges, back)


def encode_units(model: Model, units: list[str], own: np.ndarray, drop: Dropout, unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every occurrence in a row and how many each has; an occurrence is its key ``own`` and the place of its ``unit`` in ``units``."""
    if unit is None:
        unit = np.arange(len(units))
    limit, key = _skip_limit(drop.rate), _keys(drop.seed, own)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    values, sizes, n_made = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    which = np.empty(len(unit), np.int64)

    def drawn(key: np.ndarray, place: np.ndarray) -> np.ndarray:
        return _mixed_array(key ^ _mixed_array(place.astype(np.uint64))) < np.uint64(limit)

    open_ = np.flatnonzero(lengths[unit] <= LOCK_STEP)
    nodes, node = np.unique(unit[open_], return_inverse=True)  # a node is a unit and the candidates that its occurrences skip
    skips = np.zeros((len(nodes), 0), np.int64)
    while len(open_):
        alone = 2 * len(nodes) > len(open_) and limit > 0
        if alone:
            nodes, node = unit[open_], np.arange(len(open_))
            keys = key[open_]
            skipped = lambda row, place: drawn(keys[row], place)
        else:
            skipped = (lambda row, place: (skips[row] == place[:, None]).any(axis=1)) if skips.shape[1] else None
        got, n, places, n_merges = _stepped(model, [units[k] for k in nodes.tolist()], skipped)
        values.append(got)
        sizes.append(n)
        which[open_] = n_made + node
        n_made += len(nodes)
        if alone or not limit:
            break
        begin, missed, first = np.cumsum(n_merges) - n_merges, [], []
        for at in range(0, len(open_), DRAWN):
            some, per = node[at:at + DRAWN], n_merges[node[at:at + DRAWN]]
            row = np.repeat(np.arange(len(some)), per)
            merge = np.repeat(begin[some] - (np.cumsum(per) - per), per) + np.arange(len(row))
            hit = np.flatnonzero(drawn(key[open_[at:at + DRAWN]][row], places[merge]))
            hit = hit[np.diff(row[hit], prepend=-1) > 0]  # the first of each occurrence
            missed.append(at + row[hit])
            first.append(merge[hit])
        open_ = open_[np.concatenate(missed)]
        merge, node = np.unique(np.concatenate(first), return_inverse=True)
        parent = np.searchsorted(begin + n_merges, merge, side="right")
        nodes, skips = nodes[parent], np.column_stack([skips[parent], places[merge]])
    for k in np.flatnonzero(lengths[unit] > LOCK_STEP).tolist():
        got = encode_unit(model, units[unit[k]], int(own[k]), drop)
        values.append(np.array(got, np.int32))
        sizes.append(np.array([len(got)], np.int64))
        which[k] = n_made
        n_made += 1
    return _ragged(np.concatenate(values), np.concatenate(sizes), which)


def encode_texts(model: Model, ids: list[int | None], texts: list[str | None], drop: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (int32), and how many each text has; null counts as empty."""
    # A factory that knew the dict would keep all units in memory until Python looks for cycles.
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    places, counts = array("q"), []
    for text in texts:
        units = model.units.findall((" " if model.dummy else "") + text) if text else []
        places.extend(map(numbers.__getitem__, units))
        counts.append(len(units))
    unit, n = np.frombuffer(places, np.int64) if places else np.zeros(0, np.int64), np.array(counts, np.int64)
    names = list(numbers)
    if drop.rate > 0 and len(unit):
        seeds = np.array([_mixed(((i or 0) & _M) ^ _mixed(drop.seed & _M)) for i in ids], np.uint64)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
        own = _mixed_array(_mixed_array(np.repeat(seeds, n) ^ place.astype(np.uint64)) ^ hashes[unit])
    else:
        own = np.zeros(len(unit), np.uint64)
    values, sizes = encode_units(model, names, own, drop, unit)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
    return values, np.diff(ends)


_models: dict[str, Model] = {}


def model_of(path: str) -> Model:
    """The model of a file, read once per process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(ids: Column, text: Column, drop: Dropout = Dropout(), path: str = MODEL) -> Column:
    """``array<int>`` of piece ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(ids_: pa.Array, texts: pa.Array) -> pa.Array:
        model, parts = model_of(path), []
        for start, some in slices(texts, SLICE):
            values, sizes = encode_texts(model, ids_.slice(start, len(some)).to_pylist(), some, drop)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            parts.append(pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()), mask=pa.array([t is None for t in some])))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encoded(ids.cast("long"), text)


def decode(pieces: Column, path: str = MODEL) -> Column:
    """The text of an ``array<int>``; null for null."""

    @F.arrow_udf(T.StringType())
    def decoded(arrays: pa.Array) -> pa.Array:
        model = model_of(path)
        return pa.array([None if x is None else model.decode(x) for x in (v.as_py() for v in arrays)], pa.string())

    return decoded(pieces)


def encode_documents(docs: DataFrame, drop: Dropout = Dropout(), id_col: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """``id_col, pieces`` of every row. Pieces are handed on a slice of texts at a time, so that a task holds no more."""
    schema = T.StructType([docs.schema[id_col], T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    held = to_arrow_schema(schema)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for start, some in slices(batch.column(2), SLICE):
                values, sizes = encode_texts(model, batch.column(1).slice(start, len(some)).to_pylist(), some, drop)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                pieces = pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()), mask=pa.array([t is None for t in some]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)).cast(held[0].type), pieces.cast(held[1].type)], schema=held)

    given = docs.select(F.col(id_col), F.col(id_col).cast("long").alias("_key"), F.col(text).alias("_text"))
    return given.mapInArrow(lambda batches: released(encoded(batches)), schema)


ROUND_TRIP = "n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"


def round_trip(docs: DataFrame, drop: Dropout = Dropout(), id_col: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """Encode and decode every text: ``id_col`` and digests of its pieces (int32, little endian) and of the decoded text.

    A null text has null digests and is lossless, since null is what it decodes to.
    """
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(ROUND_TRIP)])
    held = to_arrow_schema(schema)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for start, some in slices(batch.column(2), SLICE):
                values, sizes = encode_texts(model, batch.column(1).slice(start, len(some)).to_pylist(), some, drop)
                rows: list[tuple] = []
                for given, pieces in zip(some, np.split(values, np.cumsum(sizes)[:-1])):
                    if given is None:
                        rows.append((None, None, None, True))
                        continue
                    back = model.decode(pieces.tolist())
                    rows.append((len(pieces), hex_sha256(pieces.astype("<i4").tobytes()), hex_sha256(back.encode()), back == given))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(held)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)).cast(held[0].type), *columns], schema=held)

    given = docs.select(F.col(id_col), F.col(id_col).cast("long").alias("_key"), F.col(text).alias("_text"))
    return given.mapInArrow(lambda batches: released(both(batches)), schema)
