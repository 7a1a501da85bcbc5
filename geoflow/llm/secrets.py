"""Secret scans: fixed patterns, and windows of high entropy inside token-like strings.

Base kinds are patterns (``assign``, ``access``, ``hex``). The method adds ``entropy``
spans: a candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of at least ``window``
characters. For each character class of ``CLASS_LIMITS`` its maximal runs inside the
candidate are slid over by a window; counts and the sum of ``c * log2(c)`` are kept up to
date as one character enters and one leaves, so a step costs the same at any width. A run
is a secret when a window reaches the class's bits per character, and its span is the run.

Suppressed by the allow list: UUIDs; words, numbers, dates and versions at either end of a candidate (parts between
``/ _ = + -`` that are digits, or letters as words have them with up to four digits), where what remains is
scanned; runs of words, digits, or the alphabet or digits in order; placeholders of few characters (the entropy limit
itself). Letters without a digit are words if they are of one case or of capitals before two or more small letters.

Null and empty texts have no spans. Very long texts are scanned whole. Equal rows give
equal spans. Two spans that start at one place are ordered by kind as listed in ``KINDS``. An empty table gives an
empty table; further columns are not touched by ``mask_documents``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoflow.llm.common import hex_sha256, slices

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes of candidate runs with their least bits per character in a window.
CLASS_LIMITS = (
    ("hex", re.compile(r"[0-9A-Fa-f]+"), 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9),
)

UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Letters as words have them, and parts of a candidate that are words, numbers or both.
WORDS = r"(?:[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z]))+)"
WORD = re.compile(rf"[0-9]+|{WORDS}[0-9]{{0,4}}")
_PART = re.compile(r"[A-Za-z0-9]+")
#: Parts of one or two characters that are numbers or versions; others belong to what they stand at.
_SHORT = re.compile(r"[vV]?[0-9]+")
_IN_ORDER = ("abcdefghijklmnopqrstuvwxyz0123456789" * 3, "abcdefghijklmnopqrstuvwxyz" * 4, "0123456789abcdef" * 8)


@dataclass(frozen=True)
class Entropy:
    window: int = 20
    limits: tuple = CLASS_LIMITS


def greatest_entropy(run: str, window: int) -> float:
    """Most bits per character of any window of a run at least that long."""
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    least = math.inf
    for at, char in enumerate(run):
        if at >= window:
            gone = run[at - window]
            c = counts[gone]
            counts[gone] = c - 1
            total += term[c - 1] - term[c]
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if at >= window - 1 and total < least:
            least = total
    return math.log2(window) - least / window


def core(candidate: str) -> tuple[int, int]:
    """Where the part of a candidate begins and ends that the allow list does not cover."""
    if UUID.fullmatch(candidate):
        return 0, 0
    parts = [(m.start(), m.end(), WORD.fullmatch(m[0]) is not None and (len(m[0]) > 2 or _SHORT.fullmatch(m[0]) is not None)) for m in _PART.finditer(candidate)]
    odd = [(start, end) for start, end, is_word in parts if not is_word]
    return (odd[0][0], odd[-1][1]) if odd else (0, 0)


def allowed(run: str) -> bool:
    """Whether the allow list suppresses a run."""
    if WORD.fullmatch(run) or UUID.fullmatch(run):
        return True
    low = run.lower()
    return any(low in row for row in _IN_ORDER)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, sorted."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS) or not low.isascii():
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, given: Entropy = Entropy()) -> list[tuple[int, int, int]]:
    """Spans of high entropy; those of several classes that overlap are joined."""
    found = []
    for candidate in _CANDIDATE.finditer(text):
        begin, end = core(candidate[0])
        if end - begin < given.window:
            continue
        base, rest = candidate.start() + begin, candidate[0][begin:end]
        for _, pattern, limit in given.limits:
            for run in pattern.finditer(rest):
                if len(run[0]) >= given.window and not allowed(run[0]) and greatest_entropy(run[0], given.window) >= limit:
                    found.append((base + run.start(), base + run.end()))
    joined: list[list[int]] = []
    for start, end in sorted(found):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return [(start, 3, end) for start, end in joined]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[secret]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, at, reach = [], 0, -1
    for start, _, end in sorted(spans):
        if start >= reach:
            out += [text[at:start], mask]
        reach = max(reach, end)
        at = reach
    return "".join(out) + text[at:]


FOUND = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("n_entropy", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def found_in(text: str | None, given: Entropy = Entropy()) -> tuple:
    text = text or ""
    base = base_spans(text)
    added = entropy_spans(text, given)
    kinds = [k for _, k, _ in base]
    return (kinds.count(0), kinds.count(1), kinds.count(2), len(added), hex_sha256(written(base).encode()),
            written(sorted(base + added)))


def scan(text: Column, given: Entropy = Entropy()) -> Column:
    """A struct column ``FOUND`` for every value of ``text``."""
    schema = pa.struct(list(to_arrow_schema(FOUND)))

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = [dict(zip(FOUND.names, found_in(t, given))) for _, some in slices(texts) for t in some]
        return pa.array(rows, schema)

    return scanned(text)


def masked(text: Column, given: Entropy = Entropy(), mask: str = "[secret]") -> Column:
    """``text`` with every span replaced; null stays null."""

    def clean(t: str) -> str:
        return redact(t, base_spans(t) + entropy_spans(t, given), mask)

    @F.arrow_udf(T.StringType())
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t) for _, some in slices(texts) for t in some], pa.string())

    return cleaned(text)


def scan_documents(docs: DataFrame, given: Entropy = Entropy(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and the fields of ``FOUND``."""
    return docs.select(F.col(id_col), scan(F.col(text), given).alias("_f")).select(id_col, "_f.*")


def mask_documents(docs: DataFrame, given: Entropy = Entropy(), text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in ``text``; ``n_chars`` follows where it is a column and was not null."""
    out = docs.withColumn(text, masked(F.col(text), given))
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(n_chars).isNotNull(), F.char_length(text)).cast(kind))
    return out
