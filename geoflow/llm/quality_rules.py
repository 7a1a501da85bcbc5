"""Quality rules: how far a document lies from its language.

For every language two histograms are summed over the whole corpus: characters by class,
and the language's ``common`` most frequent words with one bin for all others. A document
is measured against both by the Jensen-Shannon distance (base 2, from 0 to 1).

* The language of a document is the primary part of its tag in lower case (``en`` for ``EN`` and ``en-US``).
  A document with a null tag, or one that does not begin with two or three letters, is measured
  against all references, and the nearest one counts.
* A document below a rule's least number of words is not judged by that rule, since short
  texts lie far from any reference by chance. The same holds for a language with fewer
  words than ``least_reference``.
* Null and empty texts have no words: all counts are 0 and the base rule rejects them.
* Equal rows are measured each on its own; ties among common words go to the smaller word.
* Very long texts are measured whole. An empty table gives an empty table. Further columns are not touched, whatever their names.
* References hold 2 or 3 letter codes only, hence at most 18,252 rows of bounded size,
  which is what makes it right to send them to every task.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoflow.llm.common import ASCII_LOWER, free_name, slices
from geoflow.session import cut

SYMBOLS = "#*$%&|<>"
#: Character classes in the order of their histogram.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other_ascii", "beyond_ascii")
#: The primary part of a language tag.
LANGUAGE = r"^([A-Za-z]{2,3})(?:[-_].*)?$"

#: Words a task counts before it hands its counts on.
HELD_WORDS = 200_000


@dataclass(frozen=True)
class Limits:
    """Greatest distances that are kept, and the words a text needs to be judged."""

    char_distance: float = 0.30
    char_words: int = 50
    word_distance: float = 0.42
    word_words: int = 100
    common: int = 64
    least_reference: int = 2_000


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 0xC0:
        return 6
    if byte >= 0x80:
        return 7  # inside a code point that has been counted
    if "a" <= char <= "z":
        return 0
    if "A" <= char <= "Z":
        return 1
    if "0" <= char <= "9":
        return 2
    if char in " \t\n\v\f\r":
        return 3
    return 4 if char in SYMBOLS else 5


_CLASS = np.array([_class_of(b) for b in range(256)], dtype=np.uint8)


def language(tag: Column) -> Column:
    """The language that a tag names, or null."""
    found = F.lower(F.regexp_extract(tag, LANGUAGE, 1))
    return F.when(found != "", found)


def char_histogram(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)[:7]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that sum to one."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return math.sqrt(max(0.0, float(parts.sum()) / 2))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chars: dict[str, np.ndarray] = {}
    words: dict[str, Counter[bytes]] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, f"class {k}", int(n), True) for lang, h in chars.items() for k, n in enumerate(h)]
        rows += [(lang, word.decode(), n, False) for lang, c in words.items() for word, n in c.items()]
        chars.clear(), words.clear()
        lang, key, n, is_class = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(key, pa.string()), pa.array(n, pa.int64()), pa.array(is_class, pa.bool_())],
            ["lang", "key", "n", "is_class"])

    for batch in batches:
        langs = batch.column(0)
        for start, texts in slices(batch.column(1)):
            for lang, text in zip(langs.slice(start, len(texts)).to_pylist(), texts):
                data = text.encode()
                chars[lang] = chars.get(lang, 0) + char_histogram(data)
                words.setdefault(lang, Counter()).update(data.translate(ASCII_LOWER).split())
            if sum(map(len, words.values())) > HELD_WORDS:
                yield out()
    yield out()


def references(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: ``lang, classes, words, word_counts, n_words`` over all documents."""
    given = docs.select(language(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = cut(given.mapInArrow(_counted, "lang string, key string, n long, is_class boolean")
                 .groupBy("lang", "is_class", "key").agg(F.sum("n").alias("n")))  # read three times below
    by_lang = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "key")
    first = counts.where(~F.col("is_class")).withColumn("_rank", F.row_number().over(by_lang)).where(F.col("_rank") <= limits.common)
    common = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("_rank", "key", "n"))).alias("_top"))
    classes = counts.where("is_class").groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", "n"))), lambda x: x["n"]).alias("classes"))
    totals = counts.where(~F.col("is_class")).groupBy("lang").agg(F.sum("n").alias("n_words"))
    return (classes.join(common, "lang").join(totals, "lang").where(F.col("n_words") >= limits.least_reference)
            .select("lang", "classes", F.col("_top.key").alias("words"), F.col("_top.n").alias("word_counts"), "n_words"))


VERDICT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
])


def repeated(words: list) -> int:
    """Words inside three-word windows that the text has at least twice."""
    if len(words) < 4:
        return 0
    numbers: defaultdict = defaultdict(count().__next__)
    own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pair = np.unique(own[:-1] * len(numbers) + own[1:], return_inverse=True)[1]
    window, n = np.unique(pair[:-1] * len(numbers) + own[2:], return_inverse=True, return_counts=True)[1:]
    again = n[window] > 1
    marks = np.zeros(len(words), bool)
    for k in range(3):
        marks[k:len(again) + k] |= again
    return int(marks.sum())


def measure(text: str | None, references_: list[tuple], limits: Limits) -> tuple:
    """The fields of ``VERDICT`` for one text. A reference: class shares, places of the common words, their shares.

    Of several references the nearest one counts, for each rule by itself. White space of ``bytes.split`` and
    ``bytes.strip`` is what parts words.
    """
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    histogram = char_histogram(data)
    n, n_repeat = len(words), repeated(words)
    base_failed = n < 50 or 100 * n_repeat > 50 * n
    char_distance = word_distance = None
    if references_ and n >= limits.char_words:
        char_distance = min(distance(histogram / histogram.sum(), class_shares) for class_shares, _, _ in references_)
    if references_ and n >= limits.word_words:
        counts = Counter(data.translate(ASCII_LOWER).split())
        word_distance = min(distance(_common(counts, places, len(shares)) / n, shares) for _, places, shares in references_)
    far = (char_distance or 0) > limits.char_distance or (word_distance or 0) > limits.word_distance
    return (n, int(histogram.sum() - histogram[3]), int(histogram[4]), len(lines) - len(set(lines)), n_repeat, base_failed,
            char_distance, word_distance, not base_failed and not far)


def _common(counts: Counter, places: dict[bytes, int], bins: int) -> np.ndarray:
    """Counts of the common words, and of all others in the last bin."""
    own = np.zeros(bins)
    for word, place in places.items():
        own[place] = counts.get(word, 0)
    own[-1] = counts.total() - own[:-1].sum()
    return own


def prepared(rows: list) -> dict[str, tuple]:
    """References in the form that ``measure`` takes; the last bin is that of all other words."""
    out = {}
    for r in rows:
        classes, counts = np.array(r["classes"], float), np.array(r["word_counts"], float)
        shares = np.append(counts, r["n_words"] - counts.sum()) / r["n_words"]
        out[r["lang"]] = (classes / classes.sum(), {w.encode(): k for k, w in enumerate(r["words"])}, shares)
    return out


def verdict(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> Column:
    """A struct column for the rows of ``docs``, judged against references of all of ``docs``.

    Building it runs the job that sums the references.
    """
    known = prepared(references(docs, limits, text, lang).collect())
    every = list(known.values())
    schema = pa.struct(list(to_arrow_schema(VERDICT)))

    @F.arrow_udf(VERDICT)
    def judged(texts: pa.Array, langs: pa.Array) -> pa.Array:
        rows = []
        for start, some in slices(texts):
            rows += [measure(t, every if lg is None else [known[lg]] if lg in known else [], limits) for t, lg in zip(some, langs.slice(start, len(some)).to_pylist())]
        return pa.array([dict(zip(VERDICT.names, r)) for r in rows], schema)

    return judged(F.col(text), language(F.col(lang)))


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: ``id_col`` and the fields of ``VERDICT``."""
    return docs.select(F.col(id_col), verdict(docs, limits, text, lang).alias("_v")).select(id_col, "_v.*")


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with their columns as they were."""
    names = docs.columns
    mark = free_name(docs, "_kept")
    return docs.withColumn(mark, verdict(docs, limits, text, lang)["kept"]).where(F.col(mark)).select(*[F.col(f"`{n}`") for n in names])
