"""Benchmark decontamination with DataFrame functions only.

Texts are brought to lower case (A-Z) and cut into words. A window is ``width`` consecutive
words of a benchmark item, or the whole item if it is shorter. Words of a document inside
any occurrence of a window are hit.

The scan is coarse first. Of ``width`` words in a row, one aligned block of
``(width + 1) // 2`` words is always complete, so a document is cut into blocks that do not
overlap and each is looked up in the broadcast set of all blocks of that length that the
windows have. Only around blocks that are found are the windows of the document put
together and looked up, by their whole text; that is the exact check. Shorter items have
their own block length.

The benchmark is counted before it is sent to the tasks: up to ``BROADCAST_WINDOWS``
windows it is broadcast, beyond that the same joins are shuffled, with the same rows.

Hits depend on the text alone. They are found once per row, summed per distinct text and
joined back by the text's digest, so repeated ids, null ids and copies need no care.
Null and empty texts have no words; items without words have no window; an empty
benchmark or empty documents give no hits. Extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.llm.common import lowered_column, text_key
from geoflow.session import cut

WIDTH = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before they are brought to lower case.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A window has 13 words; so many of them stay far below what a task can hold.
BROADCAST_WINDOWS = 2_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered_column(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def joined_words(words: Column, start: Column, length: Column | int) -> Column:
    """``length`` words from position ``start`` (from 0) as one string."""
    return F.array_join(F.slice(words, start + 1, length), " ")


def windows(benchmark: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items with the items that hold them: ``window, n, items``."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(0), F.size("words") - n)
    each = words.select("item", "words", n.alias("n"), F.explode(starts).alias("at"))
    return (each.select("item", "n", joined_words(F.col("words"), F.col("at"), F.col("n")).alias("window"))
            .groupBy("window", "n").agg(F.collect_set("item").alias("items")))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """Hit words of each distinct text that has any: ``text_key, n_hit, positions, items``.

    ``positions`` are the places of the hit words in order, ``items`` the ids as strings.
    """
    known = cut(windows(benchmark, width, item_id, item_text))
    sizes = sorted(r["n"] for r in known.groupBy("n").agg(F.count("*").alias("c")).collect())  # at most ``width`` rows
    small = known.count() <= BROADCAST_WINDOWS
    side = F.broadcast if small else (lambda df: df)

    words = F.split("window", " ")
    parts = (known.select(F.expr("(n + 1) div 2").cast("int").alias("b"), "n", words.alias("words"))
             .select("n", "b", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("b"))).alias("at"))
             .select(F.col("n").alias("w"), F.xxhash64(joined_words(F.col("words"), F.col("at"), F.col("b"))).alias("block"))
             .distinct())

    given = docs.select(text_key(F.col(text)).alias("text_key"), words_of(F.col(text)).alias("words"))
    blocks = None
    for n in sizes:
        b = (n + 1) // 2
        starts = F.filter(F.sequence(F.lit(0), F.size("words"), F.lit(b)), lambda p: p + b <= F.size("words"))
        # What stands around a block goes with it, so that no row carries the whole text.
        own = F.transform(starts, lambda p: F.struct(
            F.lit(n).alias("w"), F.xxhash64(joined_words(F.col("words"), p, b)).alias("block"),
            F.greatest(F.lit(0), p + b - n).cast("int").alias("first"),
            joined_words(F.col("words"), F.greatest(F.lit(0), p + b - n), p + n - F.greatest(F.lit(0), p + b - n)).alias("around")))
        blocks = own if blocks is None else F.concat(blocks, own)
    if blocks is None:
        return docs.sparkSession.createDataFrame([], "text_key binary, n_hit long, positions array<int>, items array<string>")
    scanned = given.select("text_key", F.explode(blocks).alias("x"))
    found = scanned.select("text_key", "x.*").join(side(parts), ["w", "block"], "left_semi")
    around = found.select("text_key", "w", "first", F.split("around", " ").alias("around"))
    offsets = F.when(F.size("around") >= F.col("w"), F.sequence(F.lit(0), F.size("around") - F.col("w")))
    tried = (around.select("text_key", "w", "first", "around", F.explode(offsets).alias("k"))
             .select("text_key", "w", (F.col("first") + F.col("k")).alias("at"), joined_words(F.col("around"), F.col("k"), F.col("w")).alias("window")))
    held = tried.join(side(known.withColumnRenamed("n", "w")), ["window", "w"])
    sure = held.select("text_key", "w", "at", "items").dropDuplicates(["text_key", "w", "at"])
    return (sure.groupBy("text_key").agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("w") - 1))))).alias("positions"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            .select("text_key", F.size("positions").cast("long").alias("n_hit"), "positions", "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, items, contaminated``.

    A document is contaminated if it has a hit word and at least one word in twenty is hit.
    """
    found = cut(hits(docs, benchmark, width, text, item_id, item_text).select("text_key", "n_hit", "items"))
    counted = docs.select(F.col(id_col), text_key(F.col(text)).alias("text_key"),
                          F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (counted.join(found, "text_key", "left")
            .select(id_col, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they were."""
    names = [F.col(f"d.`{n}`") for n in docs.columns]
    found = cut(hits(docs, benchmark, width, text).select("text_key", "n_hit"))
    n_words = F.regexp_count(F.coalesce(F.col(f"d.`{text}`"), F.lit("")), F.lit(WORD_ANY_CASE))
    keyed = docs.alias("d").join(found.alias("f"), text_key(F.col(f"d.`{text}`")) == F.col("f.text_key"), "left")
    bad = (F.col("f.n_hit") > 0) & (20 * F.col("f.n_hit") >= n_words)
    return keyed.where(~F.coalesce(bad, F.lit(False))).select(*names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` with hit words taken out of ``text``, each with what stands between it and the word before."""
    names = docs.columns
    found = cut(hits(docs, benchmark, width, text).select("text_key", "positions"))
    value = F.col(f"d.`{text}`")
    between = WORD_ANY_CASE.replace("[^", "[")
    pieces = F.regexp_extract_all(value, F.lit(f"{between.replace(']+', ']*')}{WORD_ANY_CASE}"), F.lit(0))
    kept = F.filter(pieces, lambda x, at: ~F.array_contains(F.col("f.positions"), at))
    tail = F.regexp_extract(value, f"({between.replace(']+', ']*')})$", 1)
    clean = F.when(F.col("f.positions").isNull(), value).otherwise(F.concat(F.array_join(kept, ""), tail))
    keyed = docs.alias("d").join(found.alias("f"), text_key(value) == F.col("f.text_key"), "left")
    return keyed.select(*[clean.alias(n) if n == text else F.col(f"d.`{n}`") for n in names])
