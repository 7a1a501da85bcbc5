"""Phrase collocation mining by prefix-free parsing.

Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line breaks, pieces into words at
blanks and tabs. A phrase is 2 to 5 words in a row within a piece, and it is a candidate if it occurs
``least`` times in its language. Counts are those of all occurrences in all texts.

1. A document is a sequence of words and piece ends. Where a hash of ``OVERLAP`` tokens in a row is 0 modulo
   ``MODULUS`` there is a trigger: a chunk ends with the trigger's tokens and the next one starts with them.
   What lies between two triggers depends on the content alone, so copies and passages that documents
   share give equal chunks. Distinct chunks with their frequencies are the dictionary.
2. N-grams are counted inside distinct chunks, weighted by their frequencies. An n-gram belongs to the chunk
   in which it starts before the closing trigger, so those in an overlap are counted once; as the
   overlap is one word less than the longest phrase, that chunk holds it whole.
3. Counting goes by size. A phrase is as frequent as its rarest part at most, so bigrams are counted
   only where both words are frequent, trigrams only where both bigrams are (by 64-bit hashes, summed over all
   tasks), and phrases of 2 to 5 words only where each bigram and trigram is, this time by their words. What is
   frequent goes to the tasks as bitmaps of ``BITS`` bits each, whatever the size of the corpus. Equal hashes only let
   more phrases through to the last count, which is exact. Its tasks are as many as the cores ask for, not the
   input, and sum up what they hold before they hand it on, so that a phrase is not a row of every few megabytes.
4. Cuts, scores and the ranking are joins of the frequent phrases.

The score of a cut is ``floor(1000 * a * n / (l * r))`` in 38-digit decimals. The cut with the least score counts.
Candidates inside a longer candidate that occurs ``percent`` per cent as often go.

Null and empty texts have no words. A null language is ``und``. Ids are not looked at, so null or repeated ids and
repeated rows count as they are; further columns are not touched. Languages without candidates, and an empty table,
give no rows. A chunk is cut after ``LONGEST`` tokens also without a trigger; where chunks are cut changes no count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.llm.common import slices
from geoflow.session import cut, owned, remove

LEAST, LONGEST_PHRASE, PERCENT, SHOWN = 100, 5, 100, 2000
OVERLAP, MODULUS, SHORTEST, LONGEST = LONGEST_PHRASE - 1, 64, 16, 512
#: Bits of a bitmap of frequent words, bigrams or trigrams: eight megabytes.
BITS = 1 << 26
#: Bytes of chunks, words, numbers of phrases and counted hashes that a task holds before it hands them on.
CHUNK_BYTES, WORDS, PHRASE_NUMBERS, HASHES = 8 << 20, 300_000, 1 << 23, 1 << 21
#: Tasks of the last count for each core: a frequent phrase is a row of each of them.
TASKS_A_CORE = 2
#: A piece end as a word of its own; it parts words, so no word is like it.
BREAK = b"."
_BYTES = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words and piece ends of a text."""
    return text.encode().translate(_BYTES).replace(b".", b" . ").split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers:
    """Numbers of words in the order of their first use, with a hash each."""

    def __init__(self) -> None:
        self.of: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))
        if len(self.of) > len(self.words):
            new = list(islice(self.of, len(self.words), None))
            self.words += new
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return found


def triggers(hashes: np.ndarray) -> np.ndarray:
    """Where ``OVERLAP`` tokens in a row are a trigger."""
    n = max(0, len(hashes) - OVERLAP + 1)
    window = np.zeros(n, np.uint64)
    for k in range(OVERLAP):
        window = _mixed(window * _MULTIPLIER + hashes[k:n + k])
    return np.flatnonzero(window % np.uint64(MODULUS) == 0)


def starts(at: list[int], n: int) -> list[int]:
    """Where the chunks of ``n`` tokens with triggers at ``at`` start."""
    out = [0] if n else []
    for place in [*at, n]:
        while place - out[-1] > LONGEST:
            out.append(out[-1] + LONGEST)
        if place < n and place - out[-1] >= SHORTEST:
            out.append(place)
    return out


CHUNK = "lang string, chunk binary, own int, n int, times long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to distinct chunks with their number of own tokens, of all tokens, and frequency."""
    held: Counter[tuple[str, bytes, int, int]] = Counter()
    size, numbers = 0, Numbers()

    def out() -> pa.RecordBatch:
        lang, chunk, own, n = zip(*held) if held else ((),) * 4
        kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((lang, chunk, own, n, list(held.values())), kinds)],
                                           ["lang", "chunk", "own", "n", "times"])
        held.clear()
        return batch

    for batch in batches:
        for start, texts in slices(batch.column(1)):
            each = list(map(tokens, texts))
            own = numbers(list(chain.from_iterable(each)))
            found_at = triggers(numbers.hashes[own])
            end = 0
            for lang, found in zip(batch.column(0).slice(start, len(texts)).to_pylist(), each):
                first, end = end, end + len(found)
                a, b = np.searchsorted(found_at, (first, end - OVERLAP + 1))
                begin = starts((found_at[a:b] - first).tolist(), len(found)) if found else []
                for a, b in zip(begin, [*begin[1:], None]):
                    some = found[a:None if b is None else b + OVERLAP]
                    chunk = b" ".join(some)
                    key = (lang, chunk, len(some) if b is None else b - a, len(some))
                    if key not in held:
                        size += len(chunk)
                    held[key] += 1
                if size > CHUNK_BYTES:
                    yield out()
                    size = 0
            if len(numbers.of) > WORDS:
                numbers = Numbers()
    yield out()


def dictionary(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Distinct chunks of all texts of a language with their frequencies."""
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    return given.mapInArrow(_parsed, CHUNK).groupBy("lang", "chunk", "own", "n").agg(F.sum("times").alias("times"))


class Flat:
    """The tokens of some chunks in a row."""

    def __init__(self, rows: pa.RecordBatch, numbers: Numbers, langs: dict[str, int]) -> None:
        n = rows.column(3).to_numpy()
        words = b" ".join(rows.column(1).to_pylist()).split(b" ")
        self.word = numbers(words)
        self.lang = np.repeat(np.array([langs.setdefault(x, len(langs)) for x in rows.column(0).to_pylist()], np.int64), n)
        self.times = np.repeat(rows.column(4).to_numpy(), n)
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        #: Words that are not a piece end, and those that count as starts.
        self.is_word = self.word != numbers.of[BREAK] if BREAK in numbers.of else np.ones(len(words), bool)
        self.starts = self.is_word & (place < np.repeat(rows.column(2).to_numpy(), n))
        #: Tokens that the chunk still has after this one.
        self.after = np.repeat(n, n) - place - 1

    def hashes(self, numbers: Numbers, langs: dict[str, int]) -> np.ndarray:
        seeds = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in langs], np.uint64)
        return _mixed(numbers.hashes[self.word] ^ seeds[self.lang])

    def longer(self, some: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases of one length, by place: whether one and the next one are there and in one chunk, and the hash of both."""
        both = some.copy()
        both[:-1] &= some[1:] & (self.after[:-1] > 0)
        both[-1:] = False
        pair = np.zeros(len(hashes), np.uint64)
        pair[:-1] = _mixed(hashes[:-1] * _MULTIPLIER + hashes[1:])
        return both, pair


def _flat(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A megabyte of chunks at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + (1 << 20))))
        yield batch.slice(start, end - start)
        start = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the dictionary to (lang, phrase, times) of words; a null phrase stands for all words."""
    numbers, langs, counts = Numbers(), {}, {}

    def out() -> pa.RecordBatch:
        rows = [(name, None, int(c.sum())) for name, k in langs.items() if (c := counts.get(k)) is not None]
        for name, k in langs.items():
            at = np.flatnonzero(counts[k])
            rows += zip([name] * len(at), [numbers.words[w].decode() for w in at.tolist()], counts[k][at].tolist())
        columns = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "f"])

    for batch in batches:
        for some in _flat(batch):
            flat = Flat(some, numbers, langs)
            for k in np.unique(flat.lang).tolist():
                own = flat.starts & (flat.lang == k)
                more = np.bincount(flat.word[own], flat.times[own], minlength=len(numbers.words)).astype(np.int64)  # exact below 2^53
                if k in counts:
                    more[:len(counts[k])] += counts[k]
                counts[k] = more
            if len(numbers.words) > WORDS:
                yield out()
                numbers, langs, counts = Numbers(), {}, {}
    yield out()


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS.bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _grams(frequent: np.ndarray, size: int):
    """Rows of the dictionary to (hash, f) of phrases of ``size`` words whose two parts of one word less are frequent."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, langs, held, n_held = Numbers(), {}, [], 0

        def out() -> pa.RecordBatch:
            hashes, times = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
            order = np.argsort(hashes)
            hashes, times = hashes[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            sums = np.add.reduceat(times, first) if len(first) else times
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes[first].astype(np.uint64).view(np.int64)), pa.array(sums, pa.int64())], ["hash", "f"])

        for batch in batches:
            for some in _flat(batch):
                flat = Flat(some, numbers, langs)
                parts, hashes = flat.is_word, flat.hashes(numbers, langs)
                for _ in range(size - 2):
                    parts, hashes = flat.longer(parts, hashes)
                both, hashes = flat.longer(parts & has(frequent, hashes), hashes)
                both &= flat.starts
                held.append((hashes[both], flat.times[both]))
                n_held += int(both.sum())
                if n_held > HASHES:
                    yield out()
                    n_held = 0
                if len(numbers.words) > WORDS:
                    numbers, langs = Numbers(), {}
        yield out()

    return made


def _summed(columns: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row of the columns is first, and the sum of its times."""
    code = columns[0].astype(np.int64)
    for column in columns[1:]:  # numbers of what is there so far, with the next column: one number for each different row
        code = np.unique((np.unique(code, return_inverse=True)[1] << 32) + column, return_inverse=True)[1]
    first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, code, times)
    return first, sums


def _phrases(pairs: np.ndarray, triples: np.ndarray | None, longest: int):
    """Rows of the dictionary to (lang, phrase, f) of phrases whose bigrams and trigrams are all frequent."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, langs, size = Numbers(), {}, 0
        held: dict[int, list[np.ndarray]] = {n: [] for n in range(2, longest + 1)}  # lang, words, times

        def together(n: int) -> np.ndarray:
            """The rows of ``n`` words, each phrase once."""
            rows = np.concatenate([np.zeros((0, n + 2), np.int64), *held[n]])
            first, sums = _summed([rows[:, k] for k in range(n + 1)], rows[:, n + 1])
            rows = rows[first]
            rows[:, n + 1] = sums
            return rows

        def out(n: int) -> pa.RecordBatch:
            rows, names = together(n), list(langs)
            held[n].clear()
            phrase = [b" ".join([numbers.words[w] for w in row]).decode() for row in rows[:, 1:n + 1].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in rows[:, 0].tolist()], pa.string()), pa.array(phrase, pa.string()),
                                               pa.array(rows[:, n + 1], pa.int64())], ["lang", "phrase", "f"])

        def fewer_numbers() -> tuple[Numbers, dict[str, int]]:
            """Numbers of those words and languages alone that are held; what is held gets them."""
            names, fresh = list(langs), Numbers()
            used = np.unique(np.concatenate([rows[:, 1:-1].ravel() for of in held.values() for rows in of]))
            used_langs = np.unique(np.concatenate([rows[:, 0] for of in held.values() for rows in of]))
            fresh([numbers.words[w] for w in used.tolist()])
            for of in held.values():
                for rows in of:
                    rows[:, 1:-1] = np.searchsorted(used, rows[:, 1:-1])
                    rows[:, 0] = np.searchsorted(used_langs, rows[:, 0])
            return fresh, {names[k]: at for at, k in enumerate(used_langs.tolist())}

        for batch in batches:
            for some in _flat(batch):
                flat = Flat(some, numbers, langs)
                two, pair = flat.longer(flat.is_word, flat.hashes(numbers, langs))
                two &= has(pairs, pair)
                if longest > 2:
                    three, triple = flat.longer(two, pair)
                    three &= has(triples, triple)
                at = np.flatnonzero(two & flat.starts)
                for n in range(2, longest + 1):
                    if n > 2:
                        at = at[three[at + n - 3]]
                    columns = np.column_stack([flat.lang[at], *[flat.word[at + k] for k in range(n)], flat.times[at]])
                    first, sums = _summed([columns[:, k] for k in range(n + 1)], columns[:, n + 1])
                    columns = columns[first]
                    columns[:, n + 1] = sums
                    held[n].append(columns)
                    size += columns.size
                if size > PHRASE_NUMBERS or len(numbers.words) > WORDS:
                    for n in held:
                        held[n] = [together(n)]
                    size = sum(rows.size for of in held.values() for rows in of)
                    if len(numbers.words) > WORDS // 2:
                        numbers, langs = fewer_numbers()
                    if size > PHRASE_NUMBERS // 2 or len(numbers.words) > WORDS // 2:
                        yield from map(out, held)
                        numbers, langs, size = Numbers(), {}, 0
        yield from map(out, held)

    return made


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word) to the hashes under which ``_grams`` looks them up."""
    for batch in batches:
        lang = np.fromiter((xxhash.xxh3_64_intdigest(x, seed=1) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(_mixed(word ^ lang).view(np.int64))], ["hash"])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The ``BITS`` bits of all hashes, one bit for the leading digits of each."""
    at = F.shiftrightunsigned("hash", 64 - BITS.bit_length() + 1)
    parts = (hashes.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits"))).toArrow()  # at most BITS / 32768 rows
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist()):
        out[(bucket - 1) * len(bits):bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST_PHRASE, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, phrase, f`` of all phrases of 1 to ``longest`` words that occur ``least`` times; a null phrase stands for all words."""
    if not 2 <= longest <= OVERLAP + 1:
        raise ValueError(f"a phrase has 2 to {OVERLAP + 1} words")
    chunks = cut(dictionary(docs, lang, text))
    words = cut(chunks.mapInArrow(_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
                .where((F.col("f") >= least) | F.col("phrase").isNull()))
    often = bitmap(words.where("phrase is not null").select("lang", "phrase").mapInArrow(_hashed, "hash long"))
    maps = []
    for size in range(2, min(longest, 3) + 1):
        grams = chunks.mapInArrow(_grams(maps[-1] if maps else often, size), "hash long, f long")
        counted = cut(grams.groupBy("hash").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
        maps.append(bitmap(counted))
        remove(counted)
    pairs, triples = (*maps, None)[:2]
    tasks = TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism
    phrases = cut(chunks.coalesce(tasks).mapInArrow(_phrases(pairs, triples, longest), "lang string, phrase string, f long").groupBy("lang", "phrase")
                  .agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    remove(chunks)
    return words.unionByName(phrases)


def _part(words: Column | str, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


@owned
def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, shown: int = SHOWN, longest: int = LONGEST_PHRASE,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``shown`` best phrases of each language."""
    counts = frequent_phrases(docs, least, longest, lang, text)
    known = counts.where("phrase is not null")
    words = F.split("phrase", " ")
    several = known.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))

    k = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    cuts = several.where("size(w) > 1").select("lang", "phrase", "a", "w", k.alias("k")).select(
        "lang", "phrase", "a", "k", _part("w", 1, F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.size("w")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    total = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    held = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    # 1000 a n has at most 38 digits for up to 10^17 words; the quotient is at most 1000 n / least.
    score = F.expr("cast(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(15, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)")
    best = held.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_s"))

    # Phrases inside longer ones, with the count of the most frequent of these.
    span = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda at: _part("w", at, m))))
    inside = (several.where("size(w) > 2").select("lang", F.explode(F.array_distinct(span)).alias("phrase"), F.col("a").alias("_f"))
              .groupBy("lang", "phrase").agg(F.max("_f").alias("_f")))
    free = best.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("_f") >= percent * F.col("a"), F.lit(False)))
    out = free.select("lang", "phrase", "a", F.col("_s.l").alias("l"), F.col("_s.r").alias("r"), "n", F.col("_s.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
