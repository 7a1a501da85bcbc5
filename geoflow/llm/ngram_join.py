"""N-gram Jaccard join of a table with itself, by a grouped prefix join.

A document is its set of distinct ``width``-word shingles (lower case A-Z, words between
white space; the whole sequence as one shingle if it has fewer words). Two documents link
when ``100 * |A and B| >= percent * |A or B|``. Sets are sets of 64-bit shingle hashes.

1. Shingles are put into one order for all: those that are rare come first by hash, those
   that many documents of a task's share have come last by count. Any order gives the same
   links; this one keeps passages that many documents share out of the prefixes.
2. Two sets that link share one of the first ``n - ceil(percent * n) + 1`` shingles of both.
   Documents with the same prefix and size are one group; the index of prefix shingles is
   made of groups, and shingles that only one group has are dropped.
3. Pairs of groups come from the index. A pair is filtered by what the places of the shared shingle and the sizes
   still allow, and by the shingles' counts in ``BINS`` bins, of which two sets share no more than
   the lesser ones.
4. Pairs of groups that remain are expanded to pairs of members, whose sets are made and intersected.
   Pairs whose members are known to be connected need no verification, since only
   components are asked for: first the members of a group are verified against one of them, then every group
   against the group of its shingles' lists that has the fewest rare shingles, then all pairs of groups
   that hold members of different components. After that no candidate across components
   is left out, hence the components are exact.

Copies have one set and one group, whatever their number. No list is gathered in a task:
lists are grouped by Spark with partial aggregates, and joined back with skew handling. In the last round a list is joined
with itself by classes of size, so that only sets meet whose sizes allow a link.

Null and empty texts, or texts without words, have the empty set: ``n_shingles`` 0, linked
with nothing, their own id as ``component_id``. A null id takes part in links but is never
the smallest id; a component of null ids has a null id. Repeated ids or rows need no care,
as sets are told apart by content. Ties have no part in the result: a component is named by its least id. Very long texts are
read whole. Further columns are not touched, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoflow.llm.common import free_name, released, slices, spaced_bytes, text_key
from geoflow.llm.components import stars
from geoflow.session import cut, owned, remove

#: Shingles a task counts together, and the longest list of frequent ones; both only shape the order.
COUNTED, FREQUENT = 1 << 20, 1 << 18
#: Keys of sets and groups that a task remembers, and bytes of text that it works on together.
REMEMBERED, TOGETHER_BYTES = 1 << 15, 1 << 20
#: Shingles of a set are counted in so many bins by hash; what two sets share is at most the sum of the lesser counts.
#: Counts are bytes; a set with a larger count has no bins and passes the filter.
BINS = 128
#: Ids (of eight bytes) that are sent to every task.
BROADCAST_IDS = 1_000_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


@dataclass(frozen=True)
class Similar:
    width: int = 4
    percent: int = 85


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_table(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (int64) of all texts in a row, and where each text's start and end."""
    # A factory that knew the dict would keep all words in memory until Python looks for cycles.
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = list(map(spaced_bytes, texts))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[ids]

    def hashed(h: np.ndarray, n: int) -> np.ndarray:
        total = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            total = _mixed(total * np.uint64(_MULTIPLIERS[k % 4]) + h[k:k + len(total)])
        return total.view(np.int64)

    # One shingle for each word that has enough words after it; a shorter text has one at its first word.
    left = np.repeat(ends, sizes) - np.arange(len(h))
    all_ = np.zeros(len(h), np.int64)
    full = hashed(h, width)
    all_[:len(full)] = full
    used = left >= width
    for i in np.flatnonzero((sizes > 0) & (sizes < width)).tolist():
        first = ends[i] - sizes[i]
        all_[first], used[first] = hashed(h[first:ends[i]], int(sizes[i]))[0], True
    all_ = all_[used]
    bounds = np.concatenate([[0], np.concatenate([[0], np.cumsum(used)])[ends]])
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        all_[start:end].sort()
    new = np.ones(len(all_), bool)
    new[1:] = all_[1:] != all_[:-1]
    new[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return all_[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    tokens, bounds = shingle_table(texts, width)
    return [tokens[start:end] for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _frequent(width: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = documents = 0

        def out() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            often = n >= max(2, documents / 1000)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often])], ["token", "n"])

        for batch in batches:
            for _, texts in slices(batch.column(0), TOGETHER_BYTES):
                held.append(shingle_table(texts, width)[0])
                size += len(held[-1])
                documents += len(texts)
                if size >= COUNTED:
                    yield out()
                    size = documents = 0
        yield out()

    return lambda batches: released(counted(batches))


def frequent_shingles(docs: DataFrame, width: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, sorted, and the rank of each by count. At most ``FREQUENT``."""
    counts = docs.select(text).mapInArrow(_frequent(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, n))] = np.arange(1, len(tokens) + 1)
    order = np.argsort(tokens)
    return tokens[order], rank[order]


#: Low bits of a shingle by which one that is surely rare is told without a search.
SIEVE = (1 << 22) - 1


def _places(own: np.ndarray, tokens: np.ndarray, rank: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Rank of each shingle in the common order; 0 for those that are rare."""
    out = np.zeros(len(own), np.int64)
    maybe = np.flatnonzero(sieve[own & SIEVE]) if len(tokens) else np.zeros(0, np.int64)
    if len(maybe):
        at = np.minimum(np.searchsorted(tokens, own[maybe]), len(tokens) - 1)
        out[maybe] = np.where(tokens[at] == own[maybe], rank[at], 0)
    return out


def prefixes_of(own: np.ndarray, bounds: np.ndarray, places: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The ``first`` shingles of each set in the common order: rare ones by hash, then the others by rank."""
    rare = places == 0
    rares, others, ranks = own[rare], own[~rare], places[~rare]
    rare_at = np.concatenate([[0], np.cumsum(rare)])[bounds]
    out = []
    for low, high, start, n in zip(rare_at[:-1].tolist(), rare_at[1:].tolist(), (bounds - rare_at).tolist(), first.tolist()):
        prefix = rares[low:min(high, low + n)]
        if len(prefix) < n:
            end = start + int(bounds[len(out) + 1] - bounds[len(out)]) - (high - low)
            prefix = np.concatenate([prefix, others[start:end][np.argsort(ranks[start:end])[:n - len(prefix)]]])
        out.append(prefix)
    return out


def _indexed(given: Similar, tokens: np.ndarray, rank: np.ndarray, schema: pa.Schema):
    """Rows (id, text_key, text) to (id, text_key, n, set_key, group_key, prefix, bins)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sieve = np.zeros(SIEVE + 1, bool)
        sieve[tokens & SIEVE] = True
        for batch in batches:
            for start, texts in slices(batch.column(2), TOGETHER_BYTES):
                own, bounds = shingle_table(texts, given.width)
                n = np.diff(bounds)
                first = np.where(n > 0, n - -(-given.percent * n // 100) + 1, 0)
                set_keys, group_keys, prefixes, bins = [], [], [], []
                for at, (size, prefix) in enumerate(zip(n.tolist(), prefixes_of(own, bounds, _places(own, tokens, rank, sieve), first))):
                    if not size:
                        set_keys.append(None), group_keys.append(None), prefixes.append(None), bins.append(None)
                        continue
                    set_ = own[bounds[at]:bounds[at + 1]]
                    key = hashlib.blake2b(set_.data, digest_size=16).digest()
                    set_keys.append(key)
                    group_keys.append(hashlib.blake2b(prefix.tobytes(), digest_size=16, key=size.to_bytes(8, "little")).digest())
                    prefixes.append(None if group_keys[-1] in seen else prefix)  # one of a task's copies is enough
                    bins.append(None if key in seen else counts_of(set_))
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.update((key, group_keys[-1]))
                some = batch.slice(start, len(texts))
                columns = [some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(set_keys, pa.binary()),
                           pa.array(group_keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return lambda batches: released(made(batches))


def counts_of(own: np.ndarray) -> np.ndarray:
    """Shingles by bin; no bins if a count is beyond a byte."""
    counts = np.bincount(own & (BINS - 1), minlength=BINS)
    return counts.astype(np.int8) if counts.max() < 128 else np.zeros(0, np.int8)


def _sets(width: int):
    """Rows (sid, text) to (sid, tokens), once per set of a task."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, texts in slices(batch.column(1), TOGETHER_BYTES):
                new = {sid: text for sid, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts) if sid not in seen}
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(shingle_sets(list(new.values()), width), pa.list_(pa.int64()))],
                                                 ["sid", "tokens"])

    return lambda batches: released(made(batches))


def _overlap(a: str, b: str, given: Similar) -> Column:
    """Whether the places of a shared shingle allow two groups' sets to link."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return left * (100 + given.percent) >= given.percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _bins_allow(a: str, b: str, given: Similar) -> Column:
    """Whether the counts by bin allow two sets to link; columns ``n`` and ``bins`` of each. Sets without bins may."""
    most = F.aggregate(F.zip_with(F.col(f"{a}.bins"), F.col(f"{b}.bins"), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    unknown = F.col(f"{a}.bins").isNull() | F.col(f"{b}.bins").isNull() | (F.size(F.col(f"{a}.bins")) != F.size(F.col(f"{b}.bins"))) | (
        F.size(F.col(f"{a}.bins")) == 0)
    return unknown | (most * (100 + given.percent) >= given.percent * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, given: Similar) -> DataFrame:
    """The pairs ``(a, b)`` of set ids that link. ``pairs`` is a kept table, ``texts`` holds ``text_key, text``.

    The counts by bin leave few pairs, and only their sets are made from the texts and moved. The
    keys of these texts are counted, and go to every task up to ``BROADCAST_IDS``; beyond that they are joined by a shuffle.
    """
    x, y = sets.select("sid", "bins", "n").alias("x"), sets.select("sid", "bins", "n").alias("y")
    bounded = pairs.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid")).where(_bins_allow("x", "y", given))
    pairs = cut(bounded.select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    keys = cut(sets.select("sid", "text_key").join(ids, "sid", "left_semi"))
    held = texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "text_key").select("sid", "text")
    made = held.mapInArrow(_sets(given.width), "sid long, tokens array<long>").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    first = made.select(F.col("sid").alias("a"), F.col("tokens").alias("_a"))
    second = made.select(F.col("sid").alias("b"), F.col("tokens").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(first, "a").join(second, "b")
            .select("a", "b", both.alias("_both"), (F.size("_a") + F.size("_b")).alias("_sum"))
            .where(100 * F.col("_both") >= given.percent * (F.col("_sum") - F.col("_both"))).select("a", "b"))


def _placed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``gid, sid, comp``: members with their component so far."""
    if roots is None:
        return members.select("gid", "sid", F.col("sid").alias("comp"))
    found = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    return found.select("gid", "sid", F.coalesce("root", "sid").alias("comp"))


def _open_lists(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of lists whose groups are not all in one component yet, with the components' range and the least ``score`` of the list."""
    ranges = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    score = F.shiftleft("pos", 40).bitwiseOR(F.xxhash64("gid").bitwiseAND(F.lit((1 << 40) - 1)))
    labelled = lists.join(ranges, "gid").withColumn("score", score)
    open_ = (labelled.groupBy("token").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.min("score").alias("least"))
             .where("_low < _high").select("token", "least"))
    return labelled.join(open_, "token")


def _apart(a: str, b: str) -> Column:
    """Whether two groups hold members of different components."""
    return (F.col(f"{a}.low") != F.col(f"{b}.low")) | (F.col(f"{a}.high") != F.col(f"{b}.high")) | (F.col(f"{a}.low") != F.col(f"{a}.high"))


def _pivot_pairs(rows: DataFrame, given: Similar) -> DataFrame:
    """Pairs of each list's pivot ``g`` and its other groups ``h``, with the number of lists that they share."""
    pivots = rows.where("score = least").alias("p")
    return (rows.alias("m").join(pivots, F.col("p.token") == F.col("m.token"))
            .where((F.col("p.gid") != F.col("m.gid")) & _apart("p", "m") & _overlap("p", "m", given))
            .groupBy(F.col("p.gid").alias("g"), F.col("m.gid").alias("h")).agg(F.count("*").alias("shared")))


def _all_pairs(rows: DataFrame, groups: DataFrame, given: Similar) -> DataFrame:
    """All pairs of groups ``(g, h)`` of each list that may link and are not of one component.

    Sizes of sets that link differ by a factor of ``100 / percent`` at most. A group of a class of size meets its own class and the next one.
    """
    step = 1.001 * math.log(100 / given.percent) if given.percent < 100 else 1.0  # a little wider, so that rounding loses no pair
    sized = rows.join(groups.select("gid", "bins"), "gid").withColumn("class", F.floor(F.log("n") / step))
    near = sized.withColumn("_class", F.explode(F.array("class", F.col("class") + 1)))
    p, m = near.alias("p"), sized.alias("m")
    once = (F.col("p.class") < F.col("m.class")) | (F.col("p.gid") < F.col("m.gid"))
    return (p.join(m, (F.col("p.token") == F.col("m.token")) & (F.col("p._class") == F.col("m.class")) & once & (F.col("p.gid") != F.col("m.gid"))
                   & _apart("p", "m") & _overlap("p", "m", given) & _bins_allow("p", "m", given))
            .select(F.least("p.gid", "m.gid").alias("g"), F.greatest("p.gid", "m.gid").alias("h")).distinct())


def _expanded(pairs: DataFrame, placed: DataFrame, every: bool) -> DataFrame:
    """Pairs of members ``(a, b)`` of different components; of the first group only its first member, unless ``every``."""
    b = pairs.join(placed.select(F.col("gid").alias("h"), F.col("sid").alias("b"), F.col("comp").alias("_b")), "h")
    first = placed if every else placed.where("sid = gid")
    a = b.join(first.select(F.col("gid").alias("g"), F.col("sid").alias("a"), F.col("comp").alias("_a")), "g")
    return a.where("_a <> _b").select("a", "b")


@owned
def components(docs: DataFrame, given: Similar = Similar(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id``. A kept table."""
    tokens, rank = frequent_shingles(docs, given.width, text)
    keyed = docs.select(F.col(id_col).alias("id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    schema = T.StructType([keyed.schema["id"], keyed.schema["text_key"]]).add("n", "long").add("set_key", "binary").add(
        "group_key", "binary").add("prefix", T.ArrayType(T.LongType())).add("bins", T.ArrayType(T.ByteType()))
    index = cut(keyed.mapInArrow(_indexed(given, tokens, rank, to_arrow_schema(schema)), schema))

    # One row per set: the least of its texts, and its counts by bin. A group is named by its least set.
    of_set = index.where("bins is not null").groupBy("set_key").agg(F.min(F.struct("text_key", "group_key", "n", "bins")).alias("_s"))
    sets = cut(of_set.select("set_key", "_s.*").withColumn("sid", F.monotonically_increasing_id()))
    named = sets.groupBy("group_key").agg(F.min("sid").alias("gid"), F.count("*").alias("size"), F.first("n").alias("n"), F.min("bins").alias("bins"))
    groups = cut(named.select("group_key", "gid", "size", "n", F.when(F.col("size") == 1, F.col("bins")).alias("bins")))
    texts = keyed.select("text_key", "text")
    members = cut(sets.join(groups.select("group_key", "gid", "size"), "group_key").select("gid", "sid", "size"))

    postings = index.where("prefix is not null").select("group_key", "n", F.posexplode("prefix").alias("pos", "token"))
    seen = F.xxhash64("group_key")
    # Of two sets that link the smaller has the shared shingle among its first ones, of which there are even less.
    early = (F.col("n") - F.col("pos")) * (100 + given.percent) >= 2 * given.percent * F.col("n")
    shared = cut(postings.groupBy("token").agg(F.min(seen).alias("_low"), F.max(seen).alias("_high"), F.max(early).alias("_early"))
                 .where("_low < _high and _early").select("token"))  # kept apart, so that the join can split hot shingles
    grouped = postings.join(shared, "token").select("token", "group_key", F.col("pos").cast("long").alias("pos"))
    lists = cut(grouped.join(groups.select("group_key", "gid", "n"), "group_key").select("token", "gid", "n", "pos").distinct())
    remove(shared)

    # Members of one group against its first one.
    tried = cut(members.where("size > 1 and sid <> gid").select(F.col("gid").alias("a"), F.col("sid").alias("b")))
    roots = None if tried.isEmpty() else stars(cut(_verified(tried, sets, texts, given)))
    for part in ("best", "pivots", "all"):
        placed = cut(_placed(members, roots))
        rows = cut(_open_lists(lists, placed))
        if part == "best":
            pairs = _pivot_pairs(rows, given).groupBy("h").agg(F.max_by("g", "shared").alias("g"))
            found = _expanded(pairs, placed, False)
        elif part == "pivots":
            found = _expanded(_pivot_pairs(rows, given), placed, False)
        else:
            found = _expanded(_all_pairs(rows, groups, given), placed, True).unionByName(_inside(placed, sets, given))
        new = cut(found.distinct().join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(new).unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        remove(rows, placed)
        if new.isEmpty():
            continue
        links = cut(_verified(new, sets, texts, given))
        if links.isEmpty():
            continue
        known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))  # stars already
        roots = stars(known)

    placed = index.select("id", "n", "set_key")
    if roots is None:
        root_key = sets.select("set_key", F.col("set_key").alias("root_key")).limit(0)
    else:
        names = sets.select("set_key", "sid")
        found = names.join(roots.withColumnRenamed("node", "sid"), "sid")
        root_key = found.join(names.select(F.col("sid").alias("root"), F.col("set_key").alias("root_key")), "root").select("set_key", "root_key")
    placed = placed.join(root_key, "set_key", "left").withColumn("_key", F.coalesce("root_key", "set_key"))
    least = placed.where("n > 0").groupBy("_key").agg(F.min("id").alias("_least"))
    return (placed.join(least, "_key", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("id")).alias("component_id")))


def _inside(placed: DataFrame, sets: DataFrame, given: Similar) -> DataFrame:
    """Pairs of members of one group that are still of different components and may link by their counts."""
    several = placed.groupBy("gid").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("gid")
    held = placed.join(several, "gid").join(sets.select("sid", "n", "bins"), "sid")
    x, y = held.alias("x"), held.alias("y")
    return x.join(y, (F.col("x.gid") == F.col("y.gid")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.comp") != F.col("y.comp"))
                  & _bins_allow("x", "y", given)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))


def keep_one(docs: DataFrame, given: Similar = Similar(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their columns as they were.

    Documents without words stay. A row with a null id goes if its component has an id, or
    if it has words and its component has none but nulls it stays. Rows that repeat an id
    count as one document.
    """
    found = components(docs, given, id_col, text)
    gone = free_name(docs, "_gone")
    others = found.where(F.col(id_col).isNotNull() & (F.col(id_col) != F.col("component_id"))).select(F.col(id_col).alias(gone)).distinct()
    others = cut(others)
    kept = docs.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, F.col(id_col) == F.col(gone), "left_anti")
    return kept.select(*[F.col(f"`{n}`") for n in docs.columns])
