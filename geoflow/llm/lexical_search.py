"""Ranked lexical search: all documents for each item, by dense blocked products.

Terms are runs of ASCII letters, ASCII digits and characters beyond ASCII, A-Z lower-cased.
A term of a document weighs ``(10^9 * tf) div (1000 * tf + 8 * m)``, its impact, with
``m = 25 + (75 * n * N) div L``; a term of an item weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``
times its repeats. A score is the sum of the products, in whole numbers.

1. Terms of the items are numbered: the item vocabulary. One pass over the documents counts
   N, L and the documents of each of these terms, and keeps, per document, its length and
   the numbers and counts of the terms that it shares with the items.
2. Documents are taken ``DOCUMENTS`` at a time. For each tile of the vocabulary the terms
   that these documents hold are compacted, and their impacts (documents x terms) are multiplied
   with the items' weights (terms x items) in float64. Tiles end where a sum of products
   could reach 2^53, so that every sum is exact; their results are added as 64-bit integers.
3. A task keeps the ``k`` best documents of each item, equal scores by id, and the best of
   all tasks are ranked by Spark.

Items are worked off in blocks, dealt by a hash of the item so that a block has about ``BLOCK_ITEMS`` items
and ``BLOCK_BYTES`` of text, whatever their number; a block goes to all tasks. A single item may
be longer than that. A term of more than ``2^53 / 10^6`` in weight (repeats times its weight)
does not occur below 280,000 repeats; beyond that the item's tile is summed as integers.

Null and empty texts and texts without terms are no documents for N and are never found;
items of that kind find nothing. Rows that repeat a ``doc_id`` are ranked each, a null id
comes last among equal scores. Rows that repeat an ``item_id`` or have none are items of
their own. Extra columns are not touched. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoflow.llm.common import slices
from geoflow.llm.dense import EXACT
from geoflow.session import cut, local_frame, owned, remove

K = 10
#: Items and bytes of item text of a block.
BLOCK_ITEMS, BLOCK_BYTES = 512, 4 << 20
#: Documents and vocabulary terms of a tile.
DOCUMENTS, TERMS = 512, 2048
#: No impact is larger: 10^9 tf / (1000 tf + 8 m) stays below 10^6.
MOST_IMPACT = 1_000_000
#: Bytes of terms as they are compared; all others part terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8. Bytes of characters beyond ASCII are all 0x80 or more."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


class Block:
    """Items as a vocabulary and, per item, its terms (by number) with their repeats."""

    def __init__(self, texts: list[str | None]) -> None:
        self.number: dict[bytes, int] = {}
        self.items = len(texts)
        rows: list[tuple[int, int, int]] = []
        for item, text in enumerate(texts):
            rows += [(self.number.setdefault(t, len(self.number)), item, n) for t, n in Counter(terms(text)).items()]
        rows.sort()
        self.term, self.item, self.repeats = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3

    def tiles(self, weights: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(first term, end, weights of terms x items) of each tile; int64 where float64 would not be exact."""
        value = weights[self.term] * self.repeats
        out: list[tuple[int, int, np.ndarray]] = []
        first = 0
        while first < len(self.number):
            room = np.zeros(self.items, np.int64)
            start = int(np.searchsorted(self.term, first))
            end, at = first, start
            while end < min(first + TERMS, len(self.number)):
                stop = int(np.searchsorted(self.term, end + 1))
                more = room[self.item[at:stop]] + value[at:stop]
                if end > first and (more * MOST_IMPACT >= EXACT).any():
                    break
                room[self.item[at:stop]] = more
                end, at = end + 1, stop
            dense = np.zeros((end - first, self.items), np.int64)
            dense[self.term[start:at] - first, self.item[start:at]] = value[start:at]
            exact = not (room * MOST_IMPACT >= EXACT).any()
            out.append((first, end, dense.astype(np.float64) if exact else dense))
            first = end
        return out


def _counted(block: Block, schema: pa.Schema):
    """Rows (id, text) to (id, n, numbers, counts) of the documents that share a term with the items, and to counts of all."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.number
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                at, lengths, numbers, counts = [], [], [], []
                rest_n = rest_length = 0
                for k, text in enumerate(texts):
                    found = terms(text)
                    if not found:
                        continue
                    own = Counter(map(number.get, found))
                    own.pop(None, None)
                    if own:
                        at.append(start + k), lengths.append(len(found)), numbers.append(list(own)), counts.append(list(own.values()))
                    else:
                        rest_n, rest_length = rest_n + 1, rest_length + len(found)
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths), pa.array(numbers), pa.array(counts), pa.array([1] * len(at))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
                if rest_n:  # documents without such a term count for N and L only
                    none = [pa.nulls(1, schema[0].type), pa.array([rest_length]), pa.array([None]), pa.array([None]), pa.array([rest_n])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(none, schema)], schema=schema)

    return made


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def tile_scores(block: Block, tiles: list, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
    """Scores (n documents x items) from entries (document row, term, impact)."""
    order = np.argsort(term, kind="stable")
    row, term, impact = row[order], term[order], impact[order]
    total = np.zeros((n, block.items), np.int64)
    for first, end, weights in tiles:
        a, b = np.searchsorted(term, (first, end))
        if a == b:
            continue
        held, column = np.unique(term[a:b], return_inverse=True)  # only the terms that these documents hold
        dense = np.zeros((n, len(held)), weights.dtype)
        dense[row[a:b], column] = impact[a:b]
        total += (dense @ weights[held - first]).astype(np.int64)
    return total


def _best(block: Block, tiles: list, documents: int, length: int, k: int, schema: pa.Schema):
    """Rows (id, n, numbers, counts) to the k best of each item: (item, id, score)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(block.items)]
        least = np.zeros(block.items, np.int64)  # below that nothing can be among the best; 0 is never found
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                some = batch.slice(start, DOCUMENTS)
                n = some.column(1).to_numpy().astype(np.int64)
                sizes = np.diff(some.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), sizes)
                tf = some.column(3).flatten().to_numpy().astype(np.int64)
                m = 25 + 75 * n * documents // length
                scores = tile_scores(block, tiles, row, some.column(2).flatten().to_numpy(), impacts(tf, m[row]), len(n))
                where, item = np.nonzero((scores > 0) & (scores >= least))
                if not len(where):
                    continue
                ids = some.column(0).to_pylist()
                for at, one, score in zip(where.tolist(), item.tolist(), scores[where, item].tolist()):
                    best[one].append((-score, ids[at] is None, ids[at]))
                for one in np.unique(item).tolist():
                    if len(best[one]) > k:
                        best[one] = heapq.nsmallest(k, best[one], key=_order)
                    if len(best[one]) == k:
                        least[one] = -max(x[0] for x in best[one])
        rows = [(one, x[2], -x[0]) for one, found in enumerate(best) for x in found]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return made


def _order(x: tuple) -> tuple:
    return x[0], x[1], 0 if x[1] else x[2]


def _ranked(docs: DataFrame, block: Block, k: int, id_col: str, text: str) -> DataFrame:
    """``item, id_col, score, rank`` of one block of items; ``item`` is its number in the block."""
    kind = docs.schema[id_col]
    schema = T.StructType([kind, *T.StructType.fromDDL("n long, numbers array<int>, counts array<int>, documents long")])
    given = docs.select(F.col(id_col), F.col(text).alias("text"))
    kept = cut(given.mapInArrow(_counted(block, to_arrow_schema(schema)), schema))
    total = kept.agg(F.sum("documents").alias("N"), F.sum(F.col("n")).alias("L")).first()
    held = kept.where("numbers is not null")
    df = np.zeros(len(block.number), np.int64)
    counted = held.select(F.explode("numbers").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # of the block's terms
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    documents, length = total["N"] or 0, total["L"] or 0
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    found = T.StructType([T.StructField("item", T.IntegerType()), kind, T.StructField("score", T.LongType())])
    best = held.select(id_col, "n", "numbers", "counts").mapInArrow(
        _best(block, block.tiles(weights), documents, length, k, to_arrow_schema(found)), found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col(id_col).isNull(), id_col)
    out = cut(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    remove(kept)
    return out


@owned
def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``item_id, rank, id_col, score``: the ``k`` best documents of each item, those with a score above 0."""
    spark = docs.sparkSession
    size = items.agg(F.count("*"), F.sum(F.octet_length(item_text))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_BYTES))
    asked = items.select(F.col(item_id).alias("_id"), F.col(item_text).alias("_text"))
    schema = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    found = []
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == number).toArrow()
        block = Block(own.column("_text").to_pylist())
        if block.number:
            names = local_frame(spark, [{"item": k, "_id": x} for k, x in enumerate(own.column("_id").to_pylist())],
                                T.StructType([T.StructField("item", T.IntegerType()), T.StructField("_id", items.schema[item_id].dataType)]))
            ranked = _ranked(docs, block, k, id_col, text).select("item", "rank", F.col(id_col).alias("_doc"), "score")
            found.append(ranked.join(F.broadcast(names), "item").select(F.col("_id").alias(item_id), "rank", F.col("_doc").alias(id_col), "score"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
