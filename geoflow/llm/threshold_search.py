"""Exact top-k search by inner product, in three phases with one threshold for all lists.

Vectors are brought to whole numbers (``floor(scale * x)``) and cut into ``lists`` blocks of
components. Each block is a list: it scores every candidate by its own components, and a
candidate's score is the sum over the lists. Candidates lie in tiles of ``TILE`` vectors, and
a tile of one list is one row, so that lists and tiles are spread over all tasks.

1. Every tile gives the best local scores of its list for each query. The best of each list
   are gathered, their other lists are asked, and the (k + 1)-th best whole score of a query
   is its cutoff: no result can be below it.
2. The cutoffs are sent to the tasks. A candidate that reaches the cutoff has at least
   ``cutoff / lists`` in one of the lists, whatever the signs, so each list collects the
   entries that have that much.
3. Whole scores of entries that all lists collected raise the cutoff. What can still reach
   it, with ``cutoff / lists`` as a bound for the lists that did not collect it, is asked of
   the other lists, and the whole scores are ranked.

Vectors that are equal are one candidate and one query. A candidate carries its ``k + 1``
smallest ids, more of which no result can show, and every id of a query gets the rows of its
vector without itself. Queries are worked off in rounds of about ``ROUND`` vectors, which go
to all tasks with their cutoffs; nothing else is sent or collected, and its size depends on
``ROUND`` alone.

Vectors that are null or hold a null, an infinity or a NaN take no part. Vectors of different
length are compared as if the shorter one ended in zeros, an empty vector is all zeros. Rows
that repeat an id and a vector count once; an id with several vectors asks with each of them,
and only the vector that asks is no candidate then. A null id asks nothing and is the last among equal scores.
Empty tables and tables without a query give an empty result. Components beyond 2^62 fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.dense import exact_product, largest
from geoflow.session import cut, local_frame, owned, remove

#: Vectors of a tile, queries of a round, and queries that a task scores together.
TILE, ROUND, TOGETHER = 4096, 4096, 256
#: Entries in a batch.
ASKED = 1 << 16

TILES = "tile long, part int, n int, vectors binary"
ENTRY = "q int, tile long, at int, part int, score long"


@dataclass(frozen=True)
class Search:
    k: int = 5
    scale: int = 256
    lists: int = 2


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    value = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    huge = F.exists(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) >= float(1 << 62))
    return F.when(vector.isNull() | bad, None).when(huge, F.raise_error(F.lit("a component does not fit into 62 bits")).cast("array<long>")).otherwise(value)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an array of lists, ended by zeros up to ``width``."""
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _bounds(width: int, lists: int) -> list[tuple[int, int]]:
    return [(width * p // lists, width * (p + 1) // lists) for p in range(lists)]


def _packed(width: int, lists: int):
    """Rows (vector, ids) to tiles, with the ids in the row of the first list."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                some = batch.slice(start, TILE)
                matrix = _matrix(some.column(0), width)
                rows = [matrix[:, a:b].tobytes() for a, b in _bounds(width, lists)]
                ids = [some.column(1).to_pylist()] + [None] * (lists - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * lists, pa.int64()), pa.array(range(lists), pa.int32()), pa.array([some.num_rows] * lists, pa.int32()),
                     pa.array(rows, pa.binary()), pa.array(ids, pa.list_(some.column(1).type))], ["tile", "part", "n", "vectors", "ids"])
                number += 1

    return made


def _entries(q: np.ndarray, tile: int, at: np.ndarray, part: int, score: np.ndarray) -> pa.RecordBatch:
    n = len(q)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(np.full(n, tile)), pa.array(at, pa.int32()),
                                       pa.array(np.full(n, part), pa.int32()), pa.array(score, pa.int64())], ["q", "tile", "at", "part", "score"])


def _tiles(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            tile, part, n, data = (batch.column(c)[k].as_py() for c in range(4))
            yield tile, part, np.frombuffer(data, np.int64).reshape(n, bounds[part][1] - bounds[part][0])


def _local_best(asked: np.ndarray, bounds: list[tuple[int, int]], most: int):
    """The best local scores of each tile and list. Which of equal ones are taken makes no difference to the result."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, part, vectors in _tiles(batches, bounds):
            a, b = bounds[part]
            for start in range(0, len(asked), TOGETHER):
                scores = exact_product(asked[start:start + TOGETHER, a:b], vectors)
                keep = min(most, len(vectors))
                at = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                q = np.repeat(np.arange(start, start + len(scores)), keep)
                yield _entries(q, tile, at.ravel(), part, np.take_along_axis(scores, at, 1).ravel())

    return made


def _reaching(asked: np.ndarray, least: np.ndarray, bounds: list[tuple[int, int]]):
    """All local scores of at least ``least`` of their query."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, part, vectors in _tiles(batches, bounds):
            a, b = bounds[part]
            for start in range(0, len(asked), TOGETHER):
                scores = exact_product(asked[start:start + TOGETHER, a:b], vectors)
                q, at = np.nonzero(scores >= least[start:start + TOGETHER, None])
                for k in range(0, len(q), ASKED):
                    some = slice(k, k + ASKED)
                    yield _entries(q[some] + start, tile, at[some], part, scores[q[some], at[some]])

    return made


def _pair_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The inner product of each row of ``left`` with the same row of ``right``."""
    if left.shape[1] * largest(left) * largest(right) < 1 << 63:
        return np.einsum("ij,ij->i", left, right)
    total = (left.astype(object) * right.astype(object)).sum(axis=1)
    if largest(total) >= 1 << 63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return total.astype(np.int64)


def _answers(asked: np.ndarray, bounds: list[tuple[int, int]]):
    """Rows (tile, part, n, vectors, entries) to the local scores of the entries (q, at)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (tile, part, vectors) in enumerate(_tiles([batch], bounds)):
                a, b = bounds[part]
                pairs = batch.column(4)[k].values
                q, at = (pairs.field(c).to_numpy() for c in (0, 1))
                for start in range(0, len(q), ASKED):
                    some = slice(start, start + ASKED)
                    yield _entries(q[some], tile, at[some], part, _pair_scores(asked[q[some], a:b], vectors[at[some]]))

    return made


def _known(entries: DataFrame) -> DataFrame:
    """One row per query and candidate: the sum of the lists that are known, and which they are."""
    return entries.groupBy("q", "tile", "at").agg(F.sum("score").alias("known"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("part"))).alias("lists"))


def _whole_scores(known: DataFrame, tiles: DataFrame, asked: np.ndarray, bounds: list[tuple[int, int]]) -> DataFrame:
    """``(q, tile, at, score)`` of all candidates of ``known``; lists that are not known are asked."""
    every = (1 << len(bounds)) - 1
    parts = F.array(*[F.lit(p) for p in range(len(bounds))])
    unknown = F.filter(parts, lambda p: F.col("lists").bitwiseAND(F.call_function("shiftleft", F.lit(1), p)) == 0)
    open_ = known.where(F.col("lists") != every).select("q", "tile", "at", F.explode(unknown).alias("part"))
    # Of a tile and TOGETHER queries there are at most TILE * TOGETHER entries of eight bytes.
    packed = (open_.groupBy("tile", "part", F.expr(f"q div {TOGETHER}").alias("_block"))
              .agg(F.collect_list(F.struct("q", "at")).alias("entries")).drop("_block"))
    answered = tiles.join(packed, ["tile", "part"]).select("tile", "part", "n", "vectors", "entries").mapInArrow(_answers(asked, bounds), ENTRY)
    both = known.select("q", "tile", "at", F.col("known").alias("score")).unionByName(answered.select("q", "tile", "at", "score"))
    return both.groupBy("q", "tile", "at").agg(F.sum("score").alias("score"))


def _cutoffs(scores: DataFrame, place: int, n: int) -> np.ndarray:
    """The score in the given place of each query; the least number where there are fewer."""
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    found = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= place).where(F.col("_r") == place).select("q", "score").toArrow()
    out = np.full(n, np.iinfo(np.int64).min // 2)
    out[found.column("q").to_numpy()] = found.column("score").to_numpy()
    return out


def _round(tiles: DataFrame, members: DataFrame, asked: np.ndarray, bounds: list[tuple[int, int]], k: int) -> DataFrame:
    """The ``k + 1`` best candidates of each query: ``q, score, ids``."""
    spark, place, lists = tiles.sparkSession, k + 1, len(bounds)
    best = Window.partitionBy("q", "part").orderBy(F.desc("score"))
    gathered = (tiles.mapInArrow(_local_best(asked, bounds, place), ENTRY)
                .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= 4 * place).drop("_r"))
    first = cut(_whole_scores(cut(_known(gathered)), tiles, asked, bounds))
    cutoff = _cutoffs(first, place, len(asked))

    least = -(-cutoff // lists)
    collected = cut(_known(tiles.mapInArrow(_reaching(asked, least, bounds), ENTRY)))
    sure = collected.where(F.col("lists") == (1 << lists) - 1).select("q", "tile", "at", F.col("known").alias("score"))
    raised = np.maximum(cutoff, _cutoffs(sure.unionByName(first).distinct(), place, len(asked)))
    limits = local_frame(spark, [{"q": q, "raised": int(r), "below": int(b) - 1} for q, (r, b) in enumerate(zip(raised, least))],
                         "q int, raised long, below long")
    most = F.col("known") + (lists - F.bit_count("lists")) * F.col("below")
    remaining = collected.join(F.broadcast(limits), "q").where(most >= F.col("raised")).drop("below")
    scores = _whole_scores(remaining.drop("raised"), tiles, asked, bounds)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]["_null"], F.col("ids")[0]["_id"])
    reached = scores.join(F.broadcast(limits), "q").where("score >= raised").select("q", "tile", "at", "score")
    named = reached.join(members, ["tile", "at"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= place)
    out = cut(named.select("q", "score", "ids"))
    remove(first, collected)
    return out


@owned
def top(vectors: DataFrame, asks: Column, given: Search = Search(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score`` of the rows of ``vectors`` for which ``asks`` holds, against all others."""
    spark, place = vectors.sparkSession, given.k + 1
    kind = vectors.schema[id_col].dataType
    used = (vectors.select(F.col(id_col).alias("_id"), whole(F.col(vector), given.scale).alias("_v"), F.coalesce(asks, F.lit(False)).alias("_asks"))
            .where("_v is not null"))
    rows = cut(used.groupBy("_id", "_v").agg(F.max("_asks").alias("_asks")))
    few = Window.partitionBy("_v").orderBy(F.col("_id").isNull(), "_id")
    classes = (rows.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= place).groupBy("_v")
               .agg(F.array_sort(F.collect_list(F.struct(F.col("_id").isNull().alias("_null"), "_id"))).alias("ids")))
    asking = rows.where(F.col("_asks") & F.col("_id").isNotNull())
    ask = cut(asking.select("_v").distinct().withColumn("_n", F.monotonically_increasing_id()))
    # Which query a candidate's vector is, if it is one.
    classes = classes.join(ask, "_v", "left").withColumn("ids", F.transform("ids", lambda x: x.withField("_n", F.col("_n"))))
    n_asked = ask.count()
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kind),
                           T.StructField("score", T.LongType())])
    if not n_asked:
        return spark.createDataFrame([], schema)
    width = max(given.lists, rows.agg(F.max(F.size("_v"))).first()[0])
    bounds = _bounds(width, given.lists)
    held = T.StructType.fromDDL(TILES).add("ids", T.ArrayType(classes.schema["ids"].dataType))
    packed = cut(classes.select("_v", "ids").mapInArrow(_packed(width, given.lists), held))
    tiles = packed.select("tile", "part", "n", "vectors")
    members = packed.where("part = 0").select("tile", F.posexplode("ids").alias("at", "ids"))

    rounds = -(-n_asked // ROUND)
    found = []
    for block in range(rounds):
        own = ask.where(F.pmod(F.xxhash64("_n"), F.lit(rounds)) == block).toArrow()
        if own.num_rows:
            names = local_frame(spark, [{"q": q, "_n": n} for q, n in enumerate(own.column("_n").to_pylist())], "q int, _n long")
            asked = _matrix(own.column("_v").combine_chunks(), width)
            found.append(_round(tiles, members, asked, bounds, given.k).join(F.broadcast(names), "q").drop("q"))
    each = reduce(DataFrame.unionByName, found).select("_n", "score", F.explode("ids").alias("_x"))
    entry = F.struct((-F.col("score")).alias("_low"), F.col("_x._null").alias("_null"), F.col("_x._id").alias("_id"), F.col("_x._n").alias("_n"))
    # At most (k + 1) * (k + 1) ids for each query vector.
    best = each.groupBy("_n").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, place).alias("_best"))
    mine = asking.select(F.col("_id").alias("query_id"), "_v").join(ask, "_v").select("query_id", "_n").join(best, "_n")
    others = F.filter("_best", lambda x: ~(x["_id"].eqNullSafe(F.col("query_id")) & x["_n"].eqNullSafe(F.col("_n"))))
    out = mine.select("query_id", F.posexplode(F.slice(others, 1, given.k)).alias("_at", "_x"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x._id").alias(id_col), (-F.col("_x._low")).alias("score"))
