"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import wraps
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

T_co = TypeVar("T_co")

#: Settings every job of this library expects. They leave partition counts to
#: adaptive execution, which merges small shuffle blocks and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def build_session(app: str = "geoflow", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings above; the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a local session names none is a temporary folder made, and then noted
    in the session so that one run uses one folder. On a cluster there has to be one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("geoflow.work.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="geoflow-")
        spark.conf.set("geoflow.work.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, used by nothing else."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it wants it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def local_frame(spark: SparkSession, rows: list[dict], schema: T.StructType | str) -> DataFrame:
    """A few driver rows as a frame whose exact size the planner knows."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


#: Removes a query's shuffle files when it ends, so that kept steps don't pile up on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_cleaning = threading.Lock()
#: Session settings in use by writes of several threads: how many there are, and the value before the first of them.
_users: dict[int, tuple[int, str]] = {}

#: Tables of the open scope; steps of ``together`` share the scope of their caller.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("kept tables", default=None)


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Cleanup is on while any thread is inside, and as it was before when the last one leaves."""
    key = id(spark._jsparkSession)
    with _cleaning:
        n, before = _users.get(key) or (0, spark.conf.get(CLEANUP))
        _users[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            n, before = _users.pop(key)
            if n > 1:
                _users[key] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    This ends the lineage, survives lost executors, and gives the planner a true
    size, so that it can choose between broadcast and shuffle by itself. The shuffle
    files of the write go when it is done. The table belongs to the open ``scope``, if there is one;
    ``remove`` deletes it at any time.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    with _cleanup(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    owner = _scope.get()
    if owner is not None:
        owner.append(kept)
    return kept


def remove(*kept: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more. Deleting twice does no harm."""
    for df in kept:
        files, path = file_system(df.sparkSession, df._kept_path)
        files.delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end, also after an error."""
    mine: list[DataFrame] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(*mine)


def owned(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step whose result is one kept table; what it kept on the way is deleted when that is written.

    The result belongs to the caller: to the scope around the call, or to whoever passes it to ``remove``.
    """
    @wraps(step)
    def run(*args, **kwargs) -> DataFrame:
        around = _scope.get()
        with scope():
            inner = step(*args, **kwargs)
            token = _scope.set(around)
            try:
                return cut(inner)
            finally:
                _scope.reset(token)

    return run


def together(*steps: Callable[[], T_co]) -> list[T_co]:
    """Run independent jobs at the same time, so that one fills the gaps of another."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(copy_context().run, step) for step in steps]]


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = 4_000_000) -> int:
    """Partitions for making a known number of rows."""
    return max(2 * task_count(spark), -(-rows // rows_per_task))


def dealt_by(df: DataFrame, rows: int, *keys: str, rows_per_task: int = 500_000) -> DataFrame:
    """``df``, of at most ``rows`` rows, dealt by its keys over as many partitions as its rows ask for.

    A grouping by these and more keys then holds about ``rows_per_task`` rows in a task, whatever the size of
    the input and however well the rows compress; adaptive execution goes by compressed bytes.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task)), *keys)


def task_count(spark: SparkSession) -> int:
    """Partitions for work that starts from few rows but makes many."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)
