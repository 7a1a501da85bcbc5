"""Work folder, kept frames and jobs side by side."""

import pytest

from geoflow import session
from tests.conftest import plan


class Elsewhere:
    """Stands for a session on a cluster that names no folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "yarn"


def test_a_cluster_has_to_name_the_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_cut_keeps_rows_and_ends_the_lineage(spark):
    df = spark.range(10).selectExpr("id", "id * id as square", "cast(id as string) as text")
    kept = session.cut(df.orderBy("id"))
    assert kept.schema.names == df.schema.names
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Sort" not in plan(kept) and "FileScan" in plan(kept).replace("Scan parquet", "FileScan")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_removed_tables_are_gone(spark):
    kept = session.cut(spark.range(10).repartition(3))
    assert kept.count() == 10 and spark.conf.get(session.CLEANUP) == "false"
    session.remove(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(kept._kept_path).count()


def test_threads_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(session.CLEANUP)
    for _ in range(3):
        session.together(*[lambda n=n: session.cut(spark.range(n).repartition(2)).count() for n in (5, 50, 500)])
        assert spark.conf.get(session.CLEANUP) == before


def test_kept_tables_have_an_owner(spark):
    tables = []

    @session.owned
    def step():
        tables.append(session.cut(spark.range(4)))
        session.together(lambda: tables.append(session.cut(spark.range(3))), lambda: tables.append(session.cut(spark.range(2))))
        return tables[0].where("id > 1")

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with session.scope():
        result = step()
        assert result.count() == 2 and there(result) and not any(map(there, tables))
        with pytest.raises(ZeroDivisionError), session.scope():
            tables.append(session.cut(spark.range(1)))
            1 // 0
        assert not there(tables[-1])
    assert not there(result)


def test_jobs_together_return_in_order_and_pass_errors_on(spark):
    assert session.together(lambda: spark.range(3).count(), lambda: spark.range(5).count()) == [3, 5]
    with pytest.raises(ZeroDivisionError):
        session.together(lambda: 1, lambda: 1 // 0)


def test_task_counts(spark):
    assert session.tasks_for(spark, 10) == 2 * session.task_count(spark)
    assert session.tasks_for(spark, 10**12) == 250_000


def test_rows_ask_for_partitions_however_small_they_compress(spark):
    """Adaptive execution would make one task of these rows; a grouping by nearly unique keys then holds all of them."""
    rows = 40_000
    dealt = session.dealt_by(spark.range(rows).selectExpr("id", "0 as same"), rows, "id", rows_per_task=1000)
    sizes = [r["count"] for r in dealt.selectExpr("spark_partition_id() as at").groupBy("at").count().collect()]
    assert sum(sizes) == rows and len(sizes) == 40 and max(sizes) < 1500
    grouped = dealt.groupBy("id", "same").count()
    assert plan(grouped).count("(1) Exchange") + plan(grouped).count(") Exchange\n") <= 2  # the grouping needs none of its own


def test_fitted_moves_are_grouped_in_tasks_of_bounded_rows(spark):
    from parity.registry import run
    import parity.all_cases  # noqa: F401

    grouped = run("s7_fit_schema", spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in plan(grouped)
