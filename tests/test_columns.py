"""Hand-computed values of scalar expressions."""

import math

import pytest
from pyspark.sql import functions as F

from geoflow.functions import expr
from geoflow.functions.draws import Draws, lifespan
from geoflow.functions.periods import Periods, periods_of
from tests.conftest import rows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pack_is_negative_from_period_32_on_and_unpacks(spark):
    ids = spark.createDataFrame([(0, 0, 0), (31, 63, 5), (32, 0, 1), (49, 53, (1 << 52) - 1)], "p int, r int, i long")
    packed = ids.withColumn("id", expr.pack_id(F.col("p"), F.col("r"), F.col("i")))
    assert [r.id < 0 for r in packed.orderBy("p").collect()] == [False, False, True, True]
    back = packed.select("p", "r", "i", expr.unpack_id(F.col("id")).alias("u")).where(
        (F.col("p") != F.col("u.period")) | (F.col("r") != F.col("u.region")) | (F.col("i") != F.col("u.index"))
    )
    assert back.count() == 0
    assert packed.where("p = 32").first().id == -(1 << 63) + 1


def test_longitude_wraps_with_floored_modulo(spark):
    got = one(spark, *[expr.wrap_lon(F.lit(x)) for x in (190.0, -190.5, 180.0, -180.0, 0.0)])
    assert list(got) == [-170.0, 169.5, -180.0, -180.0, 0.0]


def test_latitude_is_clamped(spark):
    assert list(one(spark, expr.clamp_lat(F.lit(99.0)), expr.clamp_lat(F.lit(-99.0)))) == [85.0, -85.0]


def test_quarter_of_the_equator(spark):
    got = one(spark, expr.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))[0]
    assert got == pytest.approx(math.pi / 2 * 6371.0088)


def test_normalise_keeps_a_zero_array(spark):
    got = one(spark, expr.normalise(F.array(F.lit(1.0), F.lit(3.0))), expr.normalise(F.array(F.lit(0.0), F.lit(0.0))))
    assert list(got) == [[0.25, 0.75], [0.0, 0.0]]


def test_argmax_takes_the_first_maximum(spark):
    got = one(spark, expr.argmax_label(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), ["a", "b", "c"]))[0]
    assert got == "b"


def test_periods(spark):
    p = Periods(1525, 2025, 10)
    assert (p.count, p.last) == (50, 49)
    got = one(spark, *[p.index(F.lit(y)) for y in (1500.0, 1525.0, 1534.9, 2024.9, 2025.0)])
    assert list(got) == [0, 0, 0, 49, 49]
    got = one(spark, *[F.round(p.progress(F.lit(y)), 6) for y in (1500.0, 1530.0, 2025.0)])
    assert list(got) == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        Periods(0, 65, 1)


def test_covered_periods(spark):
    p = Periods(1525, 2025, 10)
    def at(a, b, match):
        return one(spark, p.covered(F.lit(a), F.lit(b), match))[0]

    assert at(1756, 1763, "start_year") == []
    assert at(1756, 1763, "overlap") == [23]
    assert at(1525, 1545, "start_year") == [0, 1, 2]
    assert at(1400, 1524, "overlap") == []
    assert at(2014, 2090, "overlap") == [48, 49]
    with pytest.raises(ValueError):
        at(1, 2, "other")


def test_periods_of_a_column(spark):
    df = spark.createDataFrame([(1990,), (1997,)], "y int")
    assert rows(periods_of(df, F.col("y"), 3)) == [(0, 1990), (1, 1993), (2, 1996)]
    far = spark.createDataFrame([(1000,), (1997,)], "y int")
    with pytest.raises(Exception, match="64 periods"):
        periods_of(far, F.col("y"), 3).collect()


def test_every_cell_is_in_the_grid(spark):
    points = spark.range(200000).select((F.rand(3) * 180 - 90).alias("lat"), (F.rand(4) * 720 - 360).alias("lon"))
    cells = points.select(expr.cell_id(F.col("lat"), F.col("lon")).alias("c")).distinct().count()
    assert 30000 < cells < expr.grid_cell_bound(3)
    poles = one(spark, expr.cell_id(F.lit(90.0), F.lit(0.0)), expr.cell_id(F.lit(-90.0), F.lit(180.0)))
    assert poles[0] != poles[1]
    assert 40000 < 4 * 180**2 / math.pi < 42000


def test_names(spark):
    got = one(spark, expr.cell_name(F.lit(255).cast("long")), expr.tile_name("density", F.lit(7)))
    assert list(got) == ["ff", "density_07.json"]


def test_death_year_limits(spark):
    got = one(spark, *[expr.death_year(F.lit(b), F.lit(s), F.lit(1995)) for b, s in ((1995, -3), (1999, 10), (2090, 50))])
    assert list(got) == [1995, 2009, 2100]


@pytest.mark.parametrize("source", ["xxhash64", "md5"])
def test_draws_have_the_right_moments(spark, source):
    d = Draws(1, F.col("id"), source=source)
    drawn = spark.range(100000).select(
        d.uniform("a", 0).alias("u"), d.uniform("a", 1).alias("v"), d.standard_normal("n", 0).alias("z"), d.gamma4("g").alias("g"),
        d.wide("w", 1).alias("w"),
    )
    m = drawn.agg(F.avg("u"), F.corr("u", "v"), F.avg("z"), F.stddev("z"), F.avg("g"), F.variance("g"), F.min("u"), F.max("u"), F.avg("w")).first()
    assert m[0] == pytest.approx(0.5, abs=0.01)
    assert m[1] == pytest.approx(0, abs=0.02)
    assert m[2] == pytest.approx(0, abs=0.02)
    assert m[3] == pytest.approx(1, abs=0.02)
    assert m[4] == pytest.approx(4, abs=0.05)
    assert m[5] == pytest.approx(4, abs=0.15)
    assert 0 < m[6] and m[7] < 1
    assert m[8] == pytest.approx(0.5, abs=0.01)


def test_unknown_source_is_refused():
    with pytest.raises(ValueError):
        Draws(1, source="other")


def test_lifespans_follow_the_period(spark):
    d = Draws(5, F.col("id"))
    def stats(period):
        life = spark.range(50000).select(lifespan(F.lit(period), 49, d).alias("y"))
        return life.agg(F.avg((F.col("y") < 8).cast("int")), F.avg(F.when(F.col("y") >= 8, F.col("y"))), F.max("y")).first()

    early, late = stats(0), stats(49)
    assert early[0] == pytest.approx(0.32, abs=0.01)
    assert late[0] == pytest.approx(0.02, abs=0.01)
    assert early[1] == pytest.approx(44.5, abs=0.7)
    assert late[1] == pytest.approx(79.4, abs=0.5)
    assert late[2] <= 100
