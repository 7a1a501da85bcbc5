"""Scalar expressions and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflow.functions import expr
from geoflow.functions.draws import Draws, jitter, lifespan
from geoflow.functions.periods import Periods
from geoflow.operators.blend import with_density_ratio, with_direction
from geoflow.operators.density import density
from geoflow.operators.shares import row_share
from geoflow.operators.synth import choose, draw_table, expand, generate_groups
from geoflow.sources.dims import run_size
from parity.registry import case
from parity.views import PERIODS, SEED, cell, haversine, normal, packed, sql, u, view, wrap

WIDE = Periods(1995, 2001, 2)

PRIORITY_COUNTS = """
    select c_nationkey as region_idx, o_orderpriority as label, cast(count(*) as double) as n
    from orders join customer on c_custkey = o_custkey group by 1, 2"""
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

ID_PARTS = "l_orderkey, l_linenumber, cast(l_linenumber * 8 % 63 as int) as p, cast(l_suppkey % 64 as int) as r"

view("v_id_parts", f"select {ID_PARTS} from lineitem")


def id_parts(v):
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") * 8 % 63).alias("p"),
        (F.col("l_suppkey") % 64).cast("int").alias("r"),
    )


@case("f1_pack_id", sql(f"select l_orderkey, l_linenumber, {packed('p', 'r', 'l_orderkey')} as id from v_id_parts", "v_id_parts"))
def f1(v):
    packed_id = expr.pack_id(F.col("p"), F.col("r"), F.col("l_orderkey"))
    return id_parts(v).select("l_orderkey", "l_linenumber", packed_id.alias("id"))


@case("f2_unpack_id", sql('select l_orderkey, l_linenumber, p as period, r as region, l_orderkey as "index" from v_id_parts', "v_id_parts"))
def f2(v):
    ids = f1(v).withColumn("part", expr.unpack_id(F.col("id")))
    return ids.select("l_orderkey", "l_linenumber", "part.period", "part.region", "part.index")


@case("f3_haversine_km", sql(f"""
    select id, round({haversine('birth_lat', 'birth_lon', 'lat', 'lon')}, 5) as km
    from v_person join v_region on region_idx = birth_region_idx""", "v_person", "v_region"))
def f3(v):
    near = v.person().join(v.region(), F.col("region_idx") == F.col("birth_region_idx"))
    km = expr.haversine_km(F.col("birth_lat"), F.col("birth_lon"), F.col("lat"), F.col("lon"))
    return near.select("id", F.round(km, 5).alias("km"))


@case("f4_wrap_clamp", sql(f"""
    select id, round({wrap('birth_lon * 3 + 500')}, 6) as lon,
           round(greatest(cast(-85 as double), least(cast(85 as double), birth_lat * 2)), 6) as lat from v_person""", "v_person"))
def f4(v):
    return v.person().select(
        "id", F.round(expr.wrap_lon(F.col("birth_lon") * 3 + 500), 6).alias("lon"),
        F.round(expr.clamp_lat(F.col("birth_lat") * 2), 6).alias("lat"),
    )


def jitter_sql(lat: str, lon: str, radius: str, scale: float, salt: str, *keys: str) -> tuple[str, str]:
    sigma = f"({radius} * cast({scale} as double))"
    new_lat = f"greatest(cast(-85 as double), least(cast(85 as double), {lat} + {sigma} * {normal(salt, *keys)}))"
    noise = f"{lon} + {sigma} * {normal(salt, *keys, part=2)} / greatest(cos(radians({lat})), cast(0.2 as double))"
    return new_lat, wrap(noise)


_LAT, _LON = jitter_sql("lat", "lon", "radius_deg", 0.5, "place", "id")


@case("f5_jitter", sql(f"""
    select id, round({_LAT}, 6) as lat, round({_LON}, 6) as lon
    from v_person join v_region on region_idx = birth_region_idx""", "v_person", "v_region"))
def f5(v):
    near = v.person().join(v.region(), F.col("region_idx") == F.col("birth_region_idx"))
    lat, lon = jitter(F.col("lat"), F.col("lon"), F.col("radius_deg"), 0.5, Draws(SEED, F.col("id"), source="md5"), "place")
    return near.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def priority_arrays(v):
    labels = v.table("orders").join(v.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    counts = [F.count(F.when(F.col("o_orderpriority") == p, 1)).cast("double").alias(f"n{i}") for i, p in enumerate(PRIORITIES)]
    return labels.groupBy(F.col("c_nationkey").alias("region_idx")).agg(*counts).select(
        "region_idx", F.array(*[f"n{i}" for i in range(len(PRIORITIES))]).alias("counts")
    )


@case("f6_normalise", f"""
    with t as ({PRIORITY_COUNTS}), s as (select region_idx, sum(n) as total from t group by 1),
         k as (select unnest([{', '.join(f"'{p}'" for p in PRIORITIES)}]) as label)
    select s.region_idx, k.label, round(coalesce(t.n, 0) / s.total, 9) as share
    from s cross join k left join t on t.region_idx = s.region_idx and t.label = k.label""")
def f6(v):
    shares = expr.normalise(F.col("counts"))
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    pairs = F.explode(F.arrays_zip(names.alias("label"), shares.alias("share")))
    return priority_arrays(v).select("region_idx", pairs.alias("p")).select(
        "region_idx", "p.label", F.round("p.share", 9).alias("share")
    )


@case("f7_argmax_label", f"""
    with t as ({PRIORITY_COUNTS})
    select region_idx, arg_min(label, {{'a': -n, 'b': label}}) as label from t group by 1""")
def f7(v):
    return priority_arrays(v).select("region_idx", expr.argmax_label(F.col("counts"), PRIORITIES).alias("label"))


SHIPPED = "(cast(year(l_shipdate) as double) + (cast(dayofyear(l_shipdate) as double) - 1) / cast(365 as double))"
INDEX = f"greatest(0, least(2, cast(floor(({SHIPPED} - 1995) / cast(2 as double)) as int)))"


def shipped(v):
    at = F.year("l_shipdate").cast("double") + (F.dayofyear("l_shipdate").cast("double") - 1) / F.lit(365.0)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", at.alias("year"))


@case("f8_period_index", f"select l_orderkey, l_linenumber, {INDEX} as period_idx from lineitem")
def f8(v):
    return shipped(v).select("l_orderkey", "l_linenumber", WIDE.index(F.col("year")).alias("period_idx"))


@case("f9_period_progress", f"""
    select l_orderkey, l_linenumber,
           round(greatest(cast(0 as double), least(cast(1 as double), ({SHIPPED} - (1995 + {INDEX} * 2)) / cast(2 as double))), 9) as progress
    from lineitem""")
def f9(v):
    return shipped(v).select("l_orderkey", "l_linenumber", F.round(WIDE.progress(F.col("year")), 9).alias("progress"))


@case("f10_clip", """
    select o_orderkey, greatest(cast(1000 as double), least(cast(200000 as double), o_totalprice)) as price from orders""")
def f10(v):
    return v.table("orders").select("o_orderkey", expr.clip(F.col("o_totalprice"), 1000.0, 200000.0).alias("price"))


@case("f11_linear_schedule", sql("""
    select id, round(cast(0.04 as double) + (cast(0.012 as double) - cast(0.04 as double)) * period_idx / cast(6 as double), 9) as rate
    from v_person""", "v_person"))
def f11(v):
    rate = expr.linear_schedule(0.04, 0.012, PERIODS.count, F.col("period_idx"))
    return v.person().select("id", F.round(rate, 9).alias("rate"))


view("v_pair", f"""
    select m.src_idx, m.dst_idx, m.n, {haversine('s.lat', 's.lon', 'd.lat', 'd.lon')} as km
    from (select from_region_idx as src_idx, to_region_idx as dst_idx, count(*) as n from v_move group by 1, 2) m
    join v_region s on s.region_idx = m.src_idx join v_region d on d.region_idx = m.dst_idx""", "v_move", "v_region")


def pairs(v):
    """Corridors of all moves with distance and count."""
    counted = v.move().groupBy(F.col("from_region_idx").alias("src_idx"), F.col("to_region_idx").alias("dst_idx")).agg(
        F.count("*").alias("n")
    )
    def end(side):
        return v.region().select(F.col("region_idx").alias(f"{side}_idx"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))

    km = expr.haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return counted.join(end("src"), "src_idx").join(end("dst"), "dst_idx").withColumn("km", km)


@case("f12_gaussian_kernel", sql("""
    select src_idx, dst_idx, round(w / sum(w) over (partition by src_idx), 9) as share
    from (select src_idx, dst_idx, exp(-(km * km) / (cast(2 as double) * 800 * 800)) as w from v_pair)""", "v_pair"))
def f12(v):
    weighted = pairs(v).withColumn("w", expr.gaussian_kernel(F.col("km")))
    return row_share(weighted, "w", ["src_idx"]).select("src_idx", "dst_idx", F.round("share", 9).alias("share"))


view("v_pair_all", f"""
    select a.region_idx as src_idx, b.region_idx as dst_idx, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km
    from v_region a join v_region b on a.region_idx <> b.region_idx""", "v_region")
view("v_pair_mass", "select src_idx as i, cast(sum(n) as double) as m from v_pair group by 1", "v_pair")


@case("f13_gravity", sql("""
    select src_idx, dst_idx, round(a.m * b.m / ((km + 1500) * (km + 1500)), 6) as w
    from v_pair join v_pair_mass a on a.i = src_idx join v_pair_mass b on b.i = dst_idx""", "v_pair_mass"))
def f13(v):
    p = pairs(v)
    mass = p.groupBy(F.col("src_idx").alias("i")).agg(F.sum("n").cast("double").alias("m"))
    a = mass.select(F.col("i").alias("src_idx"), F.col("m").alias("ma"))
    b = mass.select(F.col("i").alias("dst_idx"), F.col("m").alias("mb"))
    w = expr.gravity(F.col("ma"), F.col("mb"), F.col("km"))
    return p.join(a, "src_idx").join(b, "dst_idx").select("src_idx", "dst_idx", F.round(w, 6).alias("w"))


@case("f14_direction_score", sql("""
    select src_idx, dst_idx, round((tanh((d.lon - s.lon) / cast(90 as double)) + 1) / cast(2 as double), 9) as direction
    from v_pair join v_region s on s.region_idx = src_idx join v_region d on d.region_idx = dst_idx""", "v_pair", "v_region"))
def f14(v):
    return with_direction(pairs(v)).select("src_idx", "dst_idx", F.round("direction", 9).alias("direction"))


view("v_cell_count", f"""
    select period_idx, {cell('birth_lat', 'birth_lon')} as cell, continent, count(*) as n
    from v_person join v_region on region_idx = birth_region_idx
    where period_idx between 0 and 6 group by 1, 2, 3""", "v_person", "v_region")
view("v_density", """
    select period_idx, cast(period_idx + 1995 as int) as period_year, lower(to_hex(cell)) as cell,
           cast(sum(n) as bigint) as pop, arg_min(continent, {'a': -n, 'b': continent}) as dominant_continent
    from v_cell_count group by period_idx, cell""", "v_cell_count")


@case("f15_density_ratio", sql("""
    select period_idx, cell, round(sqrt(least(cast(1 as double), pop / greatest(cast((select max(pop) from v_density) as double), 1))), 9) as ratio
    from v_density""", "v_density"))
def f15(v):
    table = density(v.person(), v.region(), PERIODS)
    return with_density_ratio(table.withColumn("pop", F.col("pop").cast("double"))).select(
        "period_idx", "cell", F.round("ratio", 9).alias("ratio")
    )


@case("f16_cell_id", sql(f"select id, {cell('birth_lat', 'birth_lon')} as cell from v_person", "v_person"))
def f16(v):
    return v.person().select("id", expr.cell_id(F.col("birth_lat"), F.col("birth_lon")).alias("cell"))


@case("f17_cell_name", sql(f"select id, lower(to_hex({cell('birth_lat', 'birth_lon')})) as cell from v_person", "v_person"))
def f17(v):
    return f16(v).select("id", expr.cell_name(F.col("cell")).alias("cell"))


@case("f18_tile_name", sql("select period_idx, 'density_' || lpad(cast(period_idx as varchar), 2, '0') || '.json' as tile, count(*) as n from v_person group by 1", "v_person"))
def f18(v):
    counted = v.person().groupBy("period_idx").agg(F.count("*").alias("n"))
    return counted.withColumn("tile", expr.tile_name("density", F.col("period_idx")))


@case("f19_death_year", sql(f"""
    select id, greatest(birth_year, least(2100, cast(birth_year + floor({u('span', 'id')} * 200) as int) - 20)) as death_year from v_person""", "v_person"))
def f19(v):
    span = F.floor(Draws(SEED, F.col("id"), source="md5").uniform("span", 0) * 200) - 20
    first = PERIODS.first_year(F.col("period_idx"))
    return v.person().select("id", expr.death_year(F.col("birth_year"), span, first).alias("death_year"))


@case("f20_year_in_period", sql(f"select id, cast(1995 + period_idx * 10 + floor({u('year', 'id')} * 10) as int) as year from v_person", "v_person"))
def f20(v):
    draw = Draws(SEED, F.col("id"), source="md5").uniform("year", 0)
    return v.person().select("id", expr.year_in_period(F.lit(1995) + F.col("period_idx") * 10, draw, 10).alias("year"))


# --- draws and expansion --------------------------------------------------------

view("v_expanded", """
    select period_idx, region_idx, unnest(range(n)) as i from v_cohort_plan""", "v_cohort_plan")


@case("g1_expand", sql("select period_idx, region_idx, i from v_expanded", "v_expanded"))
def g1(v):
    return expand(v.cohort_plan(), ["period_idx", "region_idx"], chunk_rows=50).select("period_idx", "region_idx", "i")


@case("g2_uniform", sql(f"""
    select l_orderkey, l_linenumber, {u('x', 'l_orderkey', 'l_linenumber')} as a, {u('x', 'l_orderkey', 'l_linenumber', part=3)} as b,
           {u('x', 'l_orderkey', 'l_linenumber', part=1, digits=13)} as w from lineitem"""))
def g2(v):
    draws = Draws(SEED, F.col("l_orderkey"), F.col("l_linenumber"), source="md5")
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", draws.uniform("x", 0).alias("a"), draws.uniform("x", 3).alias("b"), draws.wide("x", 1).alias("w")
    )


@case("g2_uniform_default", """
    select cast(0.5 as double) as mean, cast(0.08 as double) as variance, cast(0 as double) as correlation""")
def g2_default(v):
    """The default source, which no other engine recomputes: the moments of all rows' draws are known."""
    draws = Draws(SEED, F.col("l_orderkey"), F.col("l_linenumber"))
    drawn = v.table("lineitem").select(draws.uniform("x", 0).alias("a"), draws.uniform("x", 1).alias("b"))
    return drawn.agg(
        F.round(F.avg("a"), 1).alias("mean"), F.round(F.var_pop("a"), 2).alias("variance"), F.round(F.abs(F.corr("a", "b")), 1).alias("correlation")
    )


@case("g3_normal", sql(f"select o_orderkey, round(10 + cast(2.5 as double) * {normal('z', 'o_orderkey')}, 6) as x from orders"))
def g3(v):
    draws = Draws(SEED, F.col("o_orderkey"), source="md5")
    return v.table("orders").select("o_orderkey", F.round(draws.normal(F.lit(10.0), F.lit(2.5), "z", 0), 6).alias("x"))


view("v_running", """
    select period_idx, region_idx, sum(n) over (partition by period_idx order by region_idx) as run,
           sum(n) over (partition by period_idx) as total, n from v_cohort_plan""", "v_cohort_plan")


@case("g4_choice", sql(f"""
    select p.id, t.region_idx as choice from (select *, {u('pick', 'id', digits=13)} as w from v_person) p
    join v_running t on t.period_idx = p.period_idx
     and cast(run - n as double) / total < p.w and p.w <= cast(run as double) / total""", "v_running", "v_person"))
def g4(v):
    weights = v.cohort_plan().select("period_idx", F.col("region_idx").alias("choice"), F.col("n").cast("double").alias("w"))
    table = draw_table(weights, ["period_idx"], "w", ["choice"])
    draws = Draws(SEED, F.col("id"), source="md5")
    return choose(v.person(), table, ["period_idx"], draws.wide("pick", 0)).select("id", "choice")


def lifespan_sql(period: str, last: int, *keys: str) -> str:
    x = f"({period} / cast({last} as double))"
    adult = (f"cast(trunc(greatest(cast(10 as double), least(cast(100 as double), (45 + 35 * {x}) + (12 - 4 * {x}) * {normal('life', *keys, part=2)}))) as int)")
    return (f"case when {u('life', *keys)} < cast(0.3 as double) * (1 - {x}) + cast(0.02 as double) "
            f"then cast(floor({u('life', *keys, part=1)} * 8) as int) else {adult} end")


@case("g5_lifespan", sql(f"select id, {lifespan_sql('period_idx', 6, 'id')} as span from v_person", "v_person"))
def g5(v):
    span = lifespan(F.col("period_idx"), PERIODS.last, Draws(SEED, F.col("id"), source="md5"))
    return v.person().select("id", span.alias("span"))


@case("g9_targets", """
    select count(*) as initial, greatest(30 * count(*), 50000) as people, greatest(20 * count(*), 30000) as moves from customer""")
def g9(v):
    return run_size(v.table("customer").agg(F.count("*").alias("initial")))


def _ids(*args):
    import pandas as pd

    *keys, first, size = args
    return pd.DataFrame({**{f"k{n}": [int(k)] * size for n, k in enumerate(keys)}, "i": range(first, first + size)})


@case("x1_grouped_map_cohorts", sql("select period_idx as k0, region_idx as k1, i from v_expanded", "v_expanded"))
def x1(v):
    return generate_groups(v.cohort_plan(), ["period_idx", "region_idx"], _ids, "k0 int, k1 int, i long", chunk_rows=50)


@case("x2_grouped_map_flows", sql("select period_idx as k0, src_idx as k1, dst_idx as k2, unnest(range(n)) as i from v_flow_plan", "v_flow_plan"))
def x2(v):
    return generate_groups(v.flow_plan(), ["period_idx", "src_idx", "dst_idx"], _ids, "k0 int, k1 int, k2 int, i long")
