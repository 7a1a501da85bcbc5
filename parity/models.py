"""Composite models and generated datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflow.functions.draws import Draws
from geoflow.operators import intervals, lineage, synth
from geoflow.operators.density import by_magnitude, density
from geoflow.plans import job, model
from geoflow.schemas import PERSON
from geoflow.session import cut, fresh_path
from geoflow.sources import facts
from geoflow.sources.dims import Scale
from parity.columns import jitter_sql, lifespan_sql
from parity.registry import case
from parity.relational import corridor_table, factors, pull_matrix
from parity.views import PERIODS, SEED, packed, sql, u, view

# --- population and plans -------------------------------------------------------


def ramp(first: float, last: float) -> str:
    return f"(cast({first} as double) + (cast({last} as double) - cast({first} as double)) * period_idx / cast(6 as double))"


view("v_growth", f"""
    select f.period_idx, f.region_idx, s.start, f.birth_factor, {ramp(0.040, 0.012)} as birth_rate,
           {ramp(0.040, 0.012)} * 1 * f.birth_factor - {ramp(0.035, 0.008)} * 1 * f.mortality_factor as net,
           s.start * {ramp(1.0, 25.0)} as capacity
    from v_factor f join (select region_idx, pop_share / sum(pop_share) over () as start from v_region_pop) s
      on s.region_idx = f.region_idx""", "v_factor", "v_region_pop")
view("v_population", """
    select period_idx, region_idx, start as population from v_growth where period_idx = 0
    union all
    select g.period_idx, g.region_idx,
           greatest(p.population * (1 + g.net * greatest(cast(-0.5 as double), least(cast(1 as double),
               1 - p.population / greatest(g.capacity, cast(1e-9 as double))))), p.population * 0.5)
    from v_population p join v_growth g on g.region_idx = p.region_idx and g.period_idx = p.period_idx + 1""", "v_growth")
view("v_weight", """
    select period_idx, region_idx, w / sum(w) over () as weight from (
      select p.period_idx, p.region_idx,
             (coalesce(lag(population) over (partition by p.region_idx order by p.period_idx), population) + population)
               / cast(2 as double) * g.birth_factor * g.birth_rate as w
      from v_population p join v_growth g on g.period_idx = p.period_idx and g.region_idx = p.region_idx)""", "v_population", "v_growth")
view("v_plan_part", """
    select *, weight / sum(weight) over () * (select count(*) from orders) as part from v_weight""", "v_weight")
view("v_plan", """
    select period_idx, region_idx,
           base + case when row_number() over (order by rest desc, period_idx, region_idx)
                         <= (select count(*) from orders) - sum(base) over () then 1 else 0 end as n
    from (select *, cast(floor(part) as bigint) as base, round(part - floor(part), 9) as rest from v_plan_part)""", "v_plan_part")


def population(v):
    return model.population(v.region_pop(), factors(v), PERIODS)


@case("m1_population", sql("select period_idx, region_idx, round(population, 9) as population from v_population", "v_population"))
def m1(v):
    return population(v).withColumn("population", F.round("population", 9))


def weights(v):
    kept = cut(factors(v))
    return model.birth_weights(model.population(v.region_pop(), kept, PERIODS), kept, PERIODS)


@case("m2_birth_weights", sql("select period_idx, region_idx, round(weight, 9) as weight from v_weight", "v_weight"))
def m2(v):
    return weights(v).select("period_idx", "region_idx", F.round("weight", 9).alias("weight"))


@case("m3_cohort_plan", sql("select period_idx, region_idx, cast(n as bigint) as n from v_plan", "v_plan"))
def m3(v):
    return model.cohort_plan(weights(v), v.table("orders").agg(F.count("*")).scalar())


view("v_mass", """
    select p.period_idx, p.region_idx, p.population, greatest(p.population, cast(1e-9 as double)) as mass,
           sum(p.population) over (partition by p.period_idx) as total, a.intensity
    from v_population p join v_active a on a.period_idx = p.period_idx""", "v_population", "v_active")
view("v_gravity", """
    select s.period_idx, q.src_idx, q.dst_idx, s.mass * d.mass / ((km + 1500) * (km + 1500)) as w,
           s.population / greatest(s.total, cast(1e-12 as double)) as leaving, s.intensity
    from v_pair_all q join v_mass s on s.region_idx = q.src_idx
    join v_mass d on d.region_idx = q.dst_idx and d.period_idx = s.period_idx""", "v_pair_all", "v_mass")
view("v_near", """
    select *, scaled / greatest(sum(scaled) over (partition by period_idx, src_idx), cast(1e-12 as double)) as near
    from (select *, w / sum(w) over (partition by period_idx) as scaled from v_gravity)""", "v_gravity")
view("v_drawn", """
    select *, pull / sum(pull) over (partition by period_idx, src_idx) as drawn from v_pull_matrix""", "v_pull_matrix")
view("v_flow", """
    select n.period_idx, n.src_idx, n.dst_idx, leaving * intensity *
           case when n.period_idx in (select period_idx from v_pull_matrix group by 1 having sum(pull) > 0)
                then cast(0.7 as double) * coalesce(d.drawn, 0) + cast(0.3 as double) * near else near end as w
    from v_near n left join v_drawn d on d.period_idx = n.period_idx and d.src_idx = n.src_idx and d.dst_idx = n.dst_idx""",
    "v_near", "v_drawn", "v_pull_matrix")
view("v_flow_share", "select period_idx, src_idx, dst_idx, w / sum(w) over () as share from v_flow", "v_flow")


def flow_shares(v):
    pop = cut(population(v))
    return model.flow_shares(v.region_pop(), pop, pull_matrix(v), v.event(), PERIODS)


@case("m4_flow_shares", sql("select period_idx, src_idx, dst_idx, round(share, 12) as share from v_flow_share", "v_flow_share"))
def m4(v):
    return flow_shares(v).withColumn("share", F.round("share", 12))


@case("m5_flow_counts", sql("""
    select * from (select period_idx, src_idx, dst_idx, cast(floor(share * (select count(*) from lineitem)) as bigint) as n from v_flow_share)
    where n > 0""", "v_flow_share"))
def m5(v):
    return model.flow_counts(flow_shares(v), v.table("lineitem").agg(F.count("*")).scalar())


@case("m5_flow_counts_exact", """
    select count(*) as total from lineitem""")
def m5_exact(v):
    total = v.table("lineitem").agg(F.count("*")).scalar()
    return model.plan_total(model.flow_counts(flow_shares(v), total, exact=True))


# --- density, corridors ---------------------------------------------------------

@case("m6_density_born", sql("select * from v_density", "v_density"))
def m6(v):
    return by_magnitude(density(v.person(), v.region(), PERIODS), "pop", ["cell"])


view("v_living_cell", """
    select p.at_idx as period_idx, x.cell, r.continent, count(*) as n from v_living p
    join v_person_cell x on x.id = p.id join v_region r on r.region_idx = p.birth_region_idx group by 1, 2, 3""",
    "v_living", "v_person_cell", "v_region")


@case("m6_density_living", sql("""
    select period_idx, cast(period_idx + 1995 as int) as period_year, lower(to_hex(cell)) as cell,
           cast(sum(n) as bigint) as pop, arg_min(continent, {'a': -n, 'b': continent}) as dominant_continent
    from v_living_cell group by period_idx, cell""", "v_living_cell"))
def m6_living(v):
    return density(v.person(), v.region(), PERIODS, mode="living")


@case("m7_corridors", sql("select * from v_corridor", "v_corridor"))
def m7(v):
    return by_magnitude(corridor_table(v), "migrations", ["src_id", "dst_id"])


# --- generated people and moves -------------------------------------------------

view("v_kernel", """
    select * from (select src_idx as region_idx, dst_idx as want, round(exp(-(km * km) / (cast(2 as double) * 800 * 800)), 15) as w from v_pair_all
                   union all select region_idx, region_idx, cast(1 as double) from v_region) where w > 0""", "v_pair_all", "v_region")
view("v_look", """
    select c.period_idx, c.region_idx, c.home, k.want, k.w, a.n as n_want, b.n as n_own
    from (select period_idx, region_idx, greatest(period_idx - o, 0) as home from v_cohort_plan, (select unnest([2, 3]) as o)
          where period_idx >= 2) c
    join v_kernel k on k.region_idx = c.region_idx
    left join v_cohort_plan a on a.period_idx = c.home and a.region_idx = k.want
    left join v_cohort_plan b on b.period_idx = c.home and b.region_idx = c.region_idx""", "v_cohort_plan", "v_kernel")
view("v_period_total", "select period_idx, sum(n) as total from v_cohort_plan group by 1", "v_cohort_plan")
view("v_parent_choice", """
    select period_idx, region_idx, parent_period, parent_region, max(parent_n) as parent_n, sum(w) as w from (
      select period_idx, region_idx, home as parent_period, case when n_want is not null then want else region_idx end as parent_region,
             coalesce(n_want, n_own) as parent_n, w from v_look where coalesce(n_want, n_own) is not null
      union all
      select l.period_idx, l.region_idx, s.period_idx, s.region_idx, s.n, l.w * s.n / t.total
      from (select *, case when home in (select period_idx from v_period_total) then home else greatest(home - 1, 0) end as home2
            from v_look where coalesce(n_want, n_own) is null) l
      join v_cohort_plan s on s.period_idx = l.home2 join v_period_total t on t.period_idx = l.home2)
    group by 1, 2, 3, 4""", "v_look", "v_cohort_plan", "v_period_total")
view("v_parent_run", """
    select *, sum(w) over (partition by period_idx, region_idx order by parent_period, parent_region) as run from v_parent_choice""", "v_parent_choice")
view("v_parent_hi", """
    select *, run / max(run) over (partition by period_idx, region_idx) as hi from v_parent_run""", "v_parent_run")
view("v_parent_table", """
    select *, coalesce(lag(hi) over (partition by period_idx, region_idx order by parent_period, parent_region), 0) as lo from v_parent_hi""", "v_parent_hi")
KEYS = ("e.period_idx", "e.region_idx", "e.i")


def parent_sql(number: int) -> str:
    index = f"cast(floor({u(f'parent{number}', *KEYS, part=1, digits=13)} * parent_n) as bigint)"
    return f"""
        select e.period_idx, e.region_idx, e.i, coalesce({packed('t.parent_period', 't.parent_region', index)}, -1) as parent_id
        from v_expanded e left join v_parent_table t on t.period_idx = e.period_idx and t.region_idx = e.region_idx
         and t.lo < {u(f'parent{number}', *KEYS, digits=13)} and {u(f'parent{number}', *KEYS, digits=13)} <= t.hi"""


for _n in (1, 2):
    view(f"v_parent{_n}", parent_sql(_n), "v_expanded", "v_parent_table")


@case("g7_assign_parents", sql("""
    select a.period_idx, a.region_idx, a.i, a.parent_id as parent1_id, b.parent_id as parent2_id
    from v_parent1 a join v_parent2 b on b.period_idx = a.period_idx and b.region_idx = a.region_idx and b.i = a.i""", "v_parent1", "v_parent2"))
def g7(v):
    plan = cut(v.cohort_plan())
    rows = synth.expand(plan, ["period_idx", "region_idx"]).drop("n")
    draws = Draws(SEED, F.col("period_idx"), F.col("region_idx"), F.col("i"), source="md5")
    return synth.assign_parents(rows, plan, v.region(), draws)


_LAT, _LON = jitter_sql("r.lat", "r.lon", "r.radius_deg", 0.5, "place", *KEYS)
view("v_people", f"""
    select {packed('e.period_idx', 'e.region_idx', 'e.i')} as id, cast(1995 + e.period_idx + floor({u('year', *KEYS)} * 1) as int) as birth_year,
           greatest(1995 + e.period_idx, least(2100, cast(1995 + e.period_idx + floor({u('year', *KEYS)} * 1) as int)
             + {lifespan_sql('e.period_idx', 6, *KEYS)})) as death_year,
           e.region_idx as birth_region_idx, cast({_LAT} as float) as birth_lat, cast({_LON} as float) as birth_lon,
           cast(floor({u('year', *KEYS, part=1)} * 2) as int) as sex, a.parent_id as parent1_id, b.parent_id as parent2_id,
           r.continent as birth_continent, e.period_idx
    from v_expanded e join v_region r on r.region_idx = e.region_idx
    join v_parent1 a on a.period_idx = e.period_idx and a.region_idx = e.region_idx and a.i = e.i
    join v_parent2 b on b.period_idx = e.period_idx and b.region_idx = e.region_idx and b.i = e.i""",
    "v_expanded", "v_region", "v_parent1", "v_parent2")
# Adding zero turns -0.0 into 0.0, which the two engines print apart.
COARSE = "round(cast({0} as double), 3) + cast(0 as double) as {0}"


def people(v, source="md5"):
    return synth.people(cut(v.cohort_plan()), v.region(), PERIODS, SEED, source)


def coarse(name):
    return (F.round(F.col(name).cast("double"), 3) + F.lit(0.0)).alias(name)


@case("g6_people", sql(f"""
    select id, birth_year, death_year, birth_region_idx, {COARSE.format('birth_lat')}, {COARSE.format('birth_lon')}, sex,
           parent1_id, parent2_id, birth_continent, period_idx from v_people""", "v_people"))
def g6(v):
    return people(v).select(
        "id", F.col("birth_year").cast("int"), F.col("death_year").cast("int"), F.col("birth_region_idx").cast("int"),
        coarse("birth_lat"), coarse("birth_lon"), F.col("sex").cast("int"), "parent1_id", "parent2_id", "birth_continent", "period_idx",
    )


@case("g6_people_default_draws", sql("""
    select period_idx, birth_region_idx, count(*) as n, cast(0 as bigint) as orphans from v_person group by 1, 2""", "v_person"))
def g6_default(v):
    """The default draws: cohort sizes as planned, and no parent that does not exist."""
    kept = cut(people(v, "xxhash64"))
    lost = lineage.orphans(kept, kept, "parent1_id").unionByName(lineage.orphans(kept, kept, "parent2_id"))
    counted = kept.groupBy("period_idx", F.col("birth_region_idx").cast("int").alias("birth_region_idx")).agg(F.count("*").alias("n"))
    return counted.withColumn("orphans", lost.agg(F.count("*")).scalar())


view("v_mover_run", """
    select c.period_idx, c.src_idx, c.at, p.n as mover_n, sum(c.w) over w as run, sum(c.w) over (partition by c.period_idx, c.src_idx) as total, c.w
    from (select period_idx, src_idx, greatest(period_idx - o, 0) as at, count(*) as w
          from (select distinct period_idx, src_idx from v_flow_plan), (select unnest([1, 2, 3]) as o) group by 1, 2, 3) c
    join v_cohort_plan p on p.period_idx = c.at and p.region_idx = c.src_idx
    window w as (partition by c.period_idx, c.src_idx order by c.at)""", "v_flow_plan", "v_cohort_plan")
view("v_cause", """
    select id as cause_label, cast(row_number() over (order by start_year, id) as int) as cause_id from v_event
    union all select 'baseline', 0""", "v_event")
MOVE_KEYS = ("f.period_idx", "f.src_idx", "f.dst_idx", "f.i")
_FLAT, _FLON = jitter_sql("s.lat", "s.lon", "s.radius_deg", 0.4, "from", *MOVE_KEYS)
_TLAT, _TLON = jitter_sql("d.lat", "d.lon", "d.radius_deg", 0.4, "to", *MOVE_KEYS)
_MOVER = packed("m.at", "f.src_idx", f"cast(floor({u('mover', *MOVE_KEYS, part=1, digits=13)} * m.mover_n) as bigint)")
view("v_move_row", "select period_idx, src_idx, dst_idx, unnest(range(n)) as i from v_flow_plan", "v_flow_plan")
view("v_moves", f"""
    select coalesce({_MOVER}, -1) as person_id, y.year, f.src_idx as from_region_idx, f.dst_idx as to_region_idx,
           cast({_FLAT} as float) as from_lat, cast({_FLON} as float) as from_lon,
           cast({_TLAT} as float) as to_lat, cast({_TLON} as float) as to_lon,
           coalesce(c.cause_id, 0) as cause_id, coalesce(l.cause_label, 'baseline') as cause_label, f.period_idx
    from v_move_row f join v_region s on s.region_idx = f.src_idx join v_region d on d.region_idx = f.dst_idx
    join v_period_year y on y.period_idx = f.period_idx
    left join v_mover_run m on m.period_idx = f.period_idx and m.src_idx = f.src_idx
     and cast(m.run - m.w as double) / m.total < {u('mover', *MOVE_KEYS, digits=13)}
     and {u('mover', *MOVE_KEYS, digits=13)} <= cast(m.run as double) / m.total
    left join v_label_year l on l.src_idx = f.src_idx and l.dst_idx = f.dst_idx and l.year = y.year
    left join v_cause c on c.cause_label = l.cause_label""",
    "v_move_row", "v_region", "v_period_year", "v_mover_run", "v_label_year", "v_cause")
view("v_period_year", "select period_idx, period_year as year from v_period", "v_period")


@case("g8_moves", sql(f"""
    select person_id, year, from_region_idx, to_region_idx, {COARSE.format('from_lat')}, {COARSE.format('from_lon')},
           {COARSE.format('to_lat')}, {COARSE.format('to_lon')}, cause_id, cause_label, period_idx from v_moves""", "v_moves"))
def g8(v):
    pulls = intervals.resolve_pulls(v.event_pull(), v.region())
    made = synth.moves(cut(v.flow_plan()), cut(v.cohort_plan()), v.region(), v.event(), pulls, PERIODS, SEED, "md5")
    return made.select(
        "person_id", F.col("year").cast("int"), F.col("from_region_idx").cast("int"), F.col("to_region_idx").cast("int"),
        coarse("from_lat"), coarse("from_lon"), coarse("to_lat"), coarse("to_lon"), "cause_id", "cause_label", "period_idx",
    )


view("v_people_seed", """
    select cast(row_number() over (order by md5(cast(id as varchar)), id) - 1 as int) as lineage_id, *
    from (select * from v_people where period_idx >= 5 order by md5(cast(id as varchar)), id limit 50)""", "v_people")
view("v_people_walk(lineage_id, depth, id, parent1_id, year, region_idx, lat, lon)", """
    select lineage_id, 0, id, parent1_id, birth_year, birth_region_idx, birth_lat, birth_lon from v_people_seed
    union all
    select w.lineage_id, w.depth + 1, p.id, p.parent1_id, p.birth_year, p.birth_region_idx, p.birth_lat, p.birth_lon
    from v_people_walk w join v_people p on p.id = w.parent1_id where w.depth < 13 and w.parent1_id <> -1""", "v_people_seed", "v_people")
PEOPLE_WALK = "v_people_walk(lineage_id, depth, id, parent1_id, year, region_idx, lat, lon)"


@case("m8_lineages", sql("""
    select w.lineage_id, w.depth, w.id as person_id, w.year, w.region_idx, r.region_id, r.name as region_name, r.continent,
           round(cast(w.lat as double), 3) + cast(0 as double) as lat, round(cast(w.lon as double), 3) + cast(0 as double) as lon
    from v_people_walk w join v_region r on r.region_idx = w.region_idx""", PEOPLE_WALK, "v_region"))
def m8(v):
    path = fresh_path(v.spark, "people")
    facts.write_facts(people(v), path)
    table = facts.read_facts(v.spark, path, PERSON)
    walked = lineage.lineages(table, v.region(), first_period=5)
    return walked.withColumn("lat", coarse("lat")).withColumn("lon", coarse("lon"))


# --- the whole run --------------------------------------------------------------

view("v_size", "select greatest(30 * count(*), 50000) as people, greatest(20 * count(*), 30000) as moves from customer")


@case("m9_run", sql("""
    select 'people' as name, people as rows from v_size
    union all select 'density', people from v_size
    union all select 'moves', (select cast(sum(cast(floor(share * (select moves from v_size)) as bigint)) as bigint) from v_flow_share)""", "v_size", "v_flow_share"))
def m9(v):
    """Generate, aggregate and export, then count what the tables hold."""
    out = fresh_path(v.spark, "run")
    given = job.Inputs(v.region_pop(), v.catalog(), PERIODS)
    customers = v.table("customer").count()
    job.run(v.spark, given, out, Scale("customers", customers, 8))
    def rows(name, what):
        return v.spark.read.parquet(f"{out}/{name}").agg(what.cast("long").alias("rows")).select(F.lit(name).alias("name"), "rows")

    return rows("people", F.count("*")).unionByName(rows("density", F.sum("pop"))).unionByName(rows("moves", F.count("*")))
