"""The driver's tables seen as people, moves, regions and dated events.

Each view exists twice: as a DataFrame for the library and as SQL text for the check.
All read whole tables. The event catalogue is grouped from all events into at most
74 entries, so it stays a catalogue however many rows the table has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions.draws import Draws
from geoflow.functions.periods import Periods
from geoflow.session import cut
from geoflow.sources.catalog import Catalog

SEED = 7
PERIODS = Periods(1995, 2002, 1)
YEARS = 7


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def region(self) -> DataFrame:
        named = self.table("nation").join(self.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        idx = F.col("n_nationkey")
        return named.select(
            idx.alias("region_idx"), F.lower("n_name").alias("region_id"), F.col("n_name").alias("name"),
            F.col("r_name").alias("continent"), centre_lat(idx).alias("lat"), centre_lon(idx).alias("lon"),
            (F.lit(2) + idx % 3).cast("double").alias("radius_deg"),
        )

    @cached_property
    def _region_pop(self) -> DataFrame:
        people = self.table("customer").groupBy(F.col("c_nationkey").alias("region_idx")).agg(
            F.count("*").cast("double").alias("n")
        )
        return cut(
            self.region().join(people, "region_idx", "left").withColumn("pop_share", F.coalesce("n", F.lit(0.0))).drop("n")
        )

    def region_pop(self) -> DataFrame:
        """Regions with the number of customers as their initial share; counted once."""
        return self._region_pop

    def person(self) -> DataFrame:
        draws = Draws(SEED, F.col("o_orderkey"), source="md5")
        born = F.year("o_orderdate")
        shift = F.lit(8.0)
        return self.table("orders").join(self.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
            F.col("o_orderkey").alias("id"),
            (born - 1995).cast("int").alias("period_idx"),
            born.cast("int").alias("birth_year"),
            (born + F.floor(draws.uniform("span", 0) * 6)).cast("int").alias("death_year"),
            F.col("c_nationkey").alias("birth_region_idx"),
            (centre_lat(F.col("c_nationkey")) + (draws.uniform("spot", 0) - 0.5) * shift).alias("birth_lat"),
            (centre_lon(F.col("c_nationkey")) + (draws.uniform("spot", 1) - 0.5) * shift).alias("birth_lon"),
        )

    def move(self) -> DataFrame:
        shipped = F.year("l_shipdate")
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(self.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
            .join(self.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
            .where(F.col("s_nationkey") != F.col("c_nationkey"))
            .select(
                F.col("l_orderkey").alias("person_id"), F.col("l_linenumber").alias("seq"),
                shipped.cast("int").alias("year"), (shipped - 1995).cast("int").alias("period_idx"),
                F.col("s_nationkey").alias("from_region_idx"), F.col("c_nationkey").alias("to_region_idx"),
                F.col("o_orderpriority").alias("cause_label"),
            )
        )

    @cached_property
    def _event_groups(self) -> DataFrame:
        k = (F.col("user_id") % 74).cast("int").alias("k")
        return cut(
            self.table("events").groupBy(k, "event_type").agg(
                F.count("*").alias("n"), F.sum(F.col("event_id") % 1009).alias("s")
            )
        )

    def event_groups(self) -> DataFrame:
        """What the catalogue is made of; the events are read once."""
        return self._event_groups

    def event(self) -> DataFrame:
        grouped = self.event_groups().groupBy("k").agg(F.sum("n").alias("n"), F.min("event_type").alias("type"))
        k = F.col("k")
        start = F.lit(1995) + k % 6
        return grouped.select(
            event_id(k).alias("id"), F.concat(F.lit("Event "), k.cast("string")).alias("name"),
            start.cast("int").alias("start_year"), (start + F.col("n") % 3).cast("int").alias("end_year"), "type",
            (F.lit(0.8) + k % 30 * F.lit(0.1)).alias("mortality"), (F.lit(1.1) - k % 10 * F.lit(0.05)).alias("birth"),
        )

    def event_region(self) -> DataFrame:
        return self.event_groups().select(event_id(F.col("k")).alias("id"), place(F.col("s") % 27).alias("region_id")).distinct()

    def event_pull(self) -> DataFrame:
        s = F.col("s")
        return self.event_groups().groupBy(
            event_id(F.col("k")).alias("id"), place(s % 27).alias("src_id"), place((s * 7 + 3) % 27).alias("dst_id")
        ).agg((F.max(F.lit(5) + s % 89) / F.lit(100.0)).alias("weight"))

    def catalog(self) -> Catalog:
        return Catalog(self.event(), self.event_region(), self.event_pull())

    def link(self) -> DataFrame:
        """Events naming an earlier event; some name one that does not exist."""
        before = F.col("event_id") - 1 - F.col("user_id") % 50
        parent = F.when(F.col("user_id") % 10 == 3, F.col("event_id") + 1_000_000_000_000).otherwise(
            F.greatest(before, F.lit(-1))
        )
        return self.table("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") % 25).cast("int").alias("region_idx"),
            F.year("ts").cast("int").alias("birth_year"), parent.alias("parent1_id"),
        )

    def cohort_plan(self) -> DataFrame:
        return self.person().groupBy("period_idx", F.col("birth_region_idx").alias("region_idx")).agg(F.count("*").alias("n"))

    def flow_plan(self) -> DataFrame:
        kept = self.move().where(F.col("period_idx").between(0, YEARS - 1))
        return kept.groupBy("period_idx", F.col("from_region_idx").alias("src_idx"), F.col("to_region_idx").alias("dst_idx")).agg(
            F.count("*").alias("n")
        )


def centre_lat(idx: Column) -> Column:
    return F.lit(-60.0) + idx * F.lit(4.7)


def centre_lon(idx: Column) -> Column:
    return F.lit(-170.0) + idx * F.lit(13.3)


def event_id(k: Column) -> Column:
    return F.concat(F.lit("ev"), k.cast("string"))


def place(number: Column) -> Column:
    return F.concat(F.lit("nation_"), number.cast("string"))


# --- SQL ------------------------------------------------------------------------

def u(salt: str, *keys: str, part: int = 0, digits: int = 8, seed: int = SEED) -> str:
    """A draw of ``Draws(seed, *keys, source="md5")`` as SQL."""
    text = "concat_ws(':', " + ", ".join([f"'{seed}'", f"'{salt}'", *[f"cast({k} as varchar)" for k in keys]]) + ")"
    cut_out = f"substr(md5({text}), {1 + part * digits}, {digits})"
    return f"((cast('0x' || {cut_out} as bigint) + cast(0.5 as double)) / cast({16**digits} as double))"


def normal(salt: str, *keys: str, part: int = 0) -> str:
    a, b = u(salt, *keys, part=part), u(salt, *keys, part=part + 1)
    return f"(sqrt(cast(-2 as double) * ln({a})) * cos(2 * pi() * {b}))"


def wrap(lon: str) -> str:
    turned = f"(({lon}) + cast(180 as double)) % cast(360 as double)"
    return f"(case when {turned} < 0 then ({turned} + 360) % cast(360 as double) else {turned} end - 180)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    o = f"sin(radians(({lon2}) - ({lon1})) / 2)"
    return (f"cast(12742.0176 as double) * asin(sqrt({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {o} * {o}))")


def cell(lat: str, lon: str) -> str:
    row = f"least(greatest(cast(floor(({lat}) + 90) as int), 0), 179)"
    columns = f"greatest(1, cast(round(360 * cos(radians(({row} + cast(0.5 as double)) - 90))) as int))"
    column = f"greatest(0, least({columns} - 1, cast(floor(({wrap(lon)} + 180) / cast(360 as double) * {columns}) as int)))"
    return f"(cast({3 << 48} as bigint) + cast({row} as bigint) * {1 << 24} + {column})"


def packed(p: str, r: str, i: str) -> str:
    return (f"(cast(case when {p} >= 32 then {p} - 64 else {p} end as bigint) * 288230376151711744"
            f" + cast({r} as bigint) * 4503599627370496 + {i})")


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_region": ((), """
        select n_nationkey as region_idx, lower(n_name) as region_id, n_name as name, r_name as continent,
               cast(-60 as double) + n_nationkey * cast(4.7 as double) as lat,
               cast(-170 as double) + n_nationkey * cast(13.3 as double) as lon,
               cast(2 + n_nationkey % 3 as double) as radius_deg
        from nation join region on r_regionkey = n_regionkey"""),
    "v_region_pop": (("v_region",), """
        select r.*, coalesce(c.n, cast(0 as double)) as pop_share from v_region r
        left join (select c_nationkey, cast(count(*) as double) as n from customer group by 1) c
          on c.c_nationkey = r.region_idx"""),
    "v_period": ((), """
        select cast(y - 1995 as int) as period_idx, cast(y as int) as period_year
        from (select unnest(generate_series(1995, 2001)) as y)"""),
    "v_person": ((), f"""
        select o_orderkey as id, cast(year(o_orderdate) - 1995 as int) as period_idx,
               cast(year(o_orderdate) as int) as birth_year,
               cast(year(o_orderdate) + floor({u('span', 'o_orderkey')} * 6) as int) as death_year,
               c_nationkey as birth_region_idx,
               cast(-60 as double) + c_nationkey * cast(4.7 as double) + ({u('spot', 'o_orderkey')} - 0.5) * 8 as birth_lat,
               cast(-170 as double) + c_nationkey * cast(13.3 as double) + ({u('spot', 'o_orderkey', part=1)} - 0.5) * 8 as birth_lon
        from orders join customer on c_custkey = o_custkey"""),
    "v_move": ((), """
        select l_orderkey as person_id, l_linenumber as seq, cast(year(l_shipdate) as int) as year,
               cast(year(l_shipdate) - 1995 as int) as period_idx,
               s_nationkey as from_region_idx, c_nationkey as to_region_idx, o_orderpriority as cause_label
        from lineitem join orders on o_orderkey = l_orderkey
             join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
        where s_nationkey <> c_nationkey"""),
    "v_event_group": ((), """
        select cast(user_id % 74 as int) as k, event_type, count(*) as n, cast(sum(event_id % 1009) as bigint) as s
        from events group by 1, 2"""),
    "v_event": (("v_event_group",), """
        select concat('ev', cast(k as varchar)) as id, concat('Event ', cast(k as varchar)) as name,
               cast(1995 + k % 6 as int) as start_year, cast(1995 + k % 6 + sum(n) % 3 as int) as end_year,
               min(event_type) as type,
               cast(0.8 as double) + k % 30 * cast(0.1 as double) as mortality,
               cast(1.1 as double) - k % 10 * cast(0.05 as double) as birth
        from v_event_group group by k"""),
    "v_event_region": (("v_event_group",), """
        select distinct concat('ev', cast(k as varchar)) as id, concat('nation_', cast(s % 27 as varchar)) as region_id
        from v_event_group"""),
    "v_event_pull": (("v_event_group",), """
        select concat('ev', cast(k as varchar)) as id, concat('nation_', cast(s % 27 as varchar)) as src_id,
               concat('nation_', cast((s * 7 + 3) % 27 as varchar)) as dst_id,
               max(5 + s % 89) / cast(100 as double) as weight
        from v_event_group group by 1, 2, 3"""),
    "v_link": ((), """
        select event_id as id, cast(user_id % 25 as int) as region_idx, cast(year(ts) as int) as birth_year,
               case when user_id % 10 = 3 then event_id + 1000000000000
                    else greatest(event_id - 1 - user_id % 50, -1) end as parent1_id
        from events"""),
    "v_cohort_plan": (("v_person",), """
        select period_idx, birth_region_idx as region_idx, count(*) as n from v_person group by 1, 2"""),
    "v_flow_plan": (("v_move",), """
        select period_idx, from_region_idx as src_idx, to_region_idx as dst_idx, count(*) as n
        from v_move where period_idx between 0 and 6 group by 1, 2, 3"""),
}


def view(name: str, body: str, *needs: str) -> None:
    """Add a named SQL step that others can build on."""
    VIEWS[name] = (needs, body)


def sql(body: str, *needs: str) -> Callable[[], str]:
    """``body`` after the views it needs, put together once all views are known."""
    return lambda: compose(body, *needs)


def compose(body: str, *needs: str) -> str:
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in ordered:
            inner, text = VIEWS[name]
            for other in inner:
                add(other)
            ordered[name] = text

    for name in needs:
        add(name)
    if not ordered:
        return body
    steps = ",\n".join(f"{name} as ({text})" for name, text in ordered.items())
    return f"with recursive {steps}\n{body}"
