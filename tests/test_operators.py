"""Hand-made cases of the operators, and what their plans must hold."""

import pytest
from pyspark.sql import functions as F

from geoflow.functions.expr import pack_id
from geoflow.functions.periods import Periods
from geoflow.operators import blend, intervals, joins, lineage, shares
from geoflow.operators.corridors import corridors
from geoflow.operators.density import density, living, totals_with_dominant
from geoflow.plans import model
from geoflow.sources import facts
from geoflow.sources.catalog import cause_dim, split_records
from geoflow.schemas import EVENT
from geoflow.session import cut, local_frame
from geoflow.sources.dims import checked_regions, region_dim
from parity.views import PERIODS, Views
from tests.conftest import plan, rows

P = Periods(1525, 2025, 10)
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def regions(spark):
    names = [("aa", "North", 10.0, 0.0, 1.0), ("bb", "East", 12.0, 20.0, 3.0), ("cc", "Far", -40.0, 120.0, 6.0)]
    return region_dim(spark, [
        {"id": i, "name": n, "lat": la, "lon": lo, "pop_share": s, "continent": f"C{k % 2}", "ethno": [0.0, 2.0, 2.0, 0, 0, 0, 0, 0]}
        for k, (i, n, la, lo, s) in enumerate(names)
    ])


@pytest.fixture(scope="module")
def catalog(spark):
    def event(id, start, end, mortality=None, birth=None, regions=None, pulls=None):
        return {"id": id, "name": id.upper(), "start": start, "end": end, "type": "war", "mortality": mortality, "birth": birth,
                "regions": regions, "pulls": pulls, "description": None}

    def pull(a, b, w):
        return {"from": a, "to": b, "weight": w, "reason": None}

    return split_records(local_frame(spark, [
        event("plague", 1525, 1545, 4.0, 0.7, ["aa", "nowhere"]),
        event("mild", 1535, 1540, 0.6, 1.4, ["bb"]),
        event("short", 1756, 1763, 9.0, 0.1, ["aa"], [pull("aa", "bb", 0.5)]),
        event("leave", 1530, 1536, None, None, None, [pull("aa", "bb", 0.2), pull("aa", "aa", 0.9), pull("zz", "bb", 0.9), pull("aa", "cc", 0.0)]),
        event("alike", 1530, 1540, None, None, None, [pull("aa", "bb", 0.2)]),
    ], EVENT))


def test_defaults_and_region_fields(catalog, regions):
    leave = catalog.event.where("id = 'leave'").first()
    assert (leave.mortality, leave.birth) == (1.0, 1.0)
    assert catalog.event_pull.first().reason == ""
    first = regions.where("region_idx = 0").first()
    assert (first.radius_deg, first.ethno) == (4.0, "mena")


def test_region_index_is_checked(spark):
    with pytest.raises(Exception, match="outside the id's range"):
        checked_regions(spark.createDataFrame([(64,)], "region_idx int")).collect()
    with pytest.raises(ValueError):
        region_dim(spark, [{}] * 65)


def test_factors(catalog, regions):
    hit = intervals.resolve_regions(catalog.event_region, regions)
    table = {(r.period_idx, r.region_idx): (r.mortality_factor, r.birth_factor)
             for r in intervals.event_factors(catalog.event, hit, regions, P).collect()}
    assert len(table) == 50 * 3
    assert table[0, 0] == (4.0, 0.7) and table[2, 0] == (4.0, 0.7)
    assert table[3, 0] == (1.0, 1.0)
    assert table[1, 1] == (1.0, 1.0)
    assert table[23, 0] == (1.0, 1.0)
    wide = intervals.event_factors(catalog.event, hit, regions, P, "overlap")
    assert wide.where("period_idx = 23 and region_idx = 0").first().mortality_factor == 9.0


def test_unknown_regions_are_reported(catalog, regions):
    assert rows(intervals.unknown_regions(catalog.event_region, regions).select("region_id")) == [("nowhere",)]


def test_pulls_drop_unknown_ends_and_self(catalog, regions):
    got = rows(intervals.resolve_pulls(catalog.event_pull, regions))
    assert got == [("alike", 0, 1, 0.2), ("leave", 0, 1, 0.2), ("leave", 0, 2, 0.0), ("short", 0, 1, 0.5)]


def test_both_ends_of_an_interval_count(catalog):
    def ids(year):
        return [r[0] for r in rows(intervals.active_events(catalog.event, year).select("id"), "as is")]

    assert ids(1545.2) == ["plague"]
    assert ids(1546) == []
    assert ids(1535) == ["plague", "alike", "leave", "mild"]
    assert len(intervals.active_events(catalog.event, 1535, 2).collect()) == 2


def test_active_counts_include_quiet_periods(catalog):
    table = {r.period_idx: (r.active_events, round(r.intensity, 6)) for r in intervals.active_counts(catalog.event, P).collect()}
    assert table[0] == (1, 0.105) and table[1] == (4, 0.405) and table[40] == (0, 0.005)


def test_label_goes_to_the_heaviest_then_earliest_pull(spark, catalog, regions):
    moves = spark.createDataFrame([(1, 0, 1, 1530), (2, 0, 1, 1538), (3, 0, 1, 1757), (4, 0, 2, 1530), (5, 1, 0, 1530)],
                                  "id int, from_region_idx int, to_region_idx int, year int")
    pulls = intervals.resolve_pulls(catalog.event_pull, regions)
    got = rows(intervals.label_cause(moves, catalog.event, pulls).select("id", "cause_label"))
    assert got == [(1, "alike"), (2, "alike"), (3, "short"), (4, "baseline"), (5, "baseline")]


def test_causes_are_numbered_by_start_and_id(catalog):
    got = {r.cause_label: r.cause_id for r in cause_dim(catalog.event).collect()}
    assert got == {"baseline": 0, "plague": 1, "alike": 2, "leave": 3, "mild": 4, "short": 5}


# --- shares ---------------------------------------------------------------------

@pytest.mark.parametrize("plan_sized", [True, False])
def test_apportion_is_exact_and_breaks_ties_by_key(spark, plan_sized):
    df = spark.createDataFrame([(k, 1.0) for k in range(7)], "k int, w double")
    got = rows(shares.apportion(df, "w", 10, ["k"], plan_sized=plan_sized).select("k", "n"))
    assert got == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_apportion_by_threshold_equals_a_full_ranking(spark):
    from geoflow.session import cut as keep

    df = keep(spark.range(5000).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 7 + 0.01).alias("w")))
    for total in (0, 3, 4999, 100_003):
        by_rank = rows(shares.apportion(df, "w", total, ["k"], plan_sized=True).select("k", "n"))
        assert rows(shares.apportion(df, "w", total, ["k"]).select("k", "n")) == by_rank
        assert sum(n for _, n in by_rank) == total
    even = shares.apportion(df.withColumn("w", F.lit(0.1)), "w", 15_000, ["k"])
    assert "Sort" not in plan(even) and "Exchange" not in plan(even) and {r.n for r in even.collect()} == {3}
    assert shares.apportion(df.limit(0), "w", 5, ["k"]).count() == 0


def test_apportion_without_weight_fails(spark):
    df = spark.createDataFrame([(1, 0.0)], "k int, w double")
    with pytest.raises(Exception, match="weights sum to zero"):
        shares.apportion(df, "w", 10, ["k"], plan_sized=True).collect()
    with pytest.raises(ValueError, match="weights sum to zero"):
        shares.apportion(df, "w", 10, ["k"])


def test_global_rank_is_the_position_in_one_order(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 5003).alias("x"))
    ranked = shares.global_rank(df, [F.col("x").desc()])
    expected = {x: i + 1 for i, x in enumerate(sorted((i * 7919 % 5003 for i in range(5000)), reverse=True))}
    assert all(expected[r.x] == r["rank"] for r in ranked.collect())


def test_zero_sums_leave_weights_alone(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0)], "k string, w double")
    for plan_sized in (True, False):
        got = rows(shares.row_share(df, "w", ["k"], plan_sized=plan_sized).select("k", "share"))
        assert got == [("a", 0.0), ("a", 0.0), ("b", 0.25), ("b", 0.75)]
    assert rows(shares.global_share(df.where("k = 'a'"), "w").select("share")) == [(0.0,), (0.0,)]
    floored = df.withColumn("w", F.lit(1e-14))
    assert rows(shares.row_share(floored, "w", ["k"], floor=1e-12).select(F.round("share", 3)))[0] == (0.01,)


def test_split_sums_to_the_mass(spark):
    df = spark.range(200).select("id", (F.col("id") % 13).alias("mass"))
    split = shares.split_evenly(df, "mass", ["id"], 3)
    back = split.groupBy("id", "mass").agg(F.sum("n").alias("n"), F.count("*").alias("slots"))
    assert back.where("n <> mass or slots <> 10").count() == 0


def test_midpoint_of_the_first_value_is_itself(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 8.0)], "p int, v double").withColumn("k", F.lit(1))
    assert rows(shares.midpoint(df, "v", ["k"], "p").select("p", "midpoint")) == [(0, 4.0), (1, 6.0)]


# --- joins ----------------------------------------------------------------------

def test_salted_join_equals_the_plain_one(spark):
    left = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([(7, -1)], "k long, v long")
    )
    for how in ("inner", "left"):
        salted = joins.skew_join(left, right, ["k"], how, hot_rows=1000)
        assert rows(salted.select("id", "k", "v")) == rows(left.join(right, ["k"], how).select("id", "k", "v"))
    assert rows(joins.hot_keys(left, ["k"], 8, 1000)) == [(7, 6681)]
    assert joins.hot_keys(left, ["k"], 8).count() == 0
    with pytest.raises(ValueError):
        joins.skew_join(left, right, ["k"], "full")


def test_equal_rows_and_nulls_of_hot_keys_are_spread(spark, monkeypatch):
    """A third of the rows are the same row, a third has no key, and one key has 30 % of the rest."""
    left = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).when(F.col("id") % 10 < 3, 8).otherwise(F.col("id") % 400).alias("k"))
    right = spark.createDataFrame([(7, "a"), (8, "b"), (8, "c"), (None, "no"), (12, "d")], "k long, v string")
    sizes = []
    monkeypatch.setattr(joins.F, "broadcast", lambda df: df, raising=True)
    for how in ("inner", "left"):
        salted = joins.skew_join(left, right, ["k"], how, hot_rows=1000, rows_per_salt=1000)
        assert rows(salted.groupBy("k", "v").count()) == rows(left.join(right, ["k"], how).groupBy("k", "v").count())
    kept = cut(left)
    found = {r.k: r["rows"] for r in joins.hot_keys(kept, ["k"], 8, 1000).collect()}
    assert found[7] >= 10_000 and None not in found
    dealt = kept.where("k = 7").select(F.pmod(F.monotonically_increasing_id(), F.lit(10)).alias("s")).groupBy("s").count().collect()
    sizes = [r["count"] for r in dealt]
    assert len(sizes) == 10 and max(sizes) < 1.2 * min(sizes)
    assert joins.skew_join(left.limit(0), right, ["k"], "left").count() == 0


def test_lookup_beyond_the_broadcast_limit(spark, monkeypatch):
    left = spark.range(1000).select("id", (F.col("id") % 10).alias("k"))
    table = spark.range(8).select(F.col("id").alias("k"), F.col("id").alias("v"))
    small = joins.lookup_join(left, table, ["k"], "left")
    assert "BroadcastHashJoin" in plan(small)
    expected = rows(small)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert rows(joins.lookup_join(left, table, ["k"], "left")) == expected


# --- population and flows -------------------------------------------------------

def test_pairs_have_no_diagonal_and_no_cross_join(regions):
    pairs = model.region_pairs(regions)
    assert rows(pairs.select("src_idx", "dst_idx")) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    text = plan(pairs)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fold_against_a_plain_loop(spark):
    steps = [(k, p, 1.0 + k, 0.1 * (k + 1) - 0.05 * p, 2.0 + p) for k in range(3) for p in range(6)]
    df = spark.createDataFrame(steps, "k int, p int, start double, net double, capacity double")
    got = {(r.k, r.p): r.population for r in model.logistic_fold(df, "k", "p").collect()}
    for k in range(3):
        value = 1.0 + k
        for p in range(6):
            if p:
                net, cap = 0.1 * (k + 1) - 0.05 * p, 2.0 + p
                value = max(value * (1 + net * min(1.0, max(-0.5, 1 - value / cap))), value * 0.5)
            assert got[k, p] == pytest.approx(value)


def test_shares_sum_to_one_and_sources_without_pulls_keep_a_part(catalog, regions):
    hit = intervals.resolve_regions(catalog.event_region, regions)
    factors = intervals.event_factors(catalog.event, hit, regions, P)
    pop = cut(model.population(regions, factors, P))
    assert pop.where("period_idx = 0").agg(F.round(F.sum("population"), 9)).first()[0] == 1.0
    pulls = intervals.resolve_pulls(catalog.event_pull, regions)
    matrix = intervals.pull_matrix(catalog.event, pulls, P)
    flow = cut(model.flow_shares(regions, pop, matrix, catalog.event, P))
    assert flow.agg(F.round(F.sum("share"), 9)).first()[0] == 1.0
    assert flow.count() == 50 * 6
    # Period 1 has a pull from region 0 only: region 1 sends 0.3 of what its people would.
    sent = {r[0]: r[1] for r in flow.where("period_idx = 1").groupBy("src_idx").agg(F.sum("share")).collect()}
    people = {r[0]: r[1] for r in pop.where("period_idx = 1").select("region_idx", "population").collect()}
    assert sent[1] / sent[0] == pytest.approx(0.3 * people[1] / people[0])
    exact = model.flow_counts(flow, 1000, exact=True)
    assert model.plan_total(exact).first()[0] == 1000
    assert model.plan_total(model.flow_counts(flow, 1000)).first()[0] <= 1000
    weights = model.birth_weights(pop, factors, P)
    assert model.plan_total(model.cohort_plan(weights, 12345)).first()[0] == 12345


# --- density and corridors ------------------------------------------------------

def test_dominant_takes_the_lowest_label_on_ties(spark):
    df = spark.createDataFrame([("x", "b", 2), ("x", "a", 2), ("y", "c", 1), ("y", "a", 3)], "k string, l string, n long")
    assert rows(totals_with_dominant(df, ["k"], "l", "total", "top")) == [("x", 4, "a"), ("y", 4, "a")]


def test_living_counts_every_period_of_a_life(spark, regions):
    people = spark.createDataFrame([(0, 1530, 1551, 0, 10.0, 0.0), (1, 1536, 1537, 1, 12.0, 20.0), (2, 1546, 1545, 1, 12.0, 20.0)],
                                   "period_idx int, birth_year int, death_year int, birth_region_idx int, birth_lat double, birth_lon double")
    assert rows(living(people, P, "living").groupBy("period_idx").count()) == [(0, 1), (1, 2), (2, 2)]
    table = density(people, regions, P, "living")
    assert rows(table.select("period_idx", "pop")) == [(0, 1), (1, 1), (1, 1), (2, 1), (2, 1)]
    assert living(people, P).count() == 3
    with pytest.raises(ValueError):
        living(people, P, "other")


def test_corridor_plan_limits_before_the_shuffle(spark):
    v = Views(spark, SF_DIR)
    text = plan(corridors(v.move(), v.region(), PERIODS, 5))
    assert "WindowGroupLimit" in text
    assert "Python" not in text


def test_density_reads_only_its_columns(spark):
    v = Views(spark, SF_DIR)
    text = plan(density(v.person(), v.region(), PERIODS))
    assert "o_totalprice" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


# --- lineage --------------------------------------------------------------------

@pytest.fixture(scope="module")
def family(spark):
    links = [(1, 2), (2, 3), (3, -1), (4, 2), (5, 99), (6, None)]
    return spark.createDataFrame(links, "id long, parent1_id long")


def test_walk_stops_at_unknown_missing_and_null(spark, family):
    seeds = family.where("id in (1, 4, 5, 6)").withColumn("lineage_id", F.col("id").cast("int"))
    got = rows(lineage.walk_ancestors(family, seeds).select("lineage_id", "depth", "id"))
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4), (4, 1, 2), (4, 2, 3), (5, 0, 5), (6, 0, 6)]
    short = lineage.walk_ancestors(family, seeds, max_nodes=2)
    assert short.agg(F.max("depth")).first()[0] == 1


def test_walk_ways_give_the_same(family, monkeypatch):
    seeds = family.withColumn("lineage_id", F.col("id").cast("int"))
    expected = rows(lineage.walk_ancestors(family, seeds))
    monkeypatch.setattr(lineage, "NAMED_IDS", 2)
    assert rows(lineage.walk_ancestors(family, seeds)) == expected
    for nodes in (1, 2, 3, 4, 9, 30):
        monkeypatch.setattr(lineage, "NAMED_IDS", 2)
        doubled = rows(lineage.walk_ancestors(family, seeds, nodes))
        monkeypatch.setattr(lineage, "NAMED_IDS", 500)
        assert rows(lineage.walk_ancestors(family, seeds, nodes)) == doubled


def test_walk_keeps_at_most_four_tables(family, monkeypatch):
    kept = []
    monkeypatch.setattr(lineage, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(lineage, "NAMED_IDS", 2)
    lineage.walk_ancestors(family, family.withColumn("lineage_id", F.col("id").cast("int"))).count()
    assert len(kept) == 4
    lineage.walk_ancestors(family, family.limit(1).withColumn("lineage_id", F.col("id").cast("int"))).count()
    assert len(kept) == 5


def test_large_samples_are_numbered_without_one_task(spark, monkeypatch):
    people = spark.range(3000).select(F.when(F.col("id") % 500 != 3, F.col("id") % 2500).alias("id"), F.lit(1).alias("x"))
    few = [lineage.hash_sample(people, n).select("lineage_id", "id").collect() for n in (1, 700, 3000, 5000)]
    monkeypatch.setattr(lineage, "RANKED_ROWS", 0)
    for n, expected in zip((1, 700, 3000, 5000), few):
        got = lineage.hash_sample(people, n).select("lineage_id", "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected))
        assert "SinglePartition" not in plan(lineage.hash_sample(people, n)).split("BroadcastExchange")[0]


def test_walk_by_period_does_not_depend_on_the_number_of_seeds(spark):
    """Ids outside their period are nobody's parent, and of a repeated id every row is met."""
    n, each = 8000, 400

    def packed(i):
        return pack_id(F.floor(i / each), F.lit(0), i % each)

    i = F.col("i")
    base = spark.range(n).select(F.col("id").alias("i")).select(
        "i", packed(i).alias("id"), F.when(i >= each, packed(i - each)).otherwise(F.lit(-1)).alias("parent1_id"),
        F.when(i % 97 == 0, 0).otherwise(F.floor(i / each)).cast("int").alias("period_idx"))
    people = cut(base.unionByName(base.where("i % 89 = 0")))
    # Walked on the numbers themselves: one step back per level while the parent is stored in its own period.
    seed = sorted((r.lineage_id, r.i) for r in lineage.hash_sample(people, 6000).select("lineage_id", "i").collect())
    expected = []
    for number, at in seed:
        met = 1
        for depth in range(4):
            expected += [(number, depth, at)] * met
            at -= each
            if at < 0 or (at % 97 == 0 and at >= each):
                break
            met *= 2 if at % 89 == 0 else 1
    for size in (50, 600, 6000):
        seeds = lineage.hash_sample(people, size)
        got = lineage.walk_ancestors(people, seeds, 4, period="period_idx").select("lineage_id", "depth", "i").collect()
        assert sorted(map(tuple, got)) == sorted(x for x in expected if x[0] < size)


def test_orphans_are_counted_per_parent(family):
    more = family.unionByName(family.where("id = 5").withColumn("id", F.lit(7).cast("long")))
    assert rows(lineage.orphans(more, more, "parent1_id")) == [(99, 2)]


def test_states_of_lineages(spark):
    spans = spark.createDataFrame([(1, 1600, 1700), (2, 1600, 1700), (3, 1600, 1700), (4, 1800, 1900)],
                                  "lineage_id int, first_year int, last_year int")
    got = rows(lineage.lineage_visible(spans, 1725, selected=1, hovered=2).select("lineage_id", "state"))
    assert got == [(1, "selected"), (2, "hovered"), (3, "window"), (4, "dim")]
    assert rows(lineage.lineage_visible(spans, 1726).select("state"))[0] == ("dim",)


# --- blending -------------------------------------------------------------------

def cells(spark, *entries):
    return spark.createDataFrame(list(entries), "cell string, pop long, dominant_continent string")


def test_blend_of_cells(spark):
    now = cells(spark, ("a", 10, "X"), ("b", 10, "X"), ("c", 1, "X"))
    then = cells(spark, ("a", 30, "Y"), ("b", 2, "Y"), ("d", 4, "Y"), ("e", 1, "Y"))
    got = rows(blend.blend_density(now, then, 0.5), "as is")
    assert got == [("a", 20.0, "Y"), ("b", 6.0, "X"), ("d", 2.0, "Y"), ("c", 0.5, "X"), ("e", 0.5, "Y")]
    unnamed = cells(spark, ("a", 100, None))
    assert rows(blend.blend_density(unnamed, cells(spark, ("a", 10, "ASIA")), 0.1), "as is") == [("a", 91.0, None)]
    assert len(blend.blend_density(now, then, 0.5, 2).collect()) == 2
    assert rows(blend.blend_density(now, then, 7.0).select("cell")) == [("a",), ("b",), ("d",), ("e",)]
    assert blend.visible_peak(blend.blend_density(now, then, 0.5)).first()[0] == 20.0
    assert blend.visible_peak(blend.blend_density(now, then, 0.5).where("pop > 99")).first()[0] == 1.0


def test_highlight_and_localize(spark):
    arcs = spark.createDataFrame([("r1", "East", "war"), ("r2", "West", "gold")], "id string, name string, top_cause string")
    assert rows(blend.highlight(arcs, "war").select("id", "factor")) == [("r1", 1.0), ("r2", 0.18)]
    assert rows(blend.highlight(arcs, None).select("factor")) == [(1.0,), (1.0,)]
    labels = spark.createDataFrame([("r1", "Ost")], "key string, label string")
    assert rows(blend.localize(arcs, "id", "name", labels).select("id", "name")) == [("r1", "Ost"), ("r2", "West")]


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "k string, v double")
    for sized in (True, False):
        out = shares.row_share(df, "v", ["k"], plan_sized=sized)
        assert rows(out.select("k", "v", "share")) == [("a", 1.0, 0.25), ("a", 3.0, 0.75), (None, 2.0, 0.25), (None, 6.0, 0.75)]
    assert shares.ratio_to_max(df, "v", ["k"]).count() == 4


def test_events_that_end_before_they_start_act_in_no_year(spark):
    event = spark.createDataFrame([("e", "E", 1990, 1985), ("f", "F", 1990, 1990)], "id string, name string, start_year int, end_year int")
    assert rows(intervals.names_by_year(event)) == [(1990, ["F"])]


def test_periods_beyond_one_word_fail(spark, tmp_path):
    watched, _ = facts.row_metrics(spark.range(40_000).withColumnRenamed("id", "period_idx"), "wide")
    with pytest.raises(Exception, match="period outside 0 to 32767"):
        watched.write.parquet(str(tmp_path / "x"))
