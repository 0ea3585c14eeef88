"""Operators against plain Python on small frames in which one key holds most rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from statistics import median, pstdev

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seamark.functions.times import hour_number
from seamark.operators import graph, histograms, joins, metrics, profile, quantiles, ranking, sampling
from seamark.operators.ranking import Running, Total

START = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def skewed():
    """(key, ts, id, value): key 0 has two thirds of the rows, times repeat."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 0 if i % 3 else rng.randrange(1, 9)
        rows.append((key, START + timedelta(minutes=rng.randrange(6000)), i, rng.choice([None, *range(20)])))
    return rows


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed, "key int, ts timestamp_ntz, id int, value int").repartition(6)


def grouped(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[r[0]].append(r)
    return groups


def test_running_values(frame, skewed):
    values = {
        "so_far": Running("sum", "value"),
        "least_before": Running("min", "value", before=True),
        "most": Running("max", "value"),
        "all": Total("sum", "value"),
    }
    slices = [hour_number(F.col("ts")), F.floor(hour_number(F.col("ts")) / 10)]
    for slice_ in (slices[0], slices):
        out = ranking.running(frame, values, by=["key"], order=["ts", "id"], slice_=slice_)
        found = {r.id: (r.so_far, r.least_before, r.most, r.all) for r in out.collect()}
        assert len(found) == len(skewed)
        for rows in grouped(skewed).values():
            known = [r[3] for r in rows]
            for i, r in enumerate(rows):
                upto = [v for v in known[: i + 1] if v is not None]
                before = [v for v in known[:i] if v is not None]
                expected = (
                    sum(upto),
                    min(before) if before else None,
                    max(upto) if upto else None,
                    sum(v for v in known if v is not None),
                )
                assert found[r[2]] == expected


@pytest.mark.parametrize("n", [1, 3, 20, 200, 10_000])
@pytest.mark.parametrize("limit", ["1000", "2"])
def test_nth_row_on_both_sides_of_the_limit(spark, frame, skewed, n, limit):
    spark.conf.set(ranking.GROUP_LIMIT, limit)
    try:
        out = ranking.nth_row(frame, n, by=["key"], order=["ts", "id"], slice_=hour_number(F.col("ts")))
        assert {r.key: r.id for r in out.collect()} == {k: g[n - 1][2] for k, g in grouped(skewed).items() if len(g) >= n}
    finally:
        spark.conf.unset(ranking.GROUP_LIMIT)


def test_every_kth_row(frame, skewed):
    out = ranking.every_kth_row(frame, 7, by=["key"], order=["ts", "id"], slice_=hour_number(F.col("ts")))
    expected = {r[2] for g in grouped(skewed).values() for r in g[6::7]}
    assert {r.id for r in out.collect()} == expected


def test_dedupe_is_idempotent(frame):
    once = ranking.first_row(frame, by=["key", "ts"], order=["id"])
    assert once.count() == frame.select("key", "ts").distinct().count()
    assert ranking.first_row(once, by=["key", "ts"], order=["id"]).exceptAll(once).count() == 0


@pytest.mark.parametrize("bounds", [None, (5, 9)])
def test_medians_and_modes(frame, skewed, bounds):
    """Given bounds need not hold: values outside share the first or last slice."""
    out = {r.key: r for r in quantiles.medians_and_modes(frame, ["value"], "key", bounds).collect()}
    for key, rows in grouped(skewed).items():
        values = [r[3] for r in rows if r[3] is not None]
        counts = Counter(values)
        best = min(counts, key=lambda v: (-counts[v], v))
        assert out[key].median_value == median(values)
        assert out[key].mode_value == best


def test_medians_of_a_key_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "key int, value int")
    out = {r.key: (r.median_value, r.mode_value) for r in quantiles.medians_and_modes(df, ["value"], "key").collect()}
    assert out == {1: (None, None), 2: (5.0, 5.0)}


def test_quantiles_of_one_to_n(spark):
    """1..4603 has the published deviation and quartiles of a table's dense ids."""
    df = spark.range(1, 4604).withColumnRenamed("id", "x")
    row = profile.numeric_stats(df, ["x"]).first()
    assert row.q == [1.0, 1151.5, 2302.0, 3452.5, 4603.0]
    assert row["mean"] == 2302.0
    assert abs(row["std"] - 1328.7716131826417) < 1e-9


def test_update_sets_nulls_too_and_leaves_others(spark):
    target = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c")], "k int, x int, y string")
    source = spark.createDataFrame([(1, 11.0), (2, None)], "k int, x double")
    assert sorted(joins.update_from(target, source, "k", ["x"]).collect()) == [(1, 11, "a"), (2, None, "b"), (3, 30, "c")]


def test_align_keeps_rows_of_either_side(spark):
    a = spark.createDataFrame([("r", 0, 1.0)], "run string, epoch int, loss double")
    b = spark.createDataFrame([("r", 1, 2.0)], "run string, epoch int, loss double")
    rows = joins.align({"train": a, "val": b}, ["run", "epoch"]).orderBy("epoch").collect()
    assert [tuple(r) for r in rows] == [("r", 0, 1.0, None), ("r", 1, None, 2.0)]


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.4, 1.0])
def test_downsample_is_exact(spark, fraction):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    kept = sampling.downsample(df, F.col("label") == 1, fraction, ["id"])
    counts = {r.label: r["count"] for r in kept.groupBy("label").count().collect()}
    assert counts.get(1, 0) == round(334 * fraction)
    assert counts[0] == 666
    again = sampling.downsample(df.repartition(13), F.col("label") == 1, fraction, ["id"])
    assert again.exceptAll(kept).count() == 0
    if 0 < fraction < 1:
        assert sampling.downsample(df, F.col("label") == 1, fraction, ["id"], seed=1).exceptAll(kept).count() > 0


def test_fast_downsample_keeps_the_other_class(spark):
    df = spark.range(1000).withColumn("label", F.lit(0))
    assert sampling.downsample_fast(df, "label", 1, 0.1).count() == 1000


def test_shuffle_changes_order_only(spark):
    df = spark.range(200)
    mixed = [r.id for r in sampling.shuffled(df, 1).collect()]
    assert sorted(mixed) == list(range(200)) and mixed != list(range(200))


def test_histograms(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.2), ("b", 5.0), ("b", None)], "g string, x double")
    units = {(r.g, r.bin): r.n for r in histograms.unit_histogram(df, "x", ["g"]).collect()}
    assert units == {(g, b): int((g, b) in {("a", 1), ("a", 3), ("b", 5)}) for g in "ab" for b in range(1, 6)}
    cells = histograms.equal_width_histogram(df, "x", 4, ["g"]).orderBy("g", "bin").collect()
    assert [r.n for r in cells] == [1, 0, 0, 1, 0, 0, 1, 0]
    assert (cells[4].bin_start, cells[7].bin_end) == (4.5, 5.5)


def test_unit_histogram_of_the_whole_frame(spark):
    df = spark.createDataFrame([(0,), (2,)], "x int")
    assert [tuple(r) for r in histograms.unit_histogram(df, "x").orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 1)]
    assert sum(r.n for r in histograms.equal_width_histogram(df, "x", 3).collect()) == 2


def brute_scores(points):
    pos = [s for y, s in points if y]
    neg = [s for y, s in points if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted(set(s for _, s in points), reverse=True):
        above = [y for y, s in points if s >= t]
        ap += sum(1 for y, s in points if y and s == t) / len(pos) * sum(above) / len(above)
    return auc, ap


def test_curve_scores_with_ties(spark):
    rng = random.Random(3)
    points = [(int(rng.random() < 0.4), float(rng.randrange(12)) / 4) for _ in range(200)]
    df = spark.createDataFrame(points, "y int, s double")
    auc, ap = brute_scores(points)
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(df.withColumn("s", 1 - F.col("s")), "y", "s").first()[0] == pytest.approx(1 - auc)
    merged = df.groupBy("y", "s").agg(F.count("*").alias("w"))
    assert metrics.roc_auc(merged, "y", "s", weight="w").first()[0] == pytest.approx(auc)
    m = metrics.binary_metrics(df, "y", "s", 1.0).first()
    assert (m.roc_auc, m.average_precision) == (pytest.approx(auc), pytest.approx(ap))


def test_scores_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] is None
    assert metrics.average_precision(df, "y", "s").first()[0] == 1.0
    assert metrics.class_scores(df, "y", "s", 0.9).first().f1 == 0.0


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, p double")
    assert metrics.log_loss(df, "y", "p").first()[0] == pytest.approx(0.0, abs=1e-12)
    wrong = spark.createDataFrame([(0, 1.0)], "y int, p double")
    assert metrics.log_loss(wrong, "y", "p").first()[0] == pytest.approx(36.04, abs=0.01)


def test_best_row_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.9), ("b", 0, None)], "run string, epoch int, m double")
    assert [tuple(r) for r in metrics.best_row(df, "m", "epoch", ["run"]).collect()] == [("a", 1, 0.9)]
    assert metrics.best_row(df, "m", "epoch", ["run"], higher_is_better=False).first().epoch == 0


def test_patience_stops_like_a_loop(spark):
    rng = random.Random(11)
    losses = {run: [rng.random() for _ in range(60)] for run in "abc"}
    rows = [(run, i, x) for run, xs in losses.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run string, epoch int, loss double")
    out = defaultdict(int)
    for r in metrics.patience(df, "loss", "epoch", 10, ["run"], slice_size=16).collect():
        out[r.run] += 1
    for run, xs in losses.items():
        best, stalled, length = float("inf"), 0, 0
        for x in xs:
            length += 1
            best, stalled = (x, 0) if x < best else (best, stalled + 1)
            if stalled >= 10:
                break
        assert out[run] == length


def test_dense_ids(spark):
    numbers = spark.createDataFrame([(10**15,), (5,), (-3,), (5,), (None,)], "k long")
    assert sorted(map(tuple, graph.dense_ids(numbers, "k").collect())) == [(-3, 0), (5, 1), (10**15, 2)]
    words = [f"{p}{i:05d}" for p in ("AAAAAAAAAAAAAAAA", "AAAAAAAB", "B") for i in range(40)] + ["", "A"]
    found = dict(map(tuple, graph.dense_ids(spark.createDataFrame([(w,) for w in words], "k string"), "k").collect()))
    assert found == {w: i for i, w in enumerate(sorted(words))}


def test_rekey_and_edges(spark):
    parent = spark.createDataFrame([("x",), ("y",)], "code string")
    child = spark.createDataFrame([(1, "y"), (2, "x"), (3, None), (4, "unknown")], "id int, code string")
    ids = graph.dense_ids(parent, "code")
    assert sorted(map(tuple, graph.rekey(child, "code", ids, "code").collect())) == [(1, 1), (2, 0), (3, None), (4, None)]
    edges = graph.foreign_key_edges(child, "id", "code", parent, "code", "f2p_code")
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, "y"), (2, "x")]
    back = graph.reverse_edges(edges).collect()
    assert {r.edge_type for r in back} == {"rev_f2p_code"} and sorted((r.dst, r.src) for r in back) == [(1, "y"), (2, "x")]


@pytest.mark.parametrize("k", [1, 4, 50])
def test_latest_neighbours_with_shared_keys(spark, frame, skewed, k):
    rng = random.Random(5)
    seeds = [(i, rng.choice([0, 0, 0, 1, 2, 99]), START + timedelta(minutes=rng.randrange(-100, 7000))) for i in range(60)]
    asks = spark.createDataFrame(seeds, "seed int, key int, at timestamp_ntz")
    out = graph.latest_neighbours(
        asks, frame, k, seed="seed", key="key", seed_time="at", time="ts", row_id="id", columns=["value"], store=k == 4
    )
    found = defaultdict(list)
    for r in out.collect():
        found[r.seed].append((r.hop_rank, r.id, r.value))
    for seed, key, at in seeds:
        near = sorted((r for r in skewed if r[0] == key and r[1] <= at), key=lambda r: (r[1], str(r[2])), reverse=True)[:k]
        assert sorted(found[seed]) == [(i + 1, r[2], r[3]) for i, r in enumerate(near)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.0), (3, "a", 4.0)], "i int, t string, d double")
    assert [tuple(r) for r in profile.null_profile(df).collect()] == [("i", "int", 0), ("t", "string", 1), ("d", "double", 1)]
    assert tuple(profile.shape(df).first()) == (3, 3)
    row = profile.numeric_stats(df, ["d"]).first()
    assert (row.n, row["mean"], row["std"]) == (2, 3.0, pstdev([2.0, 4.0]))
    assert [tuple(r) for r in profile.top_values(df, "t", 1).collect()] == [("a", 2)]
    assert profile.distinct_per_group(df, "i", ["t"], approximate=True).count() == 2


def test_seen_only(spark):
    static = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    one, two = spark.createDataFrame([(1,), (None,)], "a int"), spark.createDataFrame([(3,), (1,)], "b int")
    assert sorted(r.k for r in profile.seen_only(static, "k", [(one, "a"), (two, "b")]).collect()) == [1, 3]


def largest_slice(df, name):
    return df.groupBy(name).count().agg(F.max("count")).first()[0]


RANGED = {
    "far": lambda: F.when(F.col("id") == 5, F.lit(1 << 62)).otherwise(F.col("id")),
    "narrow": lambda: 0.5 + F.col("id") * 1e-9,
    "odd": lambda: F.when(F.col("id") < 9, float("nan")).when(F.col("id") < 20, float("inf")).otherwise(F.col("id")),
    "nested": lambda: F.when(F.col("id") == 5, 1e12).when(F.col("id") < 10, 1e6).otherwise(F.col("id") / 100_000),
    "alike": lambda: F.concat(F.lit("https://www.example.org/a/long/path/"), F.col("id")),
}


@pytest.mark.parametrize("name", sorted(RANGED))
def test_ranges_hold_about_as_many_rows_as_one_another(spark, name):
    df = spark.range(100_000).select(RANGED[name]().alias("k")).distinct()
    ranged = ranking.in_value_ranges(df, ["k"], "r", 32)
    assert largest_slice(ranged, "r") <= 2 * df.count() / 32
    edges = ranged.groupBy("r").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("r").collect()
    assert len(edges) == 32 and ranged.where("k IS NULL").count() == 0
    falls = ranged.groupBy("r").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("before", F.lag("hi").over(Window.orderBy("r")))
    assert falls.where("before >= lo").count() == 0


@pytest.mark.parametrize("name", sorted(RANGED))
def test_positions(spark, name):
    df = spark.range(5000).select(RANGED[name]().alias("k")).distinct()
    found = ranking.positions(df, "k", "at", 7).withColumn("rank", F.row_number().over(Window.orderBy("k")) - 1)
    assert found.count() == df.count() and found.where("at <> rank").count() == 0
    assert ranking.positions(df.limit(0), "k", "at").count() == 0


BUSY = {  # key, seconds after the start, id
    "hour": lambda i: (i % 10 == 0, i % 3600, i),
    "second": lambda i: (i % 10 == 0, 7 + i * 1e-6, i),
    "instant": lambda i: (i % 10 == 0, 7, i),
    "mixed": lambda i: (i % 3 == 0, (i % 4) * 900 if i % 2 else i, -i),
    "null": lambda i: (i % 7 == 0, None if i % 3 else i, i),
}


@pytest.mark.parametrize("name", sorted(BUSY))
def test_time_slices_stay_below_the_target(spark, name):
    rows = [(int(k), None if s is None else START + timedelta(seconds=s), i) for k, s, i in map(BUSY[name], range(6000))]
    df = spark.createDataFrame(rows, "key int, at timestamp_ntz, id long")
    target = 300
    placed, counts = ranking.time_slices(df, ["key"], "at", ["id"], target)
    largest = placed.groupBy("key", ranking.SLICE).count().agg(F.max("count")).first()[0]
    assert largest <= target and counts.agg(F.sum(ranking.ROWS)).first()[0] == 6000
    ranked = ranking.row_ranks(df, "r", by=["key"], order=["at", "id"], time="at", target=target).collect()
    line = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or START, r[2]))
    expected = {r[2]: i for key in (0, 1) for i, r in enumerate([r for r in line if r[0] == key], 1)}
    assert {r["id"]: r["r"] for r in ranked} == expected
    whole, _ = ranking.time_slices(df, ["key"], "at", ["id"], 10_000)
    assert dict(whole.dtypes)[ranking.SLICE] == "bigint"  # nothing is split below the target


def test_latest_neighbours_of_a_split_hub(spark):
    rows = [(1, START + timedelta(seconds=i % 3), i) for i in range(2000)]
    seeds = [(i, 1, START + timedelta(seconds=i % 5 - 1)) for i in range(400)]
    df, asks = spark.createDataFrame(rows, "key int, at timestamp_ntz, id long"), spark.createDataFrame(seeds, "seed int, key int, t timestamp_ntz")
    found = graph.latest_neighbours(asks, df, 4, seed="seed", key="key", seed_time="t", time="at", row_id="id", target=100).collect()
    expected = {}
    for seed, _, t in seeds:
        near = sorted((r for r in rows if r[1] <= t), key=lambda r: (r[1], str(r[2])), reverse=True)[:4]
        expected.update({(seed, k): r[2] for k, r in enumerate(near, 1)})
    assert {(r["seed"], r["hop_rank"]): r["id"] for r in found} == expected


def test_bounds_do_not_change_quantiles(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("nan"))], "x double")
    for bounds in (None, (0.0, 10.0), (2.0, 2.5)):
        q = quantiles.exact_quantiles(rows, ["x"], [0.0, 0.5, 1.0], bounds=bounds).first().q
        assert q[:2] == [1.0, 2.5] and q[2] != q[2]
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("inf"))], "x double")
    assert quantiles.exact_quantiles(rows, ["x"], [1.0]).first().q == [float("inf")]


@pytest.mark.parametrize("n", [15, 16, 40])
def test_both_ways_to_the_nth_row_agree(spark, n):
    rows = spark.range(400).select(
        F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("t"),
        "id",
    )
    order = [F.asc_nulls_first("t"), "id"]
    ways = [
        ranking.nth_row(rows, n, by=["k"], order=order, slice_=F.floor(F.col("t") / 10), limit=limit).collect() for limit in (1000, 1)
    ]
    assert sorted(map(str, ways[0])) == sorted(map(str, ways[1])) and len(ways[0]) == 4
