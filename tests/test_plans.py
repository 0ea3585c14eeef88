"""Pipelines on small ship data with the awkward rows, models against numpy, and plan shapes."""

import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions.times import hour_number
from seamark.operators import ranking
from seamark.operators.metrics import best_row
from seamark.operators.quantiles import medians_and_modes
from seamark.plans import balance, baseline, build, dataset, features, neighbourhood, ports, runs, task, weekly
from seamark.schema import OFFSETS, PORT, RAW_MESSAGE
from seamark.session import shuffle_partitions


def message(**given):
    row = {f.name: None for f in RAW_MESSAGE.fields}
    row.update({"mmsi": 1, "timestamp": "07/04/2025 00:00:00", "destination": "DKCPH"}, **given)
    return tuple(row.values())


MESSAGES = [
    message(shiptype="Cargo", lon=12.5, lat=13.5, draught=7.5, eta="09/05/2025 10:11:12", to_bow="12.7", imo="Unknown"),
    message(shiptype="Tanker", lon=13.5, draught=8.5, status="moored"),
    message(timestamp="08/04/2025 00:00:00", shiptype="Tanker", to_bow="3", to_stern="4", to_port="1", to_starboard="2"),
    message(timestamp="08/04/2025 06:00:00", to_bow="4"),
    message(timestamp="09/04/2025 06:00:00", to_bow="4", destination="DEHAM", draught=1.0),
    message(mmsi=2, timestamp="10/04/2025 00:00:00", shiptype=None, destination="nowhere", draught=2.0),
    message(mmsi=3, timestamp="04/04/2025 00:00:00", shiptype="Fishing"),
    message(mmsi=4, timestamp="21/04/2025 00:00:00", shiptype="Fishing"),
    message(mmsi=None),
]


@pytest.fixture(scope="module")
def harbours(spark):
    return spark.createDataFrame([(1, "DKCPH", "C", "DK", None, None), (2, "DEHAM", "H", "DE", None, None)], PORT)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(MESSAGES, RAW_MESSAGE)


@pytest.fixture(scope="module")
def built(raw, harbours):
    return build.build_tables(raw, harbours, "2025-04-04 00:00:00", "2025-04-21 00:00:00")


def test_vessels(built):
    ships = {r.mmsi: r for r in built.vessel.collect()}
    assert set(ships) == {1, 2, 3}  # the period is half open, messages without a ship are left out
    assert (ships[1].imo, ships[1].median_to_bow, ships[1].mode_to_bow) == (None, 4, 4)
    assert (ships[1].median_to_stern, ships[2].median_to_bow, ships[3].mode_to_port) == (4, None, None)


def test_facts(built):
    positions = {r.position_id: r for r in built.position.collect()}
    assert len(positions) == 6 and positions["1_20250408060000"].lon is None
    assert {r.lon for r in positions.values()} <= {None, 12, 14}  # half to even
    voyages = {r.voyage_id: r for r in built.voyage.collect()}
    assert set(voyages) == {"1_20250407000000", "1_20250409060000", "2_20250410000000"}
    first = voyages["1_20250407000000"]
    assert (first.draught, first.month, first.day, first.hour, first.minute) == (8, 5, 9, 10, 11)
    details = {r.vessel_details_id: tuple(r)[3:] for r in built.vessel_details.collect()}
    assert details["1_20250407000000"] == (13, None, None, None) and len(details) == 4


def test_a_stored_build_equals_the_lazy_one(raw, harbours, built):
    stored = build.build_tables(raw, harbours, "2025-04-04 00:00:00", "2025-04-21 00:00:00", store=True)
    for (name, a), (_, b) in zip(built.items(), stored.items()):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_rerun_changes_nothing(spark, built, tmp_path):
    for _ in range(2):
        build.write_tables(built, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "position")).count() == 6


def test_first_days(raw, harbours):
    tables = build.build_tables(raw.where("mmsi <= 3"), harbours, days=4, geometry=False)
    assert sorted(r.position_id for r in tables.position.collect()) == ["1_20250407000000", "3_20250404000000"]


def test_database_and_graph(built):
    db = dataset.ship_database(built).stored()
    assert {r.mmsi: r.shiptype for r in db["vessels"].collect()}[2] == "Other"  # a missing type is the other class
    assert tuple(db.span().first()) == (datetime(2025, 4, 4), datetime(2025, 4, 10))
    cut = db.up_to("2025-04-08 00:00:00")
    assert cut["positions"].count() == 2 and cut["vessels"].count() == 3
    dense = db.rekeyed()
    assert sorted(r.mmsi for r in dense["vessels"].collect()) == [0, 1, 2]
    assert sorted((r.voyage_id, r.mmsi, r.destination) for r in dense["voyages"].collect()) == [(0, 0, 1), (1, 0, 0), (2, 1, None)]
    counts = {(r.edge_type, r.child): r["count"] for r in neighbourhood.graph_edges(dense).groupBy("edge_type", "child").count().collect()}
    assert counts[("f2p_mmsi", "positions")] == counts[("rev_f2p_mmsi", "positions")] == 6
    assert counts[("f2p_destination", "voyages")] == 2
    nodes = {r.type: r["count"] for r in neighbourhood.graph_nodes(dense).groupBy("type").count().collect()}
    assert nodes == {"vessels": 3, "vessels_details": 4, "ports": 2, "positions": 6, "voyages": 3}
    hidden = db.without(task.HIDDEN_COLUMNS)
    assert hidden["positions"].columns == ["position_id", "mmsi", "timestamp"]
    assert "shiptype" in db.without(["shiptype"], only="positions")["vessels"].columns
    filled = db.text_filled({"positions": ["status"]})["positions"]
    assert {r.status for r in filled.collect()} == {"Unknown", "moored"} or {r.status for r in filled.collect()} == {"Unknown"}
    assert set(db.profiles()) == set(db.tables)


def test_registry(built):
    dataset.DATASETS.register("ships", lambda: dataset.ship_database(built))
    assert dataset.DATASETS.get("ships")["ports"].count() == 2
    with pytest.raises(KeyError):
        dataset.TASKS.get("absent")


def test_task_rows(spark):
    day = lambda d, h=0: datetime(2025, 4, d, h)
    # n-1, n and n+1 distinct times, a doubled time, times on both cut-offs, a missing label
    rows = [(1, day(7)), (2, day(7)), (2, day(14)), (3, day(7)), (3, day(7)), (3, day(18)), (3, day(19)), (4, day(7)), (4, day(13, 23))]
    rows += [(5, day(7)), (5, day(8))]
    moves = spark.createDataFrame(rows, "mmsi int, timestamp timestamp_ntz")
    ships = spark.createDataFrame(
        [(1, "Other"), (2, "Cargo/Tanker"), (3, "Other"), (4, "Cargo/Tanker"), (5, None)], "mmsi int, shiptype string"
    )
    t = task.NthInteractionTask(n=2)
    found = {r.mmsi: (r.nth_time, r.shiptype, r.split) for r in task.task_rows(moves, ships, t).collect()}
    assert found == {2: (day(14), 1, "val"), 3: (day(18), 0, "test"), 4: (day(13, 23), 1, "train")}
    parts = [task.task_table(moves, ships, t, s).count() for s in ("train", "val", "test")]
    assert parts == [1, 1, 1]
    assert task.task_table(moves, ships, t, "test", mask_label=True).columns == ["mmsi", "nth_time"]
    with pytest.raises(ValueError):
        task.task_table(moves, ships, t, "all")


def test_features_and_balance(spark, built):
    ships = spark.createDataFrame([(1, "Cargo"), (2, "Fishing")], "mmsi int, shiptype string")
    rows = features.nth_geometry_features(built.position, ships, built.vessel_details, 2)
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 3, 4, 1, 2, datetime(2025, 4, 8))]  # other details have nulls
    assert features.with_size(rows).select("length", "width").first() == (7, 3)
    cargo = features.nth_geometry_features(built.position, ships, built.vessel_details, 2, label=features.cargo_only())
    assert cargo.first().shiptype == 1
    split = balance.with_split(rows, "nth_timestamp", "2025-04-14", "2025-04-18")
    assert balance.class_balance(split, "shiptype").first().percent_1 == 100.0


def test_weekly(spark):
    moves = spark.createDataFrame(
        [(1, datetime(2024, 12, 31)), (1, datetime(2025, 1, 1)), (2, datetime(2025, 1, 8)), (3, datetime(2025, 1, 8))],
        "mmsi int, timestamp timestamp_ntz",
    )
    ships = spark.createDataFrame([(1, "Cargo"), (2, "Tanker"), (3, None)], "mmsi int, shiptype string")
    counts = weekly.weekly_counts(moves, ships)
    pivot = weekly.weekly_pivot(counts, "shiptype", "year_week")
    assert [tuple(r) for r in pivot.collect()] == [("2025-01", 2, 0), ("2025-02", 0, 1)]
    assert [tuple(r) for r in weekly.top_classes(counts, "shiptype", 1).collect()] == [("Cargo", 2)]


def test_ports(spark, harbours):
    seen = spark.createDataFrame([("DKCPH",), ("DKCPH",), ("X",), (None,)], "destination string")
    assert tuple(ports.match_report(seen, "destination", harbours, "port_code").first()) == (2, 2, 1)
    countries = spark.createDataFrame([("DK", "Denmark")], "CountryCode string, CountryName string")
    named = {r.port_code: r.country_name for r in ports.with_country_names(harbours, countries).collect()}
    assert named == {"DKCPH": "Denmark", "DEHAM": None}


def test_runs(spark):
    val = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.8), ("a", 2, 0.8)], "run string, epoch int, roc_auc double")
    test = spark.createDataFrame([("a", 1, 0.6)], "run string, epoch int, roc_auc double")
    best = runs.best_epochs(runs.series({"val": val, "test": test})).first()
    assert (best.epoch, best.val_roc_auc, best.test_roc_auc) == (1, 0.8, 0.6)
    grid = runs.parameter_grid(spark)
    assert grid.count() == 108 and grid.where("cell = 107").first().batch_size == 256
    trials = grid.withColumn("score", F.when(F.col("cell").isin(40, 7), 0.9).otherwise(0.1))
    assert runs.best_trial(trials, "score").first().cell == 7


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, size=(400, 4))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 2]) / 3))).astype(int)
    split = np.where(np.arange(400) < 250, "train", np.where(np.arange(400) < 320, "val", "test"))
    rows = [(str(s), int(b), *map(int, a)) for s, b, a in zip(split, y, x)]
    return x, y, split, spark.createDataFrame(rows, f"split string, label int, {', '.join(c + ' int' for c in OFFSETS)}")


def plain_regression(x, y, c=1.0, steps=60):
    """Newton's method on the summed log loss times c plus half the squared weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        gradient = c * a.T @ (p - y) + penalty @ w
        hessian = c * (a * (p * (1 - p))[:, None]).T @ a + penalty
        w = w - np.linalg.solve(hessian, gradient)
    return w


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_baseline_against_numpy(labelled, c):
    x, y, split, df = labelled
    train = split == "train"
    mean, std = x[train].mean(0), x[train].std(0)
    scaled = (x - mean) / std
    w = plain_regression(scaled[train], y[train], c)
    merged = baseline.merge_equal(df, OFFSETS, "label")
    model = baseline.fit_baseline(merged.where("split = 'train'"), OFFSETS, "label", "rows", c)
    assert np.allclose([*model.model.coefficients, model.model.intercept], w, atol=1e-4)
    p = 1 / (1 + np.exp(-(np.hstack([scaled, np.ones((400, 1))]) @ w)))
    out = {r.split: r for r in baseline.run_baseline(df, OFFSETS, "label", c).collect()}
    for s in ("train", "val", "test"):
        ps, ys = p[split == s], y[split == s]
        loss = -np.mean(np.where(ys == 1, np.log(ps), np.log(1 - ps)))
        pairs = ps[ys == 1][:, None] - ps[ys == 0][None, :]
        assert out[s].log_loss == pytest.approx(loss, abs=1e-4)
        assert out[s].roc_auc == pytest.approx(np.mean((pairs > 0) + (pairs == 0) / 2), abs=1e-3)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5), (3, 5)], "a int, b int")
    out = baseline.scale(df, baseline.fit_scaler(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_grid_and_mode_baseline(labelled):
    df = labelled[3]
    trials = baseline.grid_search(df, OFFSETS, "label", [0.001, 1.0])
    assert trials.count() == 2 and best_row(trials, "log_loss", "cell", higher_is_better=False).first().cell == 1
    scores = baseline.run_mode_baseline(df, OFFSETS, "label")
    assert {r.split for r in scores.collect()} == {"train", "val", "test"}


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "Red red  Boat"), (2, None), (3, "")], "id int, name string")
    rows = {(r.id, r.dimension): r.n for r in baseline.text_vectors(df, "id", "name", 300).collect()}
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 300
    assert rows == {(1, place("red")): 2, (1, place("boat")): 1, (2, place("unknown")): 1} or place("red") == place("boat")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_nth_row_limits_rows_before_the_shuffle(spark):
    df = spark.range(9999).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    text = plan_of(ranking.nth_row(df, 500, by=["k"], order=["t"])).split("== Physical Plan ==")[1]
    assert text.index("500, Final") < text.index("Exchange hashpartitioning(k") < text.index("500, Partial")
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert len(limits) == 4 and all("_salt" in line for line in limits[2:]) and "_salt" not in limits[0]


def test_shuffles_grow_with_the_data():
    assert shuffle_partitions(1 << 30) == 200
    assert shuffle_partitions(1 << 40) == 4096
    assert shuffle_partitions(100 << 40) == 100_000


def test_ranks_never_partition_rows_by_the_key_alone(spark):
    df = spark.createDataFrame([(1, datetime(2025, 1, 1))], "k int, t timestamp_ntz")
    ranked = ranking.row_ranks(df, "r", by=["k"], order=["t"], slice_=hour_number(F.col("t")))
    lines = plan_of(ranked).split("== Physical Plan ==")[1].splitlines()
    of_rows = [line for line in lines if "Window [" in line and "currentrow" in line]
    assert len(of_rows) == 1 and "windowspecdefinition(_part#" in of_rows[0]
    parts = [line.split(" AS _part")[0] for line in lines if " AS _part#" in line]
    assert len(parts) == 2 and all("struct(k, k#" in p and ", _slice, " in p for p in parts)
    of_groups = [line for line in lines if "Window [" in line and "currentrow" not in line]
    assert len(of_groups) == 1 and lines.index(of_groups[0]) > lines.index(of_rows[0])  # over counts only
    assert any("hashpartitioning(_part#" in line for line in lines)


def test_medians_and_modes_share_one_pass(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("k"), "id").write.parquet(str(tmp_path / "t"))
    df = medians_and_modes(spark.read.parquet(str(tmp_path / "t")), ["id"], "k", (0, 100))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1


def test_weekly_counts_are_reduced_before_the_join(spark):
    moves = spark.createDataFrame([(1, datetime(2025, 1, 1))], "mmsi int, timestamp timestamp_ntz")
    ships = spark.createDataFrame([(1, "Cargo")], "mmsi int, shiptype string")
    text = plan_of(weekly.weekly_counts(moves, ships)).split("== Physical Plan ==")[1]
    assert text.index("Join") < text.rindex("partial_count")


def scan_of(df):
    """What the scans of a plan are asked to leave out."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: ")[1] for line in text.splitlines() if "PartitionFilters: " in line]


def test_periods_leave_out_folders_and_row_groups(spark):
    from workload import messages as work
    from workload.base import Source

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    source = Source(spark, "/root/testdata/sf0.001")
    typed = work.day_folders(source)
    tables = build.build_tables(typed, work.harbours(source), "2024-01-05 00:00:00", "2024-01-07 00:00:00", geometry=False)
    for df in (tables.position, tables.vessel):
        for scan in scan_of(df):
            folders, pushed = scan.split("PushedFilters: ")
            assert "date" in folders.split("]")[0] and "timestamp" in pushed and "mmsi" in pushed
    days = {str(r.day) for r in tables.position.select(F.to_date("timestamp").alias("day")).distinct().collect()}
    assert days == {"2024-01-05", "2024-01-06"}
    kept = work.stored(source)
    one = build.in_period(kept.position, "2024-01-05", "2024-01-06").where("mmsi = 3")
    assert all("EqualTo(mmsi,3)" in scan and "GreaterThanOrEqual(timestamp" in scan for scan in scan_of(one))
    db = dataset.ship_database(kept, unique=True).up_to("2024-01-06 00:00:00")
    assert all("LessThan(timestamp" in scan for scan in scan_of(db["positions"]))


def test_edges_are_read_once_per_table(spark, built):
    dense = dataset.ship_database(built).stored().rekeyed(store=True).stored()
    text = neighbourhood.graph_edges(dense)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 3 and "Join" not in text
    untimed = neighbourhood.graph_edges(dataset.ship_database(built).stored().rekeyed(timed=False, store=True))
    assert ("f2p_mmsi", "1_20250407000000") in {(r.edge_type, r.src) for r in untimed.collect()}


def test_rows_of_unique_keys_are_numbered_where_they_are_sorted(built):
    db = dataset.ship_database(built, unique=True).part(["voyages"])
    assert set(db.tables) == {"voyages", "vessels", "ports"}
    numbered = db.rekeyed()["voyages"]
    joined = dataset.ship_database(built).rekeyed()["voyages"]
    assert sorted(map(tuple, numbered.drop("timestamp").collect()), key=str) == sorted(map(tuple, joined.drop("timestamp").collect()), key=str)

    def joins(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in text.splitlines() if "Join LeftOuter" in line and "voyage_id" in line]

    assert joins(joined) and not joins(numbered)


def test_a_database_reads_stored_messages_and_no_geometry(raw, harbours, built):
    stored = build.build_tables(raw, harbours, "2025-04-04 00:00:00", "2025-04-21 00:00:00", store=True)
    db = dataset.ship_database(stored, unique=True)
    for name in ("vessels", "vessels_details", "positions", "voyages"):
        assert all("distinct-messages" in f for f in db[name].inputFiles()) and db[name].inputFiles(), name
    lazy = dataset.ship_database(built)["vessels"]
    assert sorted(map(tuple, db["vessels"].collect()), key=str) == sorted(map(tuple, lazy.collect()), key=str)
    assert "Join" not in lazy._jdf.queryExecution().executedPlan().toString()
