"""Bucketed tables: no shuffle for joins by the key, and no task that holds a busy key whole."""

import uuid
from types import SimpleNamespace

import pytest

from seamark import session
from seamark.sources import buckets

FACTS = [(0, i, f"t{i % 7}") for i in range(70)] + [(k, 100 * k + i, "x") for k in (1, 2, 3) for i in range(5)]
FACTS += [(None, 900 + i, "n") for i in range(25)] + [(8, 800, None), (0, 5, "t5")]
SHIPS = [(0, "a"), (1, "b"), (2, None), (3, "d"), (9, "i"), (None, "none")]


@pytest.fixture
def stored(spark):
    """Facts and ships in buckets, parts of at most ten rows."""
    facts = spark.createDataFrame(FACTS, "k int, id long, v string")
    ships = spark.createDataFrame(SHIPS, "k int, name string")
    busy = buckets.busy_keys(facts, "k", target=10)
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("facts", "ships")]
    yield (
        buckets.save_bucketed(buckets.in_parts(facts, busy, "k", ["id"]), names[0], "k", 4, ["id"]),
        buckets.save_bucketed(buckets.in_all_parts(ships, busy, "k"), names[1], "k", 4),
        {r["k"]: r["parts"] for r in busy.collect()},
        names,
    )
    for name in names:
        spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_busy_keys_stand_in_parts(stored):
    facts, ships, busy, _ = stored
    assert busy == {0: 8, None: 3}
    parts = {(r["k"], r["part"]): r["count"] for r in facts.groupBy("k", "part").count().collect()}
    assert sum(k == 0 for k, _ in parts) > 5 and sum(k is None for k, _ in parts) == 3
    assert all(p == 0 for k, p in parts if k not in busy) and max(parts.values()) < 25
    assert sorted(r["part"] for r in ships.where("k = 0").collect()) == list(range(8))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_without_exchange(stored, no_broadcast, how):
    facts, ships, *_ = stored
    joined = buckets.join_parts(facts, ships, "k", ["name"], how)
    assert "Exchange" not in plan(joined)
    names = {k: n for k, n in SHIPS if k is not None}
    met = [(k, i, v, names[k]) for k, i, v in FACTS if k in names]
    lone = [(k, i, v, None) for k, i, v in FACTS if k not in names]
    expected = {"inner": met, "left": met + lone, "left_semi": [r[:3] for r in met], "left_anti": [r[:3] for r in lone]}[how]
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(expected, key=str)


def test_join_that_would_repeat_rows(stored):
    with pytest.raises(ValueError, match="several parts"):
        buckets.join_parts(stored[0], stored[1], "k", ["name"], "right")


def test_first_rows_move_one_row_a_part(stored):
    facts, *_ = stored
    found = buckets.first_rows(facts, "k", ["v", "id"])
    text = plan(found)
    below = text[text.index("Exchange") :]
    assert text.count("Exchange") == 1 and below.count("Aggregate(") == 3  # of the parts in two steps, then a partial one by key
    first = {}
    for k, i, v in FACTS:
        first[k] = min(first.get(k, (v, i)), (v, i), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert {r["k"]: (r["v"], r["id"]) for r in found.collect()} == first


def test_tables_are_kept_or_replaced(spark, stored):
    facts, _, _, names = stored
    none = facts.limit(0).drop("part")
    busy = buckets.busy_keys(none, "k")
    empty = spark.createDataFrame([], facts.schema)
    assert busy.count() == 0 and buckets.in_parts(none, busy, "k", ["id"]).count() == 0
    assert buckets.save_bucketed(empty, names[0], "k", 4).count() == len(FACTS)
    assert buckets.save_bucketed(empty, names[0], "k", 4, replace=True).count() == 0
    assert buckets.first_rows(spark.table(names[0]), "k", ["id"]).count() == 0


@pytest.mark.parametrize("master,named,warehouse,fails", [
    ("spark://host:7077", None, "file:/tmp/w", True), ("yarn", None, "/tmp/w", True), ("yarn", None, "hdfs://n/w", False),
    ("spark://host:7077", "/shared/c", "file:/tmp/w", False), ("local[4]", None, "file:/tmp/w", False),
])
def test_intermediates_need_a_shared_folder(master, named, warehouse, fails):
    conf = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": warehouse}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, *_: conf[k]), sparkContext=SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake)
    else:
        assert session.shared_folder(fake) == (named or f"{warehouse}/_intermediate")
