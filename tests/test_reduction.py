"""Filtered joins against plain Python, the filter's error, and what is left of rows before the shuffle."""

import pytest
from pyspark.sql import functions as F

from seamark.operators import reduction

FACTS = [(k % 40, f"v{k % 7}", k) for k in range(400)] + [(None, "v1", 900), (3, None, 901), (3, "v3", 3), (77, "", 902)]
KEYS = [(k, f"v{k % 7}", f"n{k}") for k in range(0, 60, 3)] * 2 + [(None, "v1", "null"), (3, None, "half"), (77, "", None)]
LIMITS = pytest.mark.parametrize("limits", [{}, {"most_bytes": 0}, {"bits": 1}])


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, "k int, v string, id int")


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(KEYS, "k int, v string, name string")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def known(row, on):
    parts = row[: len(on)]
    return None not in parts and parts in {r[: len(on)] for r in KEYS}


@LIMITS
@pytest.mark.parametrize("on", [["k"], ["k", "v"]])
def test_semi_and_anti(facts, keys, on, limits):
    assert rows(reduction.semi_join(facts, keys, on, **limits)) == sorted([r for r in FACTS if known(r, on)], key=repr)
    assert rows(reduction.anti_join(facts, keys, on, **limits)) == sorted([r for r in FACTS if not known(r, on)], key=repr)


@LIMITS
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join(facts, keys, how, limits):
    expected = []
    for r in FACTS:
        names = [n for k, _, n in KEYS if k == r[0] and k is not None]
        expected += [(*r, n) for n in names] or ([(*r, None)] if how == "left" else [])
    assert rows(reduction.join(facts, keys, ["k"], ["name"], how, **limits)) == sorted(expected, key=repr)


def test_no_keys_and_no_rows(facts, keys):
    none = keys.where("k < 0")
    assert reduction.semi_join(facts, none, ["k"]).count() == 0
    assert rows(reduction.anti_join(facts, none, ["k"])) == sorted(FACTS, key=repr)
    assert reduction.join(facts, none, ["k"], ["name"], "left").where("name is null").count() == len(FACTS)
    assert reduction.semi_join(facts.where("k < 0"), keys, ["k"]).count() == 0
    assert reduction.anti_join(facts.where("k < 0"), keys, ["k"]).count() == 0


def test_types_must_be_equal(facts, keys):
    with pytest.raises(ValueError, match="cast one of them"):
        reduction.semi_join(facts, keys.withColumn("k", F.col("k").cast("long")), ["k"])
    with pytest.raises(ValueError, match="inner or left"):
        reduction.join(facts, keys, ["k"], ["name"], "full")


def test_numbers_that_are_none_and_signed_zeros(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1), (-0.0, 2), (0.0, 3), (None, 4), (2.0, 5)], "k double, id int")
    keys = spark.createDataFrame([(nan,), (0.0,), (None,)], "k double")
    assert [r["id"] for r in reduction.semi_join(df, keys, ["k"]).orderBy("id").collect()] == [1, 2, 3]
    assert [r["id"] for r in reduction.anti_join(df, keys, ["k"]).orderBy("id").collect()] == [4, 5]


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_all_keys_pass_and_few_others(spark, kind):
    numbers = spark.range(200_000).select((F.col("id") * 1_000_003).cast(kind).alias("k"), "id")
    filter_ = reduction.sieve(numbers.where("id % 10 = 0"), ["k"])
    passed = reduction.sift(numbers, filter_).groupBy((F.col("id") % 10 == 0).alias("known")).count().collect()
    counts = {r["known"]: r["count"] for r in passed}
    assert counts[True] == 20_000 == filter_.n_keys
    assert counts.get(False, 0) < 0.01 * 180_000
    assert filter_.blocks.count() <= filter_.n_blocks == -(-20_000 * reduction.BITS // reduction.BLOCK)


def test_rows_leave_before_the_shuffle(spark, no_broadcast):
    facts = spark.range(100_000).select((F.col("id") % 50_000).alias("k"), F.col("id").alias("v"))
    keys = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    joined = reduction.join(facts, keys, ["k"], ["name"])
    text = joined._jdf.queryExecution().executedPlan().toString()
    # The test of the bits lies below the exchange of the facts, and nothing else is broadcast.
    assert text.index("SortMergeJoin") < text.index("Exchange hashpartitioning") < text.index("BroadcastHashJoin")
    assert text.count("BroadcastExchange") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text
    assert joined.count() == 1000
