"""Scores of predictions and reports over metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions import labels
from seamark.functions.times import day_number
from seamark.operators import metrics
from seamark.plans import balance, baseline, runs
from workload.base import K, TEST, VAL, Source, query, r6, split_sql


def scored(t: Source) -> DataFrame:
    """Events as predictions: the value guesses whether it is a purchase or a signup."""
    value = F.col("value")
    rows = t.events.select(
        "ts",
        "event_id",
        labels.member_label(F.col("event_type"), ["purchase", "signup"]).alias("label"),
        value.alias("score"),
        F.round(value / (value + 30), 3).alias("probability"),
    )
    return balance.with_split(rows, "ts", VAL, TEST)


SCORED = f"""
s AS (SELECT {split_sql('ts')} AS split, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label,
             value AS score, round(value / (value + 30), 3) AS probability FROM events)"""

CURVE = f"""
{SCORED},
p AS (SELECT split, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER (PARTITION BY split) AS all_pos, sum(neg) OVER (PARTITION BY split) AS all_neg
      FROM p WINDOW w AS (PARTITION BY split ORDER BY score DESC))"""

AUC = "round(sum(pos * (all_neg - fp + neg / 2.0)) / (max(all_pos) * max(all_neg)), 6)"
AP = "round(sum(pos / all_pos * (tp / (tp + fp))), 6)"


@query("auc", f"WITH {CURVE} SELECT split, {AUC} AS roc_auc FROM c GROUP BY split")
def auc(t: Source) -> DataFrame:
    return metrics.roc_auc(scored(t), "label", "score", ["split"]).withColumn("roc_auc", r6("roc_auc"))


@query(
    "auc_overall",
    f"""
WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
             / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM r
""",
)
def auc_overall(t: Source) -> DataFrame:
    return metrics.roc_auc(scored(t), "label", "score").withColumn("roc_auc", r6("roc_auc"))


@query("average_precision", f"WITH {CURVE} SELECT split, {AP} AS average_precision FROM c GROUP BY split")
def average_precision(t: Source) -> DataFrame:
    ap = metrics.average_precision(scored(t), "label", "score", ["split"])
    return ap.withColumn("average_precision", r6("average_precision"))


@query(
    "log_loss",
    f"""
WITH {SCORED}, c AS (SELECT split, label, greatest(least(probability, 1 - 2.220446049250313e-16), 2.220446049250313e-16) AS p FROM s)
SELECT split, round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM c GROUP BY split
""",
)
def log_loss(t: Source) -> DataFrame:
    return metrics.log_loss(scored(t), "label", "probability", ["split"]).withColumn("log_loss", r6("log_loss"))


@query(
    "acc_f1",
    f"""
WITH {SCORED}, c AS (SELECT split, count(*) FILTER (score > 40 AND label = 1) AS tp, count(*) FILTER (score > 40 AND label = 0) AS fp,
  count(*) FILTER (score <= 40 AND label = 1) AS fn, count(*) FILTER (score <= 40 AND label = 0) AS tn FROM s GROUP BY split)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""",
)
def acc_f1(t: Source) -> DataFrame:
    c = metrics.class_scores(scored(t), "label", "score", 40.0, ["split"])
    return c.withColumns({"accuracy": r6("accuracy"), "f1": r6("f1")})


@query(
    "task_metrics",
    f"""
WITH {CURVE},
m AS (SELECT split, {AUC} AS roc_auc, {AP} AS average_precision FROM c GROUP BY split),
h AS (SELECT split, round(avg(CASE WHEN (score > 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(2.0 * count(*) FILTER (score > 0 AND label = 1) / (count(*) FILTER (score > 0) + sum(label)), 6) AS f1 FROM s GROUP BY split)
SELECT split, average_precision, accuracy, f1, roc_auc FROM m JOIN h USING (split)
""",
)
def task_metrics(t: Source) -> DataFrame:
    m = metrics.evaluate(scored(t), "binary_classification", "label", "score", ["split"])
    return m.withColumns({c: r6(c) for c in ("average_precision", "accuracy", "f1", "roc_auc")})


NULL_SPLIT = CURVE.replace(
    f"SELECT {split_sql('ts')} AS split", f"SELECT nullif({split_sql('ts')}, 'val') AS split"
)


@query(
    "metrics_null_group",
    f"""
WITH {NULL_SPLIT},
m AS (SELECT split, {AUC} AS roc_auc, {AP} AS average_precision FROM c GROUP BY split),
h AS (SELECT split, round(avg(CASE WHEN (score > 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(2.0 * count(*) FILTER (score > 0 AND label = 1) / (count(*) FILTER (score > 0) + sum(label)), 6) AS f1 FROM s GROUP BY split)
SELECT m.split, average_precision, accuracy, f1, roc_auc FROM m JOIN h ON m.split IS NOT DISTINCT FROM h.split
""",
)
def metrics_null_group(t: Source) -> DataFrame:
    rows = scored(t).withColumn("split", F.nullif("split", F.lit("val")))
    m = metrics.binary_metrics(rows, "label", "score", by=["split"])
    return m.withColumns({c: r6(c) for c in ("average_precision", "accuracy", "f1", "roc_auc")})


@query("auc_narrow_scores", f"WITH {CURVE} SELECT split, {AUC} AS roc_auc FROM c GROUP BY split")
def auc_narrow_scores(t: Source) -> DataFrame:
    """Scores in a narrow band; the order, and with it the area, is that of the values."""
    rows = scored(t).withColumn("score", 0.5 + F.col("score") * 1e-8)
    return metrics.roc_auc(rows, "label", "score", ["split"]).withColumn("roc_auc", r6("roc_auc"))


OUTLIERS = CURVE.replace(
    "value AS score", "CASE WHEN event_id = 11 THEN 1e12 WHEN event_id % 997 = 5 THEN 1e6 + value ELSE value / (value + 100) END AS score"
)


@query("auc_nested_outliers", f"WITH {OUTLIERS} SELECT split, {AUC} AS roc_auc, {AP} AS average_precision FROM c GROUP BY split")
def auc_nested_outliers(t: Source) -> DataFrame:
    """Scores between 0 and 1, some a million times as large, and one a million times as large again."""
    value, id_ = F.col("score"), F.col("event_id")
    far = F.when(id_ == 11, 1e12).when(id_ % 997 == 5, 1e6 + value).otherwise(value / (value + 100))
    found = metrics.curve_scores(scored(t).withColumn("score", far), "label", "score", ["split"])
    return found.withColumns({c: r6(c) for c in ("roc_auc", "average_precision")})


@query(
    "mae",
    f"WITH m AS (SELECT user_id, value, {K} AS k FROM events) "
    "SELECT user_id, round(avg(abs(value - k)), 6) AS mae FROM m GROUP BY user_id",
)
def mae(t: Source) -> DataFrame:
    return metrics.evaluate(t.measured, "regression", "value", "k", ["user_id"]).withColumn("mae", r6("mae"))


@query(
    "multiclass_accuracy",
    f"""
WITH m AS (SELECT event_type, {K} % 3 AS truth, value AS a, {K} * 1.0 AS b, 45.0 AS c FROM events)
SELECT event_type, round(avg(CASE WHEN truth = CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END
                             THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM m GROUP BY event_type
""",
)
def multiclass_accuracy(t: Source) -> DataFrame:
    rows = t.measured.select(
        "event_type",
        (F.col("k") % 3).alias("truth"),
        F.array("value", F.col("k").cast("double"), F.lit(45.0)).alias("scores"),
    )
    found = metrics.evaluate(rows, "multiclass_classification", "truth", "scores", ["event_type"])
    return found.withColumn("accuracy", r6("accuracy"))


@query(
    "score_classes",
    f"""
WITH m AS (SELECT event_id, {K} * 1.0 AS k, value FROM events)
SELECT event_id, CASE WHEN value - 50 > 0 THEN 1 ELSE 0 END AS by_threshold,
       CASE WHEN value >= k AND value >= 45 THEN 0 WHEN k >= 45 THEN 1 ELSE 2 END AS by_argmax FROM m
""",
)
def score_classes(t: Source) -> DataFrame:
    scores = F.array("value", F.col("k").cast("double"), F.lit(45.0))
    return t.measured.select(
        "event_id",
        labels.class_by_threshold(F.col("value") - 50).alias("by_threshold"),
        labels.class_by_argmax(scores).alias("by_argmax"),
    )


@query(
    "scale_features",
    f"""
WITH m AS (SELECT event_id, value, {K} AS k, ts FROM events),
s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM m WHERE ts < TIMESTAMP '{VAL}')
SELECT event_id, round((value - mv) / sv, 6) AS value, round((k - mk) / sk, 6) AS k, 0.0::DOUBLE AS flat FROM m, s
""",
)
def scale_features(t: Source) -> DataFrame:
    rows = t.measured.withColumn("flat", F.lit(7)).select("event_id", "ts", "value", "k", "flat")
    train = rows.where(F.col("ts") < F.lit(VAL).cast("timestamp_ntz"))
    columns = ["value", "k", "flat"]
    scaled = baseline.scale(rows, baseline.fit_scaler(train, columns), columns)
    return scaled.select("event_id", *[r6(c).alias(c) for c in columns])


def epochs(t: Source, *types: str) -> DataFrame:
    """A user is a run and a day an epoch; the mean value of the day is its loss."""
    rows = t.events.where(F.col("event_type").isin(*types)) if types else t.events
    return rows.groupBy(F.col("user_id").alias("run"), day_number(F.col("ts")).alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("loss"), F.count("*").alias("size")
    )


def epochs_sql(*types: str) -> str:
    where = f"WHERE event_type IN ({', '.join(repr(x) for x in types)})" if types else ""
    return (
        "SELECT user_id AS run, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch, "
        f"round(avg(value), 6) AS loss, count(*) AS size FROM events {where} GROUP BY 1, 2"
    )


@query(
    "weighted_loss",
    f"SELECT run, round(sum(loss * size) / sum(size), 5) AS loss FROM ({epochs_sql()}) GROUP BY run",
)
def weighted_loss(t: Source) -> DataFrame:
    return metrics.weighted_mean_loss(epochs(t), "loss", "size", ["run"]).withColumn("loss", F.round("loss", 5))


@query(
    "patience_stop",
    f"""
WITH e AS ({epochs_sql()}),
a AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch) AS best_so_far,
             min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
             row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn FROM e),
b AS (SELECT *, best_before IS NULL OR loss < best_before AS improved FROM a),
c AS (SELECT *, rn - max(CASE WHEN improved THEN rn END) OVER (PARTITION BY run ORDER BY epoch) AS stalled FROM b),
d AS (SELECT *, min(CASE WHEN stalled >= 5 THEN rn END) OVER (PARTITION BY run) AS stop FROM c)
SELECT run, epoch, loss, size, best_so_far, improved, stalled FROM d WHERE stop IS NULL OR rn <= stop
""",
)
def patience_stop(t: Source) -> DataFrame:
    return metrics.patience(epochs(t), "loss", "epoch", 5, ["run"])


def aligned(t: Source) -> DataFrame:
    frames = {"train": epochs(t), "val": epochs(t, "view", "click"), "test": epochs(t, "purchase", "signup")}
    return runs.series({name: df.drop("size") for name, df in frames.items()})


ALIGNED = f"""
SELECT run, epoch, t.loss AS train_loss, v.loss AS val_loss, s.loss AS test_loss
FROM ({epochs_sql()}) t FULL JOIN ({epochs_sql('view', 'click')}) v USING (run, epoch)
FULL JOIN ({epochs_sql('purchase', 'signup')}) s USING (run, epoch)"""


@query("aligned_series", ALIGNED)
def aligned_series(t: Source) -> DataFrame:
    return aligned(t)


@query(
    "best_epoch",
    f"""
SELECT run, epoch, train_loss, val_loss, test_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS rn FROM ({ALIGNED}) WHERE val_loss IS NOT NULL
) WHERE rn = 1
""",
)
def best_epoch(t: Source) -> DataFrame:
    return runs.best_epochs(aligned(t), "val_loss", ["run"], higher_is_better=False)


@query(
    "best_trial",
    f"""
SELECT run, epoch, loss, size FROM ({epochs_sql()}) ORDER BY loss DESC, run LIMIT 1
""",
)
def best_trial(t: Source) -> DataFrame:
    return runs.best_trial(epochs(t), "loss", "run")
