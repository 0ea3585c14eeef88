"""Exact scores of predictions, per group or for a whole frame.

Curves need scores in order. Equal scores are merged first, then the counts
below each score come from ``running`` over ranges drawn from the scores, so a hundred
billion distinct scores are still ordered range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.labels import class_by_argmax
from seamark.operators.ranking import PART, Running, Total, in_value_ranges, running, with_part, with_row

# Smallest step of a double: probabilities are clipped this far from 0 and 1.
EPSILON = 2.220446049250313e-16


def score_points(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(by, score, pos, neg, pos_below, neg_below, pos_all, neg_all) for each distinct score.

    ``weight`` says how many equal rows a row stands for. The distinct scores are written in ranges
    between drawn ones, so no task gathers more of them than others, however they lie.
    """
    rows = F.col(weight) if weight else F.lit(1)
    points = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(rows * F.col(label).cast("long")).alias("pos"),
            F.sum(rows * (1 - F.col(label).cast("long"))).alias("neg"),
        )
    )
    return running(
        in_value_ranges(points, ["score"], "_range"),
        {
            "pos_below": Running("sum", "pos", before=True),
            "neg_below": Running("sum", "neg", before=True),
            "pos_all": Total("sum", "pos"),
            "neg_all": Total("sum", "neg"),
        },
        by=by,
        order=["score"],
        slice_=F.col("_range"),
    ).drop("_range")


def _as_double(name: str) -> Column:
    return F.col(name).cast("double")


def curve_scores(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(by, roc_auc, average_precision) from one ordering of the scores.

    ROC-AUC is the share of (positive, negative) pairs in the right order, ties
    counting half, and null with one class only. Average precision sums over
    thresholds the recall gained times the precision there, without interpolation.
    """
    wins = _as_double("pos") * (_as_double("neg_below") + _as_double("neg") / 2)
    pairs = F.max(_as_double("pos_all")) * F.max(_as_double("neg_all"))
    hits = _as_double("pos_all") - _as_double("pos_below")
    alarms = _as_double("neg_all") - _as_double("neg_below")
    gained = F.try_divide(_as_double("pos"), _as_double("pos_all"))
    return (
        score_points(df, label, score, by, weight)
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum(wins), pairs).alias("roc_auc"),
            F.sum(gained * F.try_divide(hits, hits + alarms)).alias("average_precision"),
        )
    )


def roc_auc(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    return curve_scores(df, label, score, by, weight).drop("average_precision")


def average_precision(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    return curve_scores(df, label, score, by, weight).drop("roc_auc")


def log_loss_term(label: Column, probability: Column) -> Column:
    p = F.greatest(F.least(probability.cast("double"), F.lit(1 - EPSILON)), F.lit(EPSILON))
    return -F.when(label == 1, F.log(p)).otherwise(F.log(1 - p))


def log_loss(
    df: DataFrame, label: str, probability: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    term = log_loss_term(F.col(label), F.col(probability))
    if weight is None:
        return df.groupBy(*by).agg(F.avg(term).alias("log_loss"))
    mean = F.try_divide(F.sum(term * F.col(weight)), F.sum(weight))
    return df.groupBy(*by).agg(mean.alias("log_loss"))


def class_scores(
    df: DataFrame, label: str, score: str, threshold: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """(by, tp, fp, fn, tn, accuracy, f1) for the classes ``score > threshold``."""
    guess = F.col(score) > threshold
    truth = F.col(label) == 1

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        count(guess & truth).alias("tp"),
        count(guess & ~truth).alias("fp"),
        count(~guess & truth).alias("fn"),
        count(~guess & ~truth).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": F.try_divide((tp + tn).cast("double"), tp + fp + fn + tn),
            # Without any positive, guessed or true, the score is 0.
            "f1": F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        }
    )


def multiclass_accuracy(df: DataFrame, label: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(guess)).cast("double")).alias("accuracy"))


def mean_absolute_error(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"))


def binary_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """(by, average_precision, accuracy, f1, roc_auc), the four scores of the task."""
    curves = curve_scores(df, label, score, by)
    classes = class_scores(df, label, score, threshold, by)
    if by:
        return with_part(curves, by).join(with_part(classes, by).drop(*by), PART).select(*by, "average_precision", "accuracy", "f1", "roc_auc")
    return with_row(classes, curves, "_curves").select(
        "_curves.average_precision", "accuracy", "f1", "_curves.roc_auc"
    )


def weighted_mean_loss(df: DataFrame, loss: str, size: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over rows out of per-batch means."""
    total = F.sum(F.col(loss) * F.col(size))
    return df.groupBy(*by).agg(F.try_divide(total, F.sum(size)).alias("loss"))


# Metric a task is tuned on, and whether more is better.
TASK_TUNING = {
    "regression": ("mae", False),
    "binary_classification": ("roc_auc", True),
    "multiclass_classification": ("accuracy", True),
}


def evaluate(df: DataFrame, task_type: str, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Scores that belong to the task type; ``prediction`` is a score, a value or a score vector."""
    if task_type == "regression":
        return mean_absolute_error(df, label, prediction, by)
    if task_type == "binary_classification":
        return binary_metrics(df, label, prediction, by=by)
    if task_type == "multiclass_classification":
        guessed = df.withColumn("_guess", class_by_argmax(F.col(prediction)))
        return multiclass_accuracy(guessed, label, "_guess", by)
    raise ValueError(f"unknown task type: {task_type}")


def best_row(
    df: DataFrame,
    metric: str,
    position: str,
    by: Sequence[str] = (),
    higher_is_better: bool = True,
) -> DataFrame:
    """The row with the best metric in each group; the earliest position of equals. Null metrics do not compete."""
    goodness = F.col(metric) if higher_is_better else -F.col(metric)
    rank = F.struct(goodness.alias("goodness"), (-F.col(position)).alias("early"))
    rest = [c for c in df.columns if c not in by]
    best = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("_best"))
    return best.where(F.col("_best").isNotNull()).select(*by, "_best.*")


def patience(
    df: DataFrame,
    loss: str,
    position: str,
    limit: int,
    by: Sequence[str],
    slice_size: int = 256,
) -> DataFrame:
    """Add ``best_so_far``, ``improved`` and ``stalled`` (rows since the last improvement) and keep
    the rows a run stopping after ``limit`` stalled rows would have produced."""
    slice_ = F.floor(F.col(position) / slice_size)
    ranked = running(
        df.withColumn("_one", F.lit(1).cast("long")),
        {
            "_best_before": Running("min", loss, before=True),
            "best_so_far": Running("min", loss),
            "_rank": Running("sum", "_one"),
        },
        by=by,
        order=[position],
        slice_=slice_,
    )
    better = F.col("_best_before").isNull() | (F.col(loss) < F.col("_best_before"))
    ranked = ranked.withColumn("improved", better).withColumn("_at", F.when(better, F.col("_rank")))
    ranked = running(ranked, {"_last": Running("max", "_at")}, by=by, order=[position], slice_=slice_)
    ranked = ranked.withColumn("stalled", F.col("_rank") - F.col("_last")).withColumn(
        "_over", F.when(F.col("stalled") >= limit, F.col("_rank"))
    )
    # The first row that stalls too long is the last one kept, so a row stays if none before it does.
    ranked = running(ranked, {"_ended": Running("min", "_over", before=True)}, by=by, order=[position], slice_=slice_)
    return ranked.where(F.col("_ended").isNull()).select(*df.columns, "best_so_far", "improved", "stalled")
