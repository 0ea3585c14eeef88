"""Logistic-regression baselines.

Offsets are whole metres, so very many messages share a feature vector. Rows are
merged to (split, features, label, rows) with map-side combining before scaling
and fitting, and the counts serve as weights: same objective, far less data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.casts import fill_text, float_features
from seamark.operators import metrics
from seamark.operators.ranking import with_row
from seamark.operators.regression import Regression, fit_logistic
from seamark.session import write_out

WEIGHT = "rows"


def merge_equal(df: DataFrame, columns: Sequence[str], label: str, split: str = "split") -> DataFrame:
    """(split, label, float features, rows); a frame that has ``rows`` already is summed up further."""
    rows = F.sum(WEIGHT) if WEIGHT in df.columns else F.count("*")
    return float_features(df, columns).groupBy(split, label, *columns).agg(rows.alias(WEIGHT))


def fit_scaler(train: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row: ``mean_x`` and population ``std_x`` of each column, 1 in place of a deviation of 0."""
    if weight is None:
        means = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns])
        weights = F.lit(1)
    else:
        weights = F.col(weight)
        means = train.agg(
            *[(F.sum(weights * F.col(c).cast("double")) / F.sum(weights)).alias(f"mean_{c}") for c in columns]
        )
    out = []
    for c in columns:
        centred = F.col(c).cast("double") - F.col(f"_row.mean_{c}")
        std = F.sqrt(F.sum(weights * centred * centred) / F.sum(weights))
        out += [F.max(f"_row.mean_{c}").alias(f"mean_{c}"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"std_{c}")]
    return with_row(train, means, "_row").agg(*out)


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std with the one row of ``fit_scaler``, read as a scalar subquery."""
    scaled = {c: (F.col(c).cast("double") - F.col(f"_row.mean_{c}")) / F.col(f"_row.std_{c}") for c in columns}
    return with_row(df, scaler, "_row").withColumns(scaled).drop("_row")


@dataclass(frozen=True)
class Baseline:
    """A fitted scaler and model."""

    scaler: DataFrame
    model: Regression
    columns: tuple[str, ...]

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Add the probability of class 1, null where a feature is."""
        row = self.scaler.first().asDict()  # literals, no scan
        scaled = [(F.col(c).cast("double") - row[f"mean_{c}"]) / row[f"std_{c}"] for c in self.columns]
        return df.withColumn(name, self.model.probability(scaled))


def fit_baselines(
    train: DataFrame, columns: Sequence[str], label: str, strengths: Sequence[float], weight: str | None = None, max_iter: int = 100
) -> list[Baseline]:
    """Scaler on the training rows and an L2 model for each inverse strength, all fitted in the same scans.

    The objective is the summed loss times the strength plus half the squared weights; the intercept is not penalised.
    """
    # One row of a dozen numbers, fixed here so later plans do not fit it again.
    values = fit_scaler(train, columns, weight).first().asDict()
    scaler = train.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    models = fit_logistic(scale(train, scaler, columns), columns, label, [1.0 / c for c in strengths], weight, max_iter)
    return [Baseline(scaler, m, tuple(columns)) for m in models]


def fit_baseline(
    train: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, c: float = 1.0, max_iter: int = 100
) -> Baseline:
    return fit_baselines(train, columns, label, [c], weight, max_iter)[0]


def scores_by_split(scored: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(split, log_loss, roc_auc) of merged rows with their probability."""
    losses = metrics.log_loss(scored, label, "probability", [split], WEIGHT)
    return losses.join(metrics.roc_auc(scored, label, "probability", [split], WEIGHT), split)


def run_baseline(features: DataFrame, columns: Sequence[str], label: str, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Fit on the train split of a frame with a ``split`` column and score every split."""
    rows = write_out(merge_equal(features, columns, label), "merged-features")
    model = fit_baseline(rows.where(F.col("split") == "train"), columns, label, WEIGHT, c, max_iter)
    return scores_by_split(model.predict(rows), label)


def run_mode_baseline(rows: DataFrame, columns: Sequence[str], label: str, max_iter: int = 100) -> DataFrame:
    """One row per entity; the hard 0/1 predictions themselves are scored, by split."""
    rows = write_out(rows.select("split", label, *columns), "mode-features")
    model = fit_baseline(rows.where(F.col("split") == "train"), columns, label, max_iter=max_iter)
    guessed = model.predict(rows).withColumn("guess", (F.col("probability") > 0.5).cast("double"))
    return metrics.binary_metrics(guessed, label, "guess", 0.5, ["split"])


def grid_search(features: DataFrame, columns: Sequence[str], label: str, strengths: Sequence[float], max_iter: int = 100) -> DataFrame:
    """(cell, c, log_loss, roc_auc) on the val split for each inverse strength; ``best_row`` picks.

    All cells are fitted in the same scans, and scored in one.
    """
    rows = write_out(merge_equal(features, columns, label), "merged-features")
    models = fit_baselines(rows.where(F.col("split") == "train"), columns, label, strengths, WEIGHT, max_iter)
    scored = rows.where(F.col("split") == "val")
    cells = []
    for cell, (c, model) in enumerate(zip(strengths, models, strict=True)):
        scored = model.predict(scored, f"_p{cell}")
        cells.append(F.struct(F.lit(cell).alias("cell"), F.lit(float(c)).alias("c"), F.col(f"_p{cell}").alias("probability")))
    long = scored.select(label, WEIGHT, F.inline(F.array(*cells)))
    found = scores_by_split(long.withColumn("_cell", F.struct("cell", "c")), label, "_cell")
    return found.select("_cell.cell", "_cell.c", "log_loss", "roc_auc")


def text_vectors(df: DataFrame, key: str, column: str, size: int = 300) -> DataFrame:
    """(key, dimension, n): hashed word counts of a text column, the entries that are not 0.

    A word is what white space separates, in lower case; its dimension is the
    start of its MD5 as a number, modulo ``size``. Missing text reads ``Unknown``.
    Rows of equal keys are one text.
    """
    words = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")
    flat = fill_text(df.select(key, column), [column]).select(key, F.explode(words).alias("_word"))
    place = F.conv(F.substring(F.md5(F.col("_word").cast("binary")), 1, 8), 16, 10).cast("long") % size
    return flat.groupBy(key, place.alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
