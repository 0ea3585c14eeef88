"""Reports over training runs and parameter searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.operators.joins import align
from seamark.operators.metrics import best_row
from seamark.schema import METRICS
from seamark.sources.results import SPLITS, read_losses, read_metrics

# The searched parameter lists.
TRAINING_GRID = {
    "n_epochs": [100, 150, 200],
    "learning_rate": [5e-4, 5e-5, 5e-6],
    "step_size": [500, 1000],
    "gamma": [0.5, 0.9],
    "batch_size": [64, 128, 256],
}


def series(frames: Mapping[str, DataFrame], keys: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """Splits side by side per run and epoch; a run that lacks one keeps its rows."""
    return align(frames, keys)


def best_epochs(
    aligned: DataFrame,
    tuned: str = "val_roc_auc",
    by: Sequence[str] = ("run",),
    higher_is_better: bool = True,
    position: str = "epoch",
) -> DataFrame:
    """All series of each run at its best epoch: the val metric chooses, the test metrics are read there."""
    return best_row(aligned, tuned, position, by, higher_is_better)


def run_report(spark: SparkSession, folder: str, tuned: str = "val_roc_auc", higher_is_better: bool = True) -> DataFrame:
    """One row per run below ``folder``: its best epoch with all losses and metrics there, those of the test split included.

    Reads ``<run>/<split>_loss.csv`` and ``<run>/<split>_metrics.csv`` of all runs. A run that lacks a file has nulls for it.
    """
    frames = {}
    for split in SPLITS:
        losses = read_losses(spark, f"{folder}/*/{split}_loss.csv", split)
        frames[split] = align({"": losses, "of": read_metrics(spark, f"{folder}/*/{split}_metrics.csv")}, ("run", "epoch"))
        frames[split] = frames[split].select(
            "run", "epoch", F.col("_loss").alias("loss"), *[F.col(f"of_{m}").alias(m) for m in METRICS]
        )
    return best_epochs(series(frames), tuned, higher_is_better=higher_is_better)


def parameter_grid(spark: SparkSession, lists: Mapping[str, Sequence] = TRAINING_GRID) -> DataFrame:
    """(cell, parameters) in search order, the last list changing fastest."""
    cells = [(i, *values) for i, values in enumerate(product(*lists.values()))]
    return spark.createDataFrame(cells, ["cell", *lists])


def best_trial(trials: DataFrame, score: str, cell: str = "cell", higher_is_better: bool = True) -> DataFrame:
    """The winning trial; the first one tried of equals."""
    return best_row(trials.withColumn("_pos", F.col(cell)), score, "_pos", (), higher_is_better).drop("_pos")
