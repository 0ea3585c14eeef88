"""Metric series, predictions and parameters of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions.labels import class_by_argmax, class_by_threshold
from seamark.schema import DOUBLE, INT, METRICS, struct

SPLITS = ["train", "val", "test"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_series(df: DataFrame, path: str) -> None:
    """A series with ``epoch`` as its first column, in epoch order."""
    rest = [c for c in df.columns if c != "epoch"]
    write_csv(df.select("epoch", *rest).orderBy("epoch"), path)


def write_predictions(df: DataFrame, path: str, task_type: str, label: str, score: str) -> None:
    """Targets and predictions of a test split, as classes for classification tasks."""
    guess = {
        "regression": F.col(score),
        "binary_classification": class_by_threshold(F.col(score)),
        "multiclass_classification": class_by_argmax(F.col(score)) if task_type.startswith("multi") else None,
    }[task_type]
    write_csv(df.select(F.col(label)), f"{path}/test_targets.csv")
    write_csv(df.select(guess.alias("predictions")), f"{path}/test_predictions.csv")


def _with_run(df: DataFrame) -> DataFrame:
    """``run``: the folder that holds the file, or the folder above for a sink's folder of part files."""
    path = F.url_decode(F.input_file_name())
    run = F.regexp_extract(path, r"([^/]+)/[^/]+\.csv(?:/[^/]*)?$", 1)
    return df.withColumn("run", run)


def read_losses(spark: SparkSession, paths: str | Sequence[str], split: str) -> DataFrame:
    """(run, epoch, loss) of every run under the paths (globs of ``<split>_loss.csv``)."""
    df = spark.read.schema(struct(("epoch", INT), ("loss", DOUBLE))).option("header", True).csv(paths)
    return _with_run(df).select("run", "epoch", "loss")


def read_metrics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(run, epoch, average_precision, accuracy, f1, roc_auc) of every run under the paths."""
    schema = struct(("epoch", INT), *[(m, DOUBLE) for m in METRICS])
    return _with_run(spark.read.schema(schema).option("header", True).csv(paths)).select("run", "epoch", *METRICS)


def write_parameters(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_parameters(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
