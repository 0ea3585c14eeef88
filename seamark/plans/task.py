"""What an entity is, judged at its n-th interaction, with a split by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.labels import mapped_label, split_label
from seamark.functions.times import hour_number
from seamark.operators.joins import attach
from seamark.operators.ranking import nth_row
from seamark.operators.reduction import sieve, sift
from seamark.schema import GROUPED_LABELS, MODE_COLUMNS

# Columns of the ship database that are kept from the model.
HIDDEN_COLUMNS = [
    "shiptype",
    "imo",
    "callsign",
    "shipname",
    "status",
    "turn",
    "speed",
    "lon",
    "lat",
    "course",
    "heading",
    "draught",
    "month",
    "day",
    "hour",
    "minute",
    "port_id",
    "port_name",
    "country_code",
    "country_name",
    "polygon",
]


@dataclass(frozen=True)
class NthInteractionTask:
    """Names and cut-offs of a static-property task. ``labels`` maps target values to numbers."""

    n: int = 500
    entity: str = "mmsi"
    time: str = "timestamp"
    target: str = "shiptype"
    time_name: str = "nth_time"
    val_start: str = "2025-04-14"
    test_start: str = "2025-04-18"
    labels: dict[str, int] | None = None
    hidden: tuple[str, ...] = tuple(HIDDEN_COLUMNS)
    task_type: str = "binary_classification"


def nth_distinct_time(interactions: DataFrame, task: NthInteractionTask, unique: bool = False) -> DataFrame:
    """(entity, nth time) for entities with at least n distinct times.

    Equal (entity, time) rows are merged in their own shuffle, where a busy
    entity spreads over its times, before anything is brought together by entity.
    ``unique`` says that there are none, as in a freshly built position table, and
    saves that shuffle.
    """
    times = interactions.select(task.entity, task.time).where(
        F.col(task.entity).isNotNull() & F.col(task.time).isNotNull()
    )
    times = times if unique else times.distinct()
    nth = nth_row(times, task.n, by=[task.entity], order=[task.time], slice_=hour_number(F.col(task.time)))
    return nth.withColumnRenamed(task.time, task.time_name)


def task_rows(
    interactions: DataFrame, entities: DataFrame, task: NthInteractionTask, unique: bool = False, reduced: bool = False
) -> DataFrame:
    """(entity, nth time, label, split): all splits at once, one column instead of three scans.

    With ``reduced``, for many entities without a label, their interactions go before any shuffle.
    """
    labels = task.labels or GROUPED_LABELS
    known = entities.select(task.entity, task.target).where(F.col(task.target).isNotNull())
    if reduced:
        interactions = sift(interactions, sieve(known, [task.entity]))
    rows = nth_distinct_time(interactions, task, unique).join(known, task.entity)
    return rows.select(
        task.entity,
        task.time_name,
        mapped_label(F.col(task.target), labels).alias(task.target),
        split_label(F.col(task.time_name), task.val_start, task.test_start).alias("split"),
    )


def task_table(
    interactions: DataFrame,
    entities: DataFrame,
    task: NthInteractionTask,
    split: str,
    mask_label: bool = False,
) -> DataFrame:
    """One split in time order; ``mask_label`` gives the public form of the test table."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split: {split}")
    rows = task_rows(interactions, entities, task).where(F.col("split") == split).drop("split")
    rows = rows.orderBy(task.time_name, task.entity)
    return rows.drop(task.target) if mask_label else rows


def with_mode_features(rows: DataFrame, ships: DataFrame, key: str = "mmsi", columns=MODE_COLUMNS) -> DataFrame:
    """Task rows with the entity's mode columns, joined by key."""
    return attach(rows, ships, key, columns)
