"""Labels, splits and classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamark.functions.casts import timestamp
from seamark.schema import CARGO_OR_TANKER


def grouped_ship_type(ship_type: Column, members: Sequence[str] = CARGO_OR_TANKER) -> Column:
    """Two named classes. A missing ship type falls into the second one."""
    return F.when(ship_type.isin(*members), F.lit("/".join(members))).otherwise(F.lit("Other"))


def member_label(column: Column, members: Sequence[str] = CARGO_OR_TANKER) -> Column:
    return F.when(column.isin(*members), 1).otherwise(0)


def equals_label(column: Column, value: str) -> Column:
    """1 where equal, 0 elsewhere and for nulls."""
    return F.coalesce((column == value).cast("int"), F.lit(0))


def mapped_label(column: Column, mapping: Mapping[str, int]) -> Column:
    """Dictionary lookup; a value outside the mapping gives null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def split_label(ts: Column, val_start: object, test_start: object) -> Column:
    """``train`` before ``val_start``, ``val`` before ``test_start``, ``test`` from there on."""
    return (
        F.when(ts < timestamp(val_start), F.lit("train"))
        .when(ts < timestamp(test_start), F.lit("val"))
        .when(ts.isNotNull(), F.lit("test"))
    )


def class_by_threshold(score: Column, threshold: float = 0.0) -> Column:
    return (score > threshold).cast("int")


def class_by_argmax(scores: Column) -> Column:
    """Zero-based position of the largest score, the first one of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)
