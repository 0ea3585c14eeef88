"""Queries over the supplied tables, each with the SQL that must give the same rows.

The tables stand in for ship data: ``events`` for messages of a ship (``user_id``),
``customer`` for ships with a class (``c_mktsegment``), ``orders`` for voyages and
``nation`` for ports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.base import ORACLES, QUERIES


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from workload import firsts, graph, increments, messages, models, profiles, reductions, scores, sources, splits  # noqa: F401

    return QUERIES, ORACLES
