"""Logistic regression by Newton's method, each step one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Regression:
    """The weights of the features and the intercept."""

    coefficients: tuple[float, ...]
    intercept: float

    def score(self, columns: Sequence[Column]) -> Column:
        """The sum of the weighted features."""
        out = F.lit(self.intercept)
        for weight, column in zip(self.coefficients, columns, strict=True):
            out = out + F.lit(weight) * column
        return out

    def probability(self, columns: Sequence[Column]) -> Column:
        return 1 / (1 + F.exp(-self.score(columns)))


@dataclass
class _Cell:
    """One penalty's search: the best weights so far, where to go from there, and how far."""

    penalty: float
    weights: np.ndarray
    loss: float = float("inf")
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    length: float = 1.0
    done: bool = False

    @property
    def tried(self) -> np.ndarray:
        return self.weights - self.length * self.step if len(self.step) else self.weights


def fit_logistic(
    rows: DataFrame,
    columns: Sequence[str],
    label: str,
    penalties: Sequence[float],
    weight: str | None = None,
    max_steps: int = 100,
    tolerance: float = 1e-10,
) -> list[Regression]:
    """A model for each penalty: the least weighted log loss plus half the penalty times the squared weights.

    The intercept is not penalised. Every step reads the rows once for all penalties: loss,
    gradient and Hessian of each are sums, added up in the tasks, so (d + 1)(d + 4) / 2 + 1 numbers for d features and a
    penalty reach the driver, which solves one small system for each. A step that doesn't lessen the loss is halved.
    Rows with a null label, feature or weight are left out. Raises when ``max_steps`` don't suffice, or without rows.
    """
    size = len(columns) + 1
    x = [*[F.col(c).cast("double") for c in columns], F.lit(1.0)]
    n, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(label).cast("double")
    known = F.lit(True)
    for c in (label, *columns, *([weight] if weight else [])):
        known = known & F.col(c).isNotNull()
    kept = rows.where(known)
    cells = [_Cell(float(p), np.zeros(size)) for p in penalties]
    for _ in range(max_steps):
        live = [c for c in cells if not c.done]
        if not live:
            break
        scores = {f"_z{k}": Regression(tuple(map(float, c.tried[:-1])), float(c.tried[-1])).score(x[:-1]) for k, c in enumerate(live)}
        placed = kept.withColumns(scores).withColumns({f"_p{k}": 1 / (1 + F.exp(-F.col(f"_z{k}"))) for k in range(len(live))})
        sums = []
        for k in range(len(live)):
            z, p = F.col(f"_z{k}"), F.col(f"_p{k}")
            loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z
            sums.append(F.sum(n * loss).alias(f"l{k}"))
            sums += [F.sum(n * (p - y) * x[i]).alias(f"g{k}_{i}") for i in range(size)]
            sums += [F.sum(n * p * (1 - p) * x[i] * x[j]).alias(f"h{k}_{i}_{j}") for i in range(size) for j in range(i + 1)]
        found = placed.agg(*sums).first().asDict()
        if found["l0"] is None:
            raise ValueError("no rows to fit")
        for k, cell in enumerate(live):
            _advance(cell, k, found, size, tolerance)
    if not all(c.done for c in cells):
        raise ValueError(f"no convergence in {max_steps} steps")
    return [Regression(tuple(map(float, c.weights[:-1])), float(c.weights[-1])) for c in cells]


def _advance(cell: _Cell, k: int, found: dict[str, float], size: int, tolerance: float) -> None:
    tried = cell.tried
    free = np.append(np.full(size - 1, cell.penalty), 0.0)
    loss = found[f"l{k}"] + 0.5 * float(free @ tried**2)
    if loss > cell.loss + 1e-12 * abs(cell.loss):
        cell.length /= 2
        # A step too short to tell the losses apart: the weights are as good as sums in doubles can say.
        cell.done = bool(np.abs(cell.length * cell.step).max() < 1e-14)
        return
    gradient = np.array([found[f"g{k}_{i}"] for i in range(size)]) + free * tried
    hessian = np.diag(free)
    for i in range(size):
        for j in range(i + 1):
            hessian[i, j] += found[f"h{k}_{i}_{j}"]
            hessian[j, i] = hessian[i, j]
    cell.weights, cell.loss, cell.length = tried, loss, 1.0
    # A column that never varies, or a class that is missing, leaves no curvature in a direction; there the step is 0.
    cell.step = np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
    cell.done = bool(gradient @ cell.step <= tolerance * tolerance * max(1.0, loss) or np.abs(cell.step).max() < tolerance)
    if cell.done:
        cell.weights = cell.weights - cell.step
