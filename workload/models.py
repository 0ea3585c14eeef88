"""Fitted models, held against Newton's steps written out in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.metrics import best_row
from seamark.plans import baseline
from seamark.schema import MODE_COLUMNS, OFFSETS
from workload.base import ORACLES, Source, query
from workload.messages import mode_features
from workload.graph import neighbour_mean_features
from workload.firsts import nth_event_task
from workload.splits import SPLIT_SQL, split_features


def newton_sql(name: str, c: float, steps: int = 12) -> str:
    """Common tables that fit label and feature (y, x, n) of ``z``: intercept a, slope b with penalty b*b/2c, after each step."""
    parts = [f"{name}0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(steps):
        parts.append(f"""
{name}{i + 1} AS (
  SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b
  FROM (SELECT any_value(a) AS a, any_value(b) AS b, sum(n * (p - y)) AS ga, sum(n * (p - y) * x) + any_value(b) / {c} AS gb,
               sum(n * p * (1 - p)) AS haa, sum(n * p * (1 - p) * x) AS hab, sum(n * p * (1 - p) * x * x) + 1 / {c} AS hbb
        FROM (SELECT x, y, n, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM z, {name}{i})))""")
    return ",".join(parts)


ONE_FEATURE = f"""
{SPLIT_SQL},
r AS (SELECT split, to_bow AS x, segment AS y, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT sum(n * x) / sum(n) AS m, sqrt(sum(n * x * x) / sum(n) - (sum(n * x) / sum(n)) ** 2) AS s FROM r WHERE split = 'train'),
z AS (SELECT (x - m) / s AS x, y, n FROM r, k WHERE split = 'train')"""

LOSS = "round(sum(n * -CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) / sum(n), 5)"


@query(
    "lr_one_feature",
    f"""
WITH {ONE_FEATURE}, {newton_sql('w', 1.0)},
p AS (SELECT split, y, n, 1 / (1 + exp(-(a + b * (x - m) / s))) AS p FROM r, k, w12)
SELECT split, {LOSS} AS log_loss FROM p GROUP BY split
""",
)
def lr_one_feature(t: Source) -> DataFrame:
    scores = baseline.run_baseline(split_features(t, merged=True), ["to_bow"], "segment")
    return scores.select("split", F.round("log_loss", 5).alias("log_loss"))


STRENGTHS = [0.01, 1.0, 100.0]


@query(
    "lr_one_feature_grid",
    f"WITH {ONE_FEATURE}, "
    + ", ".join(newton_sql(f"w{i}_", c) for i, c in enumerate(STRENGTHS))
    + ", w AS ("
    + " UNION ALL ".join(f"SELECT {i} AS cell, {c}::DOUBLE AS c, a, b FROM w{i}_12" for i, c in enumerate(STRENGTHS))
    + "), p AS (SELECT cell, c, y, n, 1 / (1 + exp(-(a + b * (x - m) / s))) AS p FROM r, k, w WHERE split = 'val') "
    + f"SELECT cell, c, {LOSS} AS log_loss FROM p GROUP BY cell, c",
)
def lr_one_feature_grid(t: Source) -> DataFrame:
    trials = baseline.grid_search(split_features(t, merged=True), ["to_bow"], "segment", STRENGTHS)
    return trials.select("cell", "c", F.round("log_loss", 5).alias("log_loss"))


def many_newton_sql(name: str, size: int, c: float, steps: int = 10) -> str:
    """``newton_sql`` for features x0 .. of ``z``: weights w0 .. and, last, the intercept; each step solves its system by Gauss's method."""
    cells = range(size + 1)
    x = [f"x{i}" for i in range(size)] + ["1"]
    parts = [f"{name}0 AS (SELECT {', '.join(f'0.0::DOUBLE AS w{i}' for i in cells)})"]
    score = " + ".join(f"w{i} * {x[i]}" for i in cells)
    ridge = [f" + 1 / {c}" if i < size else "" for i in cells]
    sums = [f"any_value(w{i}) AS w{i}" for i in cells]
    sums += [f"sum(n * (p - y) * {x[i]})" + (f" + any_value(w{i}) / {c}" if i < size else "") + f" AS g{i}" for i in cells]
    sums += [f"sum(n * p * (1 - p) * {x[i]} * {x[j]})" + (ridge[i] if i == j else "") + f" AS h{i}{j}" for i in cells for j in range(i + 1)]
    solve = f"SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM z, {name}#)"
    for k in range(size):  # Gauss: each stage reads the columns of the one before
        rest = range(k + 1, size + 1)
        kept = [f"h{i}{j}" for i in range(k + 1) for j in range(i + 1)] + [f"h{i}{j}" for i in rest for j in range(k + 1)]
        kept += [f"w{i}" for i in cells] + [f"g{i}" for i in range(k + 1)]
        kept += [f"h{i}{j} - h{i}{k} * h{j}{k} / h{k}{k} AS h{i}{j}" for i in rest for j in range(k + 1, i + 1)]
        kept += [f"g{i} - h{i}{k} * g{k} / h{k}{k} AS g{i}" for i in rest]
        solve = f"SELECT {', '.join(kept)} FROM ({solve})"
    for i in reversed(cells):
        known = "".join(f" - h{k}{i} * u{k}" for k in range(i + 1, size + 1))
        solve = f"SELECT *, (g{i}{known}) / h{i}{i} AS u{i} FROM ({solve})"
    for step in range(steps):
        after = ", ".join(f"w{i} - u{i} AS w{i}" for i in cells)
        parts.append(f"{name}{step + 1} AS MATERIALIZED (SELECT {after} FROM ({solve.replace(name + '#', name + str(step))}))")
    return ",\n".join(parts)


def scaled_sql(rows: str, columns: list[str], label: str) -> str:
    """``r``: merged rows of a frame ``rows`` with a split, scaled by its training rows; ``z``: those of the training rows."""
    x = [f"x{i}" for i in range(len(columns))]
    merged = ", ".join(f"CAST({c} AS FLOAT)::DOUBLE AS {v}" for c, v in zip(columns, x))
    means = ", ".join(f"sum(n * {v}) / sum(n) AS m_{v}" for v in x)
    spreads = ", ".join(f"sqrt(sum(n * ({v} - m_{v}) ** 2) / sum(n)) AS s_{v}" for v in x)
    scaled = ", ".join(f"({v} - m_{v}) / CASE WHEN s_{v} > 0 THEN s_{v} ELSE 1 END AS {v}" for v in x)
    return f"""
q AS MATERIALIZED (SELECT split, {label} AS y, {merged}, count(*)::DOUBLE AS n FROM {rows} GROUP BY ALL),
km AS (SELECT {means} FROM q WHERE split = 'train'),
ks AS (SELECT {spreads} FROM q, km WHERE split = 'train'),
r AS MATERIALIZED (SELECT split, y, n, {scaled} FROM q, km, ks),
z AS MATERIALIZED (SELECT * FROM r WHERE split = 'train')"""


def scored_sql(weights: str, size: int) -> str:
    score = " + ".join(f"w{i} * x{i}" for i in range(size)) + f" + w{size}"
    return f"SELECT *, 1 / (1 + exp(-({score}))) AS p FROM r, {weights}"


def area_sql(points: str, by: str) -> str:
    """(by, log_loss, roc_auc) of ``points(by, y, n, p)``."""
    return f"""
SELECT {by}, round(any_value(loss), 5) AS log_loss, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 4) AS roc_auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p) - neg AS below,
             sum(loss_here) OVER (PARTITION BY {by}) / sum(pos + neg) OVER (PARTITION BY {by}) AS loss
      FROM (SELECT {by}, p, sum(n * y) AS pos, sum(n * (1 - y)) AS neg,
                   sum(n * -CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS loss_here FROM {points} GROUP BY {by}, p))
GROUP BY {by}"""


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumns({"log_loss": F.round("log_loss", 5), "roc_auc": F.round("roc_auc", 4)})


FOUR = f"{SPLIT_SQL}, {scaled_sql('f', OFFSETS, 'segment')}"


@query("lr_baseline", f"WITH {FOUR}, {many_newton_sql('w', 4, 1.0)}, p AS ({scored_sql('w10', 4)}) {area_sql('p', 'split')}")
def lr_baseline(t: Source) -> DataFrame:
    return rounded(baseline.run_baseline(split_features(t, merged=True), OFFSETS, "segment"))


@query(
    "lr_grid",
    f"WITH {FOUR}, "
    + ", ".join(many_newton_sql(f"w{i}_", 4, c) for i, c in enumerate(STRENGTHS))
    + ", p AS ("
    + " UNION ALL ".join(f"SELECT {i} AS cell, y, n, p FROM ({scored_sql(f'w{i}_10', 4)}) WHERE split = 'val'" for i in range(len(STRENGTHS)))
    + f"), a AS ({area_sql('p', 'cell')})"
    + "SELECT cell, CASE cell WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS c, log_loss, roc_auc FROM a "
    + "ORDER BY roc_auc DESC, cell LIMIT 1",
)
def lr_grid(t: Source) -> DataFrame:
    """The best cell by the area, the first of equals."""
    trials = baseline.grid_search(split_features(t, merged=True), OFFSETS, "segment", STRENGTHS)
    return best_row(rounded(trials), "roc_auc", "cell")


HARD = """
g AS (SELECT split, y, n, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS guess FROM p),
t AS (SELECT split, coalesce(sum(n) FILTER (guess = 1 AND y = 1), 0) AS tp, coalesce(sum(n) FILTER (guess = 1 AND y = 0), 0) AS fp,
             coalesce(sum(n) FILTER (guess = 0 AND y = 1), 0) AS fn, coalesce(sum(n) FILTER (guess = 0 AND y = 0), 0) AS tn FROM g GROUP BY split)
SELECT split,
  round(CASE WHEN tp + fn > 0 THEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fn) * tp / (tp + fp) ELSE 0 END)
                                   + fn / (tp + fn) * (tp + fn) / (tp + fn + fp + tn) END, 6) AS average_precision,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CASE WHEN (tp + fn) * (tn + fp) > 0 THEN (tp * tn + (tp * fp + fn * tn) / 2) / ((tp + fn) * (tn + fp)) END, 6) AS roc_auc
FROM t"""


@query(
    "lr_mode_features",
    f"""
WITH mf AS ({ORACLES['mode_features']}),
f AS (SELECT * FROM mf WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ['mmsi', 'nth_time', 'shiptype', *MODE_COLUMNS])}),
{scaled_sql('f', MODE_COLUMNS, 'shiptype')}, {many_newton_sql('w', 4, 1.0)}, p AS ({scored_sql('w10', 4)}), {HARD}
""",
)
def lr_mode_features(t: Source) -> DataFrame:
    rows = mode_features(t).na.drop("any")
    scores = baseline.run_mode_baseline(rows, MODE_COLUMNS, "shiptype")
    return scores.withColumns({c: F.round(c, 6) for c in ("average_precision", "accuracy", "f1", "roc_auc")})


@query(
    "lr_on_neighbourhood",
    f"""
WITH task AS ({ORACLES['nth_event_task']}), near AS ({ORACLES['neighbour_mean_features']}),
f AS (SELECT segment, split, own_value, same_type_value FROM task JOIN near USING (user_id)),
{scaled_sql('f', ['own_value', 'same_type_value'], 'segment')}, {many_newton_sql('w', 2, 1.0)},
p AS ({scored_sql('w10', 2)}) {area_sql('p', 'split')}
""",
)
def lr_on_neighbourhood(t: Source) -> DataFrame:
    features = neighbour_mean_features(t).drop("nth_time")
    rows = nth_event_task(t).join(features, "user_id")
    return rounded(baseline.run_baseline(rows, ["own_value", "same_type_value"], "segment"))


@query(
    "text_vectors",
    """
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT p_partkey, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 300 AS dimension, count(*) AS n
FROM w WHERE word <> '' GROUP BY ALL
""",
)
def text_vectors(t: Source) -> DataFrame:
    """Hashed words of each part name."""
    return baseline.text_vectors(t.part, "p_partkey", "p_name")
