"""Model evaluation and feature ranking as single aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions import sqltext as X


def regression_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """MAE, RMSE, MAPE (%) over non-zero truth (0 if none), R2 and the
    number of valid rows, over rows where both values are finite. No valid
    rows -> no output row. R2 follows the finite convention: a constant
    truth gives 1 for a perfect fit, else 0."""
    fin = lambda c: f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) <> {X.INF})"
    y, p = f"CAST({X.q(truth)} AS DOUBLE)", f"CAST({X.q(pred)} AS DOUBLE)"
    v = df.where(f"{fin(y)} AND {fin(p)}").selectExpr(f"{y} AS y", f"{p} AS p")
    agg = v.selectExpr(
        "count(1) AS valid_samples",
        "avg(abs(y - p)) AS mae",
        "sqrt(avg((y - p) * (y - p))) AS rmse",
        "coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100.0, 0.0) AS mape",
        "sum((y - p) * (y - p)) AS sse",
        "var_pop(y) * count(1) AS sst")
    return agg.where("valid_samples > 0").selectExpr(
        "valid_samples", "mae", "rmse", "mape",
        "CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / sst END AS r2")


def feature_correlation(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson r of each feature with the target (NULL for a constant
    column), ranked by r descending. One aggregate, unpivoted with stack."""
    y = X.q(target)
    exprs = []
    for i, f in enumerate(features):
        x = X.q(f)
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        exprs.append(
            f"try_divide(covar_pop(CASE WHEN {both} THEN {x} END, CASE WHEN {both} THEN {y} END), "
            f"stddev_pop(CASE WHEN {both} THEN {x} END) * stddev_pop(CASE WHEN {both} THEN {y} END)) AS r{i}")
    row = df.selectExpr(*exprs)
    stack = ", ".join(f"'{f}', {i}, r{i}" for i, f in enumerate(features))
    out = row.selectExpr(f"stack({len(features)}, {stack}) AS (feature, feature_order, correlation)")
    # A 9-row result: rank over it without a partition is a one-task sort of 9 rows.
    return out.selectExpr("feature", "correlation",
                          "CAST(row_number() OVER (ORDER BY correlation DESC NULLS LAST, feature_order) AS INT) AS rank")
