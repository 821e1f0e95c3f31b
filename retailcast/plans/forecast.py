"""Recursive month-by-month forecasts for every product at once.

State: one row per product holding the last three values (actual, then
predicted), the history length, the product's stable statistics and its
12-month seasonal profile. Each step computes features, scores them, clamps
the score and shifts the three values; there is no shuffle.

With a ``LinearScorer`` or a tree ensemble (``boosting.Ensemble``, to which
fitted MLlib tree models convert) the whole recursion is one expression: an
``aggregate`` over the steps whose lambda variables carry the state, so nothing
is inlined and no step needs a job. Any other MLlib model scores all products
in one transform per step, and the state is checkpointed between steps.

Two modes, as in the source:
* ``core``: rolling mean of the last min(3, n) values, growth = mean growth
  x 0.8, orders = mean orders x seasonal index;
* ``plain``: rolling mean of the last 3 values or the product mean when
  fewer, undamped growth, orders = mean orders; a failed score falls back to
  the rounded product mean.

Every product of the history gets every step. One whose history has no value
at all (its months matched no row of the table that holds the target) has
nothing to go on: its forecasts are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions import sqltext as X
from retailcast.operators.features import seasonal_profile
from retailcast.plans.core_table import MODEL_FEATURES
from retailcast.session import cut_lineage

# Growth damping of the core mode.
GROWTH_DAMPING = 0.8
# For MLlib models that are not trees: each step's prediction feeds several features of the next;
# left in one plan, Catalyst would inline it into every use and the expression
# would grow exponentially with the horizon. The state (one row per product)
# is checkpointed after every step instead.
CHECKPOINT_EVERY = 1


@dataclass
class LinearScorer:
    """prediction = intercept + sum(weight * feature). A missing feature counts
    as 0, or makes the score NULL if ``missing_fails``."""
    weights: dict[str, float]
    intercept: float = 0.0
    missing_fails: bool = False

    def sql(self, prefix: str) -> str:
        terms = [f"CAST({self.intercept!r} AS DOUBLE)"]
        terms += [f"CAST({w!r} AS DOUBLE) * " + (f"{prefix}{c}" if self.missing_fails else f"coalesce({prefix}{c}, 0.0)")
                  for c, w in self.weights.items()]
        return "(" + " + ".join(terms) + ")"


# A plain weighted scorer over the nine features (used by the registered
# queries; the weights are a parameter, not learned).
DEFAULT_LINEAR = LinearScorer({
    "rolling_3m_qty": 0.5, "mean_qty_per_product": 0.2, "lag_1_qty": 0.2, "seasonal_index": 1.0,
    "trend_qty": 0.1, "lag_2_qty": 0.05, "mom_growth_qty": 0.5, "lag_3_qty": 0.05, "total_orders": 0.0})


def future_months(history: DataFrame, n: int, key: str = "product_key", month: str = "month") -> DataFrame:
    """M5: the n month starts after each product's last month."""
    last = history.groupBy(key).agg(F.max(month).alias("__last"))
    return last.select(key, F.explode(F.sequence(F.add_months("__last", 1), F.add_months("__last", n),
                                                 F.expr("INTERVAL 1 MONTH"))).alias("month"))


def forecast_state(history: DataFrame, *, key: str = "product_key", month: str = "month",
                   value: str = "total_qty", growth: str | None = "mom_growth_qty",
                   orders: str | None = "total_orders") -> DataFrame:
    """One row per product: last three non-missing values (h1 newest), their
    count, mean value, mean growth, mean orders, last month, seasonal map."""
    # read by three aggregates: a checkpoint of just these columns keeps the history's plan from being run for each
    needed = dict.fromkeys(c for c in (key, month, value, growth, orders) if c)
    h = cut_lineage(history.where(F.col(month).isNotNull()).select(*needed))
    stats = h.groupBy(key).agg(
        F.avg(value).alias("mean_value"),
        (F.avg(growth) if growth else F.lit(0.0)).alias("mean_growth"),
        (F.avg(orders) if orders else F.lit(1.0)).alias("mean_orders"),
        F.max(month).alias("last_month"),
        F.count(value).alias("cnt"))
    w = Window.partitionBy(key).orderBy(F.col(month).desc())
    last3 = (h.where(F.col(value).isNotNull())
              .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 3)
              .groupBy(key).agg(*[F.max(F.when(F.col("__rn") == i, F.col(value).cast("double"))).alias(f"h{i}")
                                  for i in (1, 2, 3)]))
    prof = seasonal_profile(h.where(F.col(value).isNotNull()), col=value, key=key, month=month)
    return stats.join(last3, key, "left").join(prof, key, "left")


def _step_features(mode: str, month: str, state: str = "") -> dict[str, str]:
    """Feature -> SQL over the state (``state`` prefixes the parts that change) and the step's month."""
    h1, h2, h3, cnt = (f"{state}{c}" for c in ("h1", "h2", "h3", "cnt"))
    seasonal = f"coalesce(element_at(seasonal, CAST(month({month}) AS INT)), 1.0)"
    if mode == "core":
        rolling = (f"CASE WHEN {cnt} >= 3 THEN (({h3} + {h2}) + {h1}) / 3.0 "
                   f"WHEN {cnt} = 2 THEN ({h2} + {h1}) / 2.0 ELSE {h1} END")
        growth = f"mean_growth * {GROWTH_DAMPING!r}"
        orders = f"mean_orders * {seasonal}"
    else:
        rolling = f"CASE WHEN {cnt} >= 3 THEN (({h3} + {h2}) + {h1}) / 3.0 ELSE mean_value END"
        growth = "mean_growth"
        orders = "mean_orders"
    trend = (f"greatest(0.0, CASE WHEN {cnt} >= 3 THEN ({h1} - {h3}) / 2.0 WHEN {cnt} = 2 THEN {h1} - {h2} "
             "ELSE 0.0 END)")
    return {c: f"CAST({x} AS DOUBLE)" for c, x in {
        "rolling_3m_qty": rolling, "mean_qty_per_product": "mean_value", "lag_1_qty": h1,
        "seasonal_index": seasonal, "trend_qty": trend,
        "lag_2_qty": f"CASE WHEN {cnt} >= 2 THEN {h2} ELSE 0.0 END", "mom_growth_qty": growth,
        "lag_3_qty": f"CASE WHEN {cnt} >= 3 THEN {h3} ELSE 0.0 END", "total_orders": orders}.items()}


def _prediction(raw: str, mode: str) -> str:
    """The clamped whole forecast of a raw score; NULL for a product without any value."""
    fallback = "CAST(bround(mean_value, 0) AS BIGINT)" if mode == "plain" else "CAST(0 AS BIGINT)"
    return (f"CASE WHEN mean_value IS NULL THEN CAST(NULL AS BIGINT) WHEN {raw} IS NULL OR isnan({raw}) "
            f"THEN {fallback} ELSE CAST(greatest(0.0, bround({raw}, 0)) AS BIGINT) END")


ENTRY = ("struct<step:int,month:date,forecast:bigint,"
         + ",".join(f"feature_{c}:double" for c in MODEL_FEATURES) + ">")


def _entry(step: str, month: str, prediction: str, prefix: str) -> str:
    return (f"named_struct('step', {step}, 'month', {month}, 'forecast', {prediction}, "
            + ", ".join(f"'feature_{c}', {prefix}{c}" for c in MODEL_FEATURES) + ")")


def as_scorer(model):
    """Tree models of MLlib as an expression; everything else as it is."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel

    from retailcast.plans.boosting import ensemble_of
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    return ensemble_of(model) if isinstance(last, (GBTRegressionModel, DecisionTreeRegressionModel)) else model


def _expression_steps(n: int, scorer, mode: str) -> str:
    """All n steps as one array expression over the columns of the state.

    ``let`` binds a value to a lambda variable, which is computed once and not inlined.
    """
    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    month = "add_months(last_month, i)"
    feats = "named_struct(" + ", ".join(f"'{c}', {x}" for c, x in _step_features(mode, month, "s.").items()) + ")"
    after = ("named_struct('h1', CAST(p AS DOUBLE), 'h2', s.h1, 'h3', s.h2, 'cnt', s.cnt + 1, 'steps', "
             f"concat(s.steps, array({_entry('i', month, 'p', 'f.')})))")
    step = let(feats, "f", let(scorer.sql("f."), "raw", let(_prediction("raw", mode), "p", after)))
    start = f"named_struct('h1', h1, 'h2', h2, 'h3', h3, 'cnt', cnt, 'steps', CAST(array() AS array<{ENTRY}>))"
    return f"aggregate(sequence(1, {n}), {start}, (s, i) -> {step}, s -> s.steps)"


def forecast_recursive(history: DataFrame, n: int = 6, *, scorer=DEFAULT_LINEAR, mode: str = "core",
                       key: str = "product_key", month: str = "month", value: str = "total_qty",
                       growth: str | None = "mom_growth_qty", orders: str | None = "total_orders",
                       checkpoint_every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Forecast n months for every product. Output: key, month, step,
    forecast (whole, >= 0, NULL without any history value) and the features
    used, ``feature_*`` (M10).

    ``scorer``: a ``LinearScorer`` or another scorer with a ``sql`` method (an
    ``Ensemble``); the ``PipelineModel`` of ``train_gbt`` (also after saving
    and loading), which takes the nine ``MODEL_FEATURES`` by name; or a bare
    MLlib model whose input is their vector (column ``features``) and whose
    output column is ``prediction``."""
    scorer = as_scorer(scorer)
    st = forecast_state(history, key=key, month=month, value=value, growth=growth, orders=orders)
    if hasattr(scorer, "sql"):
        out = st.select(key, F.expr(_expression_steps(n, scorer, mode)).alias("steps"))
    else:
        out = _model_steps(st, n, scorer, mode, checkpoint_every).select(key, "steps")
    out = out.select(key, F.explode("steps").alias("o"))
    return out.select(key, F.col("o.month").alias("month"), F.col("o.step").alias("step"),
                      F.col("o.forecast").alias("forecast"),
                      *[F.col(f"o.feature_{c}").alias(f"feature_{c}") for c in MODEL_FEATURES])


def _model_steps(st: DataFrame, n: int, model, mode: str, checkpoint_every: int) -> DataFrame:
    """The state after n steps of a fitted MLlib model; ``steps`` holds what each gave (at most n entries)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    if not isinstance(model, PipelineModel):
        va = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features", handleInvalid="keep")
        model = PipelineModel([va, model])
    base = [c for c in st.columns]
    st = st.withColumn("steps", F.array().cast(f"array<{ENTRY}>"))
    for i in range(1, n + 1):
        st = st.selectExpr(*[X.q(c) for c in [*base, "steps"]], f"add_months(last_month, {i}) AS `__m`")
        st = st.selectExpr("*", *[f"{x} AS {X.q(c)}" for c, x in _step_features(mode, "`__m`").items()])
        st = model.transform(st).withColumnRenamed("prediction", "__raw")
        st = st.selectExpr("*", f"{_prediction('`__raw`', mode)} AS `__pred`")
        shifted = {"h3": "h2", "h2": "h1", "h1": "CAST(`__pred` AS DOUBLE)", "cnt": "cnt + 1",
                   "steps": f"concat(steps, array({_entry(str(i), '`__m`', '`__pred`', '')}))"}
        st = st.selectExpr(*[f"{shifted[c]} AS {X.q(c)}" if c in shifted else X.q(c) for c in [*base, "steps"]])
        if checkpoint_every and i % checkpoint_every == 0:
            st = cut_lineage(st)
    return st


def forecast_growth(forecast: DataFrame, history: DataFrame, key: str = "product_key",
                    month: str = "month", value: str = "total_qty") -> DataFrame:
    """M9: forecast change against the latest actual, in percent."""
    w = Window.partitionBy(key).orderBy(F.col(month).desc())
    last = (history.where(F.col(value).isNotNull()).withColumn("__rn", F.row_number().over(w))
                   .where("__rn = 1").select(key, F.col(value).alias("last_actual")))
    j = forecast.join(last, key, "left")
    return j.withColumn("growth_pct", F.expr(X.ieee("forecast - last_actual", "last_actual")) * 100.0)


def history_and_forecast(history: DataFrame, forecast: DataFrame, key: str = "product_key",
                         month: str = "month", value: str = "total_qty") -> DataFrame:
    """Actual rows followed by forecast rows, one series per product."""
    a = history.where(F.col(value).isNotNull()).select(
        key, F.col(month).alias("month"), F.col(value).cast("double").alias("value"), F.lit("actual").alias("kind"))
    f = forecast.select(key, "month", F.col("forecast").cast("double").alias("value"), F.lit("forecast").alias("kind"))
    return a.unionByName(f)
