"""Regularised boosted trees on a binned matrix (M2, M4) and their scorers.

Training reads a matrix of bin numbers, checkpointed once:

1. A feature with at most ``max_bins`` distinct values has a bin for each, any
   other one quantile bins; missing values have bin 0.
2. A tree grows level by level. One Spark job per level sums the gradients of
   squared error by (model, node, feature, bin): each task adds up its rows batch
   by batch in numpy, so a hot bin is one row per task. Gradients are rounded to
   a power of two and summed as whole numbers: trees do not depend on
   partitioning or retries.
3. The driver picks each node's split from its histogram (at most features x
   bins numbers) by the second-order gain with L1 and L2 terms, for both ways
   that missing values can go.
4. Predictions since the last checkpoint follow from the bins and the new trees;
   every ``CHECKPOINT_TREES`` trees they are checkpointed with the matrix.

Several models (grid points x folds) grow in the same jobs over the same
matrix: the number of jobs is trees x depth, however many models there are.

A finished ensemble is four flat arrays and is evaluated by one ``aggregate``
expression (:meth:`Ensemble.sql`), so it fits inside other expressions, the
forecast's recursion among them; fitted MLlib models convert to it.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.functions import sqltext as X
from retailcast.plans.core_table import MODEL_FEATURES
from retailcast.plans.train import split_bucket
from retailcast.session import cut_lineage, map_in_arrow, scratch_path

MAX_BINS = 255
CHECKPOINT_TREES = 10
LEAST_GAIN = 1e-6
NO_FOLD = -(1 << 31)


@dataclass(frozen=True)
class BoostSettings:
    """The tuned settings of the source's booster, and its defaults for the rest."""

    trees: int = 300
    depth: int = 3
    rate: float = 0.2
    l1: float = 0.1
    l2: float = 1.5
    min_gain: float = 0.0
    min_child: float = 1.0


@dataclass
class Ensemble:
    """Complete binary trees: node ``n`` of a tree has the children 2n + 1 and 2n + 2.

    A row goes right where its value is above the threshold; missing values
    (NULL, NaN) go right unless ``missing_left``. A node without a split has
    feature -1 and sends all rows left; the leaves under it are alike.
    """

    features: list[str]
    depth: int
    base: float = 0.0
    feature: list[int] = field(default_factory=list)        # trees x (2**depth - 1)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[int] = field(default_factory=list)
    leaf: list[float] = field(default_factory=list)         # trees x 2**depth
    stats: list[dict] = field(default_factory=list)         # of trained models: what each node holds

    @property
    def trees(self) -> int:
        return len(self.leaf) >> self.depth

    def sql(self, prefix: str = "") -> str:
        """The prediction over columns ``prefix + feature``, one expression whatever the number of trees."""
        values = "array(" + ", ".join(f"CAST({prefix}{X.q(c)} AS DOUBLE)" for c in self.features) + ")"
        total = sum_of_trees("x", self.depth, self.trees, "0", literal(self.feature, "int"),
                             literal(self.threshold, "double"), literal(self.missing_left, "int"),
                             literal(self.leaf, "double"), "(v IS NULL OR isnan(v))")
        return f"transform(array({values}), x -> CAST({self.base!r} AS DOUBLE) + {total})[0]"

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.selectExpr("*", f"{self.sql()} AS {X.q(out)}")

    def save(self, spark: SparkSession, path: str) -> None:
        """K3: one JSON row; an ensemble is small whatever the data."""
        text = json.dumps({k: v for k, v in self.__dict__.items()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        return Ensemble(**json.loads(spark.read.text(path).first()[0]))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(round, node, kind, feature, threshold, n_rows, value) of a trained model's nodes."""
        return spark.createDataFrame(
            [(s["round"], s["node"], s["kind"], s["feature"], s["threshold"], s["n_rows"], s["value"]) for s in self.stats],
            "round int, node int, kind string, feature string, threshold double, n_rows long, value double")


def literal(values: list, kind: str) -> str:
    """An array constant: parsed once while the plan is optimised, not one node per number."""
    text = json.dumps(values).replace("Infinity", '"Infinity"')
    return f"from_json('{text}', 'array<{kind}>')"


def sum_of_trees(x: str, depth: int, trees: int, first: str, feature: str, threshold: str, missing_left: str, leaf: str,
                 missing: str) -> str:
    """Sum of the leaves that the values ``x`` reach in ``trees`` trees from number ``first`` on."""
    if not trees:
        return "CAST(0 AS DOUBLE)"
    nodes, leaves = (1 << depth) - 1, 1 << depth
    at = f"({first} + t) * {nodes} + n"
    step = goes_right(x, f"{feature}[{at}]", f"{threshold}[{at}]", f"{missing_left}[{at}]", missing)
    end = f"aggregate(sequence(1, {depth}), 0, (n, i) -> 2 * n + 1 + {step})" if depth else "0"
    return (f"aggregate(sequence(0, {trees - 1}), CAST(0 AS DOUBLE), "
            f"(s, t) -> s + {leaf}[({first} + t) * {leaves} + {end} - {nodes}])")


def goes_right(x: str, feature: str, threshold: str, missing_left: str, missing: str) -> str:
    return (f"transform(array({feature}), f -> IF(f < 0, 0, transform(array({x}[f]), v -> "
            f"IF({missing}, 1 - {missing_left}, IF(v > {threshold}, 1, 0)))[0]))[0]")


# --- bins -----------------------------------------------------------------------
def bin_edges(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Upper ends of all bins but the last, per feature: the distinct values where they are few, else quantiles."""
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features}
    parts = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    row = df.agg(*[F.percentile_approx(v, parts, 100 * max_bins).alias(f"q{i}") for i, v in enumerate(value.values())],
                 *[F.approx_count_distinct(v, 0.05).alias(f"n{i}") for i, v in enumerate(value.values())]).first()
    few = [i for i in range(len(features)) if row[f"n{i}"] <= 2 * max_bins]
    distinct: dict[int, list[float]] = {i: [] for i in few}
    if few:   # a few hundred values of each
        items = F.array(*[F.struct(F.lit(i).alias("i"), value[features[i]].alias("v")) for i in few])
        for r in df.select(F.explode(items).alias("x")).select("x.i", "x.v").where("v IS NOT NULL").distinct().collect():
            distinct[r["i"]].append(r["v"])
    return [sorted(distinct[i])[:-1] if i in distinct and len(distinct[i]) <= max_bins
            else sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def bin_number(value: str, edges: list[float]) -> str:
    """0 for a missing value, else 1 and the number of edges below it, by binary search."""
    if not edges:
        return f"IF({value} IS NULL OR isnan({value}), 0, 1)"
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    e = literal(edges, "double")
    found = (f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> IF(p + s <= {len(edges)} AND "
             f"{e}[least(p + s, {len(edges)}) - 1] < {value}, p + s, p))")
    return f"IF({value} IS NULL OR isnan({value}), 0, 1 + {found})"


# --- training ---------------------------------------------------------------------
@dataclass
class _Growing:
    """A model while it grows: the trees so far and the nodes of the present one."""

    settings: BoostSettings
    left_out: int | None
    base: float = 0.0
    model: Ensemble | None = None
    nodes: dict[int, dict] = field(default_factory=dict)


def _score(g, h, s: BoostSettings):
    t = np.maximum(np.abs(g) - s.l1, 0.0)
    return np.divide(t * t, h + s.l2, out=np.zeros_like(t), where=np.asarray(h + s.l2) > 0)


def leaf_value(g: float, h: float, s: BoostSettings) -> float:
    return -math.copysign(max(abs(g) - s.l1, 0.0), g) / (h + s.l2) * s.rate if h + s.l2 else 0.0


def best_split(g: np.ndarray, h: np.ndarray, s: BoostSettings) -> tuple | None:
    """(gain, feature, bin, missing left, left sums) from (features x bins) sums; ties go to the first feature and bin."""
    total_g, total_h = g[0].sum(), h[0].sum()
    parent = _score(total_g, total_h, s)
    best = None
    for f in range(len(g)):
        left_g, left_h = np.cumsum(g[f, 1:])[:-1], np.cumsum(h[f, 1:])[:-1]
        for missing_left in (0, 1) if h[f, 0] else (0,):
            a, n = left_g + missing_left * g[f, 0], left_h + missing_left * h[f, 0]
            gain = _score(a, n, s) + _score(total_g - a, total_h - n, s) - parent
            gain = np.where((n >= s.min_child) & (total_h - n >= s.min_child), gain, -np.inf)
            if not len(gain):
                continue
            at = int(np.argmax(gain))
            if gain[at] > max(s.min_gain, LEAST_GAIN) and (best is None or gain[at] > best[0]):
                best = (float(gain[at]), f, at + 1, missing_left, float(a[at]), float(n[at]))
    return best


def boost(train: DataFrame, features: list[str], target: str, models: list[tuple[BoostSettings, int | None]],
          fold: str | None = None, max_bins: int = MAX_BINS) -> tuple[list[Ensemble], DataFrame]:
    """One ensemble per (settings, fold left out), grown together, and the frame (y, fold, preds).

    ``preds`` holds every model's prediction of every row. Rows without a
    target are left out.
    """
    source = cut_lineage(train.where(F.col(f"`{target}`").isNotNull() & ~F.isnan(F.col(f"`{target}`").cast("double"))).select(
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(f"`{target}`").cast("double").alias("__y"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("__fold")))
    edges = bin_edges(source, features, max_bins)
    sums = {r["__fold"]: r for r in source.groupBy("__fold").agg(
        F.sum(F.col("__y").cast("decimal(38,9)")).alias("s"), F.count(F.lit(1)).alias("n"),
        F.max(F.abs("__y")).alias("top")).collect()}   # one row per fold
    grown = []
    for settings, left_out in models:
        own = [r for k, r in sums.items() if k != left_out]
        n = sum(r["n"] for r in own)
        base = float(sum(r["s"] for r in own)) / n if n else 0.0
        grown.append(_Growing(settings, left_out, base))
    n_all, top = sum(r["n"] for r in sums.values()), max((r["top"] for r in sums.values()), default=0.0)
    scale = 2.0 ** min(30, math.floor(61 - math.log2(max(n_all, 1) * 4 * max(top, 1e-9))))
    depth = max((m.settings.depth for m in grown), default=0)
    for m in grown:
        m.model = Ensemble(list(features), depth, m.base)
    bins = ", ".join(bin_number(X.q(c), e) for c, e in zip(features, edges))
    rows = cut_lineage(source.selectExpr(f"array({bins}) AS bins", "`__y` AS y", "`__fold` AS fold",
                                         "CAST(array() AS array<double>) AS preds"))
    done = 0   # trees that preds holds
    width = max((len(e) for e in edges), default=0) + 2
    for k in range(max((m.settings.trees for m in grown), default=0)):
        _grow(rows, grown, k, done, depth, width, edges, scale)
        if k + 1 - done == CHECKPOINT_TREES:
            rows = cut_lineage(_with_predictions(rows, grown, done, depth, edges))
            done = k + 1
    return [m.model for m in grown], _with_predictions(rows, grown, done, depth, edges, last=True)


@dataclass
class _Trees:
    """The trees after number ``done`` of all models, models x trees x nodes, with bins for thresholds."""

    depth: int
    base: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    leaf: np.ndarray

    def predictions(self, m: int, bins: np.ndarray, preds: np.ndarray) -> np.ndarray:
        """Model ``m``'s prediction of every row; ``preds`` holds those up to number ``done``, or no column yet."""
        more = np.zeros(len(bins))
        for t in range(self.feature.shape[1]):
            at = walk(bins, self.depth, self.feature[m, t], self.bin[m, t], self.missing_left[m, t])
            more += self.leaf[m, t][at - self.feature.shape[2]]
        return (preds[:, m] if preds.shape[1] else self.base[m]) + more


def _new_trees(grown: list[_Growing], done: int, depth: int, edges) -> _Trees:
    nodes, leaves = (1 << depth) - 1, 1 << depth
    place = [{v: i + 1 for i, v in enumerate(e)} for e in edges]

    def part(of, size, kind):
        return np.array([of(g.model)[done * size:] for g in grown], kind).reshape(len(grown), -1, size)

    def bins(x):
        return [place[i][v] if i >= 0 else 0 for i, v in zip(x.feature, x.threshold)]

    if not nodes:   # trees of one leaf
        none = np.zeros((len(grown), grown[0].model.trees - done, 0), np.int32)
        return _Trees(depth, np.array([g.base for g in grown]), none, none, none, part(lambda x: x.leaf, leaves, float))
    return _Trees(depth, np.array([g.base for g in grown]), part(lambda x: x.feature, nodes, np.int32),
                  part(bins, nodes, np.int32), part(lambda x: x.missing_left, nodes, np.int32),
                  part(lambda x: x.leaf, leaves, float))


def walk(bins: np.ndarray, levels: int, feature: np.ndarray, split: np.ndarray, missing_left: np.ndarray,
         stop: bool = False) -> np.ndarray:
    """The node that each row reaches after ``levels`` levels; rows of nodes without a split go left or, with ``stop``, to -1."""
    n = np.zeros(len(bins), np.int64)
    first = 0
    for level in range(levels):
        after = np.full(len(bins), -1, np.int64)
        for node in range(first, 2 * first + 1):
            rows = np.flatnonzero(n == node) if level else slice(None)
            f = feature[node]
            if f < 0:
                if not stop:
                    after[rows] = 2 * node + 1
                continue
            v = bins[rows, f]
            right = v > split[node]
            if not missing_left[node]:
                right |= v == 0
            after[rows] = 2 * node + 1 + right
        n, first = after, 2 * first + 1
    return n


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, y, fold, preds) of a batch; a missing fold is ``NO_FOLD``."""
    n = batch.num_rows
    return (batch.column(0).flatten().to_numpy().reshape(n, -1), batch.column(1).to_numpy(),
            batch.column(2).fill_null(NO_FOLD).to_numpy(), batch.column(3).flatten().to_numpy().reshape(n, -1))


def _with_predictions(rows: DataFrame, grown: list[_Growing], done: int, depth: int, edges, last: bool = False) -> DataFrame:
    """The matrix with all predictions so far; without the bins if it is the ``last`` time."""
    trees = _new_trees(grown, done, depth, edges)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, _, _, preds = _columns(batch)
            new = np.stack([trees.predictions(m, bins, preds) for m in range(len(trees.base))], axis=1)
            ends = pa.array(np.arange(0, new.size + 1, new.shape[1], dtype=np.int32))
            columns = [batch.column(i) for i in range(1 if last else 0, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(new.ravel()))], names)

    names = ["y", "fold", "preds"] if last else ["bins", "y", "fold", "preds"]
    return map_in_arrow(rows, run, ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in names))


def _grow(rows: DataFrame, grown: list[_Growing], k: int, done: int, depth: int, width: int, edges, scale: float) -> None:
    """Adds tree ``k`` to every model (an empty one where a model has all its trees)."""
    nodes = (1 << depth) - 1
    for m in grown:
        m.nodes = {}
    levels = max(m.settings.depth for m in grown if k < m.settings.trees)
    for level in range(levels):
        found = _histograms(rows, grown, k, done, depth, width, edges, scale, level, len(edges))
        for i, m in enumerate(grown):
            if k >= m.settings.trees or level >= m.settings.depth:
                continue
            for node in range((1 << level) - 1, (2 << level) - 1):
                g, h = found.get((i, node), (None, None))
                if g is None:
                    continue
                own = m.nodes.setdefault(node, {})
                own.update(g=float(g[0].sum()), h=float(h[0].sum()))
                split = best_split(g, h, m.settings)
                if split:
                    gain, f, b, missing_left, left_g, left_h = split
                    own.update(feature=f, bin=b, missing_left=missing_left, gain=gain)
                    m.nodes[2 * node + 1] = {"g": left_g, "h": left_h}
                    m.nodes[2 * node + 2] = {"g": own["g"] - left_g, "h": own["h"] - left_h}
    for m in grown:
        _finish(m, k, depth, edges)


def _finish(m: _Growing, k: int, depth: int, edges) -> None:
    nodes, x = (1 << depth) - 1, m.model
    value = {}   # of every node without a split, handed down to the leaves under it
    for node in range(2 * nodes + 1):
        own = m.nodes.get(node)
        above = value.get((node - 1) // 2) if node else None
        f = own.get("feature", -1) if own else -1
        if above is None and own and f < 0:
            above = leaf_value(own["g"], own["h"], m.settings)
            x.stats.append({"round": k, "node": node, "kind": "leaf", "feature": None, "threshold": None,
                            "n_rows": int(own["h"]), "value": above})
        elif own and f >= 0:
            x.stats.append({"round": k, "node": node, "kind": "split", "feature": x.features[f],
                            "threshold": edges[f][own["bin"] - 1], "n_rows": int(own["h"]), "value": None})
        if above is not None:
            value[node] = above
        if node < nodes:
            x.feature.append(f)
            x.threshold.append(edges[f][own["bin"] - 1] if f >= 0 else 0.0)
            x.missing_left.append(own["missing_left"] if f >= 0 else 0)
        else:
            x.leaf.append(value.get(node, 0.0))


def exact_sums(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Sums of the whole numbers ``g`` by place, exact: ``bincount`` adds doubles, so large numbers go in two parts."""
    if len(g) > 1 << 20:
        return exact_sums(at[1 << 20:], g[1 << 20:], size) + exact_sums(at[:1 << 20], g[:1 << 20], size)
    if len(g) and max(int(g.max()), -int(g.min())) * len(g) >= 1 << 53:
        high = g >> 31
        return (exact_sums(at, high, size) << 31) + exact_sums(at, g - (high << 31), size)
    return np.bincount(at, g, size).astype(np.int64)


def whole_gradients(g: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    a = np.abs(g)
    whole = np.trunc(a)
    return np.copysign(whole + (a - whole >= 0.5), g).astype(np.int64)


def _histograms(rows: DataFrame, grown, k, done, depth, width, edges, scale, level, n_features) -> dict:
    """{(model, node): (gradient sums, row counts)}, features x bins, of the nodes of a level."""
    nodes = (1 << depth) - 1
    trees = _new_trees(grown, done, depth, edges)
    # the present tree: feature -1 where a node has no split (yet)
    now = [[g.nodes.get(i, {}) if k < g.settings.trees else {} for i in range(nodes)] for g in grown]
    feature, split, missing_left = (np.array([[x.get(name, none) for x in own] for own in now], np.int64).reshape(len(grown), nodes)
                                    for name, none in (("feature", -1), ("bin", 0), ("missing_left", 0)))
    live = [i for i, g in enumerate(grown) if k < g.settings.trees and level < g.settings.depth]
    out = [g.left_out for g in grown]
    first, wide = (1 << level) - 1, 1 << level

    def run(batches):
        g_sums = {m: np.zeros((n_features, wide * width), np.int64) for m in live}
        h_sums = {m: np.zeros((n_features, wide * width), np.int64) for m in live}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, fold, preds = _columns(batch)
            kept = {}   # rows by fold left out
            for m in live:
                if out[m] not in kept:
                    own = (fold != NO_FOLD) & (True if out[m] is None else fold != out[m])
                    kept[out[m]] = np.asfortranarray(bins[own]), y[own], preds[own]
                x, truth, known = kept[out[m]]
                node = walk(x, level, feature[m], split[m], missing_left[m], stop=True)
                g = whole_gradients((trees.predictions(m, x, known) - truth) * scale)
                if level and (node < 0).any():
                    x, g, node = x[node >= 0], g[node >= 0], node[node >= 0]
                for f in range(n_features):
                    at = (node - first) * width + x[:, f]
                    g_sums[m][f] += exact_sums(at, g, wide * width)
                    h_sums[m][f] += np.bincount(at, minlength=wide * width)
        for m in live:
            f, at = np.nonzero(h_sums[m])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(f), m, np.int32)), pa.array((at // width + first).astype(np.int32)),
                 pa.array(f.astype(np.int32)), pa.array((at % width).astype(np.int32)),
                 pa.array(g_sums[m][f, at]), pa.array(h_sums[m][f, at])], ["m", "n", "f", "b", "g", "h"])

    parts = map_in_arrow(rows, run, "m int, n int, f int, b int, g bigint, h bigint")
    sums = parts.groupBy("m", "n", "f", "b").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()   # models x nodes x features x bins at most
    m_, n_, f_, b_, g_, h_ = (sums[c].to_numpy() for c in ("m", "n", "f", "b", "g", "h"))
    found = {}
    for i, j in set(zip(m_.tolist(), n_.tolist())):
        own = (m_ == i) & (n_ == j)
        g, h = np.zeros((n_features, width)), np.zeros((n_features, width))
        g[f_[own], b_[own]] = g_[own] / scale
        h[f_[own], b_[own]] = h_[own]
        found[i, j] = (g, h)
    return found


def train_boosted(train: DataFrame, features: list[str] = MODEL_FEATURES, target: str = "total_qty",
                  settings: BoostSettings = BoostSettings(), max_bins: int = MAX_BINS) -> Ensemble:
    """M2: one regularised model over all rows."""
    return boost(train, list(features), target, [(settings, None)], None, max_bins)[0][0]


@dataclass
class GridResult:
    """What a grid search found: ``scores`` has a row (setting, fold, n_train, n_held_out, rmse) per model."""

    scores: DataFrame
    settings: list[BoostSettings]
    mean_rmse: list[float]
    best: BoostSettings
    model: Ensemble | None


def grid_search(train: DataFrame, grid: dict[str, list], features: list[str] = MODEL_FEATURES, target: str = "total_qty",
                folds: int = 3, keys: list[str] = ("product_key", "month"), base: BoostSettings = BoostSettings(),
                refit: bool = True, max_bins: int = MAX_BINS) -> GridResult:
    """M4: every grid point on every fold, all grown in the same jobs over one binned matrix.

    A row's fold follows from its key. The setting with the least mean RMSE
    wins (the first of equals) and is fitted to all rows.
    """
    points = [replace(base, **dict(zip(grid, values))) for values in itertools.product(*grid.values())]
    models = [(p, i) for p in points for i in range(folds)]
    keyed = train.withColumn("__f", (split_bucket(list(keys)) % folds).cast("int"))
    _, rows = boost(keyed, list(features), target, models, "__f", max_bins)
    spark = train.sparkSession
    errors = rows.selectExpr("y", "fold", "posexplode(preds) AS (m, p)").groupBy("m").agg(
        F.sum(F.when(F.col("m") % folds == F.col("fold"), F.pow(F.col("p") - F.col("y"), 2))).alias("e"),
        F.count_if(F.col("m") % folds == F.col("fold")).alias("n"), F.count(F.lit(1)).alias("all"))
    found = {r["m"]: r for r in errors.collect()}   # one row per model
    rmse = [math.sqrt(found[i]["e"] / found[i]["n"]) if i in found and found[i]["n"] else float("nan")
            for i in range(len(models))]
    mean = [float(np.nanmean(rmse[i * folds:(i + 1) * folds])) if any(r == r for r in rmse[i * folds:(i + 1) * folds])
            else float("inf") for i in range(len(points))]
    best = min(range(len(points)), key=lambda i: mean[i])
    scores = spark.createDataFrame(
        [(i // folds, i % folds, found[i]["all"] - found[i]["n"], found[i]["n"], rmse[i]) for i in sorted(found)],
        "setting int, fold int, n_train long, n_held_out long, rmse double")
    model = train_boosted(train, features, target, points[best], max_bins) if refit else None
    return GridResult(scores, points, mean, points[best], model)


# --- fitted MLlib models -------------------------------------------------------------
def ensemble_of(model, features: list[str] = MODEL_FEATURES) -> Ensemble:
    """A fitted MLlib tree model (or the pipeline that ends in one) as an ensemble.

    The nodes are read from the model's persisted form, one row per node.
    MLlib sends rows right where ``value <= threshold`` fails, NaN included.
    """
    from pyspark.ml import PipelineModel

    if isinstance(model, PipelineModel):
        features = model.stages[0].getInputCols()
        model = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "tree-model")
    model.write().save(path)
    weights = list(getattr(model, "treeWeights", [1.0]))
    rows = spark.read.parquet(f"{path}/data")
    if "treeID" not in rows.columns:   # a single tree
        rows = rows.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    trees: dict[int, dict[int, object]] = {}
    for r in rows.collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    found = []   # (tree, place, node)
    depth = 0
    for t, nodes in sorted(trees.items()):
        todo = [(0, 0, 0)]
        while todo:
            i, place, level = todo.pop()
            node = nodes[i]
            found.append((t, place, node))
            depth = max(depth, level)
            if node["leftChild"] >= 0:
                if node["split"]["numCategories"] != -1:
                    raise ValueError("categorical splits are not supported")
                todo += [(node["leftChild"], 2 * place + 1, level + 1), (node["rightChild"], 2 * place + 2, level + 1)]
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Ensemble(list(features), depth, 0.0, [-1] * inner * len(trees), [0.0] * inner * len(trees),
                   [0] * inner * len(trees), [0.0] * leaves * len(trees))
    for t, place, node in found:
        if node["leftChild"] >= 0:
            out.feature[t * inner + place] = node["split"]["featureIndex"]
            out.threshold[t * inner + place] = node["split"]["leftCategoriesOrThreshold"][0]
            continue
        first, last = place, place
        while first < inner:   # all leaves of the complete tree under it
            first, last = 2 * first + 1, 2 * last + 2
        for leaf in range(first - inner, last - inner + 1):
            out.leaf[t * leaves + leaf] = weights[t] * node["prediction"]
    return out
