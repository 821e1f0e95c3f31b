"""Table comparison (golden check): shape, per-column value differences
within a tolerance, per-column NULL counts.

Equal rows of both sides cancel in one aggregate (skew-proof: a repeated row
is one partial count); only what is left is numbered inside its key and
joined. Statistics are conditional aggregates, unpivoted with ``stack``.
Nothing is collected but schema names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from retailcast.session import cut_lineage

# The default tolerances of the source's check.
RTOL = 1e-10
ATOL = 1e-10


def compare_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row and column counts, missing / extra columns, verdict."""
    ca, cb = a.columns, b.columns
    missing = sorted(set(cb) - set(ca))
    extra = sorted(set(ca) - set(cb))
    nb = b.agg(F.count(F.lit(1))).scalar()  # scalar subquery: no join of the two counts
    j = a.agg(F.count(F.lit(1)).alias("rows_processed")).withColumn("rows_reference", nb)
    same_cols = not missing and not extra
    return j.select(
        "rows_processed", "rows_reference",
        F.lit(len(ca)).cast("long").alias("cols_processed"),
        F.lit(len(cb)).cast("long").alias("cols_reference"),
        F.lit(", ".join(missing)).alias("missing_columns"),
        F.lit(", ".join(extra)).alias("extra_columns"),
        ((F.col("rows_processed") == F.col("rows_reference")) & F.lit(same_cols)).alias("shape_match"))


def _value_key(c: str, kind: str) -> Column:
    """A column as a group key: NaN counts as missing."""
    return F.when(~F.isnan(F.col(c)), F.col(c)) if kind in ("double", "float") else F.col(c)


def _numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 1 in ``order``, never sorting a whole key in one task.

    Rows are range-partitioned by (keys, order, a row id), so that a key's rows
    and even equal rows span many tasks; partition ids are frozen by a
    checkpoint, rows are numbered inside (partition, key) and shifted by the
    key's rows in earlier partitions.
    """
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = cut_lineage(df.withColumn("__tie", F.monotonically_increasing_id())
                         .repartitionByRange(*sort, F.col("__tie")).withColumn("__pid", F.spark_partition_id()))
    local = ranged.withColumn("__local", F.row_number().over(
        Window.partitionBy("__pid", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order], "__tie")))
    counts = ranged.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = (counts.withColumn("__shift", F.sum("__n").over(before)).where("__shift > 0")
             .select(F.col("__pid").alias("__p"), *[F.col(k).alias(f"__s_{k}") for k in keys], "__shift"))
    same = F.col("__pid") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    # at most one key per partition continues from the one before: the table is no longer than the partition count
    return (local.join(F.broadcast(shift), same, "left")
            .withColumn(out, F.col("__local") + F.coalesce("__shift", F.lit(0)))
            .drop("__tie", "__pid", "__local", "__p", "__shift", *[f"__s_{k}" for k in keys]))


def compare_values(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = RTOL,
                   atol: float = ATOL) -> DataFrame:
    """One row per common non-key column: type match, rows that differ, largest and mean difference.

    Numbers differ if ``|x - y| > atol + rtol * |y|``; equal infinities match,
    a finite and an infinite value differ, NULL and NaN are one missing value
    that matches itself only and stays out of the largest and mean difference.
    Text must be equal. Columns whose types differ are reported, not compared.

    Rows meet by key. Of a repeated key, rows that are equal in all compared
    columns meet first; the others meet in the order of those columns. Rows
    without a partner differ in every column. Equal rows are counted by one
    aggregate over both sides, so only rows that differ are joined.
    """
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    common = [c for c in a.columns if c in tb and c not in keys]
    same = [c for c in common if ta[c] == tb[c]]
    numeric = {f.name for f in a.schema.fields if isinstance(f.dataType, NumericType)}

    def side(df, name):
        kinds = dict(df.dtypes)
        return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                         *[_value_key(c, kinds[c]).alias(f"__v{i}") for i, c in enumerate(same)],
                         F.lit(int(name == "a")).alias("__a"), F.lit(int(name == "b")).alias("__b"))

    ks, vs = [f"__k{i}" for i in range(len(keys))], [f"__v{i}" for i in range(len(same))]
    counted = cut_lineage(side(a, "a").union(side(b, "b")).groupBy(*ks, *vs)
                          .agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")))

    def rest(n, prefix):
        d = counted.where(n > 0).withColumn("__copies", F.explode(F.sequence(F.lit(1), n.cast("int"))))
        d = d.drop("__a", "__b", "__copies")
        repeated = d.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).count() > 0
        d = _numbered(d, ks, vs, "__rank") if repeated else d.withColumn("__rank", F.lit(1))
        return d.select(*[F.col(c).alias(prefix + c) for c in [*ks, *vs, "__rank"]])

    left, right = rest(F.col("__a") - F.col("__b"), "l"), rest(F.col("__b") - F.col("__a"), "r")
    meets = F.col("l__rank") == F.col("r__rank")
    for k in ks:
        meets = meets & F.col(f"l{k}").eqNullSafe(F.col(f"r{k}"))
    pairs = left.join(right, meets, "full_outer")
    equal, other = [], []
    for i, c in enumerate(same):
        x, y = f"l__v{i}", f"r__v{i}"
        if c in numeric:
            x, y = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
            gap = f"CASE WHEN {x} = {y} THEN 0.0D ELSE abs({x} - {y}) END"
            near = (f"({x} = {y} OR (abs({x}) < double('inf') AND abs({y}) < double('inf') "
                    f"AND {gap} <= {atol!r}D + {rtol!r}D * abs({y})))")
            other += [f"sum(CASE WHEN l__rank IS NULL OR r__rank IS NULL THEN 1 "
                      f"WHEN {x} IS NULL AND {y} IS NULL THEN 0 WHEN {x} IS NULL OR {y} IS NULL THEN 1 "
                      f"WHEN {near} THEN 0 ELSE 1 END) AS d{i}",
                      f"max({gap}) AS m{i}", f"sum({gap}) AS s{i}", f"count({gap}) AS n{i}"]
            equal += ["0L", f"max(CASE WHEN __v{i} IS NOT NULL AND least(__a, __b) > 0 THEN 0.0D END)",
                      f"sum(CASE WHEN __v{i} IS NOT NULL AND least(__a, __b) > 0 THEN 0.0D END)",
                      f"sum(CASE WHEN __v{i} IS NOT NULL THEN least(__a, __b) ELSE 0 END)"]
        else:
            other += [f"sum(CASE WHEN l__rank IS NULL OR r__rank IS NULL THEN 1 WHEN {x} <=> {y} THEN 0 ELSE 1 END) "
                      f"AS d{i}", f"CAST(NULL AS DOUBLE) AS m{i}", f"CAST(NULL AS DOUBLE) AS s{i}", f"0L AS n{i}"]
            equal += ["0L", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "0L"]
    parts = []
    for c in common:
        head = f"'{c}', {str(c in same).lower()}, '{ta[c]}', '{tb[c]}'"
        if c in same:
            i = same.index(c)
            parts.append(f"{head}, CAST(coalesce(d{i}, 0) AS BIGINT), m{i}, s{i} / nullif(n{i}, 0)")
        else:
            parts.append(f"{head}, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
    names = ("(`column`, type_match, processed_type, reference_type, different_rows, "
             "max_difference, mean_difference)")
    if not common:
        return a.sparkSession.createDataFrame(
            [], "column string, type_match boolean, processed_type string, reference_type string, "
                "different_rows bigint, max_difference double, mean_difference double, values_match boolean")
    if same:
        both = pairs.selectExpr(*other).union(counted.selectExpr(*equal))   # two rows
        stats = both.agg(*[F.expr(f"{f}({k}{i})").alias(f"{k}{i}") for i in range(len(same))
                           for k, f in (("d", "sum"), ("m", "max"), ("s", "sum"), ("n", "sum"))])
    else:
        stats = a.sparkSession.range(1)
    out = stats.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS {names}")
    return out.withColumn("values_match", F.col("type_match") & (F.coalesce("different_rows", F.lit(0)) == 0))


def compare_verdict(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """One row: ``success`` over shape, columns, types and values, and the list of differences."""
    shape = compare_shape(a, b)
    values = compare_values(a, b, keys, rtol, atol)
    wrong = values.agg(F.sort_array(F.collect_list(F.when(~F.col("values_match"), F.when(
        F.col("type_match"), F.concat(F.col("column"), F.lit(": "), F.col("different_rows").cast("string"),
                                      F.lit(" rows differ")))
        .otherwise(F.concat(F.col("column"), F.lit(": type "), F.col("processed_type"), F.lit(" instead of "),
                            F.col("reference_type")))))).alias("w")).scalar()
    rows = F.when(F.col("rows_processed") != F.col("rows_reference"), F.concat(
        F.lit("rows: "), F.col("rows_processed").cast("string"), F.lit(" instead of "),
        F.col("rows_reference").cast("string")))
    missing = F.when(F.col("missing_columns") != "", F.concat(F.lit("missing columns: "), F.col("missing_columns")))
    extra = F.when(F.col("extra_columns") != "", F.concat(F.lit("extra columns: "), F.col("extra_columns")))
    found = shape.select(F.concat(F.array_compact(F.array(rows, missing, extra)), wrong).alias("found"))
    return found.select((F.size("found") == 0).alias("success"), F.size("found").cast("long").alias("n_differences"),
                        F.array_join("found", "; ").alias("message"))


def compare_nulls(a: DataFrame, b: DataFrame) -> DataFrame:
    """NULL count per common column on both sides (two aggregates)."""
    common = [c for c in a.columns if c in b.columns]

    def counts(df, name):
        row = df.agg(*[F.count(F.when(F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float")
                                                           else F.lit(False)), 1)).alias(f"n{i}")
                       for i, c in enumerate(common)])
        stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(common))
        return row.selectExpr(f"stack({len(common)}, {stack}) AS (`column`, {name})")

    return counts(a, "null_count_processed").join(counts(b, "null_count_reference"), "column")

