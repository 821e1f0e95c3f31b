"""Final missing-value rules of the notebook path, in their order:

(a) growth / trend columns: NULL -> 0 (infinities stay);
(b) ratio columns: NULL -> the column median, infinities counted as values;
(c) +-inf -> NULL in every numeric column;
(d) numeric columns: NULL -> the column median (recomputed after (c));
(e) anything still NULL (all-NULL columns) -> 0.

Medians come from ``column_medians`` (exact, distributed); they are a few
scalars, inlined as literals into one final projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from retailcast.functions import sqltext as X
from retailcast.operators.medians import column_medians, column_stats
from retailcast.session import cut_lineage

TREND_COLUMNS = ["mom_growth_qty", "mom_growth_sales", "trend_qty"]
RATIO_COLUMNS = ["price_level", "view_to_sales_ratio", "visitor_to_sales_ratio",
                 "visitor_to_view_ratio", "stock_turnover", "stock_coverage"]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def finalize_features(df: DataFrame, trend_cols=TREND_COLUMNS, ratio_cols=RATIO_COLUMNS,
                      median_cols: list[str] | None = None, checkpoint: bool = True) -> DataFrame:
    """Apply (a)-(e). ``median_cols`` limits step (d) (default: every numeric
    column, as the source does, IDs included). Column types are kept: a
    column that can hold a fractional median must already be double."""
    trend_cols = [c for c in trend_cols if c in df.columns]
    ratio_cols = [c for c in ratio_cols if c in df.columns]
    df = df.selectExpr(*[f"coalesce({X.q(c)}, 0.0) AS {X.q(c)}" if c in trend_cols else X.q(c)
                         for c in df.columns])
    if checkpoint:
        df = cut_lineage(df)  # scanned once per median pass below
    num = numeric_columns(df) if median_cols is None else [c for c in median_cols if c in df.columns]
    types = dict(df.dtypes)
    dbl = {c for c, t in types.items() if t in ("double", "float")}
    st = column_stats(df, sorted(set(num) | set(ratio_cols)))

    # Pass group 1 (one refinement loop over the table as it is): the (b)
    # medians of the ratio columns, infinities counted, and the (d) medians of
    # every other column that holds a NULL or an infinity (their (d) values
    # are just their finite values).
    need_other = [c for c in num if c not in ratio_cols and st[c]["null"] + st[c]["neg"] + st[c]["pos"] > 0]
    need_b = [c for c in ratio_cols if st[c]["null"] > 0]
    first = {c: dict(st[c], infinite=True) for c in need_b}
    first.update({c: dict(st[c], infinite=False) for c in need_other})
    med = column_medians(df, need_b + need_other, stats=first)
    med_b = {c: med[c] for c in need_b}

    def lit(v, t):
        return f"CAST({float(v)!r} AS {t.upper()})"

    def after_b(c):
        x = X.q(c)
        if c in ratio_cols and med_b.get(c) is not None:
            x = f"coalesce({x}, {lit(med_b[c], 'double')})"
        if c in dbl:
            x = X.inf_null(x)
        return x

    # Pass group 2: ratio columns still holding a NULL after (b)+(c) need a
    # (d) median over the filled values; their stats follow from group 1.
    med_d = {c: med[c] for c in need_other}
    second = {}
    for c in ratio_cols:
        if c not in num:
            continue
        m = med_b.get(c)
        m_fin = m is not None and m not in (float("inf"), float("-inf"))
        holes = st[c]["neg"] + st[c]["pos"] + (0 if m_fin else st[c]["null"])
        if holes == 0:
            continue
        s2 = {"null": 0, "neg": 0, "pos": 0, "infinite": False,
              "fin": st[c]["fin"] + (st[c]["null"] if m_fin else 0),
              "lo": st[c]["lo"], "hi": st[c]["hi"]}
        if m_fin and st[c]["null"]:
            s2["lo"] = m if s2["lo"] is None else min(s2["lo"], m)
            s2["hi"] = m if s2["hi"] is None else max(s2["hi"], m)
        second[c] = s2
    if second:
        stage = df.selectExpr(*[f"{after_b(c)} AS {X.q(c)}" for c in second])
        med_d.update(column_medians(stage, list(second), stats=second))

    out = []
    for c in df.columns:
        x = after_b(c)
        if c in num:
            m = med_d.get(c)
            if m is not None:
                x = f"coalesce({x}, {lit(m, types[c])})"
            x = f"coalesce({x}, CAST(0 AS {types[c].upper()}))"
        out.append(f"{x} AS {X.q(c)}")
    return df.selectExpr(*out)
