"""DuckDB SQL for every registered query that SQL can express.

Each string runs on the raw test tables (pre-registered views) and rebuilds
the fixture views it needs as CTEs (``retailcast.sources.fixture_sql``)."""

from __future__ import annotations

from retailcast.sources.fixture_sql import KEY_C, KEY_N, with_views

ORACLE: dict[str, str] = {}

ORACLE["monthly_product_sales"] = with_views(
    "SELECT month, product_key, qty, net_amount, net_amount AS sales_amount FROM sales_monthly_base",
    "sales_monthly_base")

# --------------------------------------------------------------------------
# Derived views shared by several oracle queries (registered next to the
# fixture views so ``with_views`` resolves their dependencies).
from retailcast.sources import fixture_sql as _fs  # noqa: E402

COUNTS = ["orders", "views", "visitors", "cancelled_orders", "returned_orders", "buyers", "new_buyers",
          "current_buyers", "potential_buyers"]
MONEY = ["cancelled_sales", "returned_sales"]
RATES = ["conversion_rate", "repeat_rate"]


def nan_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def loc_num(x: str) -> str:
    return nan_null(f"TRY_CAST(replace(replace(CAST({x} AS VARCHAR), '.', ''), ',', '.') AS DOUBLE)")


def pct_num(x: str) -> str:
    return nan_null(f"TRY_CAST(replace(replace(CAST({x} AS VARCHAR), '%', ''), ',', '.') AS DOUBLE)")


def ieee(a: str, b: str) -> str:
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
            f"WHEN ({b}) = 0 THEN (CASE WHEN ({a}) = 0 THEN NULL WHEN ({a}) > 0 "
            f"THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END) "
            f"ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)")


def msum(x: str) -> str:
    return f"coalesce(sum(CAST({x} AS DECIMAL(38,6))), 0)"


def view(name: str, sql: str, *deps: str) -> None:
    _fs.VIEWS[name] = sql
    _fs.DEPS[name] = tuple(deps)


view("sales_monthly", "SELECT month, product_key, qty, net_amount, net_amount AS sales_amount FROM sales_monthly_base",
     "sales_monthly_base")

view("traffic_monthly", f"""
SELECT CAST(date_trunc('month', d) AS DATE) AS month,
       CAST({msum(loc_num('sales_text'))} AS DOUBLE) AS total_sales,
       {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTS)},
       {", ".join(f"CAST({msum(c)} AS DOUBLE) AS {c}" for c in MONEY)},
       avg({loc_num('sales_per_order_text')}) AS sales_per_order,
       avg({pct_num('conversion_rate_text')}) AS conversion_rate,
       avg({pct_num('repeat_rate_text')}) AS repeat_rate
FROM (SELECT *, coalesce(try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%d-%m-%Y'),
                         try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d.%m.%Y')) AS d
      FROM traffic) t
WHERE d IS NOT NULL
GROUP BY 1""", "traffic")
view("traffic_monthly_all", _fs.VIEWS["traffic_monthly"].replace("FROM traffic)", "FROM traffic_all)"), "traffic_all")

_TOT = f"CAST(sum(CAST(total_sales AS DECIMAL(38,6))) AS DOUBLE)"
view("traffic_global", "SELECT " + ", ".join(
    [f"avg({r}) AS avg_{r}" for r in RATES]
    + [f"CASE WHEN coalesce({_TOT}, 0) = 0 THEN 0.0 ELSE CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / {_TOT} END AS {c}_per_sale"
       for c in COUNTS + MONEY]) + " FROM traffic_monthly", "traffic_monthly")


def allocated_sql(cutoff: str | None) -> str:
    cut = "(SELECT min(month) FROM traffic_monthly)" if cutoff is None else f"DATE '{cutoff}'"
    tcols = ", ".join(f"tm.{c}" for c in COUNTS + MONEY + ["sales_per_order"] + RATES)
    return f"""
SELECT * FROM (
  SELECT j2.*,
    {", ".join(f"CASE WHEN t_{c} IS NULL OR t_{c} = 0 OR msales = 0 OR msales IS NULL THEN CAST(0 AS BIGINT) "
               f"ELSE CAST(greatest(b_{c} + sign(t_{c} - sb_{c}) * (floor(abs(t_{c} - sb_{c}) / n) "
               f"+ CASE WHEN rk < abs(t_{c} - sb_{c}) % n THEN 1 ELSE 0 END), 1) AS BIGINT) END AS a_{c}"
               for c in COUNTS)}
  FROM (
    SELECT j1.*, {", ".join(f"sum(b_{c}) OVER (PARTITION BY month) AS sb_{c}" for c in COUNTS)}
    FROM (
      SELECT j0.*, {", ".join(f"CASE WHEN msales <> 0 THEN CAST(round_even(CAST(t_{c} AS DOUBLE) * share, 0) AS BIGINT) END AS b_{c}" for c in COUNTS)}
      FROM (
        SELECT j.*, {ieee('j.net_amount', 'j.msales')} AS share, (j.month < {cut}) AS early,
          {", ".join(f"CASE WHEN j.month < {cut} THEN greatest(1, CAST(round_even(CAST(j.msales AS DOUBLE) * g.{c}_per_sale, 0) AS BIGINT)) ELSE j.{c} END AS t_{c}" for c in COUNTS)}
        FROM (
          SELECT ms.*, {tcols},
                 sum(ms.net_amount) OVER (PARTITION BY ms.month) AS msales,
                 count(*) OVER (PARTITION BY ms.month) AS n,
                 row_number() OVER (PARTITION BY ms.month ORDER BY ms.net_amount DESC, ms.product_key ASC) - 1 AS rk
          FROM sales_monthly ms LEFT JOIN traffic_monthly tm ON ms.month = tm.month
        ) j, traffic_global g
      ) j0
    ) j1
  ) j2
) x"""


def allocated_select(src: str = "allocated") -> str:
    money = ", ".join(
        f"CASE WHEN early THEN share * ((CAST(msales AS DOUBLE) * g.{c}_per_sale) * 0.8) ELSE share * {c} END AS {c}"
        for c in MONEY)
    rates = ", ".join(f"CASE WHEN early THEN g.avg_{c} ELSE {c} END AS {c}" for c in RATES)
    counts = ", ".join(f"a_{c} AS {c}" for c in COUNTS)
    return (f"SELECT month, product_key, qty, net_amount, sales_amount, {counts}, {money}, sales_per_order, {rates} "
            f"FROM {src}, traffic_global g")


view("allocated", allocated_sql(None), "sales_monthly", "traffic_monthly", "traffic_global")
view("allocated_plain", allocated_sql("1900-01-01"), "sales_monthly", "traffic_monthly", "traffic_global")
view("traffic_allocated", allocated_select("allocated"), "allocated", "traffic_global")


def r6(x: str) -> str:
    return f"round({x}, 6)"


ORACLE["monthly_traffic"] = with_views(
    "SELECT month, " + ", ".join(
        [r6("total_sales") + " AS total_sales"] + COUNTS + [r6(c) + f" AS {c}" for c in MONEY + ["sales_per_order"] + RATES])
    + " FROM traffic_monthly_all", "traffic_monthly_all")

view("traffic_global_all", _fs.VIEWS["traffic_global"].replace("FROM traffic_monthly", "FROM traffic_monthly_all"),
     "traffic_monthly_all")
ORACLE["traffic_ratios_global"] = with_views(
    "SELECT " + ", ".join(f"round({c}, 9) AS {c}" for c in
                          [f"avg_{r}" for r in RATES] + [f"{c}_per_sale" for c in COUNTS + MONEY])
    + " FROM traffic_global_all", "traffic_global_all")

ORACLE["month_share"] = with_views(
    f"SELECT month, product_key, net_amount, {r6(ieee('net_amount', 'sum(net_amount) OVER (PARTITION BY month)'))} AS weight "
    "FROM sales_monthly", "sales_monthly")

ORACLE["apportion_counts"] = with_views(
    "SELECT month, product_key, net_amount, " + ", ".join(f"a_{c} AS {c}" for c in COUNTS) + " FROM allocated_plain",
    "allocated_plain")

ORACLE["allocate_currency"] = with_views(
    "SELECT month, product_key, " + ", ".join(
        [f"{r6(f'share * {c}')} AS {c}" for c in MONEY] + [r6(c) + f" AS {c}" for c in RATES + ["sales_per_order"]])
    + " FROM allocated_plain", "allocated_plain")

ORACLE["estimate_missing_traffic"] = with_views(
    "SELECT month, product_key, qty, net_amount, sales_amount, " + ", ".join(
        COUNTS + [r6(c) + f" AS {c}" for c in MONEY + ["sales_per_order"] + RATES])
    + " FROM traffic_allocated", "traffic_allocated")


# --------------------------------------------------------------------------
# Feature table (notebook path)
INFO = ["seller_voucher", "platform_voucher", "coin_discount", "shipping_fee", "shipping_deduction",
        "return_shipping", "total_payment", "estimated_shipping", "status", "list_price", "weight_text",
        "total_weight_text"]
ORDER = "src_orderkey, src_linenumber, src_partkey, src_suppkey, list_price"

view("sales_prep", f"SELECT *, {KEY_N} AS product_key FROM sales WHERE status IS DISTINCT FROM 'Batal'", "sales")
view("product_info", f"""
SELECT product_key, {", ".join(INFO)} FROM (
  SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY {ORDER}) AS rn
  FROM sales_prep WHERE product_key IS NOT NULL) WHERE rn = 1""", "sales_prep")

STOCK_NUM = ["product_id", "opening_stock", "closing_stock", "pending"]
view("fe_joined", f"""
SELECT a.*, {", ".join(f"i.{c}" for c in INFO if not c.endswith("_text"))},
       {", ".join(f"CAST(st.{c} AS DOUBLE) AS {c}" for c in STOCK_NUM)},
       coalesce(st.stock_status, 'Unknown') AS stock_status,
       (hm.month_text IS NOT NULL) AS is_holiday_month,
       {loc_num("replace(i.weight_text, ' gr', '')")} AS weight,
       {loc_num("replace(i.total_weight_text, ' gr', '')")} AS total_weight
FROM traffic_allocated a
LEFT JOIN product_info i ON a.product_key = i.product_key
LEFT JOIN stock_status st ON a.product_key = st.product_key AND strftime(a.month, '%Y-%m') = st.month_text
LEFT JOIN holiday_months hm ON strftime(a.month, '%Y-%m') = hm.month_text""",
     "traffic_allocated", "product_info", "stock_status", "holiday_months")

view("fe_coded", """
SELECT j.*, c.stock_status_code FROM fe_joined j JOIN (
  SELECT stock_status, CAST(dense_rank() OVER (ORDER BY stock_status) - 1 AS BIGINT) AS stock_status_code
  FROM (SELECT DISTINCT stock_status FROM fe_joined)) c ON j.stock_status = c.stock_status""", "fe_joined")

_WP = "(PARTITION BY product_key ORDER BY month)"
_R3 = "(PARTITION BY product_key ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _rz(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1 ELSE {x} END)"


view("fe_f1", f"""
SELECT *,
  CAST(year(month) AS BIGINT) AS year, CAST(month(month) AS BIGINT) AS month_of_year,
  CAST(quarter(month) AS BIGINT) AS quarter, CAST(day(last_day(month)) AS BIGINT) AS days_in_month,
  CAST(round_even(avg(qty) OVER (PARTITION BY product_key), 0) AS BIGINT) AS mean_qty_per_product,
  {ieee('qty', f'lag(qty) OVER {_WP}')} - 1.0 AS mom_growth_qty,
  {ieee('sales_amount', f'lag(sales_amount) OVER {_WP}')} - 1.0 AS mom_growth_sales,
  CASE WHEN avg(qty) OVER (PARTITION BY product_key) > 0
       THEN avg(qty) OVER (PARTITION BY product_key, month(month)) / avg(qty) OVER (PARTITION BY product_key)
       ELSE 0.0 END AS seasonal_index,
  {ieee('list_price', 'avg(list_price) OVER (PARTITION BY product_key)')} AS price_level,
  {ieee('qty', '(opening_stock + closing_stock) / 2.0')} AS stock_turnover,
  {ieee('closing_stock', f'avg(qty) OVER {_R3}')} AS stock_coverage,
  views / {_rz('qty')} AS view_to_sales_ratio,
  visitors / {_rz('qty')} AS visitor_to_sales_ratio,
  visitors / {_rz('views')} AS visitor_to_view_ratio,
  avg(qty) OVER {_R3} AS rolling_3m_qty,
  avg(sales_amount) OVER {_R3} AS rolling_3m_sales,
  avg(views) OVER {_R3} AS rolling_3m_views
FROM fe_coded""", "fe_coded")

_LAGS = []
for _k in (1, 2, 3):
    _LAGS += [f"coalesce(lag(qty, {_k}) OVER {_WP}, 0) AS lag_{_k}_qty",
              f"coalesce(lag(sales_amount, {_k}) OVER {_WP}, 0) AS lag_{_k}_sales",
              f"coalesce(lag(views, {_k}) OVER {_WP}, 0) AS lag_{_k}_views",
              f"CAST(coalesce(lag(stock_turnover, {_k}) OVER {_WP}, 0) AS DOUBLE) AS lag_{_k}_stock_turnover"]
view("fe_f2", f"""
SELECT *,
  {ieee('qty', f'lag(rolling_3m_qty) OVER {_WP}')} AS trend_qty,
  quarter = 1 AS quarter_1, quarter = 2 AS quarter_2, quarter = 3 AS quarter_3, quarter = 4 AS quarter_4,
  {", ".join(_LAGS)},
  sin(6.283185307179586 * month_of_year / 12.0) AS month_sin,
  cos(6.283185307179586 * month_of_year / 12.0) AS month_cos,
  {nan_null('price_level * views')} AS price_view_interaction,
  {nan_null('stock_coverage * visitors')} AS stock_demand_interaction
FROM fe_f1""", "fe_f1")

TREND = ["mom_growth_qty", "mom_growth_sales", "trend_qty"]
RATIO = ["price_level", "view_to_sales_ratio", "visitor_to_sales_ratio", "visitor_to_view_ratio",
         "stock_turnover", "stock_coverage"]
FE_LONG = (["qty", "net_amount", "sales_amount"] + COUNTS
           + ["stock_status_code", "year", "month_of_year", "quarter", "days_in_month", "mean_qty_per_product"]
           + [f"lag_{k}_{m}" for k in (1, 2, 3) for m in ("qty", "sales", "views")])
FE_DOUBLE = (MONEY + ["sales_per_order"] + RATES + ["seller_voucher", "platform_voucher", "coin_discount", "shipping_fee",
                "shipping_deduction", "return_shipping", "total_payment", "estimated_shipping", "list_price"]
             + STOCK_NUM + ["weight", "total_weight"] + TREND[:2] + ["seasonal_index"] + RATIO
             + ["rolling_3m_qty", "rolling_3m_sales", "rolling_3m_views", "trend_qty"]
             + [f"lag_{k}_stock_turnover" for k in (1, 2, 3)]
             + ["month_sin", "month_cos", "price_view_interaction", "stock_demand_interaction"])
FE_OTHER = ["product_key", "stock_status", "is_holiday_month", "quarter_1", "quarter_2", "quarter_3", "quarter_4"]


def _fin(x: str) -> str:
    return f"(CASE WHEN isinf({x}) THEN NULL ELSE {x} END)"


view("fe_a", "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in TREND) + ") FROM fe_f2", "fe_f2")
view("fe_bc", "SELECT * REPLACE (" + ", ".join(
    [_fin(f"coalesce({c}, (SELECT median({c}) FROM fe_a WHERE NOT isnan({c})))") + f" AS {c}" for c in RATIO]
    + [_fin(c) + f" AS {c}" for c in FE_DOUBLE if c not in RATIO]) + ") FROM fe_a", "fe_a")
view("feature_table_sql", "SELECT " + ", ".join(
    ["strftime(month, '%Y-%m') AS month", "strftime(month, '%Y-%m') AS date_index"] + FE_OTHER + FE_LONG
    + [c if c == "product_id" else f"coalesce(coalesce({c}, (SELECT median({c}) FROM fe_bc)), 0.0) AS {c}"
       for c in FE_DOUBLE])
    + " FROM fe_bc", "fe_bc")

ORACLE["feature_table"] = with_views(
    "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FE_DOUBLE) + ") FROM feature_table_sql",
    "feature_table_sql")


# --------------------------------------------------------------------------
# Lenient (core) path
view("core_sales_m", f"""
SELECT strftime(paid_at, '%Y-%m') AS month, {KEY_C} AS product_key,
       CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty, coalesce(sum(net_price), 0) AS net_price
FROM sales WHERE paid_at IS NOT NULL GROUP BY 1, 2""", "sales")
view("core_traffic_m", """
SELECT strftime(strptime(date_text, '%d/%m/%Y'), '%Y-%m') AS month, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders
FROM traffic GROUP BY 1""", "traffic")
view("core_main", """
SELECT s.month, s.product_key, s.qty, s.net_price, t.orders, st.product_id, st.opening_stock, st.sold_qty,
       st.closing_stock, st.pending, st.stock_status, (hm.month_text IS NOT NULL) AS is_holiday_month
FROM core_sales_m s LEFT JOIN core_traffic_m t ON s.month = t.month
LEFT JOIN stock_status st ON s.month = st.month_text AND s.product_key = st.product_key
LEFT JOIN holiday_months hm ON s.month = hm.month_text""", "core_sales_m", "core_traffic_m", "stock_status",
     "holiday_months")
_CW = "(PARTITION BY product_key ORDER BY month)"
view("core_f0", f"""
SELECT *, sold_qty AS total_qty, CAST(month(strptime(month, '%Y-%m')) AS BIGINT) AS month_of_year,
  {", ".join(f"CAST(coalesce(lag(sold_qty, {k}) OVER {_CW}, 0) AS DOUBLE) AS lag_{k}_qty" for k in (1, 2, 3))},
  avg(sold_qty) OVER (PARTITION BY product_key ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3m_qty,
  avg(sold_qty) OVER (PARTITION BY product_key) AS mean_qty_per_product,
  last_value(sold_qty IGNORE NULLS) OVER (PARTITION BY product_key ORDER BY month
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
  CAST(1.0 AS DOUBLE) AS seasonal_index, CAST(1.0 AS DOUBLE) AS total_orders
FROM core_main""", "core_main")
view("core_feat", f"""
SELECT * EXCLUDE (ffill, tr), CASE WHEN tr IS NULL OR isinf(tr) THEN 0.0 ELSE tr END AS trend_qty FROM (
  SELECT *, coalesce({ieee('ffill', f'lag(ffill) OVER {_CW}')} - 1.0, 0.0) AS mom_growth_qty,
         {ieee('total_qty', f'lag(rolling_3m_qty) OVER {_CW}')} AS tr
  FROM core_f0)""", "core_f0")

MODEL_FEATURES = ["rolling_3m_qty", "mean_qty_per_product", "lag_1_qty", "seasonal_index", "trend_qty",
                  "lag_2_qty", "mom_growth_qty", "lag_3_qty", "total_orders"]
CORE_DOUBLE = ["net_price", "rolling_3m_qty", "mean_qty_per_product", "mom_growth_qty", "trend_qty",
               "seasonal_index", "total_orders", "lag_1_qty", "lag_2_qty", "lag_3_qty"]

ORACLE["core_assembly"] = with_views("SELECT * REPLACE (round(net_price, 6) AS net_price) FROM core_main",
                                     "core_main")
ORACLE["core_features"] = with_views(
    "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in CORE_DOUBLE) + ") FROM core_feat", "core_feat")
ORACLE["training_rows"] = with_views(
    "SELECT month, product_key, total_qty, " + ", ".join(
        f"round({c}, 6) AS {c}" if c in CORE_DOUBLE else c for c in MODEL_FEATURES)
    + " FROM core_feat WHERE total_qty IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES),
    "core_feat")

# Forecast history and recursive forecast
view("fc_hist", """
SELECT product_key, CAST(strptime(month, '%Y-%m') AS DATE) AS month, total_qty, mom_growth_qty, total_orders
FROM core_feat""", "core_feat")
view("fc_state", """
WITH st AS (
  SELECT product_key, avg(total_qty) AS mean_value, avg(mom_growth_qty) AS mean_growth,
         avg(total_orders) AS mean_orders, max(month) AS last_month, count(total_qty) AS cnt
  FROM fc_hist GROUP BY 1),
l3 AS (
  SELECT product_key,
         max(CASE WHEN rn = 1 THEN CAST(total_qty AS DOUBLE) END) AS h1,
         max(CASE WHEN rn = 2 THEN CAST(total_qty AS DOUBLE) END) AS h2,
         max(CASE WHEN rn = 3 THEN CAST(total_qty AS DOUBLE) END) AS h3
  FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY month DESC) AS rn
        FROM fc_hist WHERE total_qty IS NOT NULL) WHERE rn <= 3 GROUP BY 1),
sm AS (
  SELECT product_key, month(month) AS moy, sum(total_qty) AS s, count(total_qty) AS c
  FROM fc_hist WHERE total_qty IS NOT NULL GROUP BY 1, 2),
ov AS (SELECT product_key, sum(s) / sum(c) AS overall FROM sm GROUP BY 1),
prof AS (
  SELECT g.product_key, list(CASE WHEN g.overall > 0 AND sm.c > 0 THEN (sm.s / sm.c) / g.overall ELSE 1.0 END
                             ORDER BY g.m) AS seasonal
  FROM (SELECT product_key, overall, unnest(generate_series(1, 12)) AS m FROM ov) g
  LEFT JOIN sm ON sm.product_key = g.product_key AND sm.moy = g.m
  GROUP BY 1)
SELECT st.*, l3.h1, l3.h2, l3.h3, prof.seasonal
FROM st LEFT JOIN l3 USING (product_key) LEFT JOIN prof USING (product_key)""", "fc_hist")

_W = {"rolling_3m_qty": 0.5, "mean_qty_per_product": 0.2, "lag_1_qty": 0.2, "seasonal_index": 1.0,
      "trend_qty": 0.1, "lag_2_qty": 0.05, "mom_growth_qty": 0.5, "lag_3_qty": 0.05, "total_orders": 0.0}


def _fc_features(mode: str) -> str:
    seasonal = "coalesce(list_extract(seasonal, month(m)), 1.0)"
    if mode == "core":
        rolling = "CASE WHEN cnt >= 3 THEN ((h3 + h2) + h1) / 3.0 WHEN cnt = 2 THEN (h2 + h1) / 2.0 ELSE h1 END"
        growth, orders = "mean_growth * 0.8", f"mean_orders * {seasonal}"
    else:
        rolling = "CASE WHEN cnt >= 3 THEN ((h3 + h2) + h1) / 3.0 ELSE mean_value END"
        growth, orders = "mean_growth", "mean_orders"
    trend = "greatest(0.0, CASE WHEN cnt >= 3 THEN (h1 - h3) / 2.0 WHEN cnt = 2 THEN h1 - h2 ELSE 0.0 END)"
    f = {"rolling_3m_qty": rolling, "mean_qty_per_product": "mean_value", "lag_1_qty": "h1",
         "seasonal_index": seasonal, "trend_qty": trend, "lag_2_qty": "CASE WHEN cnt >= 2 THEN h2 ELSE 0.0 END",
         "mom_growth_qty": growth, "lag_3_qty": "CASE WHEN cnt >= 3 THEN h3 ELSE 0.0 END", "total_orders": orders}
    return ", ".join(f"CAST({v} AS DOUBLE) AS feature_{k}" for k, v in f.items())


def forecast_sql(mode: str, n: int = 6, missing_fails: bool = False, state: str = "fc_state") -> str:
    score = "(0.0 + " + " + ".join(
        f"{w!r} * feature_{c}" if missing_fails else f"{w!r} * coalesce(feature_{c}, 0.0)"
        for c, w in _W.items()) + ")"
    fallback = "CAST(round_even(mean_value, 0) AS BIGINT)" if mode == "plain" else "CAST(0 AS BIGINT)"
    feats = ", ".join(f"feature_{c}" for c in _W)
    return f"""
fc_rec(product_key, step, last_month, mean_value, mean_growth, mean_orders, cnt, h1, h2, h3, seasonal,
       month, forecast, {feats}) AS (
  SELECT product_key, 0, last_month, mean_value, mean_growth, mean_orders, cnt, h1, h2, h3, seasonal,
         CAST(NULL AS DATE), CAST(NULL AS BIGINT), {", ".join("CAST(NULL AS DOUBLE)" for _ in _W)}
  FROM {state}
  UNION ALL
  SELECT product_key, step, last_month, mean_value, mean_growth, mean_orders, cnt + 1,
         CAST(pred AS DOUBLE), h1, h2, seasonal, m, pred, {feats}
  FROM (
    SELECT *, CASE WHEN mean_value IS NULL THEN NULL WHEN raw IS NULL OR isnan(raw) THEN {fallback}
                   ELSE CAST(greatest(0.0, round_even(raw, 0)) AS BIGINT) END AS pred
    FROM (SELECT *, {score} AS raw FROM (
      SELECT product_key, step + 1 AS step, last_month, mean_value, mean_growth, mean_orders, cnt, h1, h2, h3,
             seasonal, CAST(last_month + to_months(CAST(step + 1 AS INTEGER)) AS DATE) AS m,
             {_fc_features(mode).replace('month(m)', 'month(CAST(last_month + to_months(CAST(step + 1 AS INTEGER)) AS DATE))')}
      FROM fc_rec WHERE step < {n})))
)"""


def forecast_query(mode: str, select: str, missing_fails: bool = False, state: str = "fc_state") -> str:
    body = with_views("SELECT 1", state)
    ctes = body[len("WITH "):body.rindex("SELECT 1")].rstrip().rstrip(",")
    return f"WITH RECURSIVE {ctes},\n{forecast_sql(mode, 6, missing_fails, state)}\n{select}"


_FC_SEL = ("SELECT product_key, month, CAST(step AS INTEGER) AS step, forecast, "
           + ", ".join(f"round(feature_{c}, 6) AS feature_{c}" for c in _W) + " FROM fc_rec WHERE step >= 1")
ORACLE["forecast_recursive"] = forecast_query("core", _FC_SEL)
ORACLE["forecast_recursive_plain"] = forecast_query("plain", _FC_SEL)
# Products whose key has an even length lose their growth values, so that their scores fail.
view("fc_state_gaps", "SELECT * REPLACE (CASE WHEN length(product_key) % 2 = 1 THEN mean_growth END AS mean_growth) "
     "FROM fc_state", "fc_state")
ORACLE["forecast_fallback"] = forecast_query("plain", _FC_SEL, True, "fc_state_gaps")
# The first step's features do not depend on the model.
_KNOWN = "CASE WHEN feature_mean_qty_per_product IS NOT NULL THEN true END"
ORACLE["forecast_gbt"] = forecast_query("core", (
    "SELECT product_key, month, CAST(step AS INTEGER) AS step, feature_mean_qty_per_product IS NOT NULL AS known, "
    f"{_KNOWN} AS whole_and_not_negative, {_KNOWN} AS equals_transform, "
    + ", ".join(f"CASE WHEN step = 1 THEN round(feature_{c}, 6) END AS first_{c}"
                for c in ("lag_1_qty", "rolling_3m_qty", "seasonal_index", "trend_qty"))
    + " FROM fc_rec WHERE step >= 1"))
ORACLE["future_months"] = with_views(
    "SELECT product_key, CAST(last + to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM ("
    "SELECT product_key, last, unnest(generate_series(1, 6)) AS i "
    "FROM (SELECT product_key, max(month) AS last FROM fc_hist GROUP BY 1))", "fc_hist")
ORACLE["forecast_growth"] = forecast_query("core", """
SELECT f.product_key, f.month, CAST(f.step AS INTEGER) AS step, f.forecast, l.last_actual,
       round(""" + ieee("f.forecast - l.last_actual", "l.last_actual") + """ * 100.0, 6) AS growth_pct
FROM fc_rec f LEFT JOIN (SELECT product_key, total_qty AS last_actual FROM (
    SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY month DESC) AS rn
    FROM fc_hist WHERE total_qty IS NOT NULL) WHERE rn = 1) l ON f.product_key = l.product_key
WHERE f.step >= 1""")
ORACLE["history_and_forecast"] = forecast_query("core", """
SELECT product_key, month, CAST(total_qty AS DOUBLE) AS value, 'actual' AS kind FROM fc_hist WHERE total_qty IS NOT NULL
UNION ALL
SELECT product_key, month, CAST(forecast AS DOUBLE) AS value, 'forecast' AS kind FROM fc_rec WHERE step >= 1""")


# --------------------------------------------------------------------------
# Row-level operators
ROW_ID = "src_orderkey, src_linenumber, src_partkey, src_suppkey"
ORACLE["product_key"] = with_views(f"SELECT {ROW_ID}, {KEY_N} AS product_key FROM sales", "sales")
ORACLE["product_key_lenient"] = with_views(f"SELECT {ROW_ID}, {KEY_C} AS product_key FROM sales", "sales")
ORACLE["drop_cancelled"] = with_views(
    f"SELECT {ROW_ID}, status FROM sales WHERE status IS DISTINCT FROM 'Batal'", "sales")
ORACLE["order_month"] = with_views(
    f"SELECT {ROW_ID}, CAST(paid_at AS DATE) AS pay_date, CAST(date_trunc('month', paid_at) AS DATE) AS month "
    "FROM sales", "sales")
ORACLE["unit_price"] = with_views(f"SELECT {ROW_ID}, round({ieee('net_price', 'qty')}, 6) AS unit_price FROM sales",
                                  "sales")
ORACLE["discount_pct"] = with_views(
    f"SELECT {ROW_ID}, round(coalesce({ieee('list_price - net_price', 'list_price')} * 100.0, 0.0), 6) AS discount_pct "
    "FROM sales", "sales")
ORACLE["scaled_amount"] = with_views(
    f"SELECT {ROW_ID}, CAST(trunc(CAST(net_price AS DECIMAL(38,6)) * 1000) AS BIGINT) AS scaled_amount FROM sales",
    "sales")
ORACLE["parse_weight"] = with_views(
    f"SELECT {ROW_ID}, weight_text, {loc_num("replace(weight_text, ' gr', '')")} AS weight FROM sales",
    "sales")
ORACLE["parse_localized_number"] = with_views(
    f"SELECT date_text, sales_text, {loc_num('sales_text')} AS sales FROM traffic_all", "traffic_all")
ORACLE["parse_percent"] = with_views(
    f"SELECT date_text, conversion_rate_text, {pct_num('conversion_rate_text')} AS conversion_rate FROM traffic_all",
    "traffic_all")
ORACLE["holiday_day_flag"] = with_views(
    f"SELECT {ROW_ID}, CAST(paid_at AS DATE) AS pay_date, (h.holiday_date IS NOT NULL) AS is_holiday "
    "FROM sales_prep s LEFT JOIN holiday_dates h ON CAST(s.paid_at AS DATE) = h.holiday_date",
    "sales_prep", "holiday_dates")

# Monthly-grain operators
_SW = "(PARTITION BY product_key ORDER BY month)"
_S3 = "(PARTITION BY product_key ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
ORACLE["calendar_features"] = with_views(
    "SELECT month, product_key, CAST(year(month) AS BIGINT) AS year, CAST(month(month) AS BIGINT) AS month_of_year, "
    "CAST(quarter(month) AS BIGINT) AS quarter, CAST(day(last_day(month)) AS BIGINT) AS days_in_month "
    "FROM sales_monthly", "sales_monthly")
ORACLE["product_mean"] = with_views(
    "SELECT month, product_key, qty, CAST(round_even(avg(qty) OVER (PARTITION BY product_key), 0) AS BIGINT) "
    "AS mean_qty_per_product FROM sales_monthly", "sales_monthly")
ORACLE["cyclic_month"] = with_views(
    "SELECT month, product_key, round(sin(6.283185307179586 * month(month) / 12.0), 6) AS month_sin, "
    "round(cos(6.283185307179586 * month(month) / 12.0), 6) AS month_cos FROM sales_monthly", "sales_monthly")
ORACLE["quarter_flags"] = with_views(
    "SELECT month, product_key, " + ", ".join(f"quarter(month) = {q} AS quarter_{q}" for q in (1, 2, 3, 4))
    + " FROM sales_monthly", "sales_monthly")
ORACLE["mom_growth"] = with_views(
    f"SELECT month, product_key, round({ieee('qty', f'lag(qty) OVER {_SW}')} - 1.0, 6) AS mom_growth_qty, "
    f"round({ieee('sales_amount', f'lag(sales_amount) OVER {_SW}')} - 1.0, 6) AS mom_growth_sales FROM sales_monthly",
    "sales_monthly")
ORACLE["seasonal_index"] = with_views(
    "SELECT month, product_key, round(CASE WHEN avg(qty) OVER (PARTITION BY product_key) > 0 THEN "
    "avg(qty) OVER (PARTITION BY product_key, month(month)) / avg(qty) OVER (PARTITION BY product_key) "
    "ELSE 0.0 END, 6) AS seasonal_index FROM sales_monthly", "sales_monthly")
ORACLE["seasonal_profile"] = with_views("""
SELECT g.product_key, CAST(g.m AS BIGINT) AS month_of_year,
       round(CASE WHEN g.overall > 0 AND sm.c > 0 THEN (sm.s / sm.c) / g.overall ELSE 1.0 END, 6) AS seasonal_index
FROM (SELECT product_key, overall, unnest(generate_series(1, 12)) AS m
      FROM (SELECT product_key, sum(qty) / count(qty) AS overall FROM sales_monthly GROUP BY 1)) g
LEFT JOIN (SELECT product_key, month(month) AS moy, sum(qty) AS s, count(qty) AS c FROM sales_monthly GROUP BY 1, 2) sm
  ON sm.product_key = g.product_key AND sm.moy = g.m""", "sales_monthly")
ORACLE["rolling_3m"] = with_views(
    "SELECT month, product_key, " + ", ".join(f"round(avg({c}) OVER {_S3}, 6) AS rolling_3m_{o}" for c, o in
                                              (("qty", "qty"), ("sales_amount", "sales"), ("views", "views")))
    + " FROM traffic_allocated", "traffic_allocated")
ORACLE["trend_ratio"] = with_views(
    f"SELECT month, product_key, round({ieee('qty', f'lag(r3) OVER {_SW}')}, 6) AS trend_qty "
    f"FROM (SELECT *, avg(qty) OVER {_S3} AS r3 FROM sales_monthly)", "sales_monthly")
ORACLE["lag_features"] = with_views(
    "SELECT month, product_key, " + ", ".join(
        f"coalesce(lag({c}, {k}) OVER {_SW}, 0) AS lag_{k}_{o}" for k in (1, 2, 3)
        for c, o in (("qty", "qty"), ("sales_amount", "sales"), ("views", "views")))
    + " FROM traffic_allocated", "traffic_allocated")
ORACLE["linear_trend"] = with_views("""
SELECT product_key, round(greatest(0.0, CASE WHEN n >= 3 THEN (h1 - h3) / 2.0 WHEN n = 2 THEN CAST(h1 - h2 AS DOUBLE)
                                       ELSE 0.0 END), 6) AS trend
FROM (SELECT product_key, count(*) AS n, max(CASE WHEN rn = 1 THEN qty END) AS h1,
             max(CASE WHEN rn = 2 THEN qty END) AS h2, max(CASE WHEN rn = 3 THEN qty END) AS h3
      FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY month DESC) AS rn FROM sales_monthly)
      WHERE rn <= 3 GROUP BY 1)""", "sales_monthly")
ORACLE["holiday_month_flag"] = with_views(
    "SELECT s.month, s.product_key, (h.month_text IS NOT NULL) AS is_holiday_month FROM sales_monthly s "
    "LEFT JOIN holiday_months h ON strftime(s.month, '%Y-%m') = h.month_text", "sales_monthly", "holiday_months")
ORACLE["monthly_rollup"] = with_views(
    "SELECT strftime(paid_at, '%Y-%m') AS month, product_key, CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty, "
    "round(coalesce(sum(net_price), 0), 6) AS net_price, max(list_price) AS list_price, "
    "round(avg(src_linenumber), 6) AS src_linenumber, count(DISTINCT src_orderkey) AS src_orderkey FROM sales_prep "
    "WHERE paid_at IS NOT NULL AND product_key IS NOT NULL GROUP BY 1, 2", "sales_prep")
ORACLE["monthly_row_counts"] = with_views(
    "SELECT strftime(paid_at, '%Y-%m') AS month, count(*) AS row_count FROM sales WHERE paid_at IS NOT NULL GROUP BY 1",
    "sales")
ORACLE["dataset_summary"] = with_views(
    "SELECT count(*) AS n_rows, count(DISTINCT product_key) AS n_products, min(month) AS first_month, "
    "max(month) AS last_month, CAST(floor(datediff('day', min(month), max(month)) / 30) AS BIGINT) AS month_span, "
    "CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_qty FROM sales_monthly", "sales_monthly")
def _info_cols(prefix: str) -> str:
    text = ("status", "weight_text", "total_weight_text")
    return ", ".join(f"{prefix}{c}" if c in text else f"round({prefix}{c}, 6) AS {c}" for c in INFO)


ORACLE["product_info_first"] = with_views(f"SELECT product_key, {_info_cols('')} FROM product_info", "product_info")
ORACLE["product_list"] = with_views("SELECT DISTINCT product_key FROM sales_monthly", "sales_monthly")
ORACLE["top_products"] = with_views(
    "SELECT product_key, CAST(sum(qty) AS BIGINT) AS total_qty FROM sales_monthly GROUP BY 1 "
    "ORDER BY total_qty DESC, product_key ASC LIMIT 10", "sales_monthly")
ORACLE["encode_status"] = with_views(
    "SELECT s.product_key, s.month_text, s.stock_status, c.code AS stock_status_code FROM stock_status_all s JOIN "
    "(SELECT stock_status, CAST(dense_rank() OVER (ORDER BY stock_status) - 1 AS BIGINT) AS code "
    " FROM (SELECT DISTINCT stock_status FROM stock_status_all)) c ON s.stock_status = c.stock_status",
    "stock_status_all")
ORACLE["column_medians"] = with_views(
    "SELECT " + ", ".join(f"round(CAST(median({c}) AS DOUBLE), 6) AS {c}" for c in
                          ["qty", "net_amount", "orders", "cancelled_sales", "sales_per_order", "conversion_rate"])
    + " FROM traffic_allocated", "traffic_allocated")

# Joins
_TM_COLS = COUNTS + MONEY + ["sales_per_order"] + RATES
ORACLE["sales_traffic_join"] = with_views(
    "SELECT s.month, s.product_key, s.qty, s.net_amount, s.sales_amount, " + ", ".join(
        f"t.{c}" if c in COUNTS else f"round(t.{c}, 6) AS {c}" for c in _TM_COLS)
    + " FROM sales_monthly s LEFT JOIN traffic_monthly t ON s.month = t.month", "sales_monthly", "traffic_monthly")
ORACLE["sales_product_info_join"] = with_views(
    f"SELECT s.*, {_info_cols('i.')} FROM sales_monthly s LEFT JOIN product_info i ON s.product_key = i.product_key",
    "sales_monthly", "product_info")
ORACLE["sales_stock_join"] = with_views(
    "SELECT s.*, st.product_id, st.opening_stock, st.closing_stock, st.pending, st.stock_status "
    "FROM sales_monthly s LEFT JOIN stock_status st ON s.product_key = st.product_key "
    "AND strftime(s.month, '%Y-%m') = st.month_text", "sales_monthly", "stock_status")
view("join_l", "SELECT strftime(month, '%Y-%m') AS month_text, product_key, qty, net_amount FROM sales_monthly",
     "sales_monthly")
view("join_r", "SELECT product_key, month_text, sold_qty AS qty, opening_stock, stock_status FROM stock_status",
     "stock_status")
_ON = ("l.product_key IS NOT DISTINCT FROM r.product_key AND l.month_text IS NOT DISTINCT FROM r.month_text")
_REST = "l.qty AS qty_x, l.net_amount, r.qty AS qty_y, r.opening_stock, r.stock_status"
ORACLE["safe_join_left"] = with_views(
    f"SELECT l.product_key, l.month_text, {_REST} FROM join_l l LEFT JOIN join_r r ON {_ON}", "join_l", "join_r")
ORACLE["safe_join_right"] = with_views(
    f"SELECT r.product_key, r.month_text, {_REST} FROM join_l l RIGHT JOIN join_r r ON {_ON}", "join_l", "join_r")
ORACLE["safe_join_outer"] = with_views(
    f"SELECT coalesce(l.product_key, r.product_key) AS product_key, coalesce(l.month_text, r.month_text) AS month_text, "
    f"{_REST} FROM join_l l FULL OUTER JOIN join_r r ON {_ON}", "join_l", "join_r")
ORACLE["safe_join_inner"] = with_views(
    f"SELECT l.product_key, l.month_text, {_REST} FROM join_l l JOIN join_r r ON {_ON}", "join_l", "join_r")
_SJ = ("FROM sales_monthly s LEFT JOIN stock_status st ON s.product_key = st.product_key "
       "AND strftime(s.month, '%Y-%m') = st.month_text")
ORACLE["stock_turnover"] = with_views(
    f"SELECT s.month, s.product_key, round({ieee('s.qty', '(st.opening_stock + st.closing_stock) / 2.0')}, 6) "
    f"AS stock_turnover {_SJ}", "sales_monthly", "stock_status")
ORACLE["stock_coverage"] = with_views(
    f"SELECT s.month, s.product_key, round({ieee('st.closing_stock', 'avg(s.qty) OVER (PARTITION BY s.product_key ORDER BY s.month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')}, 6) "
    f"AS stock_coverage {_SJ}", "sales_monthly", "stock_status")
ORACLE["price_level"] = with_views(
    f"SELECT month, product_key, round({ieee('p', 'avg(p) OVER (PARTITION BY product_key)')}, 6) AS price_level FROM ("
    "SELECT CAST(date_trunc('month', paid_at) AS DATE) AS month, product_key, max(list_price) AS p FROM sales_prep "
    "WHERE product_key IS NOT NULL AND paid_at IS NOT NULL GROUP BY 1, 2)", "sales_prep")
ORACLE["traffic_ratios"] = with_views(
    "SELECT month, product_key, round(views / (CASE WHEN qty = 0 THEN 1 ELSE qty END), 6) AS view_to_sales_ratio, "
    "round(visitors / (CASE WHEN qty = 0 THEN 1 ELSE qty END), 6) AS visitor_to_sales_ratio, "
    "round(visitors / (CASE WHEN views = 0 THEN 1 ELSE views END), 6) AS visitor_to_view_ratio "
    "FROM traffic_allocated", "traffic_allocated")
ORACLE["interaction_features"] = with_views(
    "SELECT month, product_key, round(price_view_interaction, 6) AS price_view_interaction, "
    "round(stock_demand_interaction, 6) AS stock_demand_interaction FROM fe_f2", "fe_f2")

# Evaluation and comparison
view("core_train", "SELECT * FROM core_feat WHERE total_qty IS NOT NULL AND " + " AND ".join(
    f"{c} IS NOT NULL" for c in MODEL_FEATURES), "core_feat")
ORACLE["regression_metrics"] = with_views("""
SELECT valid_samples, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape,
       round(CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / sst END, 6) AS r2
FROM (SELECT count(*) AS valid_samples, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
             coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100.0, 0.0) AS mape,
             sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst
      FROM (SELECT CAST(total_qty AS DOUBLE) AS y, CAST(lag_1_qty AS DOUBLE) AS p FROM core_train))
WHERE valid_samples > 0""", "core_train")
ORACLE["feature_correlation"] = with_views(
    "SELECT feature, round(correlation, 6) AS correlation, CAST(row_number() OVER (ORDER BY correlation DESC NULLS LAST, "
    "feature_order) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS feature_order, CASE WHEN stddev_pop({c}) * stddev_pop(total_qty) = 0 "
        f"THEN NULL ELSE covar_pop({c}, total_qty) / (stddev_pop({c}) * stddev_pop(total_qty)) END AS correlation "
        f"FROM core_train" for i, c in enumerate(MODEL_FEATURES)) + ")", "core_train")
ORACLE["train_test_split"] = with_views(
    "SELECT product_key, month, total_qty, "
    "(('0x' || substr(md5(product_key || '|' || month), 1, 8))::BIGINT % 100) < 80 AS is_train FROM core_train",
    "core_train")
ORACLE["train_gbt"] = with_views(
    "SELECT product_key, month, total_qty, true AS prediction_finite FROM core_train "
    "WHERE (('0x' || substr(md5(product_key || '|' || month), 1, 8))::BIGINT % 100) >= 80", "core_train")
ORACLE["gbt_metrics"] = with_views(
    "SELECT count(*) AS test_rows, count(*) AS valid_samples, true AS rmse_below_product_mean, "
    "true AS mae_below_product_mean FROM core_train "
    "WHERE (('0x' || substr(md5(product_key || '|' || month), 1, 8))::BIGINT % 100) >= 80", "core_train")
ORACLE["forecast_totals"] = forecast_query("core", """
SELECT product_key, CAST(coalesce(sum(forecast), 0) AS BIGINT) AS total_forecast, round(avg(forecast), 6) AS mean_forecast,
       count(*) AS horizon FROM fc_rec WHERE step >= 1 GROUP BY 1""")
view("cmp_a", "SELECT strftime(month, '%Y-%m') AS month_text, product_key, qty, net_amount, sales_amount "
              "FROM sales_monthly", "sales_monthly")
view("cmp_b", "SELECT month AS month_text, product_key, qty, net_price AS net_amount, orders FROM core_main",
     "core_main")
ORACLE["compare_shape"] = with_views(
    "SELECT (SELECT count(*) FROM cmp_a) AS rows_processed, (SELECT count(*) FROM cmp_b) AS rows_reference, "
    "CAST(5 AS BIGINT) AS cols_processed, CAST(5 AS BIGINT) AS cols_reference, 'orders' AS missing_columns, "
    "'sales_amount' AS extra_columns, false AS shape_match", "cmp_a", "cmp_b")
_PLANTED = """
pa AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders),
pb AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 113 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1.001 WHEN o_orderkey % 101 = 0 THEN NULL
         WHEN o_orderkey % 103 = 0 THEN o_totalprice * (1 + 1e-13)
         WHEN o_orderkey % 107 = 0 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_orderkey % 211 <> 0)"""


def _differs(c: str) -> str:
    """Rows that differ, largest and sum of differences and their number, of one column over ``met``."""
    if c == "o_orderstatus":
        return ("sum(CASE WHEN pa_there IS NULL OR pb_there IS NULL OR a_{0} IS DISTINCT FROM b_{0} THEN 1 ELSE 0 END),"
                " CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)").format(c)
    x, y = (f"CASE WHEN isnan(CAST({s}_{c} AS DOUBLE)) THEN NULL ELSE CAST({s}_{c} AS DOUBLE) END" for s in "ab")
    return (f"sum(CASE WHEN pa_there IS NULL OR pb_there IS NULL THEN 1 WHEN ({x}) IS NULL AND ({y}) IS NULL THEN 0 "
            f"WHEN ({x}) IS NULL OR ({y}) IS NULL THEN 1 "
            f"WHEN abs(({x}) - ({y})) <= 1e-10 + 1e-10 * abs({y}) THEN 0 ELSE 1 END), "
            f"round(max(abs(({x}) - ({y}))), 6), round(avg(abs(({x}) - ({y}))), 6)")


def _value_rows(columns: list[tuple[str, str]]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", true AS type_match, '{t}' AS processed_type, '{t}' AS reference_type, d[1] AS "
             f"different_rows, d[2] AS max_difference, d[3] AS mean_difference, d[1] = 0 AS values_match "
             f"FROM (SELECT {_differs(c)} FROM met) AS q(d1, d2, d3), LATERAL (SELECT 1) l" for c, t in columns]
    return " UNION ALL ".join(p.replace("d[1]", "CAST(d1 AS BIGINT)").replace("d[2]", "d2").replace("d[3]", "d3")
                              .replace(", LATERAL (SELECT 1) l", "") for p in parts)


_MET = """
met AS (
  SELECT a.o_orderkey AS pa_there, b.o_orderkey AS pb_there, a.o_custkey AS a_o_custkey, b.o_custkey AS b_o_custkey,
    a.o_totalprice AS a_o_totalprice, b.o_totalprice AS b_o_totalprice, a.o_orderstatus AS a_o_orderstatus,
    b.o_orderstatus AS b_o_orderstatus
  FROM pa a FULL OUTER JOIN pb b ON a.o_orderkey = b.o_orderkey)"""
ORACLE["compare_values"] = f"WITH {_PLANTED},{_MET}\n" + _value_rows(
    [("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderstatus", "string")])
# Of a repeated key equal rows meet first, the others in the order of their columns.
ORACLE["compare_repeated_keys"] = f"""WITH {_PLANTED},
na AS (SELECT o_custkey, nullif(o_totalprice, CAST('nan' AS DOUBLE)) AS p, o_orderstatus AS s FROM pa),
nb AS (SELECT o_custkey, nullif(o_totalprice, CAST('nan' AS DOUBLE)) AS p, o_orderstatus AS s FROM pb),
ca AS (SELECT o_custkey, p, s, row_number() OVER (PARTITION BY o_custkey, p, s) AS k FROM na),
cb AS (SELECT o_custkey, p, s, row_number() OVER (PARTITION BY o_custkey, p, s) AS k FROM nb),
same AS (SELECT ca.* FROM ca JOIN cb ON ca.o_custkey IS NOT DISTINCT FROM cb.o_custkey
  AND ca.p IS NOT DISTINCT FROM cb.p AND ca.s IS NOT DISTINCT FROM cb.s AND ca.k = cb.k),
ra AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p NULLS FIRST, s NULLS FIRST) AS r FROM (
  SELECT * FROM ca EXCEPT SELECT * FROM same)),
rb AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p NULLS FIRST, s NULLS FIRST) AS r FROM (
  SELECT * FROM cb EXCEPT SELECT * FROM same)),
met AS (
  SELECT ra.r AS pa_there, rb.r AS pb_there, ra.p AS a_o_totalprice, rb.p AS b_o_totalprice,
    ra.s AS a_o_orderstatus, rb.s AS b_o_orderstatus
  FROM ra FULL OUTER JOIN rb ON ra.o_custkey = rb.o_custkey AND ra.r = rb.r
  UNION ALL SELECT 1, 1, p, p, s, s FROM same)
""" + _value_rows([("o_totalprice", "double"), ("o_orderstatus", "string")])
ORACLE["compare_verdict"] = f"""WITH {_PLANTED},{_MET},
v AS ({_value_rows([("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderstatus", "string")])}),
n AS (SELECT (SELECT count(*) FROM pa) AS a, (SELECT count(*) FROM pb) AS b),
w AS (SELECT "column" || ': ' || different_rows || ' rows differ' AS t, 3 AS o FROM v WHERE NOT values_match
  UNION ALL SELECT 'rows: ' || a || ' instead of ' || b, 1 FROM n WHERE a <> b
  UNION ALL SELECT 'extra columns: o_orderpriority', 2)
SELECT false AS success, count(*) AS n_differences, string_agg(t, '; ' ORDER BY o, t) AS message FROM w"""
ORACLE["compare_nulls"] = with_views("""
SELECT a."column", a.null_count_processed, b.null_count_reference FROM
 (SELECT 'month_text' AS "column", count(*) FILTER (WHERE month_text IS NULL) AS null_count_processed FROM cmp_a
  UNION ALL SELECT 'product_key', count(*) FILTER (WHERE product_key IS NULL) FROM cmp_a
  UNION ALL SELECT 'qty', count(*) FILTER (WHERE qty IS NULL) FROM cmp_a
  UNION ALL SELECT 'net_amount', count(*) FILTER (WHERE net_amount IS NULL) FROM cmp_a) a
JOIN
 (SELECT 'month_text' AS "column", count(*) FILTER (WHERE month_text IS NULL) AS null_count_reference FROM cmp_b
  UNION ALL SELECT 'product_key', count(*) FILTER (WHERE product_key IS NULL) FROM cmp_b
  UNION ALL SELECT 'qty', count(*) FILTER (WHERE qty IS NULL) FROM cmp_b
  UNION ALL SELECT 'net_amount', count(*) FILTER (WHERE net_amount IS NULL OR isnan(net_amount)) FROM cmp_b) b
ON a."column" = b."column\"""", "cmp_a", "cmp_b")


# Engine-independent rounding for every query (see sqltext.round_places).
from retailcast.functions.sqltext import fix_round as _fix_round  # noqa: E402

ORACLE = {k: _fix_round(v) for k, v in ORACLE.items()}


# --------------------------------------------------------------------------
# H2: date strategies; Spark patterns become strptime formats plus a shape
# regex (Spark's two-letter fields need two digits, strptime's do not).
from retailcast.sources.schema import DATE_STRATEGIES  # noqa: E402

_TOKENS = [("yyyy", "%Y", r"\d{4}"), ("dd", "%d", r"\d{2}"), ("MM", "%m", r"\d{2}"), ("HH", "%H", r"\d{2}"),
           ("mm", "%M", r"\d{2}"), ("ss", "%S", r"\d{2}"), ("d", "%d", r"\d{1,2}"), ("M", "%m", r"\d{1,2}"),
           ("H", "%H", r"\d{1,2}")]


def _pattern(p: str) -> tuple[str, str]:
    fmt, rx, i = "", "", 0
    while i < len(p):
        if p[i] == "'":
            j = p.index("'", i + 1)
            fmt += p[i + 1:j]
            rx += p[i + 1:j]
            i = j + 1
            continue
        for tok, f, r in _TOKENS:
            if p.startswith(tok, i):
                fmt, rx, i = fmt + f, rx + r, i + len(tok)
                break
        else:
            fmt += p[i]
            rx += "\\" + p[i] if p[i] in "./-" else p[i]
            i += 1
    return fmt, rx


def _strategy_ok(col: str, formats: list[str]) -> str:
    parts = []
    for p in formats:
        fmt, rx = _pattern(p)
        parts.append(f"(regexp_full_match({col}, '{rx}') AND try_strptime({col}, '{fmt}') IS NOT NULL)")
    return "(" + " OR ".join(parts) + ")"


def _rates(src: str, view_name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{src}' AS source, '{name}' AS strategy, {i} AS strategy_order, "
        f"round(avg(CASE WHEN {_strategy_ok('date_text', fm)} THEN 1.0 ELSE 0.0 END), 6) AS parsed_share "
        f"FROM {view_name}" for i, (name, fm) in enumerate(DATE_STRATEGIES))


ORACLE["date_parse_rates"] = _fix_round(with_views(
    _rates("holidays", "holidays") + " UNION ALL " + _rates("traffic", "traffic_all"), "holidays", "traffic_all"))

ORACLE["parse_dates"] = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day_first, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS month_first "
    "FROM orders WHERE o_orderdate IS NOT NULL")

ORACLE["table_round_trip"] = ORACLE["monthly_product_sales"]
_RESOLVED = [("sales", "date", "Tanggal", "paid_at", "sales"), ("sales", "product", "product", "product", "sales"),
             ("sales", "variant", "variant", "variant", "sales"), ("sales", "quantity", "qty", "qty", "sales"),
             ("sales", "price", "Harga", "net_price", "sales"),
             ("traffic", "date", "date_text", "date_text", "traffic_all"),
             ("traffic", "quantity", "orders", "orders", "traffic_all"),
             ("stock_status", "product", "product_key", "product_key", "stock_status_all"),
             ("stock_status", "month", "Bulan", "month_text", "stock_status_all"),
             ("stock_status", "stock_start", "opening_stock", "opening_stock", "stock_status_all"),
             ("stock_status", "stock_end", "closing_stock", "closing_stock", "stock_status_all"),
             ("shop_stock", "product", "product", "product", "shop_stock"),
             ("shop_stock", "variant", "variant", "variant", "shop_stock"),
             ("shop_stock", "stock", "stock", "stock", "shop_stock"),
             ("holidays", "date", "date_text", "date_text", "holidays"),
             ("holidays", "description", "holiday_name", "holiday_name", "holidays")]
ORACLE["resolve_columns"] = with_views(" UNION ALL ".join(
    f"SELECT '{r}' AS role, '{f}' AS field, '{h}' AS header, (SELECT count({c}) FROM {v}) AS n_values"
    for r, f, h, c, v in _RESOLVED), "sales", "traffic_all", "stock_status_all", "shop_stock", "holidays")


# Folders of exports that do not agree: what was written must come back.
ORACLE["mixed_headers"] = with_views(
    "SELECT CAST(paid_at AS DATE) AS date, product, CASE WHEN src_linenumber % 3 <> 2 THEN variant END AS variant, "
    "count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS quantity, "
    "round(CAST(sum(CAST(net_price AS DECIMAL(38,6))) AS DOUBLE), 6) AS price FROM sales GROUP BY 1, 2, 3", "sales")
ORACLE["mixed_columns"] = with_views(
    "SELECT product_id, month_text, product_key, CASE WHEN y % 3 <> 0 THEN opening_stock END AS opening_stock, sold_qty, "
    "closing_stock, CASE WHEN y % 3 <> 0 THEN pending END AS pending, stock_status, "
    "CASE WHEN y % 3 = 0 THEN 'a, \"b\" ' || product_key END AS remark "
    "FROM (SELECT *, CAST(substr(month_text, 1, 4) AS INTEGER) AS y FROM stock_status_all)", "stock_status_all")
ORACLE["mixed_encodings"] = (
    "SELECT p_partkey AS product_code, p_brand AS product, CAST(p_partkey AS VARCHAR) AS variant_code, "
    "CASE WHEN p_size % 10 <> 0 THEN translate(p_type, 'AEIOU', 'ÀÉÎÖü') END AS variant, p_retailprice AS price, "
    "CAST(p_size AS INTEGER) AS stock FROM part")

ORACLE["monthly_medians"] = with_views(
    "SELECT strftime(paid_at, '%Y-%m') AS month, product, round(median(net_price), 6) AS net_price_median, "
    "count(net_price) AS net_price_count, CAST(median(qty) AS DOUBLE) AS qty, CAST(median(src_orderkey) AS DOUBLE) "
    "AS src_orderkey FROM sales_prep WHERE paid_at IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2", "sales_prep")
ORACLE["product_medians"] = with_views(
    "SELECT product, variant, round(median(net_price), 6) AS net_price, round(median(ratio), 6) AS ratio, "
    f"CAST(median(qty) AS DOUBLE) AS qty FROM (SELECT *, {ieee('net_price', 'return_shipping')} AS ratio FROM sales) "
    "GROUP BY 1, 2", "sales")


def boosting_sql(table: str, features: list[str], target: str, trees: int, depth: int, l1: float = 0.1, l2: float = 1.5,
                 rate: float = 0.2) -> str:
    """Every node of boosted trees, by plain aggregates over the rows: all values of a feature are thresholds."""
    def score(g, n):
        return f"(greatest(abs({g}) - {l1}, 0) * greatest(abs({g}) - {l1}, 0) / ({n} + {l2}))"

    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(features))
    name = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(features)) + " END"
    parts = [f"r0 AS (SELECT {xs}, CAST({target} AS DOUBLE) AS y, (SELECT avg({target}) FROM {table}) AS p FROM {table})"]
    out = []
    for t in range(trees):
        parts.append(f"l{t}_0 AS (SELECT *, 0 AS node FROM r{t})")
        for d in range(depth):
            a, first = f"l{t}_{d}", (1 << d) - 1
            each = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, p - y AS g FROM {a} WHERE node >= {first}"
                                      for i in range(len(features)))
            parts.append(f"h{t}_{d} AS (SELECT node, f, v, sum(g) AS g, count(*) AS n FROM ({each}) GROUP BY ALL)")
            parts.append(f"c{t}_{d} AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, "
                         f"sum(g) OVER (PARTITION BY node, f) AS gt, sum(n) OVER (PARTITION BY node, f) AS nt "
                         f"FROM h{t}_{d} WINDOW w AS (PARTITION BY node, f ORDER BY v))")
            parts.append(f"b{t}_{d} AS (SELECT node, f, v, nt FROM (SELECT *, row_number() OVER (PARTITION BY node "
                         f"ORDER BY gain DESC, f, v) AS k FROM (SELECT *, {score('gl', 'nl')} + "
                         f"{score('(gt - gl)', '(nt - nl)')} - {score('gt', 'nt')} AS gain FROM c{t}_{d} WHERE nl < nt) "
                         f"WHERE gain > 1e-6) WHERE k = 1)")
            x = "CASE b.f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(features))) + " END"
            parts.append(f"l{t}_{d + 1} AS (SELECT l.* REPLACE (CASE WHEN b.f IS NULL THEN l.node WHEN {x} > b.v "
                         f"THEN 2 * l.node + 2 ELSE 2 * l.node + 1 END AS node) FROM {a} l LEFT JOIN b{t}_{d} b ON l.node = b.node)")
            out.append(f"SELECT {t} AS round, node, 'split' AS kind, {name} AS feature, v AS threshold, "
                       f"CAST(nt AS BIGINT) AS n_rows, CAST(NULL AS DOUBLE) AS value FROM b{t}_{d}")
        last = f"l{t}_{depth}"
        parts.append(f"w{t} AS (SELECT node, count(*) AS n, -sign(sum(p - y)) * greatest(abs(sum(p - y)) - {l1}, 0) "
                     f"/ (count(*) + {l2}) * {rate} AS w FROM {last} GROUP BY node)")
        parts.append(f"r{t + 1} AS (SELECT l.* EXCLUDE (node) REPLACE (p + w AS p) FROM {last} l JOIN w{t} USING (node))")
        out.append(f"SELECT {t}, node, 'leaf', NULL, NULL, n, round(w, 3) FROM w{t}")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(out)


ORACLE["boosted_trees"] = boosting_sql("lineitem", ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
                                       "l_extendedprice", trees=2, depth=2)
ORACLE["boosted_metrics"] = ORACLE["gbt_metrics"]
ORACLE["grid_search"] = (
    "WITH k AS (SELECT ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 100 % 3 AS b FROM lineitem), "
    "n AS (SELECT CAST(b AS INTEGER) AS fold, count(*) AS n_held_out, (SELECT count(*) FROM k) - count(*) AS n_train "
    "FROM k GROUP BY 1) SELECT depth, l2, fold, n_train, n_held_out, depth = 2 AS best, depth = 2 AS fits FROM n, "
    "(VALUES (1), (2)) d(depth), (VALUES (0.0::DOUBLE), (1.5::DOUBLE)) l(l2)")

ORACLE["safe_join_hot_keys"] = (
    "WITH l AS (SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_custkey END AS BIGINT) "
    "AS custkey, o_orderkey AS orderkey, o_totalprice AS amount_x FROM orders), "
    "r AS (SELECT CAST(CASE WHEN c_custkey % 400 = 5 THEN NULL WHEN c_custkey % 300 = 7 THEN -1 ELSE c_custkey END AS BIGINT) "
    "AS custkey, c_name AS name, c_acctbal AS amount_y FROM customer) "
    "SELECT coalesce(l.custkey, r.custkey) AS custkey, orderkey, amount_x, name, amount_y "
    "FROM l FULL JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey")

ORACLE["saved_model_forecast"] = forecast_query(
    "core", "SELECT product_key, month, CAST(step AS INTEGER) AS step, feature_mean_qty_per_product IS NOT NULL AS known, "
    "true AS same FROM fc_rec WHERE step >= 1")
ORACLE["exported_forecasts"] = forecast_query(
    "core", "SELECT product_key, month, CAST(step AS INTEGER) AS step, forecast FROM fc_rec WHERE step >= 1")
ORACLE["header_defaults"] = with_views(
    "SELECT date_text, orders AS total_orders, views AS page_views, CAST(0 AS DOUBLE) AS refunds, buyers, 'none' AS remark, "
    "CAST(16 AS INTEGER) AS n_columns FROM traffic_all", "traffic_all")
ORACLE["product_rows"] = with_views(
    "SELECT month, product_key, qty, net_amount FROM sales_monthly WHERE product_key = "
    "(SELECT min(product_key) FROM sales_monthly)", "sales_monthly")
