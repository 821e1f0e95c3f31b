"""The fixture views of ``retailcast.sources.fixtures`` as DuckDB SQL.

Used only by the oracle: ``with_views(body, 'sales', ...)`` prefixes a query
with the CTEs it needs, in dependency order.
"""

from __future__ import annotations

NO_VARIANT = "'Tidak ada variasi'"


def thousands(expr: str) -> str:
    return f"replace(format('{{:,}}', CAST({expr} AS BIGINT)), ',', '.')"


def cents_text(expr: str) -> str:
    return (f"({thousands(f'({expr}) // 100')} || ',' || "
            f"lpad(CAST(({expr}) % 100 AS VARCHAR), 2, '0'))")


def bp_text(expr: str) -> str:
    return (f"(CAST(({expr}) // 100 AS VARCHAR) || ',' || "
            f"lpad(CAST(({expr}) % 100 AS VARCHAR), 2, '0') || '%')")


VARIANT = "CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE p.p_type END"
KEY_N = f"(product || ' - ' || coalesce(variant, {NO_VARIANT}))"
KEY_C = "(coalesce(product, 'nan') || ' - ' || coalesce(variant, ''))"

VIEWS: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}

VIEWS["sales"] = f"""
SELECT l.l_orderkey AS src_orderkey, l.l_linenumber AS src_linenumber,
       l.l_partkey AS src_partkey, l.l_suppkey AS src_suppkey,
       o.o_orderdate AS paid_at, p.p_brand AS product, {VARIANT} AS variant,
       CASE l.l_returnflag WHEN 'R' THEN 'Batal' WHEN 'N' THEN 'Selesai' ELSE NULL END AS status,
       CAST(l.l_quantity AS BIGINT) AS qty,
       l.l_extendedprice AS list_price,
       l.l_extendedprice * (CAST(1.0 AS DOUBLE) - l.l_discount) AS net_price,
       {thousands('p.p_size * 100')} || ' gr' AS weight_text,
       {thousands('CAST(p.p_size * 100 AS BIGINT) * CAST(l.l_quantity AS BIGINT)')} || ' gr' AS total_weight_text,
       l.l_extendedprice * l.l_discount AS seller_voucher,
       l.l_extendedprice * l.l_discount / 2.0 AS platform_voucher,
       l.l_quantity AS coin_discount,
       l.l_extendedprice * l.l_tax AS shipping_fee,
       l.l_extendedprice * l.l_tax / 2.0 AS shipping_deduction,
       CASE WHEN l.l_returnflag = 'R' THEN l.l_tax ELSE 0.0 END AS return_shipping,
       l.l_extendedprice * l.l_tax + 1.0 AS estimated_shipping,
       (l.l_extendedprice * (CAST(1.0 AS DOUBLE) - l.l_discount)) * (CAST(1.0 AS DOUBLE) + l.l_tax) AS total_payment
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""
DEPS["sales"] = ()

VIEWS["traffic_daily"] = """
SELECT CAST(o_orderdate AS DATE) AS day,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS sales_cents,
       count(*) AS orders,
       count(DISTINCT o_custkey) AS buyers,
       sum(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) AS new_buyers,
       sum(CASE WHEN o_custkey % 3 = 1 THEN 1 ELSE 0 END) AS current_buyers,
       sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS cancelled_orders,
       sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS returned_orders,
       coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END), 0) AS cancelled_cents,
       coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END), 0) AS returned_cents
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-04-01'
GROUP BY 1"""
DEPS["traffic_daily"] = ()

VIEWS["traffic"] = f"""
SELECT strftime(day, '%d/%m/%Y') AS date_text,
       {cents_text('sales_cents')} AS sales_text,
       CAST(orders AS BIGINT) AS orders,
       {cents_text('sales_cents // orders')} AS sales_per_order_text,
       CAST(orders * 20 AS BIGINT) AS views,
       CAST(orders * 5 AS BIGINT) AS visitors,
       {bp_text('(cancelled_orders * 10000) // orders')} AS conversion_rate_text,
       CAST(cancelled_orders AS BIGINT) AS cancelled_orders,
       cancelled_cents / 100.0 AS cancelled_sales,
       CAST(returned_orders AS BIGINT) AS returned_orders,
       returned_cents / 100.0 AS returned_sales,
       CAST(buyers AS BIGINT) AS buyers,
       CAST(new_buyers AS BIGINT) AS new_buyers,
       CAST(current_buyers AS BIGINT) AS current_buyers,
       CAST(orders * 3 - new_buyers AS BIGINT) AS potential_buyers,
       {bp_text('(returned_orders * 10000) // orders')} AS repeat_rate_text
FROM traffic_daily"""
DEPS["traffic"] = ("traffic_daily",)
# The same for every day; the cut view leaves months without traffic for the estimate.
VIEWS["traffic_daily_all"] = VIEWS["traffic_daily"].replace(" WHERE o_orderdate >= TIMESTAMP '1995-04-01'", "")
DEPS["traffic_daily_all"] = ()
VIEWS["traffic_all"] = VIEWS["traffic"].replace("FROM traffic_daily", "FROM traffic_daily_all")
DEPS["traffic_all"] = ("traffic_daily_all",)

# Strict-key monthly sales after the cancellation rule (FIXTURES "monthly sales view").
VIEWS["sales_monthly_base"] = f"""
SELECT CAST(date_trunc('month', paid_at) AS DATE) AS month, {KEY_N} AS product_key,
       CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty,
       CAST(trunc(coalesce(sum(CAST(net_price AS DECIMAL(38,6))), 0) * 1000) AS BIGINT) AS net_amount
FROM sales
WHERE status IS DISTINCT FROM 'Batal' AND {KEY_N} IS NOT NULL AND paid_at IS NOT NULL
GROUP BY 1, 2"""
DEPS["sales_monthly_base"] = ("sales",)

VIEWS["product_ids"] = f"""
SELECT p.p_brand || ' - ' || coalesce({VARIANT}, {NO_VARIANT}) AS product_key, min(p.p_partkey) AS product_id
FROM part p GROUP BY 1"""
DEPS["product_ids"] = ()

VIEWS["stock_base"] = """
SELECT i.product_id, s.month, s.product_key, s.qty AS sold_qty,
       CAST(CASE WHEN (month(s.month) + length(s.product_key)) % 5 = 0 THEN s.qty
            ELSE greatest(1, s.qty + (((year(s.month) * 12 + month(s.month) + length(s.product_key)) % 9) - 2) * 8)
       END AS BIGINT) AS opening_stock
FROM sales_monthly_base s LEFT JOIN product_ids i ON s.product_key = i.product_key
WHERE month(s.month) <> 7"""
DEPS["stock_base"] = ("sales_monthly_base", "product_ids")

VIEWS["stock_status"] = """
SELECT product_id, strftime(month, '%Y-%m') AS month_text, product_key, opening_stock, sold_qty,
       greatest(opening_stock - sold_qty, 0) AS closing_stock,
       greatest(sold_qty - opening_stock, 0) AS pending,
       CASE WHEN greatest(sold_qty - opening_stock, 0) > 0 THEN 'Understock'
            WHEN greatest(opening_stock - sold_qty, 0) = 0 THEN 'Optimal'
            WHEN greatest(opening_stock - sold_qty, 0) <= 20 THEN 'Kurang Optimal'
            ELSE 'Overstock' END AS stock_status
FROM stock_base"""
DEPS["stock_status"] = ("stock_base",)
VIEWS["stock_base_all"] = VIEWS["stock_base"].replace("\nWHERE month(s.month) <> 7", "")
DEPS["stock_base_all"] = DEPS["stock_base"]
VIEWS["stock_status_all"] = VIEWS["stock_status"].replace("FROM stock_base", "FROM stock_base_all")
DEPS["stock_status_all"] = ("stock_base_all",)

VIEWS["shop_stock"] = f"""
SELECT p.p_partkey AS product_code, p.p_brand AS product, CAST(p.p_partkey AS VARCHAR) AS variant_code,
       {VARIANT} AS variant, p.p_retailprice AS price, p.p_size AS stock
FROM part p"""
DEPS["shop_stock"] = ()

VIEWS["holidays"] = """
SELECT CAST(h.mo AS VARCHAR) || '/' || CAST(h.d AS VARCHAR) || '/' || CAST(y AS VARCHAR) AS date_text,
       h.name AS holiday_name, CAST(y AS INTEGER) AS year
FROM (SELECT y, unnest([{'mo': 1, 'd': 1, 'name': 'Tahun Baru'}, {'mo': 5, 'd': 1, 'name': 'Hari Buruh'},
                        {'mo': 6, 'd': 1, 'name': 'Hari Lahir Pancasila'},
                        {'mo': 8, 'd': 17, 'name': 'Hari Kemerdekaan'},
                        {'mo': 12, 'd': 25, 'name': 'Hari Natal'}]) AS h
      FROM (SELECT unnest(generate_series(1995, 2001)) AS y))"""
DEPS["holidays"] = ()

VIEWS["holiday_dates"] = """
SELECT DISTINCT CAST(strptime(date_text, '%m/%d/%Y') AS DATE) AS holiday_date FROM holidays"""
DEPS["holiday_dates"] = ("holidays",)

VIEWS["holiday_months"] = """
SELECT DISTINCT strftime(holiday_date, '%Y-%m') AS month_text FROM holiday_dates"""
DEPS["holiday_months"] = ("holiday_dates",)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in DEPS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <views...>, <extra...> <body>``; extra CTEs come after the views."""
    ctes = [f"{n} AS ({VIEWS[n]}\n)" for n in _order(names)]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v}\n)")
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
