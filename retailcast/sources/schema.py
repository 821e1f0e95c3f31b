"""Header handling: role-based column resolution, date-format choice,
renames, defaults. Decisions are made from ``df.columns`` and one small
aggregate; the data itself is never pulled to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header aliases per table role and logical field, in priority
# order (source headers first, then this library's canonical names).
COLUMN_ALIASES: dict[str, dict[str, list[str]]] = {
    "sales": {
        "date": ["Waktu Pembayaran Dilakukan", "Tanggal", "Date", "Waktu", "paid_at"],
        "product": ["Nama Produk", "Product", "Produk", "Item", "product"],
        "variant": ["Nama Variasi", "Variasi", "Variant", "SKU", "variant"],
        "quantity": ["Jumlah", "Quantity", "Qty", "Total Jumlah", "qty"],
        "price": ["Harga Setelah Diskon", "Harga", "Price", "Amount", "net_price"],
    },
    "traffic": {
        "date": ["Tanggal", "Date", "Waktu Pesanan Dibuat", "Waktu", "date_text"],
        "quantity": ["Total Pesanan", "Pesanan Siap", "Jumlah", "Quantity", "orders"],
    },
    "stock_status": {
        "product": ["Produk_Variasi", "Nama Produk", "Product", "Produk", "product_key"],
        "month": ["Bulan", "Month", "Tanggal", "month_text"],
        "stock_start": ["Stok_Awal", "Stok Awal", "Stock Start", "opening_stock"],
        "stock_end": ["Stok_Akhir", "Stok Akhir", "Stock End", "closing_stock"],
    },
    "shop_stock": {
        "product": ["Nama Produk", "Product", "Produk", "Item", "product"],
        "variant": ["Nama Variasi", "Variasi", "Variant", "variant"],
        "stock": ["Stok", "Stock", "Quantity", "Jumlah", "stock"],
    },
    "holidays": {
        "date": ["Tanggal", "Date", "Hari Libur", "date_text"],
        "description": ["Keterangan", "Description", "Desc", "Detail", "holiday_name"],
    },
}

# Date strategies tried in order; the first that parses more
# than 80 % of the rows wins. Day-first, month-first, ISO, then explicit forms.
DATE_STRATEGIES: list[tuple[str, list[str]]] = [
    ("dayfirst", ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss",
                  "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]),
    ("monthfirst", ["M/d/yyyy", "M-d-yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
                    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]),
    ("iso", ["yyyy-MM-dd"]),
    ("d/m/Y", ["dd/MM/yyyy"]),
    ("m/d/Y", ["MM/dd/yyyy"]),
    ("infer", ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd"]),
]
PARSE_THRESHOLD = 0.8


def resolve_columns(df: DataFrame, role: str) -> dict[str, str | None]:
    """{logical field: first alias present in ``df.columns`` or None}."""
    cols = set(df.columns)
    return {field: next((a for a in aliases if a in cols), None)
            for field, aliases in COLUMN_ALIASES.get(role, {}).items()}


def _strategy_expr(c, formats):
    c = F.col(c)
    if formats is None:
        return None
    text = c.cast("string")
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*parsed)


# What the strategies' formats can match at all, and a time of day in its range.
_DAY_OR_MONTH_FIRST = r"^([0-9]{1,2}[-/.][0-9]{1,2}[-/.])([0-9]{4})((?: [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)$"
_YEAR_FIRST = r"^([0-9]{4})([-/][0-9]{2}[-/][0-9]{2}|[0-9]{4})((?:[ Tt][0-9]{2}:[0-9]{2}:[0-9]{2})?)$"
_TIME = r"^.(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?$"


def date_shape(text):
    """``text`` with what no strategy tells apart made alike: the year becomes a leap year, another year or 0, a
    time of day all zeros (nines where it is out of range). Day and month stay, and so does every width, so a
    text parses under a format if and only if its shape does. Texts with other characters become ''.

    A column has a few hundred shapes however many rows it has.
    """
    def part(pattern, k):
        return F.regexp_extract(text, pattern, k)

    def year(y):
        n = y.cast("int")
        leap = (n % 4 == 0) & ((n % 100 != 0) | (n % 400 == 0))
        return F.when(n == 0, "0000").when(leap, "2000").otherwise("2001")

    def time(t):
        return F.regexp_replace(t, "[0-9]", F.when(t.rlike(_TIME), F.lit("0")).otherwise(F.lit("9")))

    return (F.when(text.isNull(), None)
            .when(text.rlike(_DAY_OR_MONTH_FIRST), F.concat(part(_DAY_OR_MONTH_FIRST, 1), year(part(_DAY_OR_MONTH_FIRST, 2)),
                                                            time(part(_DAY_OR_MONTH_FIRST, 3))))
            .when(text.rlike(_YEAR_FIRST), F.concat(year(part(_YEAR_FIRST, 1)), part(_YEAR_FIRST, 2),
                                                    time(part(_YEAR_FIRST, 3))))
            .when(text.rlike(r"^[-0-9+/.:Tt ]*$"), text).otherwise(""))


def date_shapes(df: DataFrame, col: str) -> DataFrame:
    """(shape, n): the histogram of shapes, one pass with a mergeable aggregate."""
    return df.groupBy(date_shape(F.col(col).cast("string")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def date_parse_rates(df: DataFrame, col: str) -> DataFrame:
    """One row per strategy: (strategy, order, parsed share), from one pass over the column (the shapes'
    histogram); a timestamp column parses at 100 %."""
    if dict(df.dtypes).get(col) in ("timestamp", "timestamp_ntz", "date"):
        rates = [F.avg(F.col(col).isNotNull().cast("double")).alias(f"s{i}") for i in range(len(DATE_STRATEGIES))]
        row = df.agg(*rates)
    else:
        n = F.sum("n")
        row = date_shapes(df, col).agg(*[
            (F.sum(F.when(_strategy_expr("shape", fm).isNotNull(), F.col("n")).otherwise(0)) / n).alias(f"s{i}")
            for i, (_, fm) in enumerate(DATE_STRATEGIES)])
    stack = ", ".join(f"'{name}', {i}, s{i}" for i, (name, _) in enumerate(DATE_STRATEGIES))
    return row.selectExpr(f"stack({len(DATE_STRATEGIES)}, {stack}) AS (strategy, strategy_order, parsed_share)")


def choose_date_strategy(df: DataFrame, col: str) -> int:
    """The first strategy over the threshold, each tested on the raw text (so one failure cannot hide another);
    the last one if none is, as in the source. One pass over the column, whichever it is."""
    shares = {r["strategy_order"]: r["parsed_share"] or 0.0 for r in date_parse_rates(df, col).collect()}
    return next((i for i in sorted(shares) if shares[i] > PARSE_THRESHOLD), len(DATE_STRATEGIES) - 1)


def parse_dates(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Parse ``col`` with the strategy that one pass over it chooses."""
    out = out or col
    t = dict(df.dtypes).get(col)
    if t in ("timestamp", "timestamp_ntz"):
        return df.withColumn(out, F.col(col)) if out != col else df
    if t == "date":
        return df.withColumn(out, F.col(col).cast("timestamp_ntz"))
    return df.withColumn(out, _strategy_expr(col, DATE_STRATEGIES[choose_date_strategy(df, col)][1]))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns that are present; others are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def ensure_column(df: DataFrame, col: str, default=None, copy_from: str | None = None) -> DataFrame:
    """Add ``col`` when absent: a copy of ``copy_from`` if present, else the default."""
    if col in df.columns:
        return df
    if copy_from and copy_from in df.columns:
        return df.withColumn(col, F.col(copy_from))
    return df.withColumn(col, F.lit(default))
