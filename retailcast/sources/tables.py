"""The five source tables as they are exported: header maps, types, readers.

Every file is read by its own header names and in its own encoding
(``folders.py``), so the files of a folder need not agree; values become typed with ``try_cast`` (what does not fit is NULL), columns
that a file lacks are NULL. The result has this library's canonical names and
feeds ``feature_table`` directly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.sources.folders import read_csv_folder

# Source header -> (canonical name, type), by table.
SOURCE_TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "sales": {
        "Waktu Pembayaran Dilakukan": ("paid_at", "string"),
        "Nama Produk": ("product", "string"),
        "Nama Variasi": ("variant", "string"),
        "Status Pesanan": ("status", "string"),
        "Jumlah": ("qty", "bigint"),
        "Harga Awal": ("list_price", "double"),
        "Harga Setelah Diskon": ("net_price", "double"),
        "Berat Produk": ("weight_text", "string"),
        "Total Berat": ("total_weight_text", "string"),
        "Voucher Ditanggung Penjual": ("seller_voucher", "double"),
        "Voucher Ditanggung Shopee": ("platform_voucher", "double"),
        "Potongan Koin Shopee": ("coin_discount", "double"),
        "Ongkos Kirim Dibayar oleh Pembeli": ("shipping_fee", "double"),
        "Estimasi Potongan Biaya Pengiriman": ("shipping_deduction", "double"),
        "Ongkos Kirim Pengembalian Barang": ("return_shipping", "double"),
        "Total Pembayaran": ("total_payment", "double"),
        "Perkiraan Ongkos Kirim": ("estimated_shipping", "double"),
    },
    "traffic": {
        "Tanggal": ("date_text", "string"),
        "Total Penjualan (IDR)": ("sales_text", "string"),
        "Total Pesanan": ("orders", "bigint"),
        "Penjualan per Pesanan": ("sales_per_order_text", "string"),
        "Produk Dilihat": ("views", "bigint"),
        "Total Pengunjung": ("visitors", "bigint"),
        "Tingkat Konversi (Pesanan Siap Dikirim)": ("conversion_rate_text", "string"),
        "Pesanan Dibatalkan": ("cancelled_orders", "bigint"),
        "Penjualan Dibatalkan": ("cancelled_sales", "double"),
        "Pesanan Dikembalikan": ("returned_orders", "bigint"),
        "Penjualan Dikembalikan": ("returned_sales", "double"),
        "Pembeli": ("buyers", "bigint"),
        "Total Pembeli Baru": ("new_buyers", "bigint"),
        "Total Pembeli Saat Ini": ("current_buyers", "bigint"),
        "Total Potensi Pembeli": ("potential_buyers", "bigint"),
        "Tingkat Pembelian Berulang": ("repeat_rate_text", "string"),
    },
    "stock_status": {
        "ID_Produk": ("product_id", "bigint"),
        "Bulan": ("month_text", "string"),
        "Produk_Variasi": ("product_key", "string"),
        "Stok_Awal": ("opening_stock", "bigint"),
        "Total_Jumlah": ("sold_qty", "bigint"),
        "Stok_Akhir": ("closing_stock", "bigint"),
        "Pending": ("pending", "bigint"),
        "Stok_Status": ("stock_status", "string"),
    },
    "shop_stock": {
        "Kode Produk": ("product_code", "bigint"),
        "Nama Produk": ("product", "string"),
        "Kode Variasi": ("variant_code", "string"),
        "Nama Variasi": ("variant", "string"),
        "Harga": ("price", "double"),
        "Stok": ("stock", "int"),
    },
    "holidays": {
        "Tanggal": ("date_text", "string"),
        "Nama Libur": ("holiday_name", "string"),
        "Tahun": ("year", "int"),
    },
}

#: The order of sales rows in their files, as two whole numbers.
FILE_ORDER = ["source_block", "source_row"]


def to_canonical(df: DataFrame, table: str) -> DataFrame:
    """Typed canonical columns of one source table; other columns pass unless their name clashes."""
    spec = SOURCE_TABLES[table]
    made = [(F.col(f"`{h}`").try_cast(kind) if h in df.columns else F.lit(None).cast(kind)).alias(name)
            for h, (name, kind) in spec.items()]
    names = {name for name, _ in spec.values()}
    return df.select(*made, *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns
                              if c not in spec and c not in names])


LOCAL_URI = re.compile("^file:/+")   # Spark writes it with one slash in a row's metadata, with three in a listing


def with_file_order(df: DataFrame) -> DataFrame:
    """``row_order`` (file, block, row) as two numbers that sort alike.

    File names are ranked on the driver, which has listed them anyway.
    """
    files = sorted(df.inputFiles())
    spark = df.sparkSession
    ranks = spark.createDataFrame([(LOCAL_URI.sub("file:/", f), i) for i, f in enumerate(files)],
                                  "__file string, __rank bigint")
    return (df.join(ranks, F.regexp_replace("row_order.file", LOCAL_URI.pattern, "file:/") == F.col("__file"), "left")
            .withColumns({"source_block": F.col("__rank") * (1 << 42) + F.col("row_order.block"),
                          "source_row": F.col("row_order.row")})
            .drop("__file", "__rank", "row_order"))


def read_source_table(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """One exported CSV file, or a folder of them, in canonical form.

    Sales also get their file order, which 'keep the first row' needs.
    """
    df = read_csv_folder(spark, path, lambda part: to_canonical(part, table), with_row_order=table == "sales")
    return with_file_order(df) if table == "sales" else df
