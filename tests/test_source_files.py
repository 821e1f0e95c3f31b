"""The notebook path from hand-written CSV files with the source headers to the feature table."""

import csv
import datetime as dt
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from retailcast.operators.clean import drop_cancelled
from retailcast.plans.feature_table import feature_table
from retailcast.sources.tables import FILE_ORDER, SOURCE_TABLES, read_source_table


def write(path, table, rows, shuffle=None):
    headers = list(SOURCE_TABLES[table])
    if shuffle:
        random.Random(shuffle).shuffle(headers)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, headers)
        out.writeheader()
        for r in rows:
            out.writerow({h: r.get(h, "") for h in headers})


def source_files(tmp_path):
    rng = random.Random(5)
    products = [("Kopi, bubuk", "250 g"), ("Teh hijau", ""), ("Gula", "1 kg")]
    sales, stock, traffic = [], [], []
    for month in range(1, 9):
        for k, (name, variant) in enumerate(products):
            if (month + k) % 4 == 0:
                continue   # months without sales
            for day in (3, 17):
                price = 10.0 + month + k
                sales.append({
                    "Waktu Pembayaran Dilakukan": f"2024-{month:02d}-{day:02d} 10:15", "Nama Produk": name,
                    "Nama Variasi": variant, "Status Pesanan": rng.choice(["Selesai", "Batal", ""]),
                    "Jumlah": rng.randint(1, 5), "Harga Awal": price, "Harga Setelah Diskon": price * 0.9,
                    "Berat Produk": "1.200 gr", "Total Berat": "2.400 gr", "Total Pembayaran": price,
                    "Voucher Ditanggung Penjual": 1, "Voucher Ditanggung Shopee": 2, "Potongan Koin Shopee": 0.5})
            key = f"{name} - {variant}" if variant else f"{name} - Tidak ada variasi"
            if month != 5:
                stock.append({"ID_Produk": 100 + k, "Bulan": f"2024-{month:02d}", "Produk_Variasi": key, "Stok_Awal": 20,
                              "Total_Jumlah": 3, "Stok_Akhir": 17, "Pending": 0, "Stok_Status": "Kurang Optimal"})
        if month > 2:
            for day in (1, 15):
                traffic.append({"Tanggal": f"{day:02d}/{month:02d}/2024", "Total Penjualan (IDR)": "1.234,5",
                                "Total Pesanan": 12, "Penjualan per Pesanan": "102,9", "Produk Dilihat": 240,
                                "Total Pengunjung": 60, "Tingkat Konversi (Pesanan Siap Dikirim)": "2,34%",
                                "Pesanan Dibatalkan": 1, "Penjualan Dibatalkan": 10.5, "Pesanan Dikembalikan": 0,
                                "Penjualan Dikembalikan": 0, "Pembeli": 11, "Total Pembeli Baru": 4,
                                "Total Pembeli Saat Ini": 7, "Total Potensi Pembeli": 30,
                                "Tingkat Pembelian Berulang": "5,00%"})
    sales.append({"Waktu Pembayaran Dilakukan": "not a time", "Nama Produk": "Gula", "Nama Variasi": "1 kg", "Jumlah": 2})
    holidays = [{"Tanggal": "1/1/2024", "Nama Libur": "Tahun Baru", "Tahun": 2024},
                {"Tanggal": "8/17/2024", "Nama Libur": "Hari Kemerdekaan", "Tahun": 2024}]
    write(tmp_path / "sales.csv", "sales", sales, shuffle=1)
    write(tmp_path / "traffic.csv", "traffic", traffic, shuffle=2)
    write(tmp_path / "stock.csv", "stock_status", stock)
    write(tmp_path / "holidays.csv", "holidays", holidays)
    return {t: str(tmp_path / f"{n}.csv") for t, n in (("sales", "sales"), ("traffic", "traffic"),
                                                        ("stock_status", "stock"), ("holidays", "holidays"))}, sales


def test_feature_table_from_files(spark, tmp_path):
    paths, raw = source_files(tmp_path)
    t = {name: read_source_table(spark, path, name) for name, path in paths.items()}
    assert [r["product"] for r in t["sales"].orderBy(*FILE_ORDER).collect()] == [r["Nama Produk"] for r in raw]
    out = feature_table(t["sales"], t["traffic"], t["stock_status"], t["holidays"], order_cols=FILE_ORDER)
    assert len(out.columns) == 76
    rows = {(r.month, r.product_key): r for r in out.collect()}
    kept = [r for r in raw if r.get("Status Pesanan") != "Batal" and r["Waktu Pembayaran Dilakukan"] != "not a time"]
    keys = {(r["Waktu Pembayaran Dilakukan"][:7],
             f"{r['Nama Produk']} - {r['Nama Variasi'] or 'Tidak ada variasi'}") for r in kept}
    assert set(rows) == keys
    for (month, key), r in rows.items():
        own = [x for x in kept if x["Waktu Pembayaran Dilakukan"][:7] == month and key.startswith(x["Nama Produk"])]
        assert r.qty == sum(x["Jumlah"] for x in own)
        assert r.weight == 1200.0 and r.platform_voucher == 2.0
        assert r.is_holiday_month == (month in ("2024-01", "2024-08"))
        # identifiers stay what they are, or missing: never a median
        known = {"Kopi, bubuk": 100.0, "Teh hijau": 101.0, "Gula": 102.0}[key.rsplit(" - ", 1)[0]]
        assert r.product_id == (None if month == "2024-05" else known)


def test_feature_table_of_the_fixtures_is_complete(spark):
    from retailcast.catalog import QUERIES
    out = QUERIES["feature_table"](spark, "/root/testdata/sf0.001")
    assert len(out.columns) == 76
    ids = out.where("product_id is not null").groupBy("product_key").agg(F.count_distinct("product_id").alias("n"))
    assert ids.where("n > 1").count() == 0


def test_dropped_rows_are_reported(spark):
    seen = Observation("cancelled")
    df = spark.createDataFrame([("Batal",), (None,), ("Selesai",), ("Batal",)], "status string")
    assert drop_cancelled(df, report=seen).count() == 2
    assert seen.get == {"rows": 4, "dropped": 2}


def test_plans_of_the_allocation(spark):
    """One scan of the order lines and one range shuffle; the lines are never sorted for an aggregate."""
    from retailcast.catalog import _monthly, _traffic_m
    from retailcast.operators import allocate
    seen = []
    cut = allocate.cut_lineage
    try:
        allocate.cut_lineage = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)
        out = allocate.allocate_traffic(_monthly(spark, "/root/testdata/sf0.001"), _traffic_m(spark, "/root/testdata/sf0.001"))
    finally:
        allocate.cut_lineage = cut
    plans = [*seen, out._jdf.queryExecution().executedPlan().toString()]
    assert sum(p.count("FileScan parquet [l_orderkey") for p in plans) == 1
    assert sum(p.count("rangepartitioning(month") for p in plans) == 1
    assert not any("SortAggregate" in p for p in plans)
