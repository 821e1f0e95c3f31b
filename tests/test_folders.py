"""Folders whose files have headers and encodings of their own."""

import pytest

from retailcast.sources import folders
from retailcast.sources.readers import read_csv_with_fallback
from retailcast.sources.tables import FILE_ORDER, read_source_table


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def test_permuted_and_absent_columns(spark, tmp_path):
    d = tmp_path / "exports"
    put(d, "2024 01 [a].csv", "Tanggal,Nama Libur,Tahun\n1/1/2024,Tahun Baru,2024\n")
    put(d, "2024 02 é.csv", "Nama Libur,Tahun,Tanggal\nHari Buruh,2024,5/1/2024\n")
    put(d, "2024 03.csv", "Tahun,Nama Libur\n2024,\"Natal, \"\"besar\"\"\"\n")
    put(d, "empty.csv", "")
    put(d, "header.csv", "Tanggal,Tahun,Extra\n")
    got = sorted(map(tuple, read_source_table(spark, str(d), "holidays").drop("Extra").collect()), key=str)
    assert got == sorted([("1/1/2024", "Tahun Baru", 2024), ("5/1/2024", "Hari Buruh", 2024),
                          (None, 'Natal, "besar"', 2024)], key=str)


def test_encodings_by_file(spark, tmp_path):
    d = tmp_path / "both"
    put(d, "a.csv", "Nama Produk,Stok\ncafé,1\n")
    put(d, "b.csv", "Nama Produk,Stok\ncafé,2\n", "latin-1")
    put(d, "c.csv", "Stok,Nama Produk\n3,café\n", "latin-1")
    assert sorted(folders.file_encodings(spark, str(d)).values()) == ["ISO-8859-1", "ISO-8859-1", "UTF-8"]
    rows = read_source_table(spark, str(d), "shop_stock").collect()
    assert sorted((r["product"], r["stock"]) for r in rows) == [("café", 1), ("café", 2), ("café", 3)]
    same = tmp_path / "same"
    put(same, "a.csv", "name,qty\ncafé,1\n")
    put(same, "b.csv", "name,qty\ncafé,2\n", "latin-1")
    for schema in (None, "name string, qty int"):
        assert [r["name"] for r in read_csv_with_fallback(spark, str(same), schema).collect()] == ["café", "café"]


def test_latin1_header(spark, tmp_path):
    d = tmp_path / "h"
    put(d, "a.csv", "année,n\nx,1\n", "latin-1")
    put(d, "b.csv", "année,n\ny,2\n")
    df = folders.read_csv_folder(spark, str(d))
    assert df.columns == ["année", "n"] and sorted(r["année"] for r in df.collect()) == ["x", "y"]


def test_roles_resolved_by_file(spark, tmp_path):
    d = tmp_path / "roles"
    put(d, "a.csv", "Tanggal,Item,Qty\n2024-01-05,tea,3\n")
    put(d, "b.csv", "Quantity,Produk,Date,SKU\n4,rice,2024-02-01,1 kg\nx,salt,bad,\n")
    df = folders.read_role_folder(spark, str(d), "sales",
                                  {"date": "date", "product": "string", "variant": "string", "quantity": "bigint"})
    got = {r["product"]: (str(r["date"]), r["variant"], r["quantity"]) for r in df.collect()}
    assert got == {"tea": ("2024-01-05", None, 3), "rice": ("2024-02-01", "1 kg", 4), "salt": ("None", None, None)}


def test_file_order_over_groups(spark, tmp_path):
    d = tmp_path / "sales"
    put(d, "a.csv", "Nama Produk,Jumlah\n" + "".join(f"a{i},1\n" for i in range(50)))
    put(d, "b.csv", "Jumlah,Nama Produk\n" + "".join(f"1,b{i}\n" for i in range(50)))
    put(d, "c.csv", "Nama Produk,Jumlah\n" + "".join(f"c{i},1\n" for i in range(50)), "latin-1")
    rows = read_source_table(spark, str(d), "sales").orderBy(*FILE_ORDER).collect()
    assert [r["product"] for r in rows] == [f"{f}{i}" for f in "abc" for i in range(50)]


def test_as_many_scans_as_groups(spark, tmp_path):
    d = tmp_path / "many"
    for i in range(6):
        put(d, f"{i}.csv", "a,b\n1,2\n" if i % 2 else "b,a\n2,1\n")
    df = folders.read_csv_folder(spark, str(d))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert {tuple(r) for r in df.select("a", "b").collect()} == {("1", "2")} and df.count() == 6


def test_no_files(spark, tmp_path):
    put(tmp_path / "none", "a.csv", "")
    for table in ("holidays", "sales"):
        assert read_source_table(spark, str(tmp_path / "none"), table).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_source_table(spark, str(tmp_path / "absent"), "holidays")
