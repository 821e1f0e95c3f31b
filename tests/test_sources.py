"""CSV reading: quoting, Latin-1 fallback, typed schema."""

from retailcast.sources.readers import read_csv, read_csv_with_fallback


def test_latin1_fallback(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes("name,qty\n\"Caf\xe9, besar\",3\n".encode("latin-1"))
    df = read_csv_with_fallback(spark, str(p), "name string, qty int")
    row = df.collect()[0]
    assert row.name == "Café, besar" and row.qty == 3


def test_utf8_and_order(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("name,qty\nb,1\na,2\n", encoding="utf-8")
    rows = read_csv(spark, str(p), "name string, qty int", with_row_order=True).orderBy("row_order").collect()
    assert [r.name for r in rows] == ["b", "a"]


def test_date_strategy_choice(spark):
    from retailcast.sources.schema import parse_dates
    # month-first texts: day-first parses 2 of 4 (< 80 %), month-first all
    us = spark.createDataFrame([("1/5/2024",), ("8/17/2024",), ("12/25/2024",), ("2/1/2024",)], "d string")
    got = [r.d for r in parse_dates(us, "d").collect()]
    assert [(x.month, x.day) for x in got] == [(1, 5), (8, 17), (12, 25), (2, 1)]
    eu = spark.createDataFrame([("05/01/2024",), ("17/08/2024",)], "d string")
    got = [r.d for r in parse_dates(eu, "d").collect()]
    assert [(x.month, x.day) for x in got] == [(1, 5), (8, 17)]


def test_permissive_typed_read(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("name,qty\nok,3\nbad,x\n", encoding="utf-8")
    rows = {r.name: r.qty for r in read_csv(spark, str(p), "name string, qty int").collect()}
    assert rows == {"ok": 3, "bad": None}


def test_row_order_over_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("name\na1\na2\n")
    (tmp_path / "d" / "b.csv").write_text("name\n" + "".join(f"b{i}\n" for i in range(500)))
    rows = read_csv(spark, str(tmp_path / "d"), "name string", with_row_order=True).orderBy("row_order").collect()
    assert [r.name for r in rows] == ["a1", "a2"] + [f"b{i}" for i in range(500)]


def test_line_breaks_and_malformed_records(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text('name,qty\n"two\nlines",1\nplain,2\nbad,x\n', encoding="utf-8")
    rows = read_csv(spark, str(p), "name string, qty int", multi_line=True, corrupt_column="bad").cache().collect()
    assert [(r.name, r.qty) for r in rows] == [("two\nlines", 1), ("plain", 2), ("bad", None)]
    assert [r.bad for r in rows] == [None, None, "bad,x"]


def test_payment_times_in_text(spark):
    from retailcast.operators.clean import with_order_month
    df = spark.createDataFrame([("2024-01-31 10:00",), ("2024-02-01",), ("31/01/2024",), ("junk",), (None,)],
                               "paid_at string")
    got = [str(r.month) for r in with_order_month(df).collect()]
    assert got == ["2024-01-01", "2024-02-01", "None", "None", "None"]


def test_one_holiday_format_per_column(spark):
    from retailcast.operators.joins import parse_holiday_dates
    df = spark.createDataFrame([("13/01/2024",), ("05/01/2024",)], "date_text string")
    assert [str(r.holiday_date) for r in parse_holiday_dates(df).collect()] == ["2024-01-13", "2024-01-05"]
