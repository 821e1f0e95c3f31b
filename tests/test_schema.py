"""Header handling: alias resolution, renames, drops and defaults."""

from retailcast.sources.schema import drop_if_present, ensure_column, rename_columns, resolve_columns


def test_resolve_by_priority(spark):
    df = spark.createDataFrame([("x", "y", 1, 2.0, "2024-01-01")],
                               "Product string, `Nama Produk` string, Qty long, Harga double, Tanggal string")
    r = resolve_columns(df, "sales")
    assert r == {"date": "Tanggal", "product": "Nama Produk", "variant": None, "quantity": "Qty", "price": "Harga"}
    assert resolve_columns(df, "unknown_role") == {}


def test_rename_drop_ensure(spark):
    df = spark.createDataFrame([(1, 2)], "`Produk Dilihat` long, `Total Pesanan` long")
    df = rename_columns(df, {"Produk Dilihat": "views", "absent": "x"})
    df = drop_if_present(df, ["Total Pesanan", "absent"])
    df = ensure_column(df, "orders", default=1.0)
    df = ensure_column(df, "views_copy", copy_from="views")
    df = ensure_column(df, "views", default=99)
    assert df.columns == ["views", "orders", "views_copy"]
    r = df.collect()[0]
    assert (r.views, r.orders, r.views_copy) == (1, 1.0, 1)


def test_shapes_parse_as_their_texts(spark):
    """Shares from the histogram of shapes equal those of every single text, odd ones included."""
    import random

    from pyspark.sql import functions as F

    from retailcast.sources import schema as S
    rng = random.Random(3)
    n = rng.randint
    forms = [lambda: f"{n(0, 33)}/{n(0, 14)}/{n(1895, 2030)}", lambda: f"{n(0, 33):02d}-{n(0, 14):02d}-{n(0, 9999):04d}",
             lambda: f"{n(1, 31)}.{n(1, 12)}.{n(1, 40)}", lambda: f"{n(1, 12)}/{n(1, 31)}/2024 {n(0, 26)}:{n(0, 70):02d}",
             lambda: f"{n(1, 31)}/{n(1, 12)}/2023 {n(0, 26):02d}:{n(0, 59):02d}:{n(0, 64):02d}",
             lambda: f"{n(1, 9999):04d}-{n(0, 13):02d}-{n(0, 32):02d}", lambda: f"{n(1, 9999)}-{n(1, 12)}-{n(1, 28)}",
             lambda: f"2024-{n(1, 12):02d}-{n(1, 31):02d} {n(0, 25):02d}:{n(0, 60):02d}:{n(0, 60):02d}",
             lambda: f"2023-{n(1, 12):02d}-{n(1, 31):02d}{rng.choice('Tt')}{n(0, 25):02d}:00:{n(0, 60):02d}",
             lambda: f"{n(1900, 2100)}/{n(0, 13):02d}/{n(0, 32):02d}", lambda: f"{n(0, 99999999):08d}",
             lambda: f"{n(1900, 2100)}{n(1, 12):02d}{n(1, 31):02d}", lambda: "29/2/" + rng.choice(["1900", "2000", "2023", "2024"]),
             lambda: rng.choice(["", " ", "junk", "1/2/2024x", " 1/2/2024", "1/2/2024 ", "+1/2/2024", "001/2/2024", "1/2/12024",
                                 "1/2/+12024", "1//2024", "2024-01-01 1:02:03", "٣/٢/٢٠٢٤", None])]
    for k, chosen in enumerate(forms):
        texts = [(chosen() if rng.random() < 0.85 else rng.choice(forms)(),) for _ in range(400)]
        df = spark.createDataFrame(texts, "d string")
        plain = df.agg(*[F.avg(S._strategy_expr("d", fm).isNotNull().cast("double")) for _, fm in S.DATE_STRATEGIES]).first()
        got = {r["strategy_order"]: r["parsed_share"] for r in S.date_parse_rates(df, "d").collect()}
        assert [round(got[i], 9) for i in range(len(plain))] == [round(x, 9) for x in plain], k


def test_shapes_are_few(spark):
    from pyspark.sql import functions as F

    from retailcast.sources.schema import choose_date_strategy, date_shapes
    df = spark.range(200000).select(F.date_format(F.timestamp_seconds(F.col("id") * 12345), "dd/MM/yyyy HH:mm:ss").alias("d"))
    assert date_shapes(df, "d").count() <= 2 * 366
    assert choose_date_strategy(df, "d") == 0
    assert choose_date_strategy(df.limit(0), "d") == 5
