import hashlib
import math
import random
from collections import defaultdict

import duckdb
import pytest
from helpers import empty_documents, odd_documents
from pyspark.sql import functions as F

from retailcast.llm import source_mix as sm
from retailcast.llm.queries import OP12_SQL, op12_source_mix


def brute_force(rows, weights, share=1.5, epochs=2):
    """rows of (doc_id, source, size, quality) -> {source: target}, list of (doc_id, source, size, taken)."""
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in stopped)
        held = sum(w for s, w in weight.items() if s not in stopped)
        target = {s: epochs * sizes[s] if s in stopped else weight[s] * rest / held for s in names}
        over = {s for s in names if target[s] > epochs * sizes[s] and s not in stopped}
        if not over:
            break
        stopped |= over

    def key(row):
        digits = hashlib.md5(("" if row[0] is None else str(row[0])).encode()).hexdigest()[:12]
        q = 1.0 if row[3] is None or math.isnan(row[3]) else row[3]
        return -math.log((int(digits, 16) + 0.5) / 2**48) / q if q > 0 else math.inf

    out = []
    for s in names:
        whole = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        rest, upto = target[s] - whole * sizes[s], 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r), r[0] is not None, r[0] or 0, r[2])):
            upto += r[2]
            out.append((r[0], s, r[2], r[2] * (whole + (upto - r[2] / 2 <= rest))))
    return target, out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r))


SCHEMA = "doc_id long, source string, size long, q double"


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "", "\U0001f600", "￿", "tiny"]
    rows = [(i, "a" if rng.random() < 0.5 else rng.choice(sources), int(rng.expovariate(0.01)),
             rng.choice([None, 0.5, 1.0, 3.0, 0.0, float("nan")])) for i in range(400)]
    rows = [(d, s, min(n, 3) if s == "tiny" else n, q) for d, s, n, q in rows]
    target, want = brute_force(rows, [3, 1, 2])
    got = sm.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3), [3, 1, 2], quality="q").collect()
    assert order((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == order(want)
    assert {r["source"]: r["target"] for r in got} == pytest.approx(target)
    assert any(t == 2 * sum(r[2] for r in rows if r[1] == s) for s, t in target.items())   # one has stopped
    for s, t in target.items():
        largest = max(r[2] for r in rows if r[1] == s)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= largest / 2 + 1e-6
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_one_hot_source_over_many_ranges(spark):
    rows = [(i, "hot", 1 + i % 7, None) for i in range(3000)] + [(i, f"s{i % 5}", 400, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    target, want = brute_force(rows, [1, 1, 1, 1])
    got = sm.mix_sources(df, [1, 1, 1, 1], quality="q")
    again = sm.mix_sources(df.repartition(3), [1, 1, 1, 1], quality="q")
    assert order(tuple(r) for r in got.select("doc_id", "source", "size", "taken").collect()) == order(want)
    assert got.exceptAll(again).count() == 0 == again.exceptAll(got).count()   # reruns agree
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "SinglePartition" not in plan


def test_repeated_rows(spark):
    rows = [(7, "s", 10, 1.0)] * 40 + [(7, "s", 3, 1.0)] * 2 + [(None, None, 5, None)] * 3 + [(8, "t", None, None)]
    got = sm.mix_sources(spark.createDataFrame(rows, SCHEMA), [1], quality="q")
    _, want = brute_force([(d, s, n or 0, q) for d, s, n, q in rows], [1])
    assert order(tuple(r) for r in got.select("doc_id", "source", "size", "taken").collect()) == order(want)


def test_quality_moves_documents_forward(spark):
    rows = [(i, "s", 1, 9.0 if i % 2 else 1.0) for i in range(2000)] + [(i, "t", 1, 1.0) for i in range(400)]
    got = sm.mix_sources(spark.createDataFrame(rows, SCHEMA), [1], share=(1, 2), quality="q").where("source = 's'")
    good, rest = (got.where(f"doc_id % 2 = {k}").agg(F.sum("taken")).first()[0] for k in (1, 0))
    assert good > 1.4 * rest


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark).withColumn("source", F.col("lang")).withColumn("size", sm.word_count(F.col("text")))
    got = sm.mix_sources(docs, [3, 1, 2])
    assert got.count() == docs.count()
    empty = sm.mix_sources(empty_documents(spark).withColumn("source", F.col("lang")).withColumn("size", F.lit(1)), [1])
    assert empty.collect() == []
    zero = sm.mix_sources(spark.createDataFrame([(1, "a", 0, 1.0), (2, None, None, None)], SCHEMA), [1]).collect()
    assert [(r["target"], r["taken"]) for r in zero] == [(0.0, 0), (0.0, 0)]


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", "a b c d\x0be", "x " * 50000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(sm.word_count(F.col("text"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 3, 50000]


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(9)
    spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 60)) if i % 17 else None,
                            rng.choice(["x", "y", "z", "u", None]) if i % 2 else "x") for i in range(300)],
                          "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)] + [(3, 0, 1)],
                          "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cols = "doc_id, source, size, source_size, target, taken"
    want = con.sql(f"SELECT {cols} FROM ({OP12_SQL})").fetchall()
    got = [tuple(r) for r in op12_source_mix(spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect()]
    assert order(got) == order(want)
