"""Language identification: mixtures, held-out rows, edge texts."""

import random
import zlib

import numpy as np
import pytest

from helpers import empty_documents, odd_documents
from retailcast.llm import language_id as L

SYLLABLES = {"aa": ["ka", "to", "mi", "sho"], "bb": ["schw", "ung", "ich", "rei"], "cc": ["ção", "lhe", "nho", "ura"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(20, 120)), lang) for i in range(300) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000 + i, text(rng, "cc", 50), None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df, L.learn(df)


def test_held_out_accuracy(spark, learned):
    df, model = learned
    got = L.identify(df, model).select("row.*", "res.*", ).collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert len(out) > 50
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark, learned):
    df, (names, logs) = learned
    rows = [(r.doc_id, r.text if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 else "bogus", r.lang) for r in df.collect()]
    again = L.learn(spark.createDataFrame(rows, df.schema))
    assert again[0] == names and np.array_equal(again[1], logs)
    ids = [r.doc_id for r in df.where(L.held_out(df.doc_id)).collect()]
    assert ids == [r.doc_id for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]


def test_mixtures_have_their_shares(spark, learned):
    _, model = learned
    rng = random.Random(2)
    rows = [(1, text(rng, "aa", 300) + " " + text(rng, "bb", 100)), (2, text(rng, "cc", 200))]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).select(
        "row.doc_id", "res.*").collect()}
    assert got[1].languages == ["aa", "bb"] and got[1].lang_pred == "aa"
    assert got[2].languages == ["cc"] and got[2].score == 1.0


def test_em_matches_a_plain_loop():
    rng = np.random.default_rng(0)
    likely, counts = rng.random((3, 50)) + 0.01, rng.integers(1, 9, 50).astype(float)
    w, value = L.mixture(likely, counts, np.full(3, 1 / 3))
    v = [1 / 3] * 3
    for _ in range(L.STEPS):
        new = [0.0] * 3
        for g in range(50):
            mixed = sum(v[k] * likely[k, g] for k in range(3))
            for k in range(3):
                new[k] += counts[g] * v[k] * likely[k, g] / mixed / counts.sum()
        v = new
    assert np.allclose(w, v, atol=1e-3) and np.isfinite(value)


def test_edges(spark, learned):
    _, model = learned
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in L.identify(docs, model).select("row.doc_id", "res.*").collect()}
    for i in (0, 1, 2):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(got[i].lang_pred in model[0] for i in got if i not in (0, 1, 2))
    one = spark.createDataFrame([(1, "k"), (2, "12 34!"), (3, "½²")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.identify(one, model).select("row.doc_id", "res.lang_pred").collect()}
    assert got[1] in model[0] and got[2] == got[3] == "und"
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    names, logs = L.learn(empty_documents(spark))
    assert names == [] and L.identify(docs, (names, logs)).where("res.lang_pred <> 'und'").count() == 0
    assert L.identify(empty_documents(spark), model).count() == 0


def test_a_long_text_counts_as_in_one_piece(monkeypatch):
    rng = random.Random(3)
    t = text(rng, "bb", 400)
    cells, counts = L.gram_counts(t)
    monkeypatch.setattr(L, "CHUNK", 101)
    cut_cells, cut_counts = L.gram_counts(t)
    # only n-grams at the cuts differ: each cut replaces at most a few
    whole = dict(zip(cells.tolist(), counts.tolist()))
    cut = dict(zip(cut_cells.tolist(), cut_counts.tolist()))
    assert sum(abs(whole.get(k, 0) - cut.get(k, 0)) for k in whole | cut) <= 12 * (len(t) // 101 + 1)
