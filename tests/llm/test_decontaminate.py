"""Wu-Manber search against naive window search."""

import random
import re

from helpers import empty_documents, odd_documents, sentences
from retailcast.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def naive(doc, items, n):
    w, hit, ids = words(doc), set(), set()
    for item, text in items:
        own = words(text)
        for p in [own[i:i + n] for i in range(max(1, len(own) - n + 1))] if own else []:
            for at in range(len(w) - len(p) + 1):
                if w[at:at + len(p)] == p:
                    hit |= set(range(at, at + len(p)))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


def found(df):
    return {r.doc_id: (r.n_words, sum(h.end - h.begin for h in r.hits), r["items"]) for r in df.select(
        "row.doc_id", "res.n_words", "res.hits", "res.items").collect()}


def test_against_naive_search_in_one_and_many_blocks(spark):
    rng = random.Random(3)
    items = [(i, t) for i, t in enumerate(sentences(5, 40, 12, 14))] + [(None, "it's a NULL id"), (90, None), (91, "!?")]
    docs = []
    for i in range(120):   # a small vocabulary gives many partial and overlapping occurrences
        t = " ".join(sentences(5, 40, 12, 14)[rng.randrange(40)] for _ in range(rng.randint(0, 3)))
        docs.append((i, t.upper() if i % 3 else t.replace(" ", ", ")))
    docs += [(200, None), (201, ""), (202, "It's a null ID, it's a null id")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + items[:3], "item_id long, text string")
    for n in (1, 4, 10):
        expected = {i: naive(t, items, n) for i, t in docs}
        assert found(D.find_contamination(d, b, n=n)) == expected
        assert found(D.find_contamination(d, b, n=n, block_bytes=300)) == expected


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_WORDS", 7)
    text = sentences(9, 1, 50, 60)[0] + " " + sentences(10, 1, 50, 60)[0]
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    d = spark.createDataFrame([(1, "start " + text + " end"), (2, " ".join(text.split()[3:13]))],
                              "doc_id long, text string")
    got = found(D.find_contamination(d, b, n=10))
    assert got == {i: naive(t, [(1, text)], 10) for i, t in [(1, "start " + text + " end"),
                                                             (2, " ".join(text.split()[3:13]))]}


def test_edges(spark):
    docs = odd_documents(spark)
    b = spark.createDataFrame([("i", "one two three"), ("j", "repeated ROW")], "item_id string, text string")
    out = D.find_contamination(docs, b)
    assert out.count() == docs.count()
    clean = D.clean_documents(docs, b)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.clean_documents(docs, none).count() == docs.count()
    assert D.find_contamination(empty_documents(spark), b).count() == 0
