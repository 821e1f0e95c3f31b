"""MinHash fingerprints, verified classes and neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from helpers import empty_documents, odd_documents, sentences
from retailcast.llm import minhash as M


def shingles(t):
    w = (t or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_texts(seed):
    """Groups of near copies, chains of edits and unrelated texts."""
    rng = random.Random(seed)
    out = []
    for base in sentences(seed, 6, 400, 90):
        words = (base + " " + base[::-1]).split() * 2
        for _ in range(rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            out.append(" ".join(w))
            if rng.random() < 0.4:
                words = w
    return out + sentences(seed + 1, 20, 400, 60) + ["", "tiny text"]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    texts = near_texts(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[0]), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in M.near_classes(df).collect()}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets}


def test_members_apart_from_the_bucket_minimum_are_compared_too(spark, monkeypatch):
    """With one band of one row nearly everything shares a bucket: no link may be lost."""
    monkeypatch.setattr(M, "BANDS", 1)
    monkeypatch.setattr(M, "ROWS", 1)
    monkeypatch.setattr(M, "signature", lambda h: np.zeros(M.HASHES, np.uint32))
    test_classes_against_brute_force(spark, 3)


def test_likeness_estimates_jaccard():
    known = M.WordHashes()
    texts = [t for t in near_texts(7) if t]
    for a, b in zip(texts, texts[1:]):
        f, g = (M.fingerprint(M.signature(M.shingle_hashes(t, known))) for t in (a, b))
        assert abs(M.likeness(f, g) - jaccard(shingles(a), shingles(b))) < 0.2
        assert M.likeness(f, f) == 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, M.text_key(r[1])))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_neighbours(spark, ranges):
    rng = random.Random(4)
    rows = [(i * i - 50, t) for i, t in enumerate(near_texts(5) + ["ÄÖ\U0001f600 ü" * 9, None])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = M.fingerprint_neighbours(df, M.near_classes(df), ranges=ranges).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == expected(rows)
    by = {r.doc_id: r for r in out}
    ids = sorted(by)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        f, g = (np.frombuffer(bytes.fromhex(by[k].fingerprint), ">u2") for k in (i, j))
        e = np.frombuffer(bytes.fromhex(by[i].edited_fingerprint), ">u2")
        assert by[i].near_next == M.likeness(f, g) and by[i].near_edited == M.likeness(f, e)
        assert by[i].class_id is not None


def test_edges(spark):
    docs = odd_documents(spark)
    out = M.fingerprint_neighbours(docs, M.near_classes(docs), ranges=4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()), key=str) == expected(rows)
    assert len({r.fingerprint for r in out.where("n_chars = 13").collect()}) == len(
        {t for _, t in rows if t and len(t) == 13})
    none = empty_documents(spark)
    assert M.fingerprint_neighbours(none, M.near_classes(none)).count() == 0
    single = spark.createDataFrame([(5, "only one document here")], "doc_id long, text string")
    (r,) = M.fingerprint_neighbours(single, M.near_classes(single)).collect()
    assert (r.doc_id, r.near_next, r.class_id) == (5, 1.0, 5)


def test_tiles_link_what_is_similar():
    texts = [t for t in near_texts(9) if t]
    known = M.WordHashes()
    sets = [np.unique((M.shingle_hashes(t, known) >> np.uint64(32)).astype(np.uint32)) for t in texts]

    def groups(links, n):
        label = list(range(n))
        for i, j in links:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
        return label

    same = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    n = len(sets)
    full = groups([(i, j) for i in range(n) for j in range(i) if same(i, j)], n)
    got = groups(M.tile_links(sets, list(range(n)), n, 0.8), n)
    half = n // 2
    across = groups([(i, j) for i in range(half) for j in range(half, n) if same(i, j)], n)
    got_across = groups(M.tile_links(sets, list(range(n)), half, 0.8), n)
    for a, b in ((full, got), (across, got_across)):
        assert [[x == y for y in a] for x in a] == [[x == y for y in b] for x in b]
    assert M.tile_links(sets, ["one class"] * n, n, 0.8) == []


def test_large_buckets_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 5)
    test_members_apart_from_the_bucket_minimum_are_compared_too(spark, monkeypatch)


def test_tables_between_the_steps_are_removed(spark):
    # uncompressed checkpoints of all bands stayed on the disk while the texts were dealt
    import glob
    import os

    from retailcast.session import checkpoint_root
    df = spark.createDataFrame([(i, f"{'same words go here again and ' * 3}{i % 4}") for i in range(40)], "doc_id long, text string")
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    classes = M.near_classes(df)
    left = [x for x in set(glob.glob(f"{root}/*")) - before if "rdd-" not in x]
    assert [os.path.basename(x).rsplit("-", 1)[0] for x in left] == ["minhash-owner"]
    assert classes.count() == 40


def test_buckets_are_compared_in_full_once(spark):
    # the sets of texts that share several bands were dealt once for each band, and again for each pair compared before
    buckets = {10: (0, [1, 2, 3]), 11: (4, [1, 2, 3]), 12: (2, [1, 2]), 13: (1, [2, 3]), 14: (5, [1, 2, 4]), 15: (6, [2, 3])}
    member = spark.createDataFrame([(i, band, min(nodes), n) for band, (i, nodes) in buckets.items() for n in nodes],
                                   "i int, band long, u long, node long")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "v long, u long")
    assert sorted(M._uncompared(member, pairs).collect()) == [(10, 0), (13, 1), (14, 5)]


def test_sets_are_dealt_once_a_turn(spark, monkeypatch):
    # the join of the sets ran twice, for small buckets and for large ones
    joined, write = [], M.Steps.write

    def spy(self, name, df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joined.append((name, len(re.findall(r"Relation \[node#\w+,shingles#\w+\]", plan))))
        return write(self, name, df)

    monkeypatch.setattr(M.Steps, "write", spy)
    monkeypatch.setattr(M, "TILE", 5)
    test_members_apart_from_the_bucket_minimum_are_compared_too(spark, monkeypatch)
    assert [x for x in joined if x[1]] == [("tiles", 1)] * M.TURNS


def test_word_hashes_are_those_of_xxh64():
    from xxhash import xxh64_intdigest

    words = ["äÖ".encode(), b"word", b"a", b"word"]
    known = M.WordHashes()
    assert known(words).tolist() == [xxh64_intdigest(w, 7) for w in words]
    assert len(known([])) == 0 and len(M.shingle_hashes(" \n", known)) == 0
    (h,) = M.shingle_hashes("A\tWord", known).tolist()
    want = 2
    for w in (b"a", b"word"):
        want = (want ^ xxh64_intdigest(w, 7)) * 0x9E3779B97F4A7C15 % 2**64
        want ^= want >> 29
    assert h == want
