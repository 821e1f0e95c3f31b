"""SimHash fingerprints, exact links in tiles and components against brute force."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64

from helpers import empty_documents, odd_documents
from retailcast.llm import simhash as S


def naive_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    h = [xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for v in values:
        for u in values:
            if u < v and bin(u ^ v).count("1") <= radius:
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def clustered(seed, n):
    """Values in clusters around a few centres, with chains across the radius."""
    rng = random.Random(seed)
    out, centres = set(), [rng.getrandbits(64) for _ in range(8)]
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "one", "one two three", "A b C d", "a b c d e  f\tg\nh\x0bi a b c d", "é É ß x y"])
def test_fingerprint(text):
    assert S.fingerprint(text) == naive_print(text)
    assert S.fingerprint(None) == 0


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(text) == whole == naive_print(text)


def test_masks_keep_every_pair_within_the_radius():
    rng = random.Random(1)
    for distinct in (10, 1 << 26, 1 << 32):
        masks = S.bit_masks(distinct, 4, 4096)
        for _ in range(300):
            x = y = rng.getrandbits(64)
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)
    assert len(S.bit_masks(1 << 32, 4, 4096)) > len(S.bit_masks(10, 4, 4096))


def test_tiles_connect_what_is_linked():
    values = clustered(2, 700)
    edges = S.link_stars(np.array(values, np.uint64), None, 4)
    root = naive_components(values, 4)
    assert {tuple(x % (1 << 64) for x in e) and root[e[0] % (1 << 64)] == root[e[1] % (1 << 64)] for e in edges} <= {True}
    assert len(edges) == len(values) - len(set(root.values()))   # one star per group, not all pairs
    a, b = values[::2], values[1::2]
    for u, v in S.link_stars(np.array(a, np.uint64), np.array(b, np.uint64), 4):
        assert root[u % (1 << 64)] == root[v % (1 << 64)]


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_and_components_against_brute_force(spark, tile):
    values = clustered(4, 400)
    df = spark.createDataFrame([(S.signed(v),) for v in values], "fp long")
    root = naive_components(values, 4)
    got = {r.node % (1 << 64): r.root for r in S.components(S.fingerprint_links(df, 4, tile=tile)).collect()}
    for v in values:
        for u in values:
            same = root[u] == root[v]
            assert (got.get(u, S.signed(u)) == got.get(v, S.signed(v))) == same


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base) for i in (7, 3, 9, 9)] + [(20, base.replace("w17 ", "other ")), (30, "something else entirely")]
    rows += [(40, None), (41, " \n"), (None, base), (50, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id) for r in S.simhash_components(df).collect())
    root = naive_components({naive_print(t) for _, t in rows}, 4)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[naive_print(t)]
            least[r] = min(i, least.get(r, i))
    assert got == sorted((i or -1, naive_print(t), least[root[naive_print(t)]]) for i, t in rows)
    kept = S.one_per_component(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "30", "40", "50", "None"]


def test_an_id_on_texts_of_several_components(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(400)) for x in "abc")
    tables = [[(5, a), (5, b), (3, c), (6, b)],          # the smallest id of two components: both texts stay
              [(3, a), (5, a), (5, b)],                  # 5 is second in one component and alone in another
              [(5, a.replace(f"a{i} ", "other ")) for i in range(0, 400, 40)] + [(5, a), (5, a), (9, a), (9, b)]]
    for rows in tables:
        root = naive_components({naive_print(t) for _, t in rows}, 4)
        first = {}
        for i, t in sorted(rows):
            first.setdefault(root[naive_print(t)], (i, t))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, S.one_per_component(df).collect())) == sorted(first.values())


def test_edges(spark):
    docs = odd_documents(spark)
    assert S.simhash_components(docs).count() == docs.count()
    kept = S.one_per_component(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()].count(5) == 1
    assert S.simhash_components(empty_documents(spark)).count() == 0
    assert S.one_per_component(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_components_in_tasks_of_counted_rows(spark, rows_per_task):
    """The size of the tasks does not change the components; chains, loops and repeated edges included."""
    edges = [(i, i + 1) for i in range(10, 17)] + [(5, 5), (30, 20), (30, 20), (40, 20), (41, 40), (7, 99)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)
    plain = sorted(map(tuple, S.components(df).collect()))
    assert plain == [(7, 7), *((i, 10) for i in range(10, 18)), *((i, 20) for i in (20, 30, 40, 41)), (99, 7)]
    assert sorted(map(tuple, S.components(df, rows_per_task).collect())) == plain
    assert S.components(df.limit(0), rows_per_task).count() == 0
