import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import empty_documents, odd_documents, sentences
from hypothesis import given, settings
from hypothesis import strategies as st

from retailcast.llm import token_alignment as ta

EXTRA = ["▁ a mark", "ﬁ ligature é é", "<s> </s> <unk> <0x41> <|endoftext|>", "  two  spaces ", "a\tb\r\nc",
         "\x00\x01", "日本語のテキスト。" * 30, "ab" * 3000, "=" * 700, "​﻿", "🙂🙂🏽‍♀️"]


def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute_force(texts):
    """Plain loops over the contract; counts by documents."""
    a, b = tokenizers()
    byte = ta.byte_alphabet()
    rows, linked = [], Counter()
    for t in texts:
        t = t or ""
        want = (" " + t).encode()
        ids_a = a.encode(" " + t, add_special_tokens=False).ids
        ids_b = b.encode(t)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                 b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(raw_a) != want or b"".join(raw_b) != want:
            rows.append(None)
            continue
        groups, left, right, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                left.append(ids_a[i]); at_a += len(raw_a[i]); i += 1
            else:
                right.append(ids_b[j]); at_b += len(raw_b[j]); j += 1
            if at_a == at_b and left and right:
                groups.append((left, right)); left, right = [], []
        links = [(x, y) for l, r in groups for x in l for y in r]
        linked.update(set(links))
        rows.append((len(ids_a), len(ids_b), groups, links))
    most = defaultdict(int)
    for (x, _), n in linked.items():
        most[x] = max(most[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, groups, links = row
        line = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in groups)
        out.append((n_a, n_b, len(groups), len(links), hashlib.sha256(line.encode()).hexdigest(),
                    sum(linked[x] == most[x[0]] for x in links), sum(linked[x] for x in links)))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.mark.parametrize("chunk_chars", [300, ta.CHUNK_CHARS])
def test_equals_brute_force(spark, chunk_chars, monkeypatch):
    texts = EXTRA + sentences(3, 120) + ["Repeated row."] * 4 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = ta.align_documents(docs, chunk_chars=chunk_chars).collect()
    want = dict(enumerate(brute_force(texts)))
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in NAMES) == want[r["row"]["doc_id"]]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    want = Counter((r["doc_id"], w) for r, w in zip(rows, brute_force([r["text"] for r in rows])))
    got = ta.align_documents(docs, carry=["doc_id", "a.b c", "row"]).collect()
    assert Counter((r["row"]["doc_id"], tuple(r[c] for c in NAMES)) for r in got) == want
    assert {r["row"]["a.b c"] for r in got} == {"c", None}


def test_empty(spark):
    assert ta.align_documents(empty_documents(spark)).collect() == []


def test_large_groups_by_their_distinct_ids(monkeypatch):
    rng = random.Random(5)
    a = np.array([rng.randrange(9) for _ in range(400)])
    b = np.array([rng.randrange(7) for _ in range(300)])
    in_a, in_b, doc = np.array([0, 200, 399]), np.array([9, 100, 299]), np.array([0, 0, 1])

    def entries():
        found = defaultdict(int)
        *entries, links = ta.list_links(a, b, in_a, in_b, doc)
        for d, x, y, n in zip(*entries, np.ones(len(entries[0]), int) if links is None else links):
            found[d, x, y] += n
        return found

    listed = []
    for limit in (0, 20, 1 << 30):
        monkeypatch.setattr(ta, "LARGE_GROUP", limit)
        listed.append(entries())
    assert listed[0] == listed[1] == listed[2] and sum(listed[0].values()) == 10 + 200 * 91 + 199 * 199


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_gallop(x, y):
    a, b = (np.array(sorted(v), dtype=np.int64) for v in (x, y))
    in_a, in_b = ta.common_ends(a, b)
    assert a[in_a].tolist() == b[in_b].tolist() == sorted(x & y)


def test_gallop_steps_follow_the_distance():
    long = np.arange(1 << 16)
    short = np.array([3, 5, 60000, 65535])
    in_short, in_long = ta.gallop(short, long)
    assert in_short.tolist() == [0, 1, 2, 3] and in_long.tolist() == short.tolist()


def test_byte_alphabet_is_the_vocabulary_s():
    chars = set("".join(json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"]))
    assert chars - set("<|endoftext|>") <= set(ta.byte_alphabet())
    assert sorted(ta.byte_alphabet().values()) == list(range(256))


def test_both_ways_to_read_the_vocabulary_agree():
    """Every entry of the vocabulary encodes to itself, and the library and the ranks give the same ids."""
    data = open(P.path("byte_bpe_50k.json"), "rb").read()
    ranked = ta.ByteLevel(data)
    spec = json.loads(data)
    spec["model"]["merges"] = spec["model"]["merges"][:-1]   # no longer one merge for each id
    a, _ = tokenizers()
    texts = [t for t in EXTRA + sentences(8, 200) + [b.decode("utf-8", "ignore") for b in ranked.bytes[::7]]]
    want = [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ranked.encode(texts)] == want
    last = len(ranked.bytes) - 2
    library = ta.ByteLevel(json.dumps(spec).encode())
    got = [x.tolist() for x in library.encode(texts)]
    assert all(g == x for g, x in zip(got, want) if last not in x)
