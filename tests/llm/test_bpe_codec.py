"""Encoding and decoding against the tiktoken library."""

import random

import numpy as np
import pytest
import tiktoken

from helpers import empty_documents, odd_documents
from retailcast.llm import bpe_codec as B
from retailcast.llm.common import parse_ranks, rank_pattern, vocabulary_path


@pytest.fixture(scope="module")
def library():
    with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    return B.Codec(data), tiktoken.Encoding("test", pat_str=rank_pattern(), mergeable_ranks=parse_ranks(data),
                                            special_tokens={})


def fuzzed(seed, n):
    rng = random.Random(seed)
    out = ["a" * k for k in range(1, 90)] + ["ab" * 40, "aaab" * 50, "=" * 300, "  " * 77 + "x", "\n" * 99, "é" * 50,
                                              "日本語" * 30, "x" * 4000, "\U0001f600" * 20, " \t \r\n  x", "it's we'LL"]
    out.append("".join(rng.choice("abehtn") for _ in range(20000)))
    for _ in range(n):
        size = rng.randint(0, 120)
        out.append("".join(rng.choice("aetinos rhld'") for _ in range(size)))
        out.append("".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2fff), rng.randint(0x10000, 0x1ffff)]))
                           for _ in range(size)))
    return out


def test_ids_equal_the_library(library):
    codec, encoding = library
    texts = fuzzed(1, 1500)
    ids = codec.encode([None, *texts])
    assert [x.tolist() for x in ids] == [[], *(encoding.encode_ordinary(t) for t in texts)]
    assert codec.decode(ids) == [b"", *(t.encode() for t in texts)]


def test_long_and_short_recursion_agree(library, monkeypatch):
    codec, encoding = library
    texts = fuzzed(2, 300)
    monkeypatch.setattr(B, "LONG", 3)
    codec.ids_of = {}
    assert [x.tolist() for x in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_every_token_encodes_to_itself(library):
    """The property that lets the long recursion contract all occurrences of a pair in one step."""
    codec, encoding = library
    singles = [t for t in encoding._mergeable_ranks]
    codec.ids_of = {}
    for at in range(0, len(singles), 20000):
        block = singles[at:at + 20000]
        sizes = np.fromiter(map(len, block), np.int64, len(block))
        word = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
        tok = codec.byte_id[np.frombuffer(b"".join(block), np.uint8)]
        import pyarrow as pa
        out = codec._query("start_rows", pa.table({"g": np.arange(len(tok), dtype=np.int32), "w": word, "tok": tok}),
                           B.SHORT_SQL)
        assert out.column("tok").to_pylist() == [encoding._mergeable_ranks[t] for t in block]


def test_small_blocks_and_parts(library, monkeypatch):
    codec, encoding = library
    texts = fuzzed(3, 100)
    for name, value in (("BLOCK", 50), ("CHUNK", 100), ("DECODE", 13), ("KEEP", 40)):
        monkeypatch.setattr(B, name, value)
    codec.ids_of = {}
    ids = codec.encode(texts[:160])
    assert [x.tolist() for x in ids] == [encoding.encode_ordinary(t) for t in texts[:160]]
    assert codec.decode(ids) == [t.encode() for t in texts[:160]]


def test_unknown_id_raises(library):
    with pytest.raises(ValueError):
        library[0].decode([np.array([1, 60000], np.int32)])


def test_documents(spark, library):
    docs = odd_documents(spark)
    out = B.encode_documents(docs, decoded=True)
    for r in out.select("row.text", "res.ids", "res.decoded").collect():
        assert r.ids == library[1].encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    ids = out.select("row.doc_id", "res.ids", "row.text")
    for r in B.decode_documents(ids).select("row.text", "res.decoded").collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert B.encode_documents(empty_documents(spark)).count() == 0


def test_ids_above_sixteen_bits(spark):
    """Pairs of large ids must not share a key: ranks moved up by 100,000 give the same pieces."""
    import base64
    import tempfile

    from retailcast.llm import bpe_codec
    from retailcast.llm.common import vocabulary_path
    lines = [x.split() for x in open(vocabulary_path("byte_bpe_50k.tiktoken"))]
    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
        f.writelines(f"{a} {int(b) + 100_000 * (len(base64.b64decode(a)) > 1)}\n" for a, b in lines)
        f.flush()
        df = spark.createDataFrame([("some longer words, many of them merged again: " + "supercalifragilistic" * 9,)], "text string")
        low = bpe_codec.encode_documents(df, carry=["text"], decoded=True).first()["res"]
        high = bpe_codec.encode_documents(df, carry=["text"], decoded=True, vocabulary=f.name).first()["res"]
    assert high["decoded"] == low["decoded"]
    assert [i - 100_000 * (i >= 100_000) for i in high["ids"]] == list(low["ids"])
