"""Token counts against the tokenizers library."""

from tokenizers import Tokenizer

from helpers import empty_documents, odd_documents, sentences
from retailcast.llm import token_counts as C
from retailcast.llm.common import vocabulary_path


def counted(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in C.count_tokens(df).collect()), key=str)


def expected(df):
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return sorted(((r.doc_id, len((r.text or "").encode()),
                    len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()), key=str)


def test_odd_texts(spark):
    df = odd_documents(spark)
    assert counted(df) == expected(df)
    assert C.count_tokens(empty_documents(spark)).count() == 0


def test_special_strings_and_white_space(spark):
    texts = ["<|endoftext|>", "a<|endoftext|>b", "  <|endoftext|>  x ", "<|endoftext|><|endoftext|>", "<|endoftext",
             "it's  we'll\n\n\tTabs   end  ", "x  <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert counted(df) == expected(df)


def test_many_chunks_and_high_frequencies(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_FREQUENCY", 3)
    monkeypatch.setattr(C, "CHUNK_CHARS", 200)
    monkeypatch.setattr(C, "CHUNK_ROWS", 4)
    monkeypatch.setattr(C, "HOT", 1)
    monkeypatch.setattr(C, "KNOWN_PIECES", 10)
    texts = sentences(5, 80) + ["same " * 40, "same " * 40, None]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    df = df.checkpoint()
    assert counted(df) == expected(df)


def test_other_vocabularies_are_refused():
    import pytest
    with open(vocabulary_path("word_bpe_49k.json"), "rb") as f, pytest.raises((ValueError, KeyError)):
        C.added_strings(f.read())


def test_blocks_unpack_to_what_was_packed():
    from array import array

    import numpy as np
    found = {"a": array("H", [0, 1, 5, 65535, 5, 2, 65535, 3]), "long " * 100: array("H", [7, 300]), "é": array("H", [65535, 1])}
    pieces, held, doc, frequency = C.unpack(C.pack(found, list(found)))
    at = np.cumsum(held) - held
    got = {p: [x for i in range(k) for x in (doc[s + i], frequency[s + i])] for p, k, s in zip(pieces, held, at)}
    assert got == {p: list(v) for p, v in found.items()}
