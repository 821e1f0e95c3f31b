"""Small fixtures shared by the tests of the text operators."""

import random

#: Rows that every operator on documents must take: NULLs, empty, blank, repeated, very long, odd characters.
TEXTS = [None, "", " \t\n", "one", "one two three", "Repeated row.", "Repeated row.", "ÄÖÜ ß straße – 日本語 \U0001f600",
         "\x00 nul \x1f unit", "word " * 20000, "x" * 5000, "z" * 70, "<|endoftext|> tail <|endoftext|>"]


def odd_documents(spark):
    """(doc_id, text, lang) with NULL ids and columns whose names clash with operators' own."""
    rows = [(i, t, "en", "c", "c", "c", "c", "c") for i, t in enumerate(TEXTS)]
    rows += [(5, "Repeated row.", "en", "c", "c", "c", "c", "c"), (None, "no id", None, "c", "c", "c", "c", "c"),
             (100, "ties ties ties", "fr", None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, row string, res string, fp string, `a.b c` string, node string")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def sentences(seed: int, n: int, vocabulary: int = 300, length: int = 40) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
             for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, length))) for _ in range(n)]
