"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A text's words are runs of digits, a-z and non-ASCII characters after A-Z are
lower-cased. The patterns are all windows of ``n`` consecutive words of the
benchmark items; an item of fewer words is one (short) pattern, unless
``min_words`` leaves such items out. Documents are searched with one searcher
per pattern length:

* a shift table over blocks of two words says how far the search may jump
  without passing an occurrence; blocks of no pattern jump a whole window;
* where the shift is zero, the bucket of that suffix block, split by the
  window's first block, selects the few patterns to test;
* a direct comparison of all words confirms each occurrence.

The benchmark is the stated query set: it is cut into blocks of at most
``block_bytes``, and all documents are searched with each block in turn (one
narrow pass per block, no shuffle), so memory does not grow with either table.

Defined cases: NULL or wordless texts have no words and no hits; items without
words have no windows; repeated items count once by their id; a NULL item id
is the empty string; repeated documents give equal rows; empty tables work on
either side; further columns are ignored or carried unchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import ascii_lower, cut_lineage, map_in_arrow, map_rows, quoted

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")   # in UTF-8: digits, a-z and every non-ASCII character
SEGMENT_WORDS = 2000   # an item's words are shipped in pieces of so many, overlapping by n - 1

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(ascii_lower(text)) if text else []


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, patterns: Sequence[tuple[bytes, ...]]):
        self.m = m = len(patterns[0])
        self.b = b = min(2, m)
        self.jump = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(b, m + 1):
                block = p[end - b:end]
                self.shift[block] = min(self.shift.get(block, self.jump), m - end)
            self.buckets[p[m - b:]][p[:b]].append(p)

    def occurrences(self, words: list[bytes]):
        """(start, pattern) of every occurrence, in order of the start."""
        m, b, jump, shift, buckets = self.m, self.b, self.jump, self.shift.get, self.buckets
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b:end])
            step = shift(block, jump)
            if step:
                end += step
                continue
            start = end - m
            for p in buckets[block].get(tuple(words[start:start + b]), ()):
                if words[start:end] == list(p):
                    yield start, p
            end += 1


def windows(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def build_searchers(items: Sequence[tuple[str, str]], n: int):
    """Searchers by pattern length and the item ids of each pattern."""
    owners: dict[tuple, set[str]] = defaultdict(set)
    for item, words in items:
        for w in windows(words.encode("utf-8", "surrogatepass").split(b" "), n):
            owners[w].add(item)
    by_length = defaultdict(list)
    for w in owners:
        by_length[len(w)].append(w)
    return [WuManber(ps) for _, ps in sorted(by_length.items())], owners


def item_segments(items: DataFrame, item_id: str, text: str, n: int, min_words: int = 1) -> DataFrame:
    """Rows (item, words): the items' words joined by spaces, in overlapping pieces, each once."""
    src = items.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("item"),
                       quoted(text).alias("text"))

    def cut(batches):
        for batch in batches:
            out = []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t)
                if len(w) < min_words:
                    continue
                for i in range(0, max(1, len(w) - n + 1) if w else 0, SEGMENT_WORDS):
                    out.append((item, b" ".join(w[i:i + SEGMENT_WORDS + n - 1]).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()),
                                              pa.array([x[1] for x in out], pa.string())], ["item", "words"])

    return map_in_arrow(src, cut, "item string, words string").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", n: int = 10, carry: Sequence[str] | None = None,
                       block_bytes: int = 32 << 20, min_words: int = 1) -> DataFrame:
    """Columns ``row`` (carried) and ``res``: n_words, hits (disjoint word spans), items (ids, sorted).

    ``hits`` covers exactly the words inside any occurrence of a window. Items
    of fewer than ``min_words`` words have no windows.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else list(carry)
    segments = cut_lineage(item_segments(items, item_id, item_text, n, min_words))
    total = segments.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item") + 16), F.lit(0))).first()[0]
    blocks = 1 + total // block_bytes
    current = docs.select(F.struct(*[quoted(c) for c in carry]).alias("row"), quoted(text).alias("text"),
                          F.array().cast(SPANS).alias("hits"), F.array().cast("array<string>").alias("items"))
    fields = [("n_words", T.LongType()), ("hits", SPANS), ("items", T.ArrayType(T.StringType()))]
    for k in range(blocks):
        # one block of the query set: at most about block_bytes, whatever the table's size
        rows = segments.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in rows])

        def make(block=block):
            searchers, owners = build_searchers(block.value, n)

            def search(t, hits, found):
                words = words_of(t)
                spans, ids = [(h["begin"], h["end"]) for h in hits], set(found)
                for s in searchers:
                    for start, p in s.occurrences(words):
                        spans.append((start, start + s.m))
                        ids |= owners[p]
                return len(words), merge(spans), sorted(ids)

            return search

        last = k == blocks - 1
        done = map_rows(current, ["text", "hits", "items"], make, fields, ["row"] if last else ["row", "text"])
        if last:
            return done.select("row.row", "res")
        # cut after each block, so that a task holds the searchers of one
        current = cut_lineage(done.select("row.row", "row.text", "res.hits", "res.items"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with exactly the columns of ``docs``."""
    return find_contamination(docs, items, **options).where(F.size("res.hits") == 0).select("row.*")
