"""Alignment of two tokenizers' tokens of the same texts.

A byte-level vocabulary (A) reads a space and the text, a piece vocabulary (B)
the text, to which it adds the space. Byte offsets where a token of A and a
token of B both end cut the tokens into groups; every A-B pair of occurrences
in a group is a link.

1. Texts go through both tokenizers once, in chunks. All texts of a chunk stand
   one after the other on one byte axis, so the ends of A and of B are two
   rising lists. The shorter one drives a galloping search (exponential, then
   binary) into the longer (:func:`gallop`); differences of the common ranks
   are the token ranges of the groups.
2. A chunk is written to the shared folder: its documents, its distinct id
   pairs with the number of its documents that hold them linked, and a packed
   block of (document, pair, links).
3. Pair counts are a sum over chunks; the highest count of an A id has at most
   one row per vocabulary entry and is broadcast. Counts go back to the chunks
   that hold the pair, where the documents' sums are taken.

A pair that every chunk holds costs one row per chunk; nothing is kept per
occurrence outside a chunk, and a task holds one chunk (a long text is a chunk
of its own). A group of many tokens on both sides is counted by its distinct
ids, so its links are not listed one by one.

Defined cases: NULL and empty texts, and texts that either tokenizer does not
give back byte for byte after a space (a normalizer changed them, or U+2581
stands in them), have no tokens: numbers are 0, groups are ''. Special tokens'
strings are plain text. Every row is a document of its own, repeated rows and
NULL ids too. An empty table gives an empty result. Further columns are
ignored; those named in ``carry`` travel in the struct ``row``.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import (cut_lineage, map_in_arrow, quoted, read_bytes, scratch_path,
                                   rank_pattern, ship_code, vocabulary_path)
from retailcast.llm.token_counts import added_strings

CHUNK_CHARS = 4 << 20    # characters of a chunk, unless one text alone has more
ENCODE_CHARS = 1 << 18   # characters given to a tokenizer at once
LARGE_GROUP = 1 << 12    # links of a group that are listed one by one


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteLevel:
    """The byte-level tokenizer of a tokenizers file: ids of texts, and the bytes of every id.

    Where ids follow the order of merges, as in the usual files, the merges are
    the ranks of a rank tokenizer, which gives the same ids without further
    objects per token; else the tokenizers library reads the file.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        added_strings(data)   # no normalizer, the published pattern
        byte = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        added = {t["id"]: t["content"].encode("utf-8") for t in spec["added_tokens"]}
        for token in added.values():
            ranks.pop(token, None)
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *added]))
        for token, i in [*ranks.items(), *((token, i) for i, token in added.items())]:
            self.bytes[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ordered = [vocabulary.get(a + b) for a, b in merges]
        single = sorted(i for token, i in ranks.items() if len(token) == 1)
        if single == list(range(256)) and ordered == list(range(256, 256 + len(merges))) and len(ranks) == 256 + len(merges):
            import tiktoken

            own = tiktoken.Encoding("byte_level", pat_str=rank_pattern(), mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(data.decode("utf-8"))
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: [np.array(e.ids, np.int64) for e in library.encode_batch_fast(
                [" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """The piece tokenizer; it adds the space itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=data)
        n = self.processor.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i)
                      else p.replace("▁", " ").encode("utf-8")
                      for i, p in ((i, self.processor.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Lists: their bytes are joined once more, to see whether the text comes back."""
        return self.processor.encode(texts, num_threads=1)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both of the values that two strictly rising lists share.

    Elements of ``short`` are looked up in waves: those at odd multiples of a
    stride start from the place found for their left neighbour, double their
    step until it passes the value and halve the last step; the stride halves
    from wave to wave.
    """
    n, m = len(short), len(long)
    place = np.zeros(n, np.int64)
    stride = 1 << max(n.bit_length(), 1)
    first = True
    while stride:
        at = np.zeros(1, np.int64) if first else np.arange(stride, n, 2 * stride)
        low = place[at - stride] if not first else np.zeros(1, np.int64)
        first, stride = False, stride if first else stride >> 1
        if not len(at) or not n or not m:
            continue
        value, high, step = short[at], low.copy(), 1
        while True:
            far = (high < m) & (long[np.minimum(high, m - 1)] < value)
            if not far.any():
                break
            low = np.where(far, high + 1, low)
            high = np.where(far, np.minimum(high + step, m), high)
            step *= 2
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & (long[np.minimum(middle, m - 1)] < value)
            low, high = np.where(less, middle + 1, low), np.where(less | ~open_, high, middle)
        place[at] = low
    if not n or not m:
        return place[:0], place[:0]
    hit = np.nonzero((place < m) & (long[np.minimum(place, m - 1)] == short))[0]
    return hit, place[hit]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the common ends in A and in B; the shorter list drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    in_b, in_a = gallop(b, a)
    return in_a, in_b


def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (below ten million) as ASCII digits in the first seven bytes of a number, and how many digits they have."""
    if n > 10 ** 7:
        raise ValueError("ids of more than seven digits")
    rest, table, digits = np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(7):   # the last digit first; each further one moves those before it up by a byte
        more = (rest > 0) | (k == 0)
        table = np.where(more, table << np.uint64(8) | (rest % np.uint64(10) + np.uint64(48)), table)
        digits += more
        rest //= np.uint64(10)
    return table, digits


def list_links(a, b, in_a, in_b, doc):
    """Entries (document, A id, B id, links) of all groups; the large ones by their distinct ids.
    Links are None where each entry is one.

    ``in_a`` / ``in_b`` are the ranks of the groups' last tokens, ``doc`` the
    groups' documents.
    """
    na, nb = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
    small = na * nb <= LARGE_GROUP
    of = np.repeat(np.arange(len(na)), na)
    token = np.nonzero(small[of])[0]
    of = of[token]
    times = nb[of]
    start = np.repeat(in_b[of] - times + 1 - (np.cumsum(times) - times), times)
    docs, left, right = np.repeat(doc[of], times), np.repeat(a[token], times), b[start + np.arange(len(start))]
    if small.all():
        return docs, left, right, None
    docs, left, right, links = [docs], [left], [right], [np.ones(len(start), np.int64)]
    for g in np.nonzero(~small)[0]:
        x, nx = np.unique(a[in_a[g] - na[g] + 1:in_a[g] + 1], return_counts=True)
        y, ny = np.unique(b[in_b[g] - nb[g] + 1:in_b[g] + 1], return_counts=True)
        docs.append(np.full(len(x) * len(y), doc[g]))
        left.append(np.repeat(x, len(y)))
        right.append(np.tile(y, len(x)))
        links.append(np.outer(nx, ny).ravel())
    return tuple(np.concatenate(v).astype(np.int64) for v in (docs, left, right, links))


def summed(key: np.ndarray, links: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and their sums of links (None: 1 each)."""
    if links is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, links = key[order], links[order]
    start = np.nonzero(np.diff(key, prepend=-1))[0]
    return key[start], np.add.reduceat(links, start) if len(start) else links


def group_digests(a, b, in_a, in_b, doc, n_docs, digits_a, digits_b) -> list[str]:
    """SHA-256 of each document's groups written as ``a1,a2|b1;a3|b2,b3``."""
    na, nb = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
    line = np.zeros(len(a) + len(b), "<u8")   # a token's digits and, in the last byte, what follows it
    size = np.zeros(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(na), nb)
    for at, ids, (digits, count), last, mark in ((at_a, a, digits_a, in_a, "|"), (at_b, b, digits_b, in_b, ";")):
        own = digits[ids] | np.uint64(ord(",") << 56)
        own[last] ^= np.uint64((ord(",") ^ ord(mark)) << 56)
        line[at], size[at] = own, count[ids] + 1
    tokens = np.bincount(doc, na + nb, n_docs).astype(np.int64)   # of each document
    end = np.cumsum(tokens)
    final = end[tokens > 0] - 1   # nothing follows a document's last token
    line[final] &= np.uint64((1 << 56) - 1)
    size[final] -= 1
    cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], end])]
    flat = line.view(np.uint8)
    flat = flat[flat != 0].tobytes()
    return [hashlib.sha256(flat[x:y]).hexdigest() if n else "" for x, y, n in zip(cut, cut[1:], tokens)]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, byte planes apart, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(
        x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw]


class Aligner:
    """A chunk of texts -> numbers of its documents, its pairs and its packed block."""

    def __init__(self, a, b):
        self.sides = [(t, np.fromiter(map(len, t.bytes), np.int64, len(t.bytes)), digit_table(len(t.bytes)))
                      for t in (a, b)]

    def tokens(self, texts: list[str]) -> list[tuple]:
        """Ids of A and of B; none where a side does not give back a space and the text.

        A is a bijection of bytes, so its sizes tell; B's bytes are compared.
        """
        out = []
        (a, size_a, _), (b, _, _) = self.sides
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= ENCODE_CHARS):
                chars += len(texts[end])
                end += 1
            part = texts[at:end]
            for text, ids_a, ids_b in zip(part, a.encode(part), b.encode(part)):
                want = b" " + text.encode("utf-8")
                same = text and b"".join(map(b.bytes.__getitem__, ids_b)) == want and size_a[ids_a].sum() == len(want)
                out.append((ids_a, ids_b) if same else (NO_IDS, NO_IDS))
            at = end
        return out

    def __call__(self, texts: list[str]) -> dict:
        found = self.tokens(texts)
        n = len(texts)
        sizes = [np.fromiter((len(x[k]) for x in found), np.int64, n) for k in (0, 1)]
        a = np.concatenate([x[0] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        b = np.fromiter(chain.from_iterable(x[1] for x in found), np.int64, int(sizes[1].sum()))
        ids = [a, b]
        in_a, in_b = common_ends(*(np.cumsum(size[x]) for x, (_, size, _) in zip(ids, self.sides)))
        doc = np.searchsorted(np.cumsum(sizes[0]), in_a, side="right")
        linked = np.diff(in_a, prepend=-1) * np.diff(in_b, prepend=-1)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, doc, linked)
        digests = group_digests(a, b, in_a, in_b, doc, n, self.sides[0][2], self.sides[1][2])

        of, left, right, links = list_links(a, b, in_a, in_b, doc)
        pairs, inverse = np.unique(left << 32 | right, return_inverse=True)
        key, links = summed(of * max(len(pairs), 1) + inverse, links)
        of, pair = key // max(len(pairs), 1), key % max(len(pairs), 1)
        return {"n_a": sizes[0], "n_b": sizes[1], "n_groups": np.bincount(doc, minlength=n), "n_links": n_links,
                "groups_sha256": digests, "pairs": pairs, "held": np.bincount(pair, minlength=len(pairs)),
                "block": pack(of, np.diff(pair, prepend=0), links)}


_ALIGNERS: dict[bytes, Aligner] = {}   # of a worker, the last one


def aligner(data_a: bytes, data_b: bytes) -> Aligner:
    """The worker's aligner for two vocabularies; tasks that follow each other share it."""
    key = hashlib.sha256(data_a).digest() + hashlib.sha256(data_b).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(ByteLevel(data_a), Pieces(data_b))
    return _ALIGNERS[key]


NO_IDS = np.zeros(0, np.int64)
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align_chunks(docs: DataFrame, text: str, carry: Sequence[str], data_a: bytes, data_b: bytes,
                 chunk_chars: int) -> DataFrame:
    """Rows of documents (``at`` set) and one row of each chunk (``at`` NULL)."""
    spark = docs.sparkSession
    src = docs.select(quoted(text).cast("string").alias("text"),
                      F.struct(*[quoted(c) for c in carry], F.lit(0).alias("__one")).alias("row"))
    shared = spark.sparkContext.broadcast((data_a, data_b))
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("at", T.IntegerType()),
        T.StructField("row", src.schema["row"].dataType),
        *[T.StructField(c, T.LongType()) for c in NUMBERS], T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.LongType())),
        T.StructField("block", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            align = aligner(*shared.value)
            texts = [t or "" for t in batch.column(0).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= chunk_chars):
                    chars += len(texts[end])
                    end += 1
                done, n = align(texts[at:end]), end - at
                rows = batch.column(1).slice(at, n)
                none = pa.nulls(n, pa.list_(pa.int64()))
                names = ["chunk", "at", "row", *NUMBERS, "groups_sha256", "pairs", "held", "block"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), rows,
                     *[pa.array(done[c].astype(np.int64)) for c in NUMBERS], pa.array(done["groups_sha256"], pa.string()),
                     none, none, pa.nulls(n, pa.binary())], names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, rows.type),
                     *[pa.nulls(1, pa.int64()) for _ in NUMBERS], pa.nulls(1, pa.string()),
                     pa.array([done["pairs"]], pa.list_(pa.int64())),
                     pa.array([done["held"].astype(np.int64)], pa.list_(pa.int64())),
                     pa.array([done["block"]], pa.binary())], names)
                chunk += 1
                at = end

    return map_in_arrow(src, run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold the pair linked; best if no pair of its A id has more.

    ``pairs`` has one row (pair, held) per chunk and pair.
    """
    counts = cut_lineage(pairs.groupBy("pair").agg(F.sum("held").alias("n_docs")))
    # one row per id of vocabulary A, a bound that does not grow with the corpus
    top = counts.groupBy(F.shiftright("pair", 32).alias("id_a")).agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("id_a")).select(
        "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",),
                    vocabulary_a: str | None = None, vocabulary_b: str | None = None,
                    chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``row`` (the ``carry`` columns), n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-alignment")
    align_chunks(docs, text, carry, read_bytes(spark, vocabulary_a or vocabulary_path("byte_bpe_50k.json")),
                 read_bytes(spark, vocabulary_b or vocabulary_path("piece_bpe_32k.model")),
                 chunk_chars).write.parquet(path)
    table = spark.read.parquet(path)
    pairs = (table.where("at IS NULL").select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
             .select("chunk", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held")))
    back = pairs.join(pair_counts(pairs.select("pair", "held")), "pair").select("chunk", "pair", "n_docs", "best")
    fields = [f for f in table.schema.fields if f.name not in ("chunk", "at", "pairs", "held", "block")]
    schema = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        docs = left.filter(pa.compute.is_valid(left["at"]))
        block = left.filter(pa.compute.is_null(left["at"]))["block"][0].as_py()
        right = right.sort_by("pair")
        of, step, links = unpack(block, 3)
        pair = np.cumsum(step)
        count = right["n_docs"].to_numpy()[pair] * links if len(pair) else links
        best = links * right["best"].to_numpy(zero_copy_only=False)[pair] if len(pair) else links
        at = docs["at"].to_numpy()
        total = {c: np.zeros(docs.num_rows, np.int64) for c in ("n_best", "count_sum")}
        np.add.at(total["n_best"], of, best)
        np.add.at(total["count_sum"], of, count)
        out = docs.select([f.name for f in fields])
        for c in ("n_best", "count_sum"):
            out = out.append_column(c, pa.array(total[c][at]))
        return out

    ship_code(spark)
    held = spark.read.parquet(path).select("chunk", "at", "block", *[f.name for f in fields])   # columns of its own
    done = held.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(sums, schema)
    return done.select(F.struct(*[F.col("row").getField(c).alias(c) for c in carry]).alias("row") if carry else
                       F.lit(None).alias("row"), *NUMBERS, "groups_sha256", "n_best", "count_sum")
