"""Token counts per document, without ever holding a document's ids.

1. Each document is split into pre-tokens by the vocabulary's own pattern;
   added special strings are pieces of their own. A chunk of documents lists,
   for every distinct pre-token, the documents that hold it and how often.
2. The lists are dealt by pre-token: a chunk sends one packed row to each hash
   bucket, so all chunks' lists of a pre-token meet in one bucket.
3. There each distinct pre-token is counted once with the tokenizer, the count
   meets the frequencies, and frequency times count is summed by document of
   the block; the blocks' packed sums go back to their chunk and are added.

A pre-token that a chunk holds in more than ``HOT`` documents is dealt by
pre-token and chunk: the most common ones spread over all buckets (and are
counted once in each), so that no bucket grows with them.

The row number that ties the steps together is Spark's own of a scan, so
``docs`` must be a table read (or checkpointed), not the output of a shuffle.

Defined cases: NULL or empty texts have no bytes and no tokens; repeated rows
are counted each for itself; an empty table gives an empty result; further
columns are ignored. Only byte-level BPE files with the published pattern are
accepted, and only added strings that match as they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import map_in_arrow, quoted, rank_pattern, read_bytes, vocabulary_path

CHUNK_CHARS = 16 << 20   # characters of a chunk; a chunk has at most CHUNK_ROWS documents
CHUNK_ROWS = 1 << 16
MAX_FREQUENCY = (1 << 16) - 1
HOT = 2048               # documents of a chunk
KNOWN_PIECES = 1 << 20   # counts remembered in a task; beyond it they are taken anew
COUNT_BLOCK = 1 << 14


def added_strings(data: bytes) -> list[str]:
    """The strings that the tokenizer takes whole out of a text."""
    spec = json.loads(data)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
        raise ValueError("not a byte-level vocabulary with the published pattern")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("an added string takes in its surroundings")
    return sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)


def make_splitter(added: list[str]):
    """text -> its pre-tokens, added strings whole."""
    import regex

    find = regex.compile(rank_pattern()).findall
    if not added:
        return find
    special = set(added)
    cut = re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def split(text: str) -> list[str]:
        parts = cut.split(text)
        if len(parts) == 1:
            return find(text)
        return [p for part in parts for p in ([part] if part in special else find(part))]

    return split


def planes(x: np.ndarray) -> bytes:
    """16-bit numbers as their low bytes, then their high bytes: small numbers compress well so."""
    return (x & 255).astype(np.uint8).tobytes() + (x >> 8).astype(np.uint8).tobytes()


def from_planes(raw: bytes, at: int, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8, 2 * n, at).astype(np.int64)
    return x[:n] + 256 * x[n:]


def pack(found: dict[str, array], pieces: list[str]) -> bytes:
    """Pre-tokens and their (document, frequency) pairs in one compressed block."""
    import zstandard

    pieces = sorted(pieces)
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    pairs = np.frombuffer(b"".join(found[p].tobytes() for p in pieces), np.uint16).astype(np.int64)
    doc, frequency = pairs[::2], pairs[1::2]
    held = np.fromiter((len(found[p]) // 2 for p in pieces), np.int64, len(pieces))
    first = np.cumsum(held) - held
    step = np.diff(doc, prepend=0)   # documents as steps from the one before, anew for each pre-token
    step[first] = doc[first]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(
        [np.uint32(len(raw)).tobytes(), np.fromiter(map(len, raw), "<u4", len(raw)).tobytes(),
         held.astype("<u4").tobytes(), *raw, planes(step), planes(frequency)]))


def unpack(block: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(pre-tokens, number of pairs of each, documents, frequencies)."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
    held = np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64)
    ends = 4 + 8 * n + np.cumsum(sizes)
    pieces = [raw[e - k:e].decode("utf-8", "surrogatepass") for e, k in zip(ends.tolist(), sizes.tolist())]
    total, at = int(held.sum()), int(ends[-1])
    step, frequency = from_planes(raw, at, total), from_planes(raw, at + 2 * total, total)
    run = np.cumsum(step)
    first = np.cumsum(held) - held
    return pieces, held, run - np.repeat(run[first] - step[first], held), frequency


def pre_token_rows(docs: DataFrame, text: str, added: list[str], buckets: int) -> DataFrame:
    """Rows (bucket, first, block): a chunk's pre-tokens of one bucket; documents count from row number ``first``."""
    src = docs.select(F.monotonically_increasing_id().alias("rid"), quoted(text).alias("text"))

    def run(batches):
        from xxhash import xxh64_intdigest

        split = make_splitter(added)
        found: dict[str, array] = defaultdict(lambda: array("H"))
        first, chars = None, 0

        def flush():
            dealt = defaultdict(list)
            for p, pairs in found.items():
                dealt[xxh64_intdigest(p.encode("utf-8", "surrogatepass"),
                                      first if len(pairs) > 2 * HOT else 0) % buckets].append(p)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(dealt), pa.int32()), pa.array([first] * len(dealt), pa.int64()),
                 pa.array([pack(found, pieces) for pieces in dealt.values()], pa.binary())],
                ["bucket", "first", "block"])

        for batch in batches:
            for rid, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                if first is not None and (chars + len(t) > CHUNK_CHARS or rid - first >= CHUNK_ROWS):
                    yield flush()
                    found.clear()
                    first, chars = None, 0
                first = rid if first is None else first
                chars += len(t)
                at = rid - first
                for piece, n in Counter(split(t)).items():
                    while n > MAX_FREQUENCY:
                        found[piece].extend((at, MAX_FREQUENCY))
                        n -= MAX_FREQUENCY
                    found[piece].extend((at, n))
        if first is not None:
            yield flush()

    return map_in_arrow(src, run, "bucket int, first bigint, block binary")


def block_sums(rows: DataFrame, data: bytes) -> DataFrame:
    """(first, sums): for each block its documents' counts times frequencies, packed."""
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import zstandard
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for block in batch.column("block"):
                pieces, held, doc, frequency = unpack(block.as_py())
                if len(known) > KNOWN_PIECES:
                    known.clear()
                new = [p for p in pieces if p not in known]
                for at in range(0, len(new), COUNT_BLOCK):
                    part = new[at:at + COUNT_BLOCK]
                    known.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False))))
                tokens = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
                sums = np.zeros(CHUNK_ROWS, np.int64)
                np.add.at(sums, doc, np.repeat(tokens, held) * frequency)
                some = np.nonzero(sums)[0]
                out.append(squeeze(planes(np.diff(some, prepend=0)) + sums[some].astype("<i8").reshape(-1, 1)
                                   .view(np.uint8).T.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(out, pa.binary())], ["first", "sums"])

    return map_in_arrow(rows, run, "first bigint, sums binary")


def row_sums(blocks: DataFrame) -> DataFrame:
    """(rid, tokens): the sums of all blocks of a chunk, by document."""
    def run(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor().decompress
        chunk, total = None, None

        def done():
            held = np.nonzero(total)[0]
            return pa.RecordBatch.from_arrays([pa.array(chunk + held), pa.array(total[held])], ["rid", "tokens"])

        for batch in batches:
            for first, packed in zip(batch.column("first").to_pylist(), batch.column("sums")):
                if first != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, total = first, np.zeros(CHUNK_ROWS, np.int64)
                raw = unsqueeze(packed.as_py())
                n = len(raw) // 10   # two bytes of a step and eight of a sum for each document
                sums = np.frombuffer(raw, np.uint8, 8 * n, 2 * n).reshape(8, n).T.copy().view("<i8")[:, 0]
                total[np.cumsum(from_planes(raw, 0, n))] += sums
        if chunk is not None:
            yield done()

    return map_in_arrow(blocks.repartition("first").sortWithinPartitions("first"), run, "rid bigint, tokens bigint")


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens."""
    spark = docs.sparkSession
    data = read_bytes(spark, vocabulary or vocabulary_path("byte_bpe_50k.json"))
    # four buckets to a partition even out what hashing puts into each
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pre_token_rows(docs, text, added_strings(data), buckets)
    sums = row_sums(block_sums(rows.repartition("bucket"), data))
    info = docs.select(F.monotonically_increasing_id().alias("rid"), quoted(doc_id).alias("doc_id"),
                       F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return info.join(sums, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("tokens", F.lit(0)).cast("long").alias("n_tokens"))
