"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

Text is split by the vocabulary's published pattern. The distinct pieces of
some documents become token-position rows, one row per byte at first, and a
recursive DuckDB query contracts them: neighbours join the merge table, each
word takes its leftmost pair of minimum rank, the pair becomes one token, and
words without a mergeable pair drop out, until none is left. Documents are put
together from their pieces. Decoding joins ids with the vocabulary and
concatenates the bytes in an aggregate ordered by position.

Pieces of more than ``LONG`` bytes take a second recursion that keeps one state
per position and contracts all non-overlapping occurrences of a word's
minimum-rank pair in one step. That gives the same ids: a token made by a merge
only takes part in merges of a higher rank, because every token's own bytes
encode to that token.

Memory is one Arrow batch, ``BLOCK`` bytes of pieces in a recursive query (a
piece is never cut, so one longer piece is a block), ``CHUNK`` characters of
documents in work, ``DECODE`` ids in a decoding query and about ``KEEP``
pieces remembered between documents. DuckDB runs in memory, on one thread of
the task, and writes no files.

Defined cases: a NULL or empty text has no ids and decodes to no bytes; special
tokens are ordinary text; repeated rows give equal results; empty tables give
empty results; further columns are ignored or carried unchanged; an id that
the vocabulary lacks raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retailcast.llm.common import map_batches, parse_ranks, rank_pattern, read_bytes, vocabulary_path

BLOCK, CHUNK, DECODE, KEEP, LONG = 1 << 18, 1 << 20, 1 << 19, 400_000, 64

# Rows are (position g over the whole block, word w, token). A step sees each row's right neighbour;
# `best` is the word's smallest (rank, position) and the position that merges away.
SHORT_SQL = """
WITH RECURSIVE t(step, g, w, tok) AS (
  SELECT 0, g, w, tok FROM start_rows
  UNION ALL
  (WITH pair AS (
     SELECT g, w, tok, lead(tok) OVER ww AS next_tok, lead(g) OVER ww AS next_g, lead(w) OVER ww AS next_w
     FROM t WINDOW ww AS (ORDER BY g)),
   best AS (
     SELECT p.w, min(m.merged::BIGINT * 4294967296 + p.g) AS first,
       arg_min(p.next_g, m.merged::BIGINT * 4294967296 + p.g) AS gone
     FROM pair p JOIN merges m ON m.ab = p.tok::BIGINT * 4294967296 + p.next_tok
     WHERE p.next_w = p.w GROUP BY p.w)
   SELECT t.step + 1, t.g, t.w, CASE WHEN t.g = (b.first & 4294967295) THEN (b.first >> 32)::INT ELSE t.tok END
   FROM t JOIN best b ON b.w = t.w WHERE t.g <> b.gone)
)
SELECT w, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY g
"""

# One state per position: `pick` has each word's occurrences of its minimum-rank pair; of a run of equal
# overlapping pairs (a, a) every second one counts. Token -1 marks a row that was merged away.
LONG_SQL = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, g, tok FROM start_rows
  UNION
  (WITH live AS (
     SELECT w, pos, tok, lead(tok) OVER ww AS next_tok, lead(pos) OVER ww AS next_pos, row_number() OVER ww AS i
     FROM recurring.t WHERE tok >= 0 AND w IN (SELECT w FROM t)
     WINDOW ww AS (PARTITION BY w ORDER BY pos)),
   pair AS (
     SELECT l.w, l.pos, l.next_pos, l.tok = l.next_tok AS same, l.i, m.merged, m.merged AS rank
     FROM live l JOIN merges m ON m.ab = l.tok::BIGINT * 4294967296 + l.next_tok),
   least AS (SELECT w, min(rank) AS rank FROM pair GROUP BY w),
   pick AS (
     SELECT p.*, p.i - row_number() OVER (PARTITION BY p.w ORDER BY p.i) AS run
     FROM pair p JOIN least USING (w, rank)),
   done AS (
     SELECT w, pos, next_pos, merged FROM pick
     QUALIFY NOT same OR row_number() OVER (PARTITION BY w, run ORDER BY i) % 2 = 1)
   SELECT w, pos, merged FROM done UNION ALL SELECT w, next_pos, -1 FROM done)
)
SELECT w, tok FROM t WHERE tok >= 0 ORDER BY w, pos
"""

DECODE_SQL = """
SELECT d.part, unhex(string_agg(v.hex, '' ORDER BY d.pos)) AS bytes, count(*) AS n
FROM id_rows d JOIN vocabulary v ON v.id = d.id GROUP BY d.part ORDER BY d.part
"""


class Codec:
    """Encoder and decoder of one task, for one rank file."""

    def __init__(self, rank_data: bytes):
        import duckdb
        import regex

        ranks = parse_ranks(rank_data)
        self.pieces = regex.compile(rank_pattern()).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [((ranks[t[:i]] << 32) + ranks[t[i:]], r) for t, r in ranks.items()
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self._table("merges", pa.table({"ab": pa.array([m[0] for m in merges], pa.int64()),
                                        "merged": pa.array([m[1] for m in merges], pa.int32())}))
        self._table("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()),
                                            "hex": [t.hex() for t in ranks]}))
        self.ids_of: dict[str, bytes] = {}   # a piece's ids as little-endian 32-bit numbers

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS FROM rows")
        self.db.unregister("rows")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _learn(self, pieces: Iterator[str]) -> None:
        """Encode pieces, in blocks of bounded size."""
        blocks: dict[str, list[bytes]] = {SHORT_SQL: [], LONG_SQL: []}
        held = dict.fromkeys(blocks, 0)
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            kind = LONG_SQL if len(raw) > LONG else SHORT_SQL
            if blocks[kind] and held[kind] + len(raw) > BLOCK:
                self._contract(blocks[kind], kind)
                blocks[kind], held[kind] = [], 0
            blocks[kind].append(raw)
            held[kind] += len(raw)
        for kind, block in blocks.items():
            if block:
                self._contract(block, kind)

    def _contract(self, block: list[bytes], sql: str) -> None:
        sizes = np.fromiter(map(len, block), np.int64, len(block))
        word = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
        tok = self.byte_id[np.frombuffer(b"".join(block), np.uint8)]
        out = self._query("start_rows", pa.table({"g": np.arange(len(tok), dtype=np.int32), "w": word, "tok": tok}),
                          sql)
        ends = np.cumsum(np.bincount(out.column("w").to_numpy(), minlength=len(block))) * 4
        ids = out.column("tok").to_numpy().astype("<i4").tobytes()
        at = 0
        for raw, end in zip(block, ends.tolist()):
            self.ids_of[raw.decode("utf-8", "surrogatepass")] = ids[at:end]
            at = end

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The token ids of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < CHUNK):
                chars += len(texts[end] or "")
                end += 1
            cut = [self.pieces(t) if t else [] for t in texts[at:end]]
            if len(self.ids_of) > KEEP:
                self.ids_of = {}
            new = dict.fromkeys(p for ps in cut for p in ps if p not in self.ids_of)
            self._learn(iter(new))
            out += [np.frombuffer(b"".join(map(self.ids_of.__getitem__, ps)), "<i4") for ps in cut]
            at = end
        return out

    def decode(self, ids: Sequence[np.ndarray]) -> list[bytes]:
        """The bytes of each id list."""
        parts = [(i, x[a:a + DECODE]) for i, x in enumerate(ids) for a in range(0, len(x), DECODE)]
        out: list[list[bytes]] = [[] for _ in ids]
        at = 0
        while at < len(parts):
            end, held = at, 0
            while end < len(parts) and (end == at or held + len(parts[end][1]) <= DECODE):
                held += len(parts[end][1])
                end += 1
            sizes = np.array([len(x) for _, x in parts[at:end]])
            flat = np.concatenate([x for _, x in parts[at:end]])
            got = self._query("id_rows", pa.table({
                "part": np.repeat(np.arange(end - at, dtype=np.int32), sizes),
                "pos": np.arange(len(flat), dtype=np.int32), "id": flat}), DECODE_SQL)
            if not np.array_equal(got.column("n").to_numpy(), sizes):
                raise ValueError("an id is not in the vocabulary")
            for (i, _), raw in zip(parts[at:end], got.column("bytes").to_pylist()):
                out[i].append(raw)
            at = end
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def codec(rank_data: bytes) -> Codec:
    """One codec per Python worker and vocabulary; later tasks of the worker reuse it."""
    return Codec(rank_data)


def id_lists(ids: Sequence[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode_documents(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None,
                     vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """Columns ``row`` (carried) and ``res``: ids and, if asked for, the bytes that the ids decode to."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(read_bytes(spark, vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")))

    def make():
        c = codec(data.value)

        def apply(texts):
            ids = c.encode(texts.to_pylist())
            return [id_lists(ids), *([pa.array(c.decode(ids), pa.binary())] if decoded else [])]

        return apply

    fields = [("ids", T.ArrayType(T.IntegerType())), *([("decoded", T.BinaryType())] if decoded else [])]
    return map_batches(docs, [text], make, fields, docs.columns if carry is None else carry)


def decode_documents(docs: DataFrame, ids: str = "ids", carry: Sequence[str] | None = None,
                     vocabulary: str | None = None) -> DataFrame:
    """Columns ``row`` (carried) and ``res.decoded``: the bytes of each id list; a NULL list has none."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(read_bytes(spark, vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")))

    def make():
        c = codec(data.value)
        return lambda lists: [pa.array(c.decode([np.array(x or [], np.int32) for x in lists.to_pylist()]),
                                       pa.binary())]

    return map_batches(docs, [ids], make, [("decoded", T.BinaryType())], docs.columns if carry is None else carry)
