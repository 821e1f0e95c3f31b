"""MinHash document fingerprints, near-duplicate classes and neighbour comparison.

A text's words (runs without ASCII white space, A-Z lower-cased) make shingles
of five; a shorter text is one shingle. Universal hash functions over the
shingles' hashes (permutations of 32 bits) are minimised in numpy; the
fingerprint is the low 16 bits of each minimum, in hexadecimal. The likeness of two fingerprints is the
share of equal values, an estimate of the Jaccard similarity.

:func:`near_classes` joins signature bands in Spark. Texts that share a band
are candidates, and every link is verified by the exact Jaccard similarity of
the shingle sets, which are read from the texts once and written to the shared
folder. Each text is first compared with the smallest one that it shares a
bucket with. Buckets that this leaves in several classes are then compared in
full, those of the same members once: their members' shingle sets meet in tiles
of at most about ``TILE`` texts (larger buckets as pairs of tiles), where an
inverted index counts common shingles; what leaves a tile is a spanning set of
links and not all pairs. So no candidate is skipped unless it is already
connected or compared, and no bucket is held in one task. Equal texts are one node throughout. A bitmap of
fixed size (``2**BITMAP_BITS`` bits) of the candidates goes to the tasks, so
that only candidates' shingle sets are written.

:func:`fingerprint_neighbours` compares each document with its edited text and
with the next document by id. Documents are dealt by ranges of the id, in
order, each range closed by the first document of the range after it, so
texts are shuffled once (compressed) and no task sees more than its ranges.

Defined cases: NULL texts are empty; a text without words has a fingerprint of
ones and is like other such texts only; NULL ids sort first; equal ids sort by
a hash of the text; a single document is its own next document; repeated rows
stay separate rows; an empty table gives an empty result; further columns are
ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import ascii_lower, cut_lineage, map_in_arrow, map_rows, quoted, scratch_path
from retailcast.llm.simhash import components
from retailcast.sources.sinks import remove

SHINGLE = 5
HASHES = 128
BANDS, ROWS = 21, 6   # a pair of similarity 0.8 shares a band with probability 0.998, one of 0.9 always
CHUNK = 1024          # shingles hashed at once
TILE = 256            # texts compared at once
LOT = 512             # texts that one set is compared with in a row
TURNS = 3             # parts of the bands, compared one after the other
BITMAP_BITS = 23
ROWS_PER_TASK = 1 << 15   # rows of numbers that a task reads of a table between the steps


@lru_cache(maxsize=1)
def parameters() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hash functions; the same at every run."""
    random = np.random.Generator(np.random.PCG64(20240229))
    a = random.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
    return a[:, None], random.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


class WordHashes:
    """64-bit hashes of words; to remember them takes longer where a task meets many different words."""

    def __init__(self):
        from xxhash import xxh64_digest

        self.digest = xxh64_digest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.digest, words, repeat(7))), ">u8").astype(np.uint64)


def runs(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of five word hashes; of all of them if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h ^= words[i:len(words) - k + 1 + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def shingle_hashes(text: str, known: WordHashes) -> np.ndarray:
    """A 64-bit hash of each run of five words; of all words if there are fewer."""
    return runs(known(ascii_lower(text).split()))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the shingles (32 bits)."""
    a, b = parameters()
    low = np.full(HASHES, (1 << 32) - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        np.minimum(low, (a * short[None, at:at + CHUNK] + b).min(axis=1), out=low)
    return low


def fingerprint(sig: np.ndarray) -> np.ndarray:
    return (sig & 0xFFFF).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two fingerprints: the share of equal values."""
    return float((a == b).mean())


def text_key(text: str | None) -> bytes:
    """16 bytes that stand for a text in the joins."""
    from xxhash import xxh3_128_digest
    return xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


# ---- near-duplicate classes ------------------------------------------------------------------------------

class Steps:
    """Tables between the steps, by name: written once to the shared folder, removed when they have been used.

    Columns of numbers are far smaller in Parquet than in a checkpoint, and
    removal does not wait for the driver to collect garbage.
    """

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = path = scratch_path(self.spark, f"minhash-{name}")
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def settled(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written, counted and read in tasks of about ``ROWS_PER_TASK`` rows.

        Each task of a shuffle leaves files of its own, so a small table in many
        partitions costs more disk in file blocks than in rows.
        """
        done = self.write(name, df)
        return done.coalesce(max(1, -(-done.count() // ROWS_PER_TASK)))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of text keys (column ``hi``); other keys may pass it, no key of ``keys`` fails it."""
    cell = F.pmod(F.col("hi"), F.lit(1 << BITMAP_BITS))
    rows = (keys.select(cell.alias("cell"))
            .groupBy((F.col("cell") / 32768).cast("int").alias("page"))
            .agg(F.bitmap_construct_agg(F.col("cell") % 32768).alias("bits")).collect())
    bits = np.zeros(1 << BITMAP_BITS, bool)   # at most 2**BITMAP_BITS / 32768 rows of 4096 bytes
    for r in rows:
        bits[r["page"] * 32768:(r["page"] + 1) * 32768] = np.unpackbits(
            np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return np.packbits(bits)


def key_numbers(key: bytes) -> tuple[int, int]:
    """A text key as two numbers: Spark's aggregates hash numbers, but sort on bytes."""
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


def key_bytes(hi: int, lo: int) -> bytes:
    return hi.to_bytes(8, "big", signed=True) + lo.to_bytes(8, "big", signed=True)


def pack_set(shingles: np.ndarray) -> bytes:
    """Sorted distinct 32-bit hashes as compressed steps, byte by byte place."""
    import zstandard

    steps = np.diff(shingles, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_set(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(raw.reshape(4, -1).T.copy().view("<u4")[:, 0], dtype=np.uint32)


def _shingle_sets(docs: DataFrame, text: str, wanted: DataFrame, steps: Steps) -> DataFrame:
    """(node, shingles) of the wanted texts (node, hi, lo), written once; shingles are packed 32-bit hashes."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bitmap(wanted))

    def run(batches):
        known, page = WordHashes(), bits.value
        for batch in batches:
            keys, sets, seen = [], [], set()
            for t in batch.column(0):
                t = t.as_py() or ""
                key = key_numbers(text_key(t))
                cell = key[0] % (1 << BITMAP_BITS)
                if page[cell >> 3] >> (7 - (cell & 7)) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(pack_set(np.unique((shingle_hashes(t, known) >> np.uint64(32)).astype("<u4"))))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()),
                                              pa.array([k[1] for k in keys], pa.int64()), pa.array(sets, pa.binary())],
                                             ["hi", "lo", "shingles"])

    found = map_in_arrow(docs.select(quoted(text).alias("text")), run, "hi bigint, lo bigint, shingles binary")
    return steps.write("sets", found.join(wanted, ["hi", "lo"]).groupBy("node").agg(F.first("shingles").alias("shingles")))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    The pairs of a ``u`` are dealt in lots of about ``LOT``; its set goes once to
    each lot, first of the lot's rows, and is compared as they stream by.
    """
    lots = cut_lineage(pairs.groupBy("u").agg(F.ceil(F.count("*") / LOT).alias("lots")))
    heads = lots.join(sets, F.col("u") == F.col("node")).select(
        "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("v"),
        "shingles")
    rows = pairs.join(lots, "u").select("u", F.pmod(F.xxhash64("v"), F.col("lots")).alias("lot"), "v").join(
        sets, F.col("v") == F.col("node")).select("u", "lot", "v", "shingles")
    dealt = heads.unionByName(rows).repartition("u", "lot").sortWithinPartitions("u", "lot", F.col("v").asc_nulls_first())

    def run(batches):
        head = None
        for batch in batches:
            keep = []
            for v, packed in zip(batch.column("v"), batch.column("shingles")):
                own = unpack_set(packed.as_py())
                if not v.is_valid:
                    head = own
                    keep.append(False)
                    continue
                same = len(np.intersect1d(head, own, assume_unique=True))
                union = len(head) + len(own) - same
                keep.append(same >= threshold * union if union else True)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_in_arrow(dealt.select("u", "v", "shingles"), run, "u bigint, v bigint")


def tile_links(sets: list[np.ndarray], classes: list, split: int, threshold: float) -> list[tuple[int, int]]:
    """Links that connect what is similar among ``sets`` and in different classes.

    With ``split`` below the number of sets, only sets before it are compared
    with sets from it on. Equal classes count as connected already.
    """
    n = len(sets)
    names = {c: i for i, c in enumerate(dict.fromkeys(classes))}
    label = np.array([names[c] for c in classes])
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate([*sets, np.zeros(0, np.uint32)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i in range(split):
        left, right = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        spans = right - left
        at = np.repeat(left - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=n)
        near = common >= threshold * (sizes + sizes[i] - common)
        near[:split if split < n else i + 1] = False
        for j in np.nonzero(near)[0].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _uncompared(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(band, i) of the buckets to compare in full.

    Of buckets with the same members one stands for all, and two texts that
    have been compared as one of the ``pairs`` (u, v) are not compared again.
    """
    buckets = (member.groupBy("band").agg(
        F.count("*").alias("n"), F.min("i").alias("i"), F.min("node").alias("u"), F.max("node").alias("v"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
        .groupBy("n", "u", "v", "x", "y").agg(F.min("band").alias("band"), F.min("i").alias("i")))
    return (buckets.join(pairs.withColumn("n", F.lit(2).cast("long")), ["n", "u", "v"], "left_anti").select("band", "i"))


def _open_links(open_rows: DataFrame, sets: DataFrame, threshold: float, steps: Steps) -> DataFrame:
    """Links (u, v) inside the buckets (band, n, node, class) that hold several classes, of ``n`` rows each.

    The sets meet the rows once and are written as tiles; a large bucket's tiles then meet in pairs.
    """
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(TILE)))
    tiles = steps.write("tiles", open_rows.join(sets, "node").groupBy("band", "n", part.alias("part")).agg(
        F.collect_list(F.struct("node", "class", "shingles")).alias("m")))
    work = tiles.select("m", F.lit(None).cast(tiles.schema["m"].dataType).alias("m2"))
    large = tiles.where(F.col("n") > TILE).drop("n")
    if not large.isEmpty():
        other = large.select("band", F.col("part").alias("part2"), F.col("m").alias("m2"))
        work = work.unionByName(large.join(other, "band").where("part2 > part").select("m", "m2"))

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                first, second = a.as_py(), b.as_py() or []
                members = first + second
                links = tile_links([unpack_set(m["shingles"]) for m in members],
                                   [m["class"] for m in members], len(first), threshold)
                if links:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([members[i]["node"] for i, _ in links], pa.int64()),
                         pa.array([members[j]["node"] for _, j in links], pa.int64())], ["u", "v"])

    return map_in_arrow(work, run, "u bigint, v bigint")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, hi, lo (the text's key), class_id.

    A class holds all texts connected by links of at least ``threshold``;
    its id is the smallest document id in it. A text is known by the smallest
    number of its rows, so all joins and aggregates go by one whole number.
    """
    def make():
        known = WordHashes()

        def bands(t):
            from xxhash import xxh64_intdigest

            t = t or ""
            sig = signature(shingle_hashes(t, known))
            part = np.ascontiguousarray(sig[:BANDS * ROWS].reshape(BANDS, ROWS))
            return (*key_numbers(text_key(t)),
                    [xxh64_intdigest(part[i].tobytes(), i) - (1 << 63) for i in range(BANDS)])

        return bands

    fields = [("hi", T.LongType()), ("lo", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    steps = Steps(docs.sparkSession)
    prints = steps.settled("prints", map_rows(docs, [text], make, fields, [doc_id]).select(
        F.monotonically_increasing_id().alias("rid"), F.col("row")[doc_id].alias("doc_id"), "res.hi", "res.lo", "res.bands"))
    texts = steps.settled("texts", prints.groupBy("hi", "lo").agg(F.min("rid").alias("node")))
    bands = steps.settled("bands", prints.join(texts.select("node"), F.col("rid") == F.col("node"))
                          .select("node", F.posexplode("bands").alias("i", "band")))
    low = bands.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1")
    member = steps.settled("member", bands.join(low, "band").select("i", "band", "u", "node"))
    steps.drop("bands")
    sets = _shingle_sets(docs, text, cut_lineage(texts.join(member.select("node").distinct(), "node")), steps)
    # First each text is compared with one other only, the smallest that it shares a bucket with.
    pairs = steps.settled("pairs", member.where("u <> node").groupBy(F.col("node").alias("v")).agg(F.min("u").alias("u")))
    found = components(_verified(pairs, sets, threshold), ROWS_PER_TASK)
    # What is left: buckets whose members are in different classes. They go in turns: what one part of the
    # bands connects need not be compared again in the others.
    buckets = steps.settled("buckets", member.drop("i", "u").join(_uncompared(member, pairs), "band"))
    steps.drop("member", "pairs")
    for turn in range(TURNS):
        named = steps.settled("named", buckets.where(F.col("i") % TURNS == turn).select("band", "node")
                              .join(found, "node", "left")
                              .select("band", "node", F.coalesce("root", "node").alias("class")))
        mixed = (named.groupBy("band").agg(F.min("class").alias("c"), F.max("class").alias("d"), F.count("*").alias("n"))
                 .where("c <> d").select("band", "n"))
        more = steps.settled("more", _open_links(named.join(mixed, "band"), sets, threshold, steps))
        steps.drop("tiles")
        if not more.isEmpty():   # from the classes so far, each a star, and the new links
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), ROWS_PER_TASK)
        steps.drop("named", "more")
    roots = steps.settled("roots", texts.join(found, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root")))
    owner = steps.settled("owner", prints.select("doc_id", "hi", "lo").distinct().join(roots, ["hi", "lo"]))
    steps.drop("buckets", "sets", "texts", "prints", "roots")
    first = owner.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return owner.join(first, "root").select("doc_id", "hi", "lo", "class_id")


# ---- a document, its edited text and the next document ---------------------------------------------------

def _ranges(docs: DataFrame, doc_id: str, ranges: int) -> tuple[np.ndarray, dict[int, int | None]]:
    """(cut points, smallest id of each range that has rows): at most ``ranges`` numbers each."""
    ids = docs.select(quoted(doc_id).cast("long").alias("id"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = np.unique(np.array(ids.approxQuantile("id", shares, 1 / (4 * ranges)) if shares else [])).astype(np.int64)

    def lowest(batches):
        for batch in batches:
            x = batch.column(0)
            known = x.drop_null().to_numpy()
            place = np.searchsorted(cuts, known, side="right")
            at, first = np.unique(place[np.argsort(known, kind="stable")], return_index=True)
            low = np.sort(known, kind="stable")[first]
            if x.null_count:
                at, low = np.append(at, 0), np.append(low, np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(low.astype(np.int64)),
                 pa.array([False] * (len(at) - bool(x.null_count)) + [True] * bool(x.null_count))],
                ["bucket", "low", "nulls"])

    found = (map_in_arrow(ids, lowest, "bucket int, low bigint, nulls boolean")
             .groupBy("bucket").agg(F.min("low").alias("low"), F.max("nulls").alias("nulls")).collect())
    return cuts, {r["bucket"]: None if r["nulls"] else r["low"] for r in found}


def fingerprint_neighbours(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, class_id (from ``classes``: doc_id, hi, lo, class_id).

    The edited text has its last n_chars // 2 characters replaced by the first
    as many (or all) of the next document's. Each document is dealt once, its
    class row beside it.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, low = _ranges(docs, doc_id, ranges)
    order = sorted(low)
    before = {b: order[i - 1] for i, b in enumerate(order)}   # the range that a range's first row closes

    def place(doc):
        return 0 if doc is None else int(np.searchsorted(cuts, doc, side="right"))

    def deal(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                b = place(doc)
                row = (doc, text_key(t), None, squeeze(t.encode("utf-8", "surrogatepass")))
                out.append((b, False, *row))
                if doc == low[b]:
                    out.append((before[b], True, *row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    names = ["bucket", "closing", "doc_id", "node", "class_id", "packed"]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    schema = "bucket int, closing boolean, doc_id bigint, node binary, class_id bigint, packed binary"

    def deal_classes(batches):
        for batch in batches:
            ids, *key = (batch.column(i).to_pylist() for i in range(3))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place(i) for i in ids], pa.int32()), pa.array([False] * n), batch.column(0),
                 pa.array(list(map(key_bytes, *key)), pa.binary()), batch.column(3), pa.nulls(n, pa.binary())], names)

    texts = map_in_arrow(docs.select(quoted(doc_id).cast("long"), quoted(text)), deal, schema)
    known = map_in_arrow(classes.select(F.col("doc_id").cast("long"), "hi", "lo", F.col("class_id").cast("long")),
                         deal_classes, schema)
    rows = (texts.unionByName(known).repartition("bucket")
            .sortWithinPartitions("bucket", "closing", "doc_id", "node", F.col("packed").isNotNull()))
    result = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, class_id bigint")

    def compare(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        words = WordHashes()

        def read(packed):
            t = unpack(packed).decode("utf-8", "surrogatepass")
            return t, fingerprint(signature(shingle_hashes(t, words)))

        waiting, bucket, label = None, None, None   # the document whose next one has not come yet
        for batch in batches:
            out = []
            for r in zip(*batch.columns):
                b, closing, doc, node, cls, packed = (x.as_py() for x in r)
                if b != bucket:
                    waiting, bucket = None, b
                if packed is None:
                    label = (doc, node, cls)
                    continue
                if closing and waiting is None:
                    continue
                t, fp = read(packed)
                if waiting is not None:
                    own_id, own, own_fp, own_class = waiting
                    half = len(own) // 2
                    edited = own[:len(own) - half] + t[:half]
                    efp = fingerprint(signature(shingle_hashes(edited, words)))
                    out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                own_fp.tobytes().hex(), efp.tobytes().hex(), likeness(own_fp, efp),
                                likeness(own_fp, fp), own_class))
                waiting = None if closing else (doc, t, fp, label[2] if label and label[:2] == (doc, node) else None)
            cols = [[o[i] for o in out] for i in range(8)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
                     pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)],
                                             ["doc_id", "n_chars", "edited_sha256", "fingerprint",
                                              "edited_fingerprint", "near_edited", "near_next", "class_id"])

    return map_in_arrow(rows, compare, result)
