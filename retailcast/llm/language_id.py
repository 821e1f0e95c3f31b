"""Language identification as mixture inference.

Each language is a distribution over hashed byte n-grams of letters, learned
from labelled documents. A document's text is a mixture of languages: for a
set of languages, expectation-maximisation finds the proportions under which
its n-grams are most likely. The set is selected by penalised likelihood:
languages enter in order of their proportion under the full mixture, and each
further one must raise the log-likelihood by more than half the logarithm of
the number of n-grams times ``penalty``. The prediction is the language with
the largest proportion in the selected set, the score is that proportion.

Learning uses at most about ``per_language`` documents of each language (a
documented bound: an exact share by document hash, so that it is the same
sample at every run). Their n-grams are counted in Spark; the model is one
table of ``languages x 2**BITS`` numbers, whatever the corpus size.

Defined cases: NULL, empty or letterless text is ``und`` with score 0; equal
proportions go to the first language by name; with nothing to learn from every
text is ``und``; rows with a NULL id are not
held out and are not learned from; repeated rows give equal results; an empty
table gives an empty result; further columns are ignored or carried unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import map_in_arrow, map_rows, quoted

UNKNOWN = "und"
GRAM = 4          # bytes of an n-gram, word boundaries included
BITS = 16         # n-grams are hashed to so many bits
SMOOTHING = 0.1   # added to every count
CHUNK = 1 << 20   # characters of a text that are turned into n-grams at once
STEPS, CLOSE = 50, 1e-4

NOT_LETTERS = re.compile(r"[\W\d_]+")


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text's words and their counts."""
    total = None
    text = text or ""
    for at in range(0, len(text), CHUNK):
        words = f" {NOT_LETTERS.sub(' ', f' {text[at:at + CHUNK].lower()} ')} "   # one letter still makes n-grams
        b = np.frombuffer(words.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(b) < GRAM:
            continue
        code = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        cell = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        if total is None and len(text) <= CHUNK:
            return np.unique(cell, return_counts=True)
        total = np.bincount(cell, minlength=1 << BITS) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cells = np.nonzero(total)[0]
    return cells, total[cells]


def held_out(doc_id: Column) -> Column:
    """One document in four, by the checksum of its id, is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang",
          per_language: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: language x hashed n-gram) from labelled rows that are not held out."""
    known = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"), quoted(label).alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull()
        & ~held_out(F.col("id")))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 1 << BITS), np.float32)
    # the share of each language that is learned from, as a bound on a hash of the id
    bound = F.create_map(*[x for name in languages for x in (
        F.lit(name), F.lit(min(1.0, per_language / sizes[name])))])
    sample = known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
                         < F.element_at(bound, F.col("label")))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells, counts = gram_counts(t.as_py())
                if name not in sums:
                    sums[name] = np.zeros(1 << BITS, np.int64)
                sums[name][cells] += counts
        for name, total in sums.items():
            cells = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int64()),
                                              pa.array(total[cells], pa.int64())], ["label", "cell", "n"])

    counted = (map_in_arrow(sample.select(F.col("label").cast("string"), "text"), run,
                            "label string, cell bigint, n bigint")
               .groupBy("label", "cell").agg(F.sum("n").alias("n")))
    table = np.full((len(languages), 1 << BITS), SMOOTHING)
    got = counted.toPandas()   # at most languages x 2**BITS rows
    table[np.searchsorted(languages, got["label"].to_numpy(dtype=str)), got["cell"].to_numpy()] += got["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(likely: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """EM: (proportions, log-likelihood) of a mixture, from the likelihoods (language x n-gram)."""
    total = counts.sum()
    for _ in range(STEPS):
        mixed = weights @ likely
        new = weights * (likely @ (counts / mixed)) / total
        moved = np.abs(new - weights).max()
        weights = new
        if moved < CLOSE:
            break
    return weights, float(counts @ np.log(weights @ likely))


def infer(logs: np.ndarray, cells: np.ndarray, counts: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """The selected languages and their proportions."""
    at = logs[:, cells].astype(np.float64)
    top = at.max(axis=0)
    likely = np.exp(at - top)   # scaling each n-gram changes no proportion and every likelihood alike
    size = len(logs)
    everything, _ = mixture(likely, counts, np.full(size, 1.0 / size))
    order = np.argsort(-everything, kind="stable")
    single = at @ counts
    best = int(np.argmax(single))
    chosen, share = [best], np.ones(1)
    score = float(single[best] - counts @ top)
    price = penalty * 0.5 * np.log(counts.sum())
    members = [best]
    for k in order:
        if int(k) == best:
            continue
        members = [*members, int(k)]
        start = np.maximum(everything[members], 1e-3)
        weights, value = mixture(likely[members], counts, start / start.sum())
        if value - score <= price:
            break
        chosen, share, score = members, weights, value
    return chosen, share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
             carry: Sequence[str] | None = None, penalty: float = 4.0) -> DataFrame:
    """Columns ``row`` (carried) and ``res``: lang_pred, score, languages and shares of the selected set."""
    languages, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, logs))
    nothing = (UNKNOWN, 0.0, [], [])

    def make():
        names, table = shared.value

        def predict(t):
            if not names or not t or not any(map(str.isalpha, t)):
                return nothing
            cells, counts = gram_counts(t)
            if not len(cells):
                return nothing
            chosen, share = infer(table, cells, counts.astype(np.float64), penalty)
            ranked = sorted(zip(chosen, share.tolist()), key=lambda x: (-x[1], names[x[0]]))
            return (names[ranked[0][0]], min(1.0, max(0.0, ranked[0][1])),
                    [names[i] for i, _ in ranked], [s for _, s in ranked])

        return predict

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()),
              ("languages", T.ArrayType(T.StringType())), ("shares", T.ArrayType(T.DoubleType()))]
    return map_rows(docs, [text], make, fields, docs.columns if carry is None else carry)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
                    min_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has a main language, with exactly its columns.

    Rejected: texts without letters, and texts in which no language has a share of ``min_score``.
    """
    return identify(docs, model, text).where(
        (F.col("res.lang_pred") != UNKNOWN) & (F.col("res.score") >= min_score)).select("row.*")
