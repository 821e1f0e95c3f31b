"""Secret scans: fixed credential shapes plus a token-efficiency test.

Base spans come from three patterns (assignments to secret-like names, access
keys, long hexadecimal runs). The token-efficiency test adds spans of kind
``random``: a run of key characters that a byte-pair vocabulary can only cut
into very short pieces (few characters per token) is a random string, since
the vocabulary's merges follow natural text. Known digests (hexadecimal runs
of a digest's length, base64 of its length after its name), UUIDs, plain numbers and identifiers are excluded, and
runs that one base span covers wholly are not repeated. An identifier is made
of words: letter parts that are themselves cheap in tokens (in lower case, so
that capitals do not count against a name), or that repeat a few letters.

Defined cases: NULL text is empty and has no span; an empty table gives an
empty result; ties (spans with one start) order by kind as listed; repeated
rows give equal results; further columns are ignored or carried unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retailcast.llm.common import map_rows, parse_ranks, rank_pattern, read_bytes, vocabulary_path

KINDS = ("assign", "access", "hex", "random")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()),
                                 T.StructField("end", T.LongType())]))

# The base patterns and the least lengths of a match that counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"   # 18 characters or more; the run is greedy, so shorter runs cannot match
HEX = r"[0-9a-f]{16,}"

#: Runs of key characters that the token-efficiency test looks at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Lengths of common hexadecimal digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
# Names of digests and their lengths in base64 without padding.
BASE64_DIGESTS = {"sha1": 27, "sha224": 38, "sha256": 43, "sha384": 64, "sha512": 86, "md5": 22}
DIGEST_NAME = re.compile(r"(?<![A-Za-z0-9])(" + "|".join(BASE64_DIGESTS) + r")[-=:/]([A-Za-z0-9+/_-]+={0,2})", re.I)
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
# A word has this many characters per token or more; a part of at most so many different
# letters, each so many times on average, is a repetition ("zzzzz", "acgtacgt..."), not a key.
WORD_CHARS_PER_TOKEN = 3
REPEATED_LETTERS = 4


def base_spans(text: str, assign=re.compile(ASSIGN, re.I | re.A), access=re.compile(ACCESS),
               hexa=re.compile(HEX)) -> list[tuple[int, int, int]]:
    """(begin, rank of the kind, end) of the three fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in hexa.finditer(text)]
    return found


def word_like(part: str, tokens: Callable[[str], int]) -> bool:
    """A letter part that the vocabulary knows as words, or that repeats very few letters."""
    if len(set(part)) <= min(REPEATED_LETTERS, len(part) // REPEATED_LETTERS):
        return True
    lower = part.lower()
    return len(part) >= WORD_CHARS_PER_TOKEN * min(tokens(part), tokens(lower), tokens(" " + lower))


def known(run: str, tokens: Callable[[str], int]) -> bool:
    """Digests, UUIDs, plain numbers and identifiers made of words are not secrets."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) and len(run) in DIGEST_LENGTHS:
        return True
    if re.fullmatch(UUID, run) or re.fullmatch(r"[0-9_+/=-]+", run):
        return True
    # identifiers: words of letters with few digits, joined by separators or by a change of case
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", run)
    words = sum(len(p) for p in parts if p.isalpha() and len(p) >= 3 and word_like(p, tokens))
    return words >= 0.75 * len(run)


def named_digest(text: str, begin: int, end: int) -> bool:
    """Whether a run ends in a base64 digest of the right length after its name (``sha256-...``, ``sha512=...``)."""
    m = DIGEST_NAME.search(text, max(0, begin - 8), end)
    return bool(m) and m.end() == end and len(m.group(2).rstrip("=")) == BASE64_DIGESTS[m.group(1).lower()]


_SCANNERS: dict[tuple, Callable] = {}   # of a worker: tasks that follow each other share the vocabulary


def shared_scanner(rank_data: bytes, max_chars_per_token: float) -> Callable[[str | None], list]:
    key = (hashlib.sha256(rank_data).digest(), max_chars_per_token)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = make_scanner(rank_data, max_chars_per_token)
    return _SCANNERS[key]


def make_scanner(rank_data: bytes, max_chars_per_token: float) -> Callable[[str | None], list]:
    """scan(text) -> spans sorted by (begin, kind)."""
    import tiktoken

    encoding = tiktoken.Encoding("secrets", pat_str=rank_pattern(), mergeable_ranks=parse_ranks(rank_data),
                                 special_tokens={})
    candidate = re.compile(CANDIDATE)

    def tokens(run: str) -> int:
        return len(encoding.encode_ordinary(run))

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        text = text or ""
        found = base_spans(text)
        base = iter(sorted((b, e) for b, _, e in found))
        ahead, reach = next(base, None), -1   # reach: the furthest end of the base spans that start so far
        for m in candidate.finditer(text):
            b, e, run = m.start(), m.end(), m.group()
            while ahead and ahead[0] <= b:
                ahead, reach = next(base, None), max(reach, ahead[1])
            if e <= reach:
                continue
            if (len(run) < max_chars_per_token * tokens(run) and not known(run, tokens)
                    and not named_digest(text, b, e)):
                found.append((b, 3, e))
        return [(KINDS[k], b, e) for b, k, e in sorted(found)]

    return scan


def scan_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, vocabulary: str | None = None,
                 max_chars_per_token: float = 2.0) -> DataFrame:
    """Columns ``row`` (the carried columns) and ``res.spans`` (kind, begin, end in code points)."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(
        read_bytes(spark, vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")))

    def make():
        scan = shared_scanner(ranks.value, max_chars_per_token)
        return lambda t: (scan(t),)

    return map_rows(docs, [text], make, [("spans", SPAN)], docs.columns if carry is None else carry)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", vocabulary: str | None = None,
           max_chars_per_token: float = 2.0) -> DataFrame:
    """Every column of ``docs``, with each secret span of the text replaced by ``mark``.

    Overlapping spans become one mark. A ``n_chars`` column, if there is one,
    follows the new text. NULL texts stay NULL. All rows stay.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(
        read_bytes(spark, vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")))

    def make():
        scan = shared_scanner(ranks.value, max_chars_per_token)

        def clean(t):
            spans = scan(t)
            if not spans:
                return t, False
            out, at, i = [], 0, 0
            while i < len(spans):
                _, b, e = spans[i]
                while i + 1 < len(spans) and spans[i + 1][1] < e:
                    i += 1
                    e = max(e, spans[i][2])
                out += [t[at:b], mark]
                at, i = e, i + 1
            return "".join([*out, t[at:]]), True

        return clean

    others = [c for c in docs.columns if c != text]
    done = map_rows(docs, [text], make, [("text", T.StringType()), ("changed", T.BooleanType())], others)
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col("res.text").alias(text))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("res.changed"), F.length("res.text").cast(kind))
                        .otherwise(F.col("row.n_chars")).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return done.select(*cols)
