"""Whitening of embeddings along exact principal components.

1. Entries become whole numbers, ``floor(scale * c)`` (+ ``offset`` in the
   reported deviations; a shift changes no covariance). One pass sums the
   vectors and their products exactly: digits of 2**20 in float matrix products
   of at most 4,096 rows, then whole numbers cut into limbs that Spark adds.
2. The scatter ``n * sum(x x') - S S'`` is a matrix of whole numbers. Its
   characteristic polynomial is taken modulo primes by reduction to Hessenberg
   form (one Spark row per prime) and put together by Chinese remaindering.
3. All its roots are real, so the number of roots above a point is the number
   of sign changes of the polynomial shifted to it (Descartes), exactly and
   with multiplicity. Bisection on that count isolates the largest roots and
   narrows them to ``DIGITS`` digits, in whole numbers throughout.
4. The null space of ``scatter - root`` gives the components: inverse iteration
   in ``DIGITS`` decimal digits, against the components found before for equal
   roots. The sign is fixed by the entry of largest size.
5. A pass projects the centred vectors; the largest entry of their covariance
   minus the identity is one aggregate (``covar_pop``, centred and mergeable).

The driver holds d * d sums and a polynomial of degree d, whatever the number
of vectors; a task holds one Arrow batch. Steps 2 to 4 cost d**4 to d**5 small
operations: meant for some hundred dimensions at most.

Defined cases: a vector that is NULL or holds NULL, NaN or infinite entries is
left out; so is one whose length is not the most frequent (ties: the longest),
or that is empty. Entries whose scaled value leaves 62 bits stop there.
Repeated rows are fitted and returned each for itself. A root of 0 has no
scale: its whitened values and its share are 0, and it does not count in the
identity error. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import map_batches, map_in_arrow, quoted

LIMB_BITS = 24        # of the sums that Spark adds
DIGIT_BITS = 20       # of the factors of a float matrix product
BLOCK_ROWS = 1 << 12  # 2**12 products of 2**40 stay below 2**53
DIGITS = 100          # decimal digits of roots and components
LARGEST = float(1 << 62)


def usable(docs: DataFrame, vector: str) -> DataFrame:
    v = quoted(vector)
    return docs.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double")) < F.lit(float("inf")))))


def dimension(rows: DataFrame, vector: str) -> int:
    top = (rows.groupBy(F.size(quoted(vector)).alias("d")).count().where("d > 0")
           .orderBy(F.col("count").desc(), F.col("d").desc()).first())
    return top["d"] if top else 0


def whole_numbers(vectors: pa.Array, d: int, scale: float) -> np.ndarray:
    """Vectors of length ``d`` as a matrix of whole numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64)


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x' x`` as a matrix of Python's whole numbers."""
    digits = []
    rest = x
    while rest.any():
        low = ((rest + (1 << DIGIT_BITS - 1)) & ((1 << DIGIT_BITS) - 1)) - (1 << DIGIT_BITS - 1)   # signed
        digits.append(low.astype(np.float64))
        rest = (rest - low) >> DIGIT_BITS
    d = x.shape[1]
    total = np.zeros((d, d), dtype=object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) << DIGIT_BITS * (i + j)
    return total


@dataclass
class Moments:
    """Exact sums of the whole-number vectors of a table."""

    n: int
    sums: list[int]
    products: np.ndarray   # d x d, Python's whole numbers

    @property
    def scatter(self) -> list[list[int]]:
        """``n`` squared times the covariance."""
        d = len(self.sums)
        return [[self.n * int(self.products[i][j]) - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]


def limbs(value: int) -> list[int]:
    """``value`` in digits of 2**24, all of its sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB_BITS) - 1)))
        value >>= LIMB_BITS
    return out


def moments(rows: DataFrame, vector: str, d: int, scale: float) -> Moments:
    """Of vectors of length ``d``, in one pass; each task sends the limbs of d sums and d * (d + 1) / 2 products, which Spark adds."""
    src = rows.select(quoted(vector).cast("array<double>").alias("v"))

    def run(batches):
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            x = whole_numbers(batch.column(0), d, scale)
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at:at + BLOCK_ROWS]
                n += len(part)
                products += exact_products(part)
                sums += (part >> 31).sum(axis=0).astype(object) << 31   # halves, so that no sum leaves 64 bits
                sums += (part & (1 << 31) - 1).sum(axis=0).astype(object)
        if n:
            values = [((-1, -1), n), *(((-1, i), int(v)) for i, v in enumerate(sums)),
                      *(((i, j), int(products[i][j])) for i in range(d) for j in range(i, d))]
            out = [(i, j, k, v) for (i, j), value in values for k, v in enumerate(limbs(value))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "k", "v"])

    parts = map_in_arrow(src, run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    n, sums, products = 0, [0] * d, np.zeros((d, d), dtype=object)
    for i, j, k, v in parts.collect():   # a few numbers for each of d * d entries
        value = v << LIMB_BITS * k
        if j < 0:
            n += value
        elif i < 0:
            sums[j] += value
        else:
            products[i, j] += value
            if i != j:
                products[j, i] += value
    return Moments(n, sums, products)


def primes_below(top: int):
    """Primes downwards from ``top`` (below 2**31: trial division by the few thousand small primes)."""
    root = math.isqrt(top) + 1
    sieve = np.ones(root + 1, bool)
    sieve[:2] = False
    for p in range(2, math.isqrt(root) + 1):
        if sieve[p]:
            sieve[p * p::p] = False
    small = np.nonzero(sieve)[0]
    for x in range(top - 1, 2, -1):
        if not (x % small[small * small <= x] == 0).any():
            yield x


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo ``p``, lowest first: Hessenberg form, then its recurrence."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for m in range(1, d - 1):
        nonzero = np.nonzero(h[m:, m - 1])[0]
        if not len(nonzero):
            continue
        pivot = m + int(nonzero[0])
        if pivot != m:   # a similarity: rows, then columns
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - factor[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * factor[None, :] % p).sum(axis=1)) % p
    polys = [np.ones(1, np.int64)]
    for m in range(d):   # the leading block of m + 1 rows by those before it
        last = polys[-1]
        new = np.zeros(m + 2, np.int64)
        new[1:] = last
        new[:-1] = (new[:-1] - h[m, m] * last) % p
        product = 1
        for i in range(1, m + 1):
            product = product * int(h[m - i + 1, m - i]) % p
            if not product:
                break
            term = int(h[m - i, m]) * product % p
            new[:m - i + 1] = (new[:m - i + 1] - term * polys[m - i]) % p
        polys.append(new % p)
    return [int(c) for c in polys[-1]]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of det(t - matrix) of a matrix without negative roots is larger: (1 + trace / d) ** d, and 1 for safety."""
    d = len(matrix)
    return (1 + -(-sum(matrix[i][i] for i in range(d)) // d)) ** d + 1


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first, of a symmetric matrix without negative roots."""
    bound, primes, modulus = 2 * coefficient_bound(matrix), [], 1
    for p in primes_below(1 << 31):
        if modulus > bound:
            break
        primes.append(p)
        modulus *= p
    d = len(matrix)
    shared = spark.sparkContext.broadcast([str(x) for row in matrix for x in row])   # d * d numbers

    def run(batches):
        values = None
        for batch in batches:
            values = values or [int(x) for x in shared.value]
            out = []
            for p in batch.column(0).to_pylist():
                residue = np.fromiter((x % p for x in values), np.int64, d * d).reshape(d, d)
                out.append(polynomial_modulo(residue, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(spark.sparkContext.defaultParallelism)
    found = dict(map_in_arrow(rows, run, "p long, c array<long>").collect())
    total = [0] * (d + 1)
    for p in primes:
        rest = modulus // p
        weight = rest * pow(rest, -1, p)
        total = [(t + c * weight) % modulus for t, c in zip(total, found[p])]
    return [c - modulus if c > modulus // 2 else c for c in total]


def sign_changes(values: list[int]) -> int:
    signs = [v > 0 for v in values if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """Number of roots above ``at / 2**bits``, with multiplicity, of a polynomial all of whose roots are real."""
    d = len(poly) - 1
    c = [v << bits * (d - i) for i, v in enumerate(poly)]   # of the roots times 2**bits
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    return sign_changes(c)


def largest_roots(poly: list[int], k: int, top: int) -> list[tuple[int, int]]:
    """The ``k`` largest roots, falling, as (numerator, bits): the root is within 2**-bits above it.

    ``top`` is above all roots, none of which is negative. A root of 0 is (0, 0).
    """
    k = min(k, len(poly) - 1)
    zeros = next(i for i, c in enumerate(poly) if c)
    positive = len(poly) - 1 - zeros
    poly = poly[zeros:]
    out = []
    known = {}   # (place, bits) -> roots above it; places in lowest terms

    def above(at, bits):
        while bits and not at & 1:
            at, bits = at >> 1, bits - 1
        if (at, bits) not in known:
            known[at, bits] = roots_above(poly, at, bits)
        return known[at, bits]

    for i in range(k):
        if i >= positive:
            out.append((0, 0))
            continue
        low, high, bits = 0, top, 0
        # first the count, which tells roots apart; the interval then holds equal roots or one
        while high - low > 1 or low.bit_length() < DIGITS * 10 // 3:
            if high - low <= 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            n = above(middle, bits)
            low, high = (middle, high) if n > i else (low, middle)
            lone = above(low, bits) - above(high, bits) == 1 and above(low, bits) == i + 1
            if lone:
                low, high, bits = narrowed(poly, low, high, bits)
                break
        out.append((low, bits))
    return out


def value_at(poly: list[int], at: int, bits: int) -> int:
    """Sign of the polynomial at ``at / 2**bits``, scaled."""
    v = 0
    for i, c in enumerate(reversed(poly)):
        v = v * at + (c << bits * i)
    return v


def narrowed(poly: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """The lone root of (low, high] to ``DIGITS`` digits, by the polynomial's sign."""
    above_sign = value_at(poly, high, bits)
    if above_sign == 0:   # the root itself
        return high, high, bits
    while high - low > 1 or low.bit_length() < DIGITS * 10 // 3:
        if high - low <= 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        v = value_at(poly, middle, bits)
        if v == 0:
            return middle, middle, bits
        low, high = (low, middle) if (v > 0) == (above_sign > 0) else (middle, high)
    return low, high, bits


def factored(matrix: list[list[Decimal]]) -> tuple[list[list[Decimal]], list[int]]:
    """Rows of L and U in place and the order of rows; a pivot of 0 becomes the smallest number that counts."""
    d = len(matrix)
    lu, order = [row[:] for row in matrix], list(range(d))
    least = max((abs(x) for row in matrix for x in row), default=Decimal(0)) * Decimal(10) ** -DIGITS or Decimal(1)
    for c in range(d):
        best = max(range(c, d), key=lambda r: abs(lu[r][c]))
        lu[c], lu[best] = lu[best], lu[c]
        order[c], order[best] = order[best], order[c]
        if abs(lu[c][c]) < least:
            lu[c][c] = least
        pivot, head = lu[c][c], lu[c]
        for r in range(c + 1, d):
            row = lu[r]
            if row[c]:
                f = row[c] = row[c] / pivot
                for j in range(c + 1, d):
                    row[j] -= f * head[j]
    return lu, order


def solved(lu: list[list[Decimal]], order: list[int], b: list[Decimal]) -> list[Decimal]:
    d = len(lu)
    x = [b[i] for i in order]
    for r in range(d):
        x[r] -= sum((lu[r][j] * x[j] for j in range(r)), Decimal(0))
    for r in range(d - 1, -1, -1):
        x[r] = (x[r] - sum((lu[r][j] * x[j] for j in range(r + 1, d)), Decimal(0))) / lu[r][r]
    return x


def unit(x: list[Decimal], against: list[list[Decimal]]) -> list[Decimal]:
    """``x`` without its parts along ``against``, of length 1."""
    for _ in range(2):
        for y in against:
            along = sum(a * b for a, b in zip(x, y))
            x = [a - along * b for a, b in zip(x, y)]
    size = sum(a * a for a in x).sqrt()
    return [a / size for a in x]


@dataclass
class Components:
    """The largest components: unit vectors, eigenvalues of the covariance and their shares of its trace."""

    vectors: np.ndarray      # k x d
    eigenvalues: list[float]
    explained: list[float]


def components(spark, m: Moments, k: int) -> Components:
    matrix = m.scatter
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Components(np.eye(min(k, d), d), [0.0] * min(k, d), [0.0] * min(k, d))
    poly = characteristic_polynomial(spark, matrix)
    roots = largest_roots(poly, k, trace + 1)
    vectors, values, shares, same = [], [], [], []
    with localcontext(Context(prec=DIGITS + 20, Emin=-10**9, Emax=10**9)):
        m2 = Decimal(m.n) ** 2
        for i, (at, bits) in enumerate(roots):
            root = Decimal(at) / Decimal(2) ** bits
            if i and roots[i - 1] == (at, bits):
                same.append(vectors[-1])
            else:
                same = []
                lu, order = factored([[Decimal(x) - root if r == c else Decimal(x) for c, x in enumerate(row)]
                                      for r, row in enumerate(matrix)])
            # starts that no component is likely to be orthogonal to, another one for each equal root
            x = unit([Decimal(1) / (1 + (j * (i + 1) + i) % (d + 1)) for j in range(d)], same)
            for _ in range(3):
                x = unit(solved(lu, order, x), same)
            top = max(range(d), key=lambda j: abs(x[j]))
            vectors.append(x if x[top] > 0 else [-a for a in x])
            values.append(float(root / m2))
            shares.append(float(root / trace))
    return Components(np.array([[float(a) for a in x] for x in vectors]), values, shares)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8,
           scale: float = 1024.0) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation (DECIMAL(38,0), exact; NULL
    beyond), whitened, eigenvalue, explained, identity_error."""
    spark = rows.sparkSession
    good = usable(rows, vector)
    d = dimension(good, vector)
    good = good.where(F.size(quoted(vector)) == F.lit(d) if d else F.lit(False))
    found = moments(good, vector, d, scale) if d else Moments(0, [], np.zeros((0, 0), dtype=object))
    parts = components(spark, found, k) if d else Components(np.zeros((0, 0)), [], [])
    n, sums = found.n, [str(s) for s in found.sums]
    rising = [1 / math.sqrt(e) if e else 0.0 for e in parts.eigenvalues]
    basis = parts.vectors * np.array(rising)[:, None] if d else parts.vectors

    def make():
        total = [int(s) for s in sums]
        small = np.array(total, dtype=object)

        def run(vectors):
            x = whole_numbers(vectors, d, scale)
            top = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
            centred = n * (x if top < 1 << 62 else x.astype(object)) - (small if top >= 1 << 62 else small.astype(np.int64))
            squares = (centred * centred if d * top * top < 1 << 62 else centred.astype(object) ** 2).sum(axis=1)
            flat = (centred / n).astype(np.float64)
            white = np.stack([(flat * b).sum(axis=1) for b in basis], axis=1)
            return [pa.array([str(v) for v in squares]), pa.array(list(white), pa.list_(pa.float64()))]

        return run

    src = good.select(
        quoted(vec_id).alias("vec_id"), quoted(vector).cast("array<double>").alias("v"))
    done = map_batches(src, ["v"], make, [("deviation", T.StringType()),
                                          ("white", T.ArrayType(T.DoubleType()))], ["vec_id"])
    live = [i for i, e in enumerate(parts.eigenvalues) if e]
    error = 0.0
    if live:
        white = done.select(*[F.col("res.white")[i].alias(f"w{i}") for i in live])
        row = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in live for j in live if i <= j]).first()
        error = max(abs(row[f"c{i}_{j}"] - (i == j)) for i in live for j in live if i <= j)
    share = F.array(*[F.lit(v) for v in parts.explained]) if d else F.array().cast("array<double>")
    value = F.array(*[F.lit(v) for v in parts.eigenvalues]) if d else F.array().cast("array<double>")
    out = done.select("row.vec_id", F.expr("try_cast(res.deviation AS DECIMAL(38,0))").alias("deviation"),
                      F.posexplode("res.white").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(value, F.col("at")).alias("eigenvalue"),
                      F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
