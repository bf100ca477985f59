"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers ``floor(SCALE * c)`` (plus ``OFFSET`` where the value itself counts; the covariance does not see it). Then:

* Tasks sum products of their rows exactly (float64 products of limbs small enough to be exact) and send the sums as limbs, which
  Spark adds up. With n vectors, sums S and products Q the scatter ``n * Q - S * S'`` is an integer matrix, n * n times the covariance.
* Its characteristic polynomial is found modulo as many 31-bit primes as its coefficients need (bound by the trace), a task per
  some primes: Hessenberg form, then the recurrence over its leading minors. Each coefficient is put together by Chinese remainders.
* All roots are real, so the changes of sign among the coefficients of the polynomial shifted by a count the roots beyond a. A
  component's root is isolated by bisection on that count and refined by the polynomial's sign, in exact integers, to ``BITS`` bits below the
  trace. Roots that cannot be told apart at that width are one root of that multiplicity.
* Its eigenvectors are the null space of scatter minus root by elimination with complete pivoting in decimals of ``DIGITS`` digits; a single
  one is refined by a step of inverse iteration, several are made orthonormal.

What the driver sees is bounded by the square of the dimension: sums, coefficients, components.

The fit list is every vector without null or non-finite entries, repeated rows included. Null vectors and such with null or non-finite entries are
dropped. The dimension is the most frequent length among the rest (ties: the longer one); vectors of other lengths, empty ones
too, share no space with them and are dropped as well. Components with eigenvalue 0 cannot be scaled and are left out, so equal vectors or a single one give no rows, as
does an empty table. Entries beyond 62 bits after scaling are taken at that bound. A deviation beyond 63 bits is null. Null ids give rows like any
other; other columns are ignored, whatever their names. Components of equal eigenvalues are any orthonormal basis, the same for all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.llm.staged import stage
from cellpath.session import shuffle_partitions

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BITS = 192
DIGITS = 120

_BOUND = 1 << 62
_LIMB = 21
_ROWS = 1 << 11  # products of limbs of 21 bits, added up over so many rows, stay below 2 ** 53
_SHIFT = 40


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: vectors as doubles, without those that are null or hold null or non-finite entries."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("v is not null and size(v) > 0 and forall(v, c -> c is not null and abs(c) < double('Infinity'))")


def _integers(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of scaled integers, without the offset."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -float(_BOUND), float(_BOUND)).astype(np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of 21 bits as doubles, the last one signed."""
    parts, most = [], int(np.abs(x).max(initial=0))
    while most >= 1 << _LIMB:
        parts.append((x & ((1 << _LIMB) - 1)).astype(np.float64))
        x, most = x >> _LIMB, (most >> _LIMB) + 1
    return [*parts, x.astype(np.float64)]


def _products(x: np.ndarray) -> np.ndarray:
    """``x' x`` as exact integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for start in range(0, len(x), _ROWS):
        parts = _limbs(x[start : start + _ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j)) if i + j else (a.T @ b).astype(np.int64).astype(object)
    return total


def _split(values: list[int]) -> list[pa.Array]:
    """Four columns of 40 bits each, the last one signed, whose sums give the sum of the values."""
    mask = (1 << _SHIFT) - 1
    return [pa.array([(v >> (_SHIFT * k)) & mask if k < 3 else v >> (3 * _SHIFT) for v in values], pa.int64()) for k in range(4)]


@dataclass(frozen=True)
class Scatter:
    """Number of vectors, their sums and n * n times their covariance, all exact."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray

    @property
    def trace(self) -> int:
        return sum(int(x) for x in np.diag(self.matrix)) if self.n else 0


def scatter(rows: DataFrame, dimension: int) -> Scatter:
    """Scatter of the vectors in column ``v``, all of one dimension."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            x = _integers(batch["v"], dimension)
            n += len(x)
            sums = sums + x.astype(object).sum(axis=0) if len(x) else sums
            products = products + _products(x)
        if n:
            low, high = np.tril_indices(dimension)
            at = [*low.tolist(), *range(dimension), -1]
            to = [*high.tolist(), *[-1] * dimension, -1]
            values = [*products[low, high].tolist(), *sums.tolist(), n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(to, pa.int32()), *_split([int(v) for v in values])], names=["i", "j", "a", "b", "c", "d"]
            )

    parts = rows.select("v").mapInArrow(add_up, "i int, j int, a long, b long, c long, d long")
    found = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()
    n, sums, matrix = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
    for r in found:
        value = r.a + (r.b << _SHIFT) + (r.c << 2 * _SHIFT) + (r.d << 3 * _SHIFT)
        if r.i < 0:
            n = value
        elif r.j < 0:
            sums[r.i] = value
        else:
            matrix[r.i, r.j] = matrix[r.j, r.i] = value
    return Scatter(n, sums, n * matrix - np.outer(sums, sums))


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide below 3.2 * 10 ** 9."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(trace: int, dimension: int) -> list[int]:
    """Primes below 2 ** 31 whose product exceeds twice any coefficient of a semidefinite matrix of that trace."""
    needed = dimension * math.log2(1 + trace / dimension) + 4 if trace < 1 << 900 else dimension * trace.bit_length() + 4
    found, at = [], (1 << 31) - 1
    while 30.9 * len(found) < needed:
        if _is_prime(at):
            found.append(at)
        at -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo a prime below 2 ** 31, that of x ** k at k."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weights = np.zeros(k, np.int64)  # of the minors before, from 0 on
        weights[k - 1] = h[k - 1, k - 1]
        step = 1
        for i in range(k - 2, -1, -1):
            step = step * int(h[i + 1, i]) % p
            if not step:
                break
            weights[i] = int(h[i, k - 1]) * step % p
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weights[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def _remaindered(residues: list[int], primes: list[int]) -> int:
    """The integer of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += (r - value) * pow(product, -1, p) % p * product
        product *= p
    return value - product if 2 * value > product else value


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray, trace: int) -> list[int]:
    """Coefficients of the characteristic polynomial of a semidefinite integer matrix, exact, that of x ** k at k."""
    primes = primes_for(trace, len(matrix))
    shared = spark.sparkContext.broadcast((matrix, primes))

    def modulo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, all_primes = shared.value
        for batch in batches:
            for at in batch["id"].to_pylist():
                found = polynomial_modulo(whole, all_primes[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(found))), pa.array(np.full(len(found), at)), pa.array(found)], names=["k", "prime", "residue"]
                )

    def remainder(group: pa.Table) -> pa.Table:
        group = group.sort_by("prime")
        value = _remaindered(group["residue"].to_pylist(), shared.value[1])
        return pa.table({"k": group["k"].slice(0, 1), "value": [str(value)]})

    tasks = min(len(primes), max(1, shuffle_partitions(spark)))
    residues = spark.range(0, len(primes), 1, tasks).mapInArrow(modulo, "k long, prime long, residue long")
    found = residues.groupBy("k").applyInArrow(remainder, "k long, value string").collect()
    return [int(r.value) for r in sorted(found, key=lambda r: r.k)]


def roots_beyond(polynomial: list[int], a: int) -> int:
    """Number of roots above ``a`` of a polynomial whose roots are all real, by the signs of its coefficients about ``a``."""
    shifted = polynomial[::-1]
    for end in range(len(shifted), 1, -1):
        for j in range(1, end):
            shifted[j] += a * shifted[j - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(polynomial: list[int], a: int) -> int:
    value = 0
    for c in reversed(polynomial):
        value = value * a + c
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root, how many roots are not told apart from it, and how many are larger."""

    value: Fraction
    multiplicity: int
    larger: int


def isolate(polynomial: list[int], k: int, bound: int) -> Root:
    """The k-th largest root (from 1), which must be above 0; all roots are real and at most ``bound``."""
    size = bound.bit_length()
    finer, unit = max(0, BITS - size), max(0, size - BITS)
    degree = len(polynomial) - 1
    scaled = [c << (finer * (degree - i)) for i, c in enumerate(polynomial)]
    low, high = 0, 1 << (size + finer - unit)
    at_low, at_high = roots_beyond(scaled, 0), 0
    while at_low - at_high > 1 and high - low > 1:
        middle = (low + high) // 2
        beyond = roots_beyond(scaled, middle << unit)
        if beyond >= k:
            low, at_low = middle, beyond
        else:
            high, at_high = middle, beyond
    if at_low - at_high == 1:
        after = -1 if at_high % 2 else 1
        while high - low > 1:
            middle = (low + high) // 2
            if _sign(scaled, middle << unit) * after >= 0:
                high = middle
            else:
                low = middle
    return Root(Fraction(high << unit, 1 << finer), at_low - at_high, at_high)


def _eliminated(matrix: np.ndarray, value: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LU form, in place, of ``matrix - value`` with complete pivoting, and the orders of its rows and columns."""
    shift = Decimal(value.numerator) / Decimal(value.denominator)
    a = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
    d = len(a)
    for i in range(d):
        a[i, i] -= shift
    rows, columns = np.arange(d), np.arange(d)
    for k in range(d):
        rest = np.abs(a[k:, k:])
        i, j = divmod(int(rest.argmax()), d - k)
        a[[k, k + i]], rows[[k, k + i]] = a[[k + i, k]], rows[[k + i, k]]
        a[:, [k, k + j]], columns[[k, k + j]] = a[:, [k + j, k]], columns[[k + j, k]]
        if a[k, k] == 0:
            break
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, rows, columns


def _back(upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve with the upper triangle."""
    out = right.copy()
    for i in range(len(out) - 1, -1, -1):
        out[i] = (out[i] - (upper[i, i + 1 : len(out)] * out[i + 1 :]).sum()) / upper[i, i] if i + 1 < len(out) else out[i] / upper[i, i]
    return out


def _norm(x: np.ndarray) -> Decimal:
    return (x * x).sum().sqrt()


def eigenvectors(matrix: np.ndarray, root: Root) -> np.ndarray:
    """Orthonormal eigenvectors of a root, one a row, in doubles; the largest entry of each is positive."""
    with localcontext(Context(prec=DIGITS)):
        a, rows, columns = _eliminated(matrix, root.value)
        d, free = len(a), root.multiplicity
        fixed = d - free
        basis = []
        for f in range(fixed, d):
            x = np.array([Decimal(0)] * d, object)
            x[f] = Decimal(1)
            if fixed:
                x[:fixed] = _back(a[:fixed, :fixed], -a[:fixed, f])
            basis.append(x)
        if free == 1 and a[d - 1, d - 1] != 0:
            # A step of inverse iteration: rows in pivot order, forward, then backward.
            start = np.empty(d, object)
            start[columns] = basis[0]
            y = start[rows]
            for i in range(1, d):
                y[i] -= (a[i, :i] * y[:i]).sum()
            basis = [_back(a, y)]
        out = []
        for x in basis:
            x = x / _norm(x)
            for other in out:
                x = x - other * (x * other).sum()
            out.append(x / _norm(x))
        found = np.zeros((free, d))
        for i, x in enumerate(out):
            found[i, columns] = x.astype(np.float64)
    largest = np.abs(found).argmax(axis=1)
    return found * np.sign(found[np.arange(free), largest])[:, None]


@dataclass(frozen=True)
class Whitening:
    """Fit: scatter, and by falling eigenvalue the components (rows), eigenvalues of the covariance and their shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def fit(spark: SparkSession, found: Scatter, most: int = COMPONENTS) -> Whitening:
    """Components of positive eigenvalue, ``most`` at most; a task each."""
    trace, d = found.trace, len(found.sums)
    if not trace:
        return Whitening(found.n, found.sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    polynomial = characteristic_polynomial(spark, found.matrix, trace)
    rank = d - next(k for k, c in enumerate(polynomial) if c)
    wanted = min(most, rank)
    shared = spark.sparkContext.broadcast((found.matrix, polynomial))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, coefficients = shared.value
        for batch in batches:
            for k in batch["id"].to_pylist():
                root = isolate(coefficients, k, trace)
                vector = eigenvectors(matrix, root)[k - 1 - root.larger]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([float(root.value / found.n**2)]), pa.array([float(root.value / trace)]), pa.array([vector.tolist()])],
                    names=["k", "eigenvalue", "share", "vector"],
                )

    solved = spark.range(1, wanted + 1, 1, wanted).mapInArrow(solve, "k long, eigenvalue double, share double, vector array<double>").collect()
    solved.sort(key=lambda r: r.k)
    columns = ([r.vector for r in solved], [r.eigenvalue for r in solved], [r.share for r in solved])
    return Whitening(found.n, found.sums, *(np.array(c) for c in columns))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """``n * x - S`` as doubles and the exact sums of its squares; null beyond 63 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if x.shape[1] * most * most < 1 << 63:
        gap = n * x - sums.astype(np.int64)
        return gap.astype(np.float64), (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * n - sums
    squares = [int(s) for s in (gap * gap).sum(axis=1)]
    return gap.astype(np.float64), [s if s < 1 << 63 else None for s in squares]


def transform(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (an entry per component) of vectors in column ``v``."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    d = fitted.components.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scaled = model.components.T / np.sqrt(model.eigenvalues)
        for batch in batches:
            gap, squares = _deviations(_integers(batch["v"], d), model.n, model.sums)
            white = (gap / model.n) @ scaled
            offsets = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(squares, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return rows.select("vec_id", "v").mapInArrow(project, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, size: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity; centred before multiplying."""

    def sums(mean: np.ndarray | None):
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size) if mean is not None else (1, size))
            for batch in batches:
                w = batch["whitened"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                total = total + (w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean))
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (i, j, total)], names=["i", "j", "x"])

        found = white.select("whitened").mapInArrow(add_up, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
        out = np.zeros((size, size) if mean is not None else (1, size))
        for r in found:
            out[r.i, r.j] = r.x
        return out / n

    return float(np.abs(sums(sums(None)[0]) - np.eye(size)).max())


_EMPTY = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    none = spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {_EMPTY}")
    if lengths is None:
        return none
    rows = rows.where(F.size("v") == lengths.d)
    fitted = fit(spark, scatter(rows, lengths.d), most)
    size = len(fitted.eigenvalues)
    if not size:
        return none
    white = stage(transform(rows, fitted), "whitened")
    error = identity_error(white, fitted.n, size)
    explained = F.array(*map(F.lit, fitted.explained.tolist()))
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "white")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
