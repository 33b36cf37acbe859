"""Embedding whitening by the exact characteristic polynomial.

Components become whole numbers, so n times their scatter, M = n * sum(x x') - S S', is a matrix of whole numbers, found
by one aggregate, and M / n^2 is the covariance. Its characteristic polynomial is found exactly: modulo many primes by
reduction to Hessenberg form, one prime a task row, and by Chinese remainders. All roots of it are real, so the number of
roots above a point is the number of changes of sign in the coefficients of the polynomial shifted there; bisection with
whole numbers isolates each eigenvalue, multiple or not, to any precision. Components come from inverse iteration near
the null space of M - eigenvalue, in decimal arithmetic, so close eigenvalues cost no digits.

What reaches the driver is of the vectors' length squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Factor and shift of a component; components returned at most.
FACTOR, SHIFT, COMPONENTS = 1024, 100_000, 8
#: A component times FACTOR is held to this size, so that all sums fit 38 digits.
MOST = 1 << 40
#: Bits of an eigenvalue behind its first; digits of the inverse iteration and times it is done.
BITS, DIGITS, ROUNDS = 96, 80, 3
#: Rows whose products are summed at a time.
ROWS = 4096

WHITE = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whole_vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """floor(FACTOR * c) of (…, vectors) as int64; missing entries at the end of shorter vectors are 0."""
    lists = batch.column(batch.num_columns - 1)
    lengths = np.asarray(pc.list_value_length(lists), np.int64)
    flat = np.asarray(lists.flatten(), float)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((batch.num_rows, dims))
    out[np.repeat(np.arange(batch.num_rows), lengths), at] = flat
    return np.clip(np.floor(FACTOR * out), -MOST, MOST).astype(np.int64)


def exact(x: np.ndarray, terms: int) -> np.ndarray:
    """As whole numbers of any size if a sum of so many products might pass 63 bits."""
    return x if int(np.abs(x).max(initial=0)) ** 2 * terms < 1 << 62 else x.astype(object)


@dataclass
class Scatter:
    n: int
    sums: list[int]  # of the shifted components
    matrix: list[list[int]]  # n * sum(x x') - S S'


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that are not null and hold neither nulls nor values that are not finite."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", finite))


def scatter(rows: DataFrame, dims: int) -> Scatter:
    """Sums of rows, components and products: by batch in whole numbers, then one row a position by Spark."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in common.sliced(batches):
            x = whole_vectors(batch, dims)
            for at in range(0, len(x), ROWS):
                part = exact(x[at : at + ROWS], ROWS)
                values = [len(part), *part.sum(axis=0).tolist(), *(part.T @ part)[upper].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in values]], pa.list_(pa.string()))], names=["s"])

    parts = rows.select("v").mapInArrow(run, "s array<string>").select(F.posexplode("s").alias("i", "s"))
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()}
    n, s = found.get(0, 0), [found.get(1 + i, 0) for i in range(dims)]
    matrix = [[0] * dims for _ in range(dims)]
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        matrix[i][j] = matrix[j][i] = n * found.get(1 + dims + k, 0) - s[i] * s[j]
    return Scatter(n, [x + n * SHIFT for x in s], matrix)


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The greatest primes below a bound."""
    small = [p for p in range(2, isqrt(below) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    tests, out, high = np.array(small), [], below
    while len(out) < count:
        low = high - 50_000
        free = np.ones(high - low, bool)
        for p in tests:
            free[(-low) % p :: p] = False
        out += [low + int(i) for i in np.flatnonzero(free)[::-1]]
        high = low
    return out[:count]


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to `a` modulo p whose entries below the first subdiagonal are 0."""
    a, d = a % p, len(a)
    for k in range(d - 2):
        found = np.flatnonzero(a[k + 1 :, k])
        if not len(found):
            continue
        if i := int(found[0]):
            i += k + 1
            a[[k + 1, i]] = a[[i, k + 1]]
            a[:, [k + 1, i]] = a[:, [i, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(axis=1)) % p
    return a


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo p, the constant first."""
    h, d = hessenberg(matrix, p), len(matrix)
    before = [np.zeros(d + 1, np.int64)]
    before[0][0] = 1
    for k in range(d):
        now = (np.roll(before[k], 1) - h[k, k] * before[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            now = (now - int(h[i, k]) * product % p * before[i]) % p
        before.append(now)
    return before[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t - matrix) for a symmetric matrix without negative eigenvalues, the constant first.
    The k-th elementary sum of eigenvalues is at most comb(d, k) * (trace / d)^k, which says how many primes are enough."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    most = max((comb(d, k) * trace**k // d**k for k in range(1, d + 1)), default=0)
    moduli = primes((2 * most + 2).bit_length() // 30 + 1)
    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            p = batch.column(0).to_pylist()
            found = [polynomial_mod(np.array([[x % m for x in row] for row in matrix], np.int64), m) for m in p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    product, out = 1, [0] * (d + 1)
    for row in rows.mapInArrow(run, "p long, c array<long>").collect():  # as many as the coefficients' bits need
        step = pow(product, -1, row["p"])
        out = [c + product * ((r - c) * step % row["p"]) for c, r in zip(out, row["c"], strict=True)]
        product *= row["p"]
    return [c if 2 * c <= product else c - product for c in out]


class Roots:
    """Counts the roots of a polynomial with real roots only above points num / 2^bits."""

    def __init__(self, coefficients: list[int], bits: int):
        d = len(coefficients) - 1
        self.scaled = [c << bits * (d - i) for i, c in enumerate(coefficients)]  # roots times 2^bits
        self.known: dict[int, int] = {}

    def above(self, at: int) -> int:
        """Roots greater than the point, multiple ones as often: the changes of sign of the coefficients around it."""
        if at not in self.known:
            c = list(self.scaled)
            for i in range(len(c) - 1):
                for j in range(len(c) - 2, i - 1, -1):
                    c[j] += at * c[j + 1]
            signs = [x > 0 for x in c if x]
            self.known[at] = sum(a != b for a, b in zip(signs, signs[1:], strict=False))
        return self.known[at]

    def sign(self, at: int) -> int:
        value = 0
        for c in reversed(self.scaled):
            value = value * at + c
        return (value > 0) - (value < 0)

    def nth(self, k: int, high: int, bits: int) -> int:
        """A point at most 2^-bits, by the root's size, below the k-th root from above. Once no other root is near, the
        sign of the polynomial is enough."""
        low, side = 0, 0
        while high - low > max(1, high >> bits):
            mid = (low + high) // 2
            side = side or (self.above(low) == k and self.above(high) == k - 1 and self.sign(high))
            now = side and self.sign(mid)
            if side and not now:
                return mid
            low, high = (mid, high) if (now != side if side else self.above(mid) >= k) else (low, mid)
        return low


def eigenvalues(coefficients: list[int], trace: int, count: int, bits: int = BITS) -> list[Decimal]:
    """The greatest eigenvalues that are not 0, by falling size, multiple ones as often. Small ones are found on a finer
    scale."""
    zeros = next((i for i, c in enumerate(coefficients) if c), len(coefficients) - 1)
    own, scale, out = coefficients[zeros:], bits, []
    roots = Roots(own, scale)
    with localcontext() as context:
        context.prec = DIGITS
        for k in range(1, min(count, len(own) - 1) + 1):
            while (root := roots.nth(k, (trace + 1) << scale, bits)).bit_length() < bits:
                scale *= 2
                roots = Roots(own, scale)
            out.append(Decimal(root) / Decimal(1 << scale))
    return out


def solved(a: list[list[Decimal]], tiny: Decimal):
    """A function that solves a x = b, by elimination with row pivots; a pivot of 0 becomes `tiny`."""
    a, d = [list(row) for row in a], len(a)
    order = list(range(d))
    for k in range(d):
        i = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[i], order[k], order[i] = a[i], a[k], order[i], order[k]
        if not a[k][k]:
            a[k][k] = tiny
        top = a[k]
        for row in a[k + 1 :]:
            if row[k]:
                row[k] = f = row[k] / top[k]
                for j in range(k + 1, d):
                    row[j] -= f * top[j]

    def solve(b: list[Decimal]) -> list[Decimal]:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
        return x

    return solve


def orthonormal(vector: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    for _ in range(2):
        for o in others:
            dot = sum(x * y for x, y in zip(vector, o, strict=True))
            vector = [x - dot * y for x, y in zip(vector, o, strict=True)]
    length = sum(x * x for x in vector).sqrt()
    return [x / length for x in vector]


def components(matrix: list[list[int]], values: list[Decimal]) -> list[list[float]]:
    """Unit eigenvectors of the eigenvalues, orthogonal to each other; the entry of greatest size is positive."""
    out: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = DIGITS
        for k, value in enumerate(values):
            shifted = [[Decimal(x) - (value if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
            solve = solved(shifted, value.scaleb(10 - DIGITS))
            # Start values that are the same in every run and in no special direction.
            vector = [Decimal((7919 * (i + 1) * (k + 3) + 104_729 * i * i) % 1009 + 1) for i in range(len(matrix))]
            for _ in range(ROUNDS):
                vector = orthonormal(solve(orthonormal(vector, out)), out)
            sign = 1 if max(vector, key=abs) > 0 else -1
            out.append([sign * x for x in vector])
    return [[float(x) for x in v] for v in out]


@dataclass
class Whitening:
    """The fitted components: whitened = ((n x - S) / n) . component / sqrt(eigenvalue)."""

    scatter: Scatter
    vectors: np.ndarray  # (components, dimensions)
    values: list[float]  # eigenvalues of the covariance
    explained: list[float]

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        """n x - S, exactly."""
        x = whole_vectors(batch, len(self.scatter.sums))
        sums = np.array([s - self.scatter.n * SHIFT for s in self.scatter.sums], object)
        most = int(np.abs(x).max(initial=0)) * self.scatter.n + max(map(abs, sums.tolist()), default=0)
        return x * self.scatter.n - sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * self.scatter.n - sums

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.scatter.n) @ (self.vectors.T / np.sqrt(self.values))

    def transform(self, rows: DataFrame) -> DataFrame:
        """A row per vector and component, from `usable` ones."""
        model = rows.sparkSession.sparkContext.broadcast(self)  # of the length of a few vectors

        def run(batches: Iterator[pa.RecordBatch]):
            own = model.value
            k, dims = own.vectors.shape
            for batch in common.sliced(batches):
                centred = own.centred(batch)
                deviation = (exact(centred, dims) ** 2).sum(axis=1)
                size = pa.array(deviation.tolist(), pa.decimal128(38, 0))
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, own.scatter.n), pa.int64()), size.take(pa.array(np.repeat(np.arange(m), k))), pa.array(own.project(centred).ravel()), pa.array(np.tile(own.explained, m))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

        return rows.select("vec_id", "v").mapInArrow(run, WHITE)

    def identity_error(self, rows: DataFrame) -> float:
        """The largest absolute entry of the whitened vectors' covariance, divisor n, less the identity."""
        model, k = rows.sparkSession.sparkContext.broadcast(self), len(self.values)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in common.sliced(batches):
                w = model.value.project(model.value.centred(batch))
                yield pa.RecordBatch.from_arrays([pa.array([[*w.sum(axis=0).tolist(), *(w.T @ w).ravel().tolist()]], pa.list_(pa.float64()))], names=["s"])

        parts = rows.select("vec_id", "v").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
        found = np.array([r["s"] for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]) / self.scatter.n
        mean, second = found[:k], found[k:].reshape(k, k)
        return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit(rows: DataFrame, count: int = COMPONENTS) -> Whitening:
    """Fit on all `usable` vectors. Components whose eigenvalue is 0 are left out: with no vectors, one vector or equal
    vectors there are none."""
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    total = scatter(rows, dims)
    trace = sum(total.matrix[i][i] for i in range(dims))
    if not trace:
        return Whitening(total, np.zeros((0, dims)), [], [])
    found = eigenvalues(characteristic_polynomial(rows.sparkSession, total.matrix), trace, count)
    vectors = components(total.matrix, found)
    with localcontext() as context:
        context.prec = DIGITS
        values, explained = [float(v / total.n / total.n) for v in found], [float(v / trace) for v in found]
    return Whitening(total, np.array(vectors), values, explained)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable vector and component.

    Vectors that are null or hold nulls, NaN or infinities take no part. Shorter vectors count as filled up with zeros.
    Components times 1024 are held to 2^40. Repeated rows and null ids are rows like others; further columns are not
    looked at. Where fewer components than asked for have an eigenvalue above 0 there are fewer rows: none for an empty
    table, one vector or equal ones."""
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows, count)
    if not model.values:
        return rows.sparkSession.createDataFrame([], f"{WHITE}, identity_error double")
    return model.transform(rows).withColumn("identity_error", F.lit(model.identity_error(rows)))
