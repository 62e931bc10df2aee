"""Embedding whitening by spectrum slicing.

Two passes make the covariance: sums per dimension, then products of the entries less an integer near their mean. Both
are integers and added up exactly, per task and then by matrix place, so the covariance does not depend on order or
partitioning. What meets the driver is one number per place of the matrix, whatever the rows.

On the driver the spectrum is cut by counts: by Sylvester's law the signs of D in P(V - s)Pᵀ = LDLᵀ (symmetric pivoting,
blocks of one or two) say how many eigenvalues lie above s. Bisection on s isolates the eigenvalues from the largest
down; inverse iteration from inside the interval and Rayleigh quotient iteration then converge cubically, and counts
just below and just above the result certify its number. Where rounding leaves several eigenvalues in one interval that
cannot be cut any more, the vectors are orthogonalised within it.

A third pass projects the rows; the covariance of what it wrote, by Spark's centred moments, gives the identity error.

Defined results: vectors that are null or hold null or non-finite entries are dropped. Vectors shorter than the longest
count as filled up with zero entries. Rows with equal or null ids are rows of their own. Components are numbered by
falling eigenvalue; those of eigenvalues that are zero up to rounding cannot be scaled and are left out, so equal
vectors, a single one, or an empty table give an empty result. A component's entry of largest size is positive.
``deviation`` is null where it exceeds 64 bits; entries that exceed 2 ** 52 after scaling raise OverflowError. Only the key
and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.session import written

COMPONENTS, SCALE, OFFSET = 8, 1024, 100_000
LARGEST = 1 << 52
ROWS = 4096
EPS = float(np.finfo(float).eps)
#: Of Bunch and Parlett: from this ratio of diagonal to other entries on, a single pivot is stable.
PIVOT = (1 + 17**0.5) / 8


def sound_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """_key, _vector (doubles) of the rows that are not dropped."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").alias("_key"), F.transform(v, lambda x: x.cast("double")).alias("_vector"))


def integers(column: pa.Array, size: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * x) + offset as rows of a matrix, short vectors filled up."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise OverflowError("an entry is too large")
    n = np.diff(column.offsets.to_numpy())
    out = np.full((len(n), size), offset, np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat.astype(np.int64) + offset
    return out


def parts(batches):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def exact_product(y: np.ndarray) -> np.ndarray:
    """yᵀy as unbounded integers, by floating point where that is exact."""
    top = int(np.abs(y).max()) if y.size else 0
    step = (1 << 53) // max(1, top * top)
    if step == 0:
        wide = y.astype(object)
        return wide.T @ wide
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(float)
        total += (part.T @ part).astype(np.int64)
    return total


def added_up(places: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of (i, j, value) by place."""
    return {(r["i"], r["j"]): int(r["s"]) for r in places.groupBy("i", "j").agg(F.sum("value").alias("s")).collect()}


PLACES = "i int, j int, value decimal(38,0)"


def place_rows(values: dict[tuple[int, int], int]) -> pa.RecordBatch:
    at = list(values)
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([Decimal(int(values[p])) for p in at], pa.decimal128(38, 0))],
        ["i", "j", "value"],
    )


@dataclass
class Moments:
    """Rows, sums per dimension, and the covariance (divisor n) of the integer vectors."""

    n: int
    sums: list[int]
    near: np.ndarray  # an integer next to the mean of each dimension
    rest: list[int]  # sums of what is left when it is taken off
    covariance: np.ndarray


def moments(vectors: DataFrame, scale: int, offset: int) -> Moments | None:
    """None without rows or dimensions."""
    size = vectors.agg(F.max(F.size("_vector")).alias("m")).first()["m"]
    if not size:
        return None

    def sum_up(batches):
        n, sums = 0, np.zeros(size, object)
        for part in parts(batches):
            x = integers(part.column(0), size, scale, offset)
            n += len(x)
            sums += x.astype(object).sum(axis=0) if np.abs(x).max() > (1 << 50) else x.sum(axis=0)
        yield place_rows({(-1, 0): n, **{(0, j): s for j, s in enumerate(sums)}})

    found = added_up(vectors.select("_vector").mapInArrow(sum_up, PLACES))
    n, sums = found[-1, 0], [found[0, j] for j in range(size)]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, near)]

    def products(batches):
        total = np.zeros((size, size), object)
        for part in parts(batches):
            total += exact_product(integers(part.column(0), size, scale, offset) - near)
        yield place_rows({(i, j): total[i, j] for i in range(size) for j in range(i, size)})

    gram = added_up(vectors.select("_vector").mapInArrow(products, PLACES))
    covariance = np.zeros((size, size))
    for (i, j), g in gram.items():
        covariance[i, j] = covariance[j, i] = (n * g - rest[i] * rest[j]) / (n * n)
    return Moments(n, sums, near, rest, covariance)


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the positive part of D in LDLᵀ."""
    n, count = len(matrix), 0
    m = matrix - shift * np.eye(n)
    while n:
        a = m[:n, :n]
        size = np.abs(a)
        single = np.diagonal(size)
        i = int(single.argmax())
        top = single[i]
        np.fill_diagonal(size, 0.0)
        p, q = divmod(int(size.argmax()), n)
        if top == 0 and size[p, q] == 0:
            return count  # what is left is zero
        if top >= PIVOT * size[p, q]:
            swap(a, i, n - 1)
            pivot, column = a[n - 1, n - 1], a[: n - 1, n - 1].copy()
            count += bool(pivot > 0)
            a[: n - 1, : n - 1] -= np.outer(column, column / pivot)
            n -= 1
        else:  # a block of one positive and one negative eigenvalue
            p, q = min(p, q), max(p, q)
            swap(a, q, n - 1)
            swap(a, p, n - 2)
            block, columns = a[n - 2 : n, n - 2 : n].copy(), a[: n - 2, n - 2 : n].copy()
            count += 1
            a[: n - 2, : n - 2] -= columns @ np.linalg.solve(block, columns.T)
            n -= 2
    return count


def swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class Slicer:
    """Counts at shifts seen so far; cuts out one eigenvalue after the other, the largest first."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = (matrix + matrix.T) / 2
        self.reach = float(np.abs(self.matrix).sum(axis=1).max())  # no eigenvalue is larger
        self.round = 4 * len(matrix) * EPS * self.reach
        self.seen = {2 * self.reach: 0, -2 * self.reach: len(matrix)}
        self.found: list[np.ndarray] = []

    def count(self, shift: float) -> int:
        if shift not in self.seen:
            self.seen[shift] = above(self.matrix, shift)
        return self.seen[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest known shifts with eigenvalue ``number`` between them."""
        return max(s for s, n in self.seen.items() if n >= number), min(s for s, n in self.seen.items() if n < number)

    def cut(self, number: int) -> tuple[float, float, bool]:
        """An interval that holds this eigenvalue alone, or one too narrow to cut."""
        while True:
            a, b = self.interval(number)
            if b - a <= self.round:
                return a, b, False
            if self.seen[a] == number and self.seen[b] == number - 1:
                return a, b, True
            self.count((a + b) / 2)

    def clear(self, x: np.ndarray) -> np.ndarray:
        """A unit vector without the components already found."""
        for _ in range(2):
            for u in self.found:
                x = x - (u @ x) * u
        return x / np.linalg.norm(x)

    def step(self, shift: float, x: np.ndarray) -> np.ndarray:
        eye = np.eye(len(x))
        try:
            y = np.linalg.solve(self.matrix - shift * eye, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(self.matrix - (shift + EPS * self.reach) * eye, x)
        return self.clear(y / np.abs(y).max())

    def residual(self, x: np.ndarray) -> tuple[float, float]:
        y = self.matrix @ x
        value = float(x @ y)
        return value, float(np.linalg.norm(y - value * x))

    def next(self) -> tuple[float, np.ndarray]:
        """The next eigenvalue and its unit vector."""
        number = len(self.found) + 1
        start = np.random.default_rng(number).normal(size=len(self.matrix))
        while True:
            a, b, alone = self.cut(number)
            x = self.step((a + b) / 2, self.clear(start))
            x = self.step((a + b) / 2, x)
            value, error = self.residual(x)
            if alone and a < value < b:
                best = (error, value, x)
                for _ in range(12):  # Rayleigh quotient iteration
                    x = self.step(value, x)
                    value, error = self.residual(x)
                    if error >= best[0]:
                        break
                    best = (error, value, x)
                error, value, x = best
            slack = error + self.round
            if not alone or (error <= self.round and self.count(value - slack) >= number and self.count(value + slack) < number):
                x = x if x[np.abs(x).argmax()] > 0 else -x
                self.found.append(x)
                return value, x
            self.count((a + b) / 2)  # led to a neighbour: a narrower interval


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues that are not zero, falling, and their unit vectors as columns."""
    if not matrix.any():
        return np.zeros(0), np.zeros((len(matrix), 0))
    slicer, values = Slicer(matrix), []
    floor = max(slicer.round, EPS * len(matrix) * float(np.trace(slicer.matrix)))
    while len(values) < min(most, len(matrix)) and slicer.count(floor) > len(values):
        values.append(slicer.next()[0])
    vectors = np.array(slicer.found).T if values else np.zeros((len(matrix), 0))
    return np.array(values), vectors


def exact_deviation(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n y - rest)² per row; None beyond 64 bits."""
    top = n * (int(np.abs(y).max()) if y.size else 0) + max(map(abs, rest))
    if top * top * len(rest) < 1 << 63:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    wide = ((y.astype(object) * n - np.array(rest, object)) ** 2).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in wide]


@dataclass
class Whitening:
    """The fitted map: whitened = (x - mean) · components / sqrt(values)."""

    moments: Moments
    values: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.moments.covariance)


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    found = moments(sound_vectors(rows, key, vector), scale, offset)
    return None if found is None else Whitening(found, *leading(found.covariance, components))


def whitened(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, deviation, whitened (array) of every row that is not dropped."""
    size, n, rest, near = len(model.moments.near), model.moments.n, model.moments.rest, model.moments.near
    mean = np.array([r / n for r in rest])
    onto = model.components / np.sqrt(model.values)

    def run(batches):
        for part in parts(batches):
            y = integers(part.column(1), size, scale, offset) - near
            z = (y - mean) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(exact_deviation(y, n, rest), pa.int64()), lists], ["id", "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return sound_vectors(rows, key, vector).mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    at = lambda i: F.get("whitened", F.lit(i))
    entries = [F.abs(F.covar_pop(at(i), at(j)) - (1.0 if i == j else 0.0)) for i in range(k) for j in range(i, k)]
    return rows.agg(F.array_max(F.array(*entries)).alias("e")).first()["e"]


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = written(whitened(rows, model), "whitened")
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    return done.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(model.moments.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(identity_error(done, len(model.values))).alias("identity_error"),
    )
