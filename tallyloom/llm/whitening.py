"""Whitening of embeddings by a compensated covariance.

Entries become integers, so counts and sums are exact.  Then every task centres its vectors in double-double and
multiplies them by error-free transformations: columns are cut into slices of so few bits that the products of
two slices over a block of rows are exact in a double whatever their order, and these exact blocks are added in
double-double by two-sums.  Tasks hand on the high and the low parts of each row of the matrix, which are merged the
same way.  The eigenvectors come from the tridiagonal divide-and-conquer solver of LAPACK (``eigh`` is ``syevd``),
corrected once by what the double-double matrix says of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bits of one slice, slices of a double-double, and rows of a block: 2 * 20 bits and 10 for 1,024 rows are below 53.
BITS, SLICES, BLOCK = 20, 4, 1024
#: Entries beyond this saturate, so that the offset fits.
LARGEST = float(2**63 - 2**22)
#: Eigenvalues of less than this share of the largest are none: beyond it only rounding is left.
SMALLEST = 1e-18
#: Partial matrices that one task merges at first.
SALTS = 64
#: Bytes of all models that tasks are given; beyond it the vectors are of too many lengths.
MODEL_BYTES = 256 << 20

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """``a + b`` as a rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    return two_sum(s, e + (x[1] + y[1]))


def _slices(x: Pair) -> list[np.ndarray]:
    """Parts of a double-double matrix, of at most ``BITS`` bits below the largest entry of their column."""
    high, low = x
    unit = np.ldexp(1.0, np.frexp(np.abs(high).max(0, initial=0.0))[1] - BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        high, low = two_sum(high - part, low)
        out.append(part)
        unit = unit * 2.0 ** -(BITS + 1)
    return out


def product(a: Pair, b: Pair) -> Pair:
    """``a.T @ b`` of double-double matrices, as a double-double."""
    total = np.zeros((2, a[0].shape[1], b[0].shape[1]))
    for k in range(0, len(a[0]), BLOCK):
        left, right = (_slices((m[0][k : k + BLOCK], m[1][k : k + BLOCK])) for m in (a, b))
        for i, own in enumerate(left):
            for other in right[: SLICES - i]:
                total = add(total, (own.T @ other, np.zeros_like(total[0])))
    return total[0], total[1]


def integers(x: np.ndarray) -> np.ndarray:
    """Entries as the integers that are whitened."""
    return np.clip(np.floor(np.clip(x, -LARGEST / SCALE, LARGEST / SCALE) * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


@dataclass
class Centre:
    """Count and exact sums of the integer vectors of one length."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.n for s in self.sums])
        self.rest = np.array([float(Fraction(s, self.n) - Fraction(m)) for s, m in zip(self.sums, self.mean, strict=True)])

    def centred(self, x: np.ndarray) -> Pair:
        """``x - sums / n`` in double-double."""
        high = x >> 32 << 32
        s, e = two_sum(high.astype(float), -self.mean)
        t, f = two_sum((x - high).astype(float), -self.rest)
        return add((s, e), (t, f))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over ``(n * x - sums) ** 2``, exact; None where one does not fit 64 bits."""
        about = ((self.centred(x)[0] * self.n) ** 2).sum(1)
        wrapped = x.view(np.uint64) * np.uint64(self.n) - np.array([s % 2**64 for s in self.sums], np.uint64)  # modulo 2 ** 64
        exact: list[int | None] = (wrapped * wrapped).sum(1, dtype=np.uint64).tolist()
        for k in np.flatnonzero(about > 2.0**62).tolist():
            whole = sum((self.n * v - s) ** 2 for v, s in zip(x[k].tolist(), self.sums, strict=True)) if about[k] < 2.0**64 else 2**63
            exact[k] = whole if whole < 2**63 else None
        return exact


@dataclass
class Model:
    """Components of the vectors of one length, by falling eigenvalue; a scale is 0 where an eigenvalue is none."""

    centre: Centre
    vectors: np.ndarray
    scales: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.centred(x)
        return (high @ self.vectors + low @ self.vectors) * self.scales


def eigen(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors, by falling eigenvalue, of a symmetric double-double matrix.

    LAPACK's vectors are off by what rounding the matrix cost.  Their products over the double-double matrix tell
    how far each pair is from orthogonal and from diagonal, which first-order terms mend, except between values too
    close to be told apart.
    """
    values, q = np.linalg.eigh(v[0])
    q = q[:, ::-1].copy()
    none = np.zeros_like(q)
    for _ in range(2):
        s = product((q, none), product(v, (q, none)))
        excess = np.eye(len(q)) - np.add(*product((q, none), (q, none)))
        matrix = np.add(*s)
        values = np.diag(matrix) / (1 - np.diag(excess))
        apart = values[None, :] - values[:, None]
        norm = np.abs(values).max(initial=0.0)
        close = np.abs(apart) <= 2 * (np.linalg.norm(matrix - np.diag(values), 2) + norm * np.linalg.norm(excess, 2))
        fix = np.where(close, excess / 2, (matrix + values[None, :] * excess) / np.where(close, 1.0, apart))
        q = q + q @ fix
    q /= np.sqrt((q * q).sum(0))
    s = product((q, none), product(v, (q, none)))
    values = np.diag(np.add(*s))
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


def _matrices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and entries of the vectors of each length in an Arrow batch."""
    column = batch.column(name)
    ends = column.offsets.to_numpy().astype(np.int64)
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[ends[at][:, None] + np.arange(d)].reshape(len(at), d)


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, x`` of the rows that are whitened."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return rows.where(F.coalesce(finite, F.lit(False)) & (F.size("x") > 0))


def centres(rows: DataFrame) -> dict[int, Centre]:
    """Counts and exact sums by length of the vectors: a number for each of their dimensions comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                x = integers(x)
                high, low = (x >> 32).sum(0).astype(object), (x & 0xFFFFFFFF).sum(0).astype(object)
                own = found.setdefault(x.shape[1], [0, 0])
                own[0], own[1] = own[0] + len(at), own[1] + high * 2**32 + low
        for d, (n, sums) in found.items():
            yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([str(s) for s in sums]), pa.array([n] * d, pa.int64())], names=["dim", "at", "sum", "n"])

    sums = rows.select("x").mapInArrow(run, "dim int, at int, sum string, n long")
    sums = sums.groupBy("dim", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).cast("string").alias("sum"), F.sum("n").alias("n"))
    sizes = stored(sums, "vector-sums")
    dims = [r["dim"] for r in sizes.select("dim").distinct().limit(MODEL_BYTES // 64 + 1).collect()]
    if sum(8 * d * (min(d, COMPONENTS) + 4) for d in dims) > MODEL_BYTES:
        raise ValueError("the vectors are of too many lengths to whiten each by itself")
    found: dict[int, Centre] = {}
    for r in sizes.orderBy("dim", "at").collect():
        found.setdefault(r["dim"], Centre(r["n"], [])).sums.append(int(r["sum"]))
    discard(sizes)
    return {d: Centre(c.n, c.sums) for d, c in found.items()}


def summed_products(rows: DataFrame, terms: Callable[[np.ndarray], tuple[Pair, Pair]]) -> DataFrame:
    """``dim, i, high, low``: rows of the sum over all vectors of the products of two matrices made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Pair] = {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                own = product(*terms(integers(x)))
                found[x.shape[1]] = add(found[x.shape[1]], own) if x.shape[1] in found else own
        salt = TaskContext.get().partitionId() % SALTS
        for d, (high, low) in found.items():
            m = len(high)
            yield pa.record_batch([pa.array([d] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([salt] * m, pa.int32()), pa.array(high.tolist()), pa.array(low.tolist())], names=["dim", "i", "salt", "high", "low"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for high, low in zip(pdf["high"], pdf["low"], strict=True):
            total = (high, low) if total is None else add(total, (high, low))
        return pdf.iloc[:1].assign(high=[total[0]], low=[total[1]])

    schema = "dim int, i int, salt int, high array<double>, low array<double>"
    partial = rows.select("x").mapInArrow(run, schema)
    partial = partial.groupBy("dim", "i", "salt").applyInPandas(merge, schema)
    return partial.groupBy("dim", "i").applyInPandas(merge, schema).drop("salt")


def _square(pdf: pd.DataFrame) -> Pair:
    pdf = pdf.sort_values("i")
    return np.stack(list(pdf["high"])), np.stack(list(pdf["low"]))


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors in ``x``."""
    found = centres(rows)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _square(pdf)
        values, vectors = eigen(total)
        k = min(components, len(values))
        trace = float(np.diag(total[0]).sum())
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "vals": [values[:k]], "vectors": [vectors[:, :k].ravel()], "trace": [trace]})

    def centred(x: np.ndarray) -> tuple[Pair, Pair]:
        own = found[x.shape[1]].centred(x)
        return own, own

    solved = summed_products(rows, centred).groupBy("dim").applyInPandas(solve, "dim int, vals array<double>, vectors array<double>, trace double")
    models = {}
    for r in solved.collect():  # their size was checked with the sums
        values, d, n = np.array(r["vals"]), r["dim"], found[r["dim"]].n
        live = values > SMALLEST * values.max(initial=0.0)
        scales = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0) / n), 0.0)
        explained = np.where(live, values, 0.0) / (r["trace"] or 1.0)
        models[d] = Model(found[d], np.array(r["vectors"]).reshape(d, len(values)), scales, explained)
    return models


def identity_errors(rows: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """How far the covariance of the whitened vectors is from the identity, as its largest entry, by length.

    Components without an eigenvalue have no part in it.
    """

    def plain(x: np.ndarray) -> tuple[Pair, Pair]:
        w = models[x.shape[1]].whitened(x)
        ones = np.ones((len(w), 1))
        return (ones, np.zeros_like(ones)), (w, np.zeros_like(w))

    means = {r["dim"]: (np.array(r["high"]) / models[r["dim"]].centre.n) for r in summed_products(rows, plain).collect()}

    def centred(x: np.ndarray) -> tuple[Pair, Pair]:
        w = models[x.shape[1]].whitened(x)
        own = two_sum(w, -means[x.shape[1]][None, :])
        return own, own

    def largest(pdf: pd.DataFrame) -> pd.DataFrame:
        model = models[int(pdf["dim"].iloc[0])]
        off = np.abs(_square(pdf)[0] / model.centre.n - np.diag((model.scales > 0).astype(float)))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "error": [off.max(initial=0.0)]})

    found = summed_products(rows, centred).groupBy("dim").applyInPandas(largest, "dim int, error double")
    return {r["dim"]: r["error"] for r in found.collect()}


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``: the vectors on their principal components.

    Entries are taken as ``floor(64 * c) + 1000000``; ``whitened`` has for each component, by falling eigenvalue,
    the centred vector's projection over the square root of the eigenvalue, ``explained`` the eigenvalues over
    the trace.  ``deviation`` is the exact sum of ``(n * x - sum) ** 2``, null where it doesn't fit 64 bits.

    Rows whose vector is null or empty or holds null or non-finite entries are dropped.  Vectors of different lengths
    are whitened by themselves, each with a model of their own.  Where fewer directions vary than there are
    components, as for constant dimensions or few rows, the others are null and explain 0.  Rows with null or equal
    ids are rows of their own, an empty table gives an empty result, further columns are ignored whatever their names.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = _valid(vectors, vec_id, embedding)
    models = fit(rows, components)
    errors = identity_errors(rows, models)
    told = [(d, m.centre.n, m.explained.tolist(), float(errors[d])) for d, m in models.items()]
    told = spark.createDataFrame(told, "dim int, n long, explained array<double>, identity_error double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                model, x = models[x.shape[1]], integers(x)
                own = np.where(model.scales > 0, model.whitened(x), np.nan)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel(), from_pandas=True), own.shape[1]).cast(pa.list_(pa.float64()))
                ids, dims = batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32))
                yield pa.record_batch([ids, dims, pa.array(model.centre.deviations(x), pa.int64()), lists], names=["vec_id", "dim", "deviation", "whitened"])

    found = rows.mapInArrow(run, "vec_id long, dim int, deviation long, whitened array<double>")
    return found.join(F.broadcast(told), "dim").select("vec_id", "n", "deviation", "whitened", "explained", "identity_error")  # a row for each length
