"""Whitening of embeddings by exact cross-products.

Entries become long integers x = floor(scale * c).  Each distinct vector is in the fit list
once.  A task takes its distinct vectors in slabs; of a slab, every dimension is shifted by its
smallest value there, and its bit planes are packed across rows into 64-bit words.  The
cross-product of two dimensions is the sum over pairs of their planes of the population count
of the planes' AND, weighted by the planes' places, and the shifts are taken back in
integers: so sums and cross-products are exact, whatever the order in which tasks are added.
They are added by Spark per pair of dimensions; the driver gets one number per pair (at most
MAX_DIM dimensions), centres them as integers, n * cross - sum * sum, and only then divides and
asks for eigenvectors.

Defined results: a row whose vector is null, or holds a null or non-finite entry, takes no
part; a null id is kept; rows of equal vectors get equal results, and count once in the fit; vectors of
each length have a fit of their own, an empty vector gives no rows; of a fit whose vectors span
fewer dimensions than ``components`` asks for, components without variance are left out (a
single distinct vector has none); an empty table gives no rows; further columns are ignored,
whatever their names.  An entry that a long can't hold raises.  A ``deviation`` that a long
can't hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries of a slab; words of a plane that are counted at once; dimensions whose pairs the driver may hold.
SLAB_VALUES, WORDS, MAX_DIM = 1 << 21, 512, 1_024


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors, their exact sums, unit eigenvectors by falling eigenvalue, the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum) ** 2, exactly: n^2 x.x - 2 n x.S + S.S."""
        top = max(int(x.max()), -int(x.min()))
        wide = top * top * len(self.sums) >= 1 << 62 or top * sum(map(abs, self.sums)) >= 1 << 62
        x = x.astype(object) if wide else x
        squares = (x * x).sum(axis=1)
        with_sums = x @ np.array(self.sums, object if wide else "i8")
        s2 = sum(s * s for s in self.sums)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + s2 for a, b in zip(squares, with_sums, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): x less its mean, on each component, over the root of its eigenvalue."""
        centred = x.astype("f8") - np.array([s / self.n for s in self.sums])
        return centred @ (self.vectors / np.sqrt(self.values))


def quantized(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x) of the rows that take part, x as array of long."""
    c = F.col(vector)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))

    def entry(v):
        y = F.lit(float(scale)) * v.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("an entry is too large for a long")).cast("long"))

    x = F.transform(c, entry)
    return vectors.where(c.isNotNull() & fine & (F.size(c) > 0)).select(F.col(key).alias("key"), x.alias("x"))


def planes(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], list[int]]:
    """Words of all bit planes (planes, words) of x (rows, dims) less its smallest values; (dim, bit) of each plane; these values."""
    low = [int(v) for v in x.min(axis=0)]
    shifted = x.astype("u8") - np.array([v & (1 << 64) - 1 for v in low], "u8")  # modulo 2**64, so never wrong
    bits = [int(v).bit_length() for v in shifted.max(axis=0)]
    rows = -(-len(x) // 64) * 64
    names, words = [], []
    for d, b in enumerate(bits):
        column = np.zeros(rows, "u8")
        column[: len(x)] = shifted[:, d]
        for k in range(b):
            names.append((d, k))
            words.append(np.packbits((column >> np.uint64(k)).astype("u1") & 1).view("u8"))
    return np.array(words, "u8").reshape(len(names), rows // 64), names, low


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (dims) and cross-products (dims, dims; j >= i) of x (rows, dims), as Python integers."""
    n, dims = x.shape
    words, names, low = planes(x)
    dim_of, place = np.array([d for d, _ in names], "i8"), np.array([k for _, k in names], "i8")
    # 64 bits hold all sums of a slab, unless entries are far apart
    kind = "i8" if 2 * int(place.max(initial=0)) + 4 + (n * dims).bit_length() < 62 else object
    counts = np.bitwise_count(words).sum(axis=1, dtype="i8").astype(kind)
    sums, cross = np.zeros(dims, kind), np.zeros((dims, dims), kind)
    np.add.at(sums, dim_of, counts << place.astype(kind))
    for p, (i, k) in enumerate(names):
        first = np.searchsorted(dim_of, i)  # the planes of this and later dimensions
        met = np.zeros(len(names) - first, "i8")
        for w in range(0, words.shape[1], WORDS):
            met += np.bitwise_count(words[first:, w : w + WORDS] & words[p, w : w + WORDS]).sum(axis=1, dtype="i8")
        np.add.at(cross[i], dim_of[first:], met.astype(kind) << (place[first:] + k).astype(kind))
    sums, cross, low = sums.astype(object), cross.astype(object), np.array(low, object)
    shift = np.outer(low, sums)
    return sums + n * low, cross + shift + shift.T + n * np.outer(low, low)


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """(dims, x, keys of its rows) in slabs of one length and at least one row."""
    held: dict[int, list] = {}

    def slab(dims: int):
        parts = held.pop(dims)
        return dims, np.concatenate([x for x, _ in parts]), [keys for _, keys in parts]

    values = 0
    for batch in batches:
        lists = batch.column(column)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for dims in map(int, np.unique(lengths)):
            at, rows = np.flatnonzero(lengths == dims), max(64, SLAB_VALUES // dims)
            for s in range(0, len(at), rows):
                part = pa.array(at[s : s + rows])
                x = lists.take(part).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                held.setdefault(dims, []).append((x, batch.column(0).take(part) if column else None))
                values += x.size
                if sum(len(x) for x, _ in held[dims]) >= rows:
                    values -= sum(x.size for x, _ in held[dims])
                    yield slab(dims)
        if values > 4 * SLAB_VALUES:  # many lengths, few of each
            values = 0
            yield from map(slab, list(held))
    yield from map(slab, list(held))


_PAIRS = "dims int, i int, j int, total decimal(38,0)"


def _cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors: (i, j, cross-product), (i, null, sum) and (null, null, n) of a task's rows."""
    totals: dict[int, list] = {}
    for dims, x, _ in _matrices(batches, 0):
        t = totals.setdefault(dims, [0, 0, 0])
        t[:] = (a + b for a, b in zip(t, (len(x), *scatter(x)), strict=True))
    for dims, (n, sums, cross) in totals.items():
        rows = [(None, None, n), *((i, None, s) for i, s in enumerate(sums)), *((i, j, cross[i, j]) for i in range(dims) for j in range(i, dims))]
        i, j, total = zip(*rows, strict=True)
        exact = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([dims] * len(rows), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), exact], names=["dims", "i", "j", "total"])


def fit(distinct: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """The whitening of each length of vectors, from a table of distinct vectors (one column of arrays)."""
    if (widest := distinct.agg(F.max(F.size(distinct.columns[0]))).first()[0] or 0) > MAX_DIM:
        raise ValueError(f"vectors of {widest} entries have more pairs of dimensions than the driver may hold")
    totals = distinct.mapInArrow(_cross_products, _PAIRS).groupBy("dims", "i", "j").agg(F.sum("total").alias("total"))
    found: dict[int, dict] = {}
    for r in totals.collect():  # a row per pair of dimensions
        found.setdefault(r.dims, {})[r.i, r.j] = int(r.total)
    return {dims: whitening(dims, t[None, None], [t[i, None] for i in range(dims)], t, components) for dims, t in found.items()}


def whitening(dims: int, n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int) -> Whitening:
    """From exact sums and cross-products; a quotient of integers is rounded once."""
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * cross[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values > dims * np.finfo("f8").eps * max(values[0], 0.0)).sum())
    k = min(components, some)
    vectors = vectors[:, :k]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]  # a sign that doesn't depend on the library
    trace = sum(n * cross[i, i] - sums[i] ** 2 for i in range(dims)) / (n * n)
    return Whitening(n, sums, values[:k].copy(), vectors * np.where(largest < 0, -1.0, 1.0), trace)


def identity_errors(distinct: DataFrame, fits: dict[int, Whitening], components: int) -> dict[int, float]:
    """By length, the largest absolute entry of the whitened fit list's covariance less the identity."""
    names = [f"w{c}" for c in range(components)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, x, _ in _matrices(batches, 0):
            w = fits[dims].whitened(x)
            columns = [pa.array(w[:, c]) if c < w.shape[1] else pa.nulls(len(x), pa.float64()) for c in range(components)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dims, "i4")), *columns], names=["dims", *names])

    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    w = distinct.mapInArrow(run, ", ".join(["dims int", *(f"{x} double" for x in names)]))
    # Spark's own covariance is centred by running means before it multiplies
    table = w.groupBy("dims").agg(*(F.covar_pop(names[a], names[b]).alias(f"v{a}_{b}") for a, b in pairs))
    out = {}
    for r in table.collect():  # a row per length of vectors
        k = fits[r.dims].values.size
        out[r.dims] = max([0.0, *(abs(r[f"v{a}_{b}"] - (a == b)) for a, b in pairs if b < k)])
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error) for each row that takes part."""
    rows = quantized(vectors, key, vector, scale)
    distinct = written(rows.select("x").distinct())
    fits = fit(distinct, components)
    errors = identity_errors(distinct, fits, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, x, ids in _matrices(batches, 1):
            f, k = fits[dims], fits[dims].values.size
            deviation = pa.array([d if d < 1 << 63 else None for d in f.deviations(x)], pa.int64())
            w = f.whitened(x)
            keys = pa.concat_arrays(ids)
            for c in range(k):
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(np.full(len(x), v, t)) for v, t in ((c + 1, "i4"), (f.n, "i8"))), deviation, pa.array(np.ascontiguousarray(w[:, c])), *(pa.array(np.full(len(x), v)) for v in (f.values[c] / f.trace, errors[dims]))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
