"""Embedding whitening by bit-sliced scatter: exact integer cross-products from AND and popcount, centred as integers.

Each entry c becomes the integer x = floor(256 * c). The fit list is each distinct x-vector once. A block of its rows is
shifted by each dimension's least value, and each dimension's bit planes are packed across the rows into 64-bit words; the sum over rows
of a product of two dimensions is the sum over pairs of their planes of 2 ** (p + q) times the set bits of the planes' AND.
Blocks add up as exact integers, so any order of tasks gives the same result; n * C - S * S' is centred in integers, and only
its quotient by n * n meets floating point, before the eigendecomposition of the d by d covariance.

Defined results: rows with a null vector or a null or non-finite entry are dropped. Of vectors of several lengths only those of the most frequent
one (ties: the longest) remain, an empty one never does. An entry whose x exceeds a long is the nearest long, and a deviation that
does is null. Repeated rows and equal vectors count once in the fit but each gets its rows; a null vec_id is kept. Components
without variance (eigenvalue below d * 2 ** -50 of the largest) have null whitened values and are left out of
identity_error. Ties of eigenvalues leave the order to the decomposition, the same for all rows. Fewer dimensions than
components give fewer rows; columns beyond vec_id and embedding are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .hashing import release

SCALE = 256
COMPONENTS = 4
#: Rows whose planes are packed together.
BLOCK = 1 << 14
_HIGH = (1 << 63) - 1
#: Sums go through Spark as digits of this base, each well inside a decimal.
_DIGIT = 1 << 60


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the integer vectors of usable rows."""
    v = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # floor of a double saturates at the range of a long
    x = v.where(finite).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    found = sizes.first()
    return x.where(F.size("x") == (found.d if found else -1))


def planes(u: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative rows, packed across the rows: dimension x bit x words of 64 rows."""
    n, d = u.shape
    bits = int(u.max(initial=0)).bit_length()
    out = np.zeros((d, bits, -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        out[:, b, : -(-n // 8)] = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
    return out.view(np.uint64)


def weighted(counts: np.ndarray, most: int) -> list[int]:
    """The sum over bits p and q of 2 ** (p + q) * counts[p, j, q] for each j, exact; ``most`` bounds the counts."""
    bits = counts.shape[0]
    if 2 * bits + most.bit_length() < 63:
        powers = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        return np.einsum("p,pjq,q->j", powers, counts, powers).tolist()
    rows = counts.transpose(1, 0, 2).reshape(counts.shape[1], -1)
    shifts = np.add.outer(np.arange(bits), np.arange(bits)).reshape(-1)
    return [sum(c << s for c, s in zip(r, shifts.tolist(), strict=True) if c) for r in rows.tolist()]


def scatter(x: np.ndarray) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """n, sums and cross-products (i <= j) of the rows of ``x`` (long), exact."""
    n, d = x.shape
    low = x.min(axis=0)
    words = planes(x.astype(np.uint64) - low.astype(np.uint64))  # modulo 2 ** 64: the difference of two longs fits
    bits = words.shape[1]
    ones = np.bitwise_count(words).sum(axis=2, dtype=np.int64).tolist()
    over = [sum(c << b for b, c in enumerate(r)) for r in ones]
    lows = low.tolist()
    out = {}
    for i in range(d):
        counts = np.empty((bits, d - i, bits), np.int64)
        for p in range(bits):
            counts[p] = np.bitwise_count(words[i, p] & words[i:]).sum(axis=2, dtype=np.int64)
        for j, v in enumerate(weighted(counts, n), i):
            out[i, j] = v + lows[i] * over[j] + lows[j] * over[i] + n * lows[i] * lows[j]
    return n, [o + n * v for o, v in zip(over, lows, strict=True)], out


@dataclass(frozen=True)
class Fit:
    """n, per-dimension sums, unit eigenvectors (rows, by falling eigenvalue), their eigenvalues, the trace and the error of whitening."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def usable(self) -> np.ndarray:
        return self.values > max(float(self.values.max(initial=0.0)), 0.0) * len(self.sums) * 2.0**-50


def totals(x: DataFrame) -> tuple[int, list[int], dict[tuple[int, int], int]] | None:
    """n, sums and cross-products of the distinct vectors of ``x``: d * (d + 3) / 2 integers leave each task."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("digit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, None, {}
        for batch in _blocks(batches):
            block = scatter(batch)
            n += block[0]
            sums = block[1] if sums is None else [a + b for a, b in zip(sums, block[1], strict=True)]
            for at, v in block[2].items():
                cross[at] = cross.get(at, 0) + v
        found = [((-1, -1), n), *[((-1, i), v) for i, v in enumerate(sums or [])], *cross.items()]
        rows = [(i, j, k, digit) for (i, j), v in found for k, digit in enumerate(_digits(v))]
        release()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = x.select("x").distinct().mapInArrow(run, "i int, j int, k int, digit bigint")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "k").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("v")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + int(r.v) * _DIGIT**r.k
    n = out.pop((-1, -1), 0)
    if not n:
        return None
    sums = [out.pop((-1, i)) for i in range(sum(1 for i, _ in out if i == -1))]
    return n, sums, out


def _digits(v: int) -> list[int]:
    """v in digits of base 2 ** 60 with the sign of v."""
    sign, rest, out = (-1 if v < 0 else 1), abs(v), []
    while rest or not out:
        rest, digit = divmod(rest, _DIGIT)
        out.append(sign * digit)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = _matrix(batch.column(0).slice(at, BLOCK))
            held.append(part)
            rows += len(part)
            if rows >= BLOCK:
                yield np.concatenate(held)
                held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def fitted(n: int, sums: list[int], cross: dict[tuple[int, int], int]) -> Fit:
    """The eigendecomposition of the covariance; every entry of it is an integer over n * n, rounded once."""
    d = len(sums)
    v = np.empty((d, d))
    trace = 0
    for (i, j), c in cross.items():
        centred = n * c - sums[i] * sums[j]
        v[i, j] = v[j, i] = centred / (n * n)
        trace += centred if i == j else 0
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].T.copy()
    fit = Fit(n, tuple(sums), vectors, values, trace / (n * n), None)
    use = fit.usable
    use[COMPONENTS:] = False
    if not use.any():
        return fit
    w = (vectors[use] / np.sqrt(values[use])[:, None]).astype(np.longdouble)
    error = np.abs(w @ v.astype(np.longdouble) @ w.T - np.eye(int(use.sum())))
    return Fit(n, tuple(sums), vectors, values, trace / (n * n), float(error.max()))


def _centred(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S as doubles (rounded once) and the rows' sums of its squares, null where a long can't hold them."""
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    reach = fit.n * top + max(map(abs, fit.sums))
    if reach * reach * len(fit.sums) < _HIGH:
        c = fit.n * x - np.array(fit.sums, np.int64)
        return c.astype(float), (c * c).sum(axis=1).tolist()
    rows = [[fit.n * a - s for a, s in zip(r, fit.sums, strict=True)] for r in x.tolist()]
    squares = [sum(a * a for a in r) for r in rows]
    return np.array(rows, float).reshape(len(rows), len(fit.sums)), [s if s <= _HIGH else None for s in squares]


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component up to ``components``."""
    scratch = Scratch(rows.sparkSession)
    x = scratch.keep(integers(rows), "integers")
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = totals(x)
    if found is None:
        return rows.sparkSession.createDataFrame([], out)
    fit = fitted(*found)
    count = min(components, len(fit.sums))
    use = fit.usable[:count]
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(use[:, None], fit.vectors[:count] / np.sqrt(np.where(use, fit.values[:count], 1.0))[:, None], 0.0)
    explained = (fit.values[:count] / fit.trace).tolist() if fit.trace > 0 else [None] * count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, deviation = _centred(_matrix(batch.column(1)), fit)
            size = len(c)
            value = (c / fit.n) @ axes.T
            at = np.repeat(np.arange(size), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()),
                    pa.array(np.full(size * count, fit.n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(at)),
                    pa.array(value.reshape(-1), pa.float64(), mask=~np.tile(use, size)),
                    pa.array(explained * size, pa.float64()),
                    pa.array([fit.identity_error] * (size * count), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select("vec_id", "x").mapInArrow(run, out)


def op12_whitening(spark, sf_dir) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
