"""Whitening of embeddings from an exact scatter matrix in residue arithmetic.

Vectors are quantised to integers x. With n vectors and sums S, the centred
integer n*x - S is exact, and so is the scatter of these, if its products are
added up modulo several primes:

1. One pass adds up, for every dimension, the number, sum, least and largest x.
   From these come S and a proven bound of every entry of the scatter, and from
   the bound the number of primes.
2. Every partition reduces its centred vectors modulo each prime and multiplies
   blocks of them as doubles: residues lie within half a prime, a block is so
   short that no sum passes 2**53, and the block's product is reduced again. A
   row for every cell of the upper triangle goes out, however many vectors a
   partition holds, and the residues are added up as integers.
3. The driver puts the sums together by the Chinese remainder theorem (cells by
   width, not by rows), divides them by n**3 with one rounding each, and takes
   the eigenvectors of the covariance in double precision.
4. A pass over the whitened rows measures their covariance, and the last one
   returns them.

Every pass reads the input again, so nothing is stored; a lost executor costs
the passes over its partitions.

Given cases: vectors that are null, hold null, NaN or infinite components, or
components of 2**62 / scale and beyond (no long holds them) take no part; a
shorter vector counts as padded with components of 0; repeated rows count each;
a null vec_id is carried along; an empty table gives an empty result. A
component whose eigenvalue is zero but for rounding can't be divided by its
root: its `whitened` is null, and it has no part in the identity error.
Eigenvectors have their largest entry positive; of equal eigenvalues any basis
may come. A deviation beyond 64 bits is null as long, and exact in
deviation_exact up to 38 digits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.batches import sliced, small_batches

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
BLOCK = 2048  # vectors whose products of residues are added up before they are reduced
TOP = 1 << 22  # primes lie below: BLOCK * (TOP / 2)**2 = 2**53
WIDEST = 2048  # dimensions; the driver holds the triangle of cells


def primes(bound: int, top: int = TOP) -> list[int]:
    """The largest primes below top whose product exceeds bound."""
    sieve = np.ones(top, bool)
    sieve[:2] = False
    for i in range(2, int(top**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        out.append(p)
        product *= p
        if product > bound:
            return out
    raise ValueError("no so many primes")


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The integers nearest to zero that have these residues: residues[k][i] modulo moduli[k]."""
    whole = 1
    for p in moduli:
        whole *= p
    share = [whole // p * pow(whole // p, -1, p) for p in moduli]
    out = [sum(r * s for r, s in zip(row, share, strict=True)) % whole for row in zip(*residues, strict=True)]
    return [x - whole if x > whole // 2 else x for x in out]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows; what is missing is the OFFSET, a component of 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), OFFSET, np.int64)
    for i, (k, end) in enumerate(zip(sizes, np.cumsum(sizes), strict=True)):
        out[i, :k] = flat[end - k : end]
    return out


@dataclass
class Centre:
    """n vectors with sums n * mid + rest, 0 <= rest < n; far: the largest |x - mid|."""

    n: int
    mid: np.ndarray
    rest: np.ndarray
    far: int

    @property
    def width(self) -> int:
        return len(self.mid)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < float(1 << 62)))
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(OFFSET).cast("long"))
    return vectors.where(whole).select("vec_id", x.alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, hi, lo, least, most) of a partition, sums as hi * 2**32 + lo; at dim -1 the number of vectors."""
    rows, held = 0, {}
    for b in sliced(batches, rows=4096):
        sizes = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
        rows += len(b)
        for width in np.unique(sizes).tolist():
            x = _matrix(b.column(0).filter(pa.array(sizes == width)), width)
            facts = (len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0))
            if width not in held:
                held[width] = facts
            else:
                old = held[width]
                held[width] = (old[0] + facts[0], old[1] + facts[1], old[2] + facts[2], np.minimum(old[3], facts[3]), np.maximum(old[4], facts[4]))
    out = [(-1, rows, 0, 0, 0, 0)]
    for width, (k, hi, lo, least, most) in held.items():
        out += zip(range(width), [k] * width, hi.tolist(), lo.tolist(), least.tolist(), most.tolist(), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["dim", "n", "hi", "lo", "least", "most"])


def centre(rows: DataFrame) -> Centre:
    """Number and sums of the rows(vec_id, x): one row for each dimension is collected."""
    found = rows.select("x").mapInArrow(_sums, "dim long, n long, hi long, lo long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    facts = {r["dim"]: r for r in found.groupBy("dim").agg(F.sum("n").alias("n"), wide("hi"), wide("lo"), F.min("least").alias("least"), F.max("most").alias("most")).collect()}
    n = facts.pop(-1)["n"] if -1 in facts else 0
    if len(facts) > WIDEST:
        raise ValueError(f"vectors of {len(facts)} dimensions; at most {WIDEST} are supported")
    mid, rest, far = [], [], 0
    for k in range(len(facts)):
        r = facts[k]
        short = n - r["n"]  # vectors that end before
        s = (int(r["hi"]) << 32) + int(r["lo"]) + short * OFFSET
        m, left = divmod(s, n)
        mid.append(m)
        rest.append(left)
        far = max(far, r["most"] - m, m - r["least"], abs(OFFSET - m) if short else 0)
    return Centre(n, np.array(mid, np.int64), np.array(rest, np.int64), far)


def _products(c: Centre, moduli: list[int]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((c.width, c.width), np.int64) for _ in moduli]
        for b in sliced(batches, rows=BLOCK):
            d = _matrix(b.column(0), c.width) - c.mid
            for t, p in zip(total, moduli, strict=True):
                y = ((c.n % p) * (d % p) - c.rest % p) % p
                y = np.where(y > p // 2, y - p, y).astype(np.float64)
                t += (y.T @ y).astype(np.int64) % p
                t %= p
        i, j = np.triu_indices(c.width)
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(j[at]), *[pa.array(t[i[at], j[at]]) for t in total]], names=["i", "j", *[f"r{k}" for k in range(len(moduli))]])

    return run


def scatter(rows: DataFrame, c: Centre) -> list[list[int]]:
    """The exact sums of (n*x - S)_i * (n*x - S)_j over all rows."""
    moduli = primes(2 * c.n * (c.n * (c.far + 1)) ** 2)
    names = [f"r{k}" for k in range(len(moduli))]
    made = rows.select("x").mapInArrow(_products(c, moduli), "i long, j long, " + ", ".join(f"{k} long" for k in names))
    cells = made.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names]).collect()
    out = [[0] * c.width for _ in range(c.width)]
    values = remaindered([[r[k] % p for r in cells] for k, p in zip(names, moduli, strict=True)], moduli)
    for r, v in zip(cells, values, strict=True):
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = v
    return out


@dataclass
class Whitener:
    """axes: (width, k) unit eigenvectors by falling eigenvalue; roots: square roots of the eigenvalues, NaN where one is zero but for rounding."""

    centre: Centre
    axes: np.ndarray
    roots: np.ndarray
    explained: list[float | None]

    def project(self, x: np.ndarray) -> np.ndarray:
        c = self.centre
        return ((x - c.mid) - c.rest / c.n) @ self.axes / self.roots


def whitener(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    c = centre(rows)
    if not c.n or not c.width:
        return None
    exact = scatter(rows, c)
    cube = c.n**3
    v = np.array([[x / cube for x in row] for row in exact])
    values, axes = np.linalg.eigh(v)
    k = min(components, c.width)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    lead = np.abs(axes).argmax(axis=0)
    axes = axes * np.where(axes[lead, np.arange(k)] < 0, -1.0, 1.0)
    trace = sum(exact[i][i] for i in range(c.width)) / cube
    real = values > c.width * np.finfo(float).eps * max(values[0], 0.0)
    return Whitener(c, axes, np.where(real, np.sqrt(np.where(real, values, 1.0)), np.nan), [max(0.0, float(e)) / trace if trace > 0 else None for e in values])


def identity_error(rows: DataFrame, w: Whitener) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    real = np.flatnonzero(~np.isnan(w.roots))
    if not len(real):
        return None
    i, j = np.triu_indices(len(real))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(len(real)), np.zeros((len(real), len(real)))
        for b in sliced(batches, rows=BLOCK):
            z = w.project(_matrix(b.column(0), w.centre.width))[:, real]
            one += z.sum(axis=0)
            two += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([*[-1] * len(real), *i.tolist()]), pa.array([*range(len(real)), *j.tolist()]), pa.array(np.concatenate([one, two[i, j]]))], names=["i", "j", "s"])

    sums = {(r["i"], r["j"]): r["s"] / w.centre.n for r in rows.select("x").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(sums[a, b] - sums[-1, a] * sums[-1, b] - (a == b)) for a, b in zip(i.tolist(), j.tolist(), strict=True))


def _deviations(d: np.ndarray, c: Centre) -> list[int]:
    """Sums over the dimensions of (n*x - S)**2, as n**2 * A - 2n * B + C with A, B from the small x - mid."""
    if c.width * (c.n * (c.far + 1)) ** 2 < 1 << 63:
        return ((c.n * d - c.rest) ** 2).sum(axis=1).tolist()
    if c.width * (c.far + 1) * max(c.far + 1, c.n) < 1 << 63:
        constant = sum(r * r for r in c.rest.tolist())
        return [c.n * (c.n * a - 2 * b) + constant for a, b in zip((d * d).sum(axis=1).tolist(), (d @ c.rest).tolist(), strict=True)]
    return ((c.n * d.astype(object) - c.rest.astype(object)) ** 2).sum(axis=1).tolist()


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)."""
    small_batches(vectors.sparkSession)
    rows = quantised(vectors)
    w = whitener(rows, components)
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("deviation_exact", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])
    lost = None if w is None else identity_error(rows, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, rows=BLOCK) if w is not None else ():
            x = _matrix(b.column(1), w.centre.width)
            z = w.project(x)
            flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            exact = [Decimal(v) if v < 10**38 else None for v in _deviations(x - w.centre.mid, w.centre)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), flat)], names=schema.names)

    made = rows.mapInArrow(run, schema)
    shares = F.array(*[F.lit(e).cast("double") for e in w.explained]) if w is not None else F.array(F.lit(None).cast("double"))
    each = made.select("*", F.posexplode("w").alias("at", "whitened")).withColumn("shares", shares)
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.centre.n if w is not None else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation_exact AS long)").alias("deviation"), "whitened", F.element_at("shares", F.col("at") + 1).alias("explained"),
        F.lit(lost).cast("double").alias("identity_error"), "deviation_exact",
    )
