"""Whitening by spectral divide and conquer: QDWH polar factors of the shifted covariance split it into components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexgiving.llm.common import stored

SCALE, OFFSET = 64, 1_000_000       # an entry c becomes floor(SCALE * c) + OFFSET
COMPONENTS = 16
EPS = float(np.finfo(float).eps)
SEED = 11


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QR- or solve-based dynamically weighted Halley steps."""
    n = len(a)
    eye = np.eye(n)
    x, low = a / np.linalg.norm(a), EPS / 2
    for _ in range(30):
        sq = low * low
        root = np.cbrt(4 * (1 - sq) / sq ** 2)
        base = np.sqrt(1 + root)
        wa = base + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - sq) / (sq * base))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            step = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            step = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        step = (step + step.T) / 2
        moved, x = np.linalg.norm(step - x), step
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        if moved <= 10 * EPS * np.sqrt(n) or (1 - low < 10 * EPS and moved < EPS ** (1 / 3)):
            break
    return x


def _shifts(a: np.ndarray) -> list[float]:
    """Where to split the spectrum: the widest middle gap of the diagonal, the mean, then places beside it."""
    d = np.sort(np.diag(a))
    mean, spread = float(d.mean()), float(np.linalg.norm(a - d.mean() * np.eye(len(a))) / np.sqrt(len(a)))
    at = np.arange(len(d) // 4, max(len(d) // 4 + 1, len(d) - 1 - len(d) // 4))
    widest = at[np.argmax(d[at + 1] - d[at])]
    return [float(d[widest] + d[widest + 1]) / 2, mean, *(mean + f * spread for f in (0.1, -0.1, 0.3, -0.3, 0.6, -0.6, 0.9, -0.9))]


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix.

    The projector (I + U) / 2, U the polar factor of a - shift, spans the
    eigenvectors above the shift; both invariant subspaces are split on until
    a block is a multiple of the identity.
    """
    d = len(a)
    scale = np.linalg.norm(a)
    rng = np.random.default_rng(SEED)
    basis, todo, done = np.eye(d), [np.arange(d)] if d else [], []
    while todo:
        at = todo.pop()
        v = basis[:, at]
        b = v.T @ a @ v
        b = (b + b.T) / 2
        n = len(at)
        if n == 1 or np.linalg.norm(b - np.trace(b) / n * np.eye(n)) <= 4 * EPS * scale * np.sqrt(n):
            done.append(at)
            continue
        best = None
        for shift in _shifts(b):
            u = polar(b - shift * np.eye(n))
            k = int(round((n + np.trace(u)) / 2))
            if not 0 < k < n:
                continue
            p = (u + np.eye(n)) / 2
            q = np.linalg.qr(p @ rng.standard_normal((n, k)), mode="complete")[0]
            q = np.linalg.qr(p @ q[:, :k], mode="complete")[0]
            left = np.linalg.norm(q[:, k:].T @ b @ q[:, :k])
            if best is None or left < best[0]:
                best = left, q, k
            if left <= 8 * EPS * scale * np.sqrt(n):
                break
        if best is None:
            done.append(at)
            continue
        basis[:, at] = v @ best[1]
        todo += [at[:best[2]], at[best[2]:]]
    basis = np.linalg.qr(basis)[0] if d else basis
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Whitening:
    """What whitening needs: size and exact sums of the fit list, components, and how far whitened rows are from white."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def white(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.values > len(self.sums) * EPS * max(self.trace, 0.0)

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.white, self.values, np.nan))

    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values]


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): vectors as whole numbers; those that are null or hold null or non-finite entries are left out.

    So are those of an uncommon length (ties: the longer is common). Null ids
    and repeated rows stay. An entry too large for a long is an error.
    """
    v = F.col("v")
    good = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(v.isNotNull()).where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    whole = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET).cast("long"))
    return good.where(F.size("v") == (lengths["n"] if lengths else 0)).select("id", whole.alias("x"))


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole part first, so that nothing cancels."""
    whole, rest = _mean(n, sums)
    return (x - whole).astype(float) - rest / n


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [divmod(s, n) for s in sums]
    return np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)


def covariance(fit: DataFrame, n: int, sums: list[int], matrix: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred rows of ``fit``, or of their products with ``matrix``.

    Each task adds up one square matrix; its rows are added up by row number.
    """
    shared = fit.sparkSession.sparkContext.broadcast((n, sums, matrix))

    def partial(batches):
        size, total, m = *shared.value[:2], shared.value[2]
        acc = 0.0
        for batch in batches:
            if batch.num_rows:
                c = _centred(_flat(batch.column(0)), size, total)
                c = c if m is None else c @ m
                acc = acc + c.T @ c
        if isinstance(acc, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc)), pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))],
                                             names=["i", "v"])

    def merge(t: pa.Table) -> pa.Table:
        return pa.table({"i": t["i"][:1], "v": pa.array([_flat(t["v"].combine_chunks()).sum(0)], pa.list_(pa.float64()))})

    merged = fit.select("x").mapInArrow(partial, "i int, v array<double>").groupBy("i").applyInArrow(merge, "i int, v array<double>")
    rows = sorted((r["i"], r["v"]) for r in merged.collect())       # one for each dimension
    out = np.array([v for _, v in rows]) / n
    return (out + out.T) / 2


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors of ``rows`` (id, x): all of them, none sampled.

    The driver holds sums and one matrix of the vectors' dimensions. No rows give a whitening of n = 0.
    """
    fit = stored(rows.select("x").distinct(), "fit-vectors")
    n = fit.count()
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, None)

    def totals(batches):
        acc = 0
        for batch in batches:
            if batch.num_rows:
                acc = acc + _flat(batch.column(0)).sum(0)
        if isinstance(acc, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc)), pa.int32()), pa.array(acc, pa.int64())], names=["i", "s"])

    sums = [int(r["s"]) for r in fit.mapInArrow(totals, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]
    v = covariance(fit, n, sums) if sums else np.zeros((0, 0))
    values, vectors = spectral(v)
    model = Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(v)), None)
    keep = model.white
    if keep.any():
        white = covariance(fit, n, sums, model.matrix[:, keep])
        model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) for each row of (id, x), by the broadcast model.

    deviation: exact sum over dimensions of (n x - S)^2; null beyond a long.
    whitened: the centred row on each component over the square root of its
    eigenvalue; null where the eigenvalue is 0 but for rounding.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        whole, rest = _mean(m.n, m.sums)
        matrix = m.matrix
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _flat(batch.column(1))
            off = x - whole
            size = float(np.abs(off).max(initial=0)) * m.n + m.n
            if size * size * max(1, x.shape[1]) < 2.0 ** 62:
                dev = ((off * m.n - rest) ** 2).sum(1).tolist()
            else:
                dev = [sum(t * t for t in (int(o) * m.n - int(r) for o, r in zip(row, rest, strict=True))) for row in off]
                dev = [t if t < 2 ** 63 else None for t in dev]
            white = (off.astype(float) - rest / m.n) @ matrix
            lists = [[None if np.isnan(w) else w for w in r] for r in white.tolist()] if np.isnan(matrix).any() else list(white)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dev, pa.int64()), pa.array(lists, pa.list_(pa.float64()))],
                                             names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")
