"""Ridge regression out of sample: every key is forecast by a model that has seen none of its windows.

One pass adds up products of features and targets by fold; a fold's model is fitted to the sum of the other folds' products, in a
task of its own. Products travel as square blocks, are added pairwise up a tree, and never reach the driver; the weights,
whose number does not depend on the windows, do. Columns are standardised from the same products. A certificate, from
another pass over the windows themselves, says how far the weights are from solving the normal equations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.selection import order_statistics
from gaugeflow.operators.splits import ranked_by_hash
from gaugeflow.session import Scratch

BLOCKS = "fold int, i int, j int, part int, m binary"
HELD = 2**27  # bytes of sums that a task holds; rows of more folds than that are sorted by fold first


@dataclass
class Fit:
    """Weights for plain features with the intercept last, the columns' mean and deviation, and the number of windows."""

    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    n: int


def with_folds(windows: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """``windows`` with ``fold``: keys are dealt to the folds in turn, in the order of md5(seed:key)."""
    keys = ranked_by_hash(windows.select(F.col("key").cast("string").alias("key")).distinct(), seed, "key")
    return windows.join(keys.select("key", ((F.col("rank") - 1) % folds).cast("int").alias("fold")), "key")


def units(windows: DataFrame) -> DataFrame:
    """``key, mean, std`` of the keys' histories; a deviation of less than 1e-6 counts as 1."""
    norm = windows.select("key", F.explode("x").alias("q")).groupBy("key").agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"))
    return norm.withColumn("std", F.when(F.coalesce(F.col("std"), F.lit(0.0)) < 1e-6, 1.0).otherwise(F.col("std")))


def in_units(windows: DataFrame) -> DataFrame:
    """``windows``, which have their key's ``mean`` and ``std``, in units of the deviation around the mean."""
    return windows.withColumns({c: F.transform(c, lambda v: (v - F.col("mean")) / F.col("std")) for c in ("x", "y")})


def normalised(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``windows`` in units of each key's deviation around its mean, and ``key, mean, std`` of the keys' histories."""
    norm = units(windows)
    return in_units(windows.join(norm, "key")).select("key", "origin", *(c for c in windows.columns if c not in ("key", "origin", "x", "y")), "x", "y"), norm


def first_by_hash(windows: DataFrame, most: int) -> DataFrame:
    """The ``most`` windows with the least hashes of key and origin, for fits that need no more; all if there are fewer."""
    hashed = windows.withColumn("_h", F.xxhash64("key", "origin") / float(2**63))
    last = order_statistics(hashed, [], "_h", {"last": F.least(F.lit(most), F.col("n_rows"))}).select(F.col("value").alias("_last"))
    return hashed.join(F.broadcast(last)).where("_h <= _last").drop("_h", "_last")  # one row


def usable(windows: DataFrame, lags: int, ahead: int) -> DataFrame:
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return windows.where((F.size("x") == lags) & (F.size("y") == ahead) & F.forall("x", fine) & F.forall("y", fine))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(batch) -> np.ndarray:
    """Features, a one and targets, a row for each window."""
    x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
    return np.hstack([x, np.ones((len(x), 1)), y])


def _products(size: int, block: int, most: int):
    """Blocks of the upper triangle of the products of each fold; sums of ``most`` folds are held, then all are given out."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def blocks(fold, total):
            n = -(-size // block)
            cut = [(i, j, total[i * block : (i + 1) * block, j * block : (j + 1) * block].tobytes()) for i in range(n) for j in range(i, n)]
            columns = [[fold] * len(cut), [c[0] for c in cut], [c[1] for c in cut], [part] * len(cut), [c[2] for c in cut]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fold", "i", "j", "part", "m"])

        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for own in np.unique(folds).tolist():
                if own not in held and len(held) == most:
                    yield from (blocks(*item) for item in held.items())
                    held.clear()
                rows = _rows(batch.take(pa.array(np.flatnonzero(folds == own))))
                held[own] = held.get(own, 0.0) + rows.T @ rows
        yield from (blocks(*item) for item in held.items())

    return run


def _added(key, table):
    import pyarrow as pa

    total = None
    for m in table.column("m"):
        one = np.frombuffer(m.as_buffer(), np.float64)
        total = one.copy() if total is None else total + one
    values = [*(k.as_py() for k in key), total.tobytes()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["fold", "i", "j", "part", "m"])


def _whole(table, size: int, block: int) -> np.ndarray:
    whole = np.zeros((size, size))
    for i, j, m in zip(table.column("i").to_pylist(), table.column("j").to_pylist(), table.column("m"), strict=True):
        at = whole[i * block : (i + 1) * block, j * block : (j + 1) * block]
        at[:] = np.frombuffer(m.as_buffer(), np.float64).reshape(at.shape)
        whole[j * block : (j + 1) * block, i * block : (i + 1) * block] = at.T
    return whole


def solve(products: np.ndarray, lags: int, penalty: float) -> Fit:
    """The weights from the products of features, one and targets: standardised columns, the intercept without penalty."""
    n, sums, right = products[lags, lags], products[lags, :lags], products[:lags, lags + 1 :]
    mean, targets = sums / n, products[lags, lags + 1 :] / n
    centred = products[:lags, :lags] - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(centred) / n, 0.0))
    std[std < 1e-8] = 1.0
    gram = centred / np.outer(std, std) + penalty * np.eye(lags)
    right = (right - n * np.outer(mean, targets)) / std[:, None]
    try:
        w = np.linalg.solve(gram, right)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(gram, right, rcond=None)[0]
    w = w / std[:, None]
    return Fit(np.vstack([w, targets - mean @ w]), mean, std, int(round(n)))


def fit_folds(windows: DataFrame, lags: int, ahead: int, penalty: float, block: int = 256, width: int = 32) -> dict[int, Fit]:
    """For each fold (``fold`` of ``windows``) the model of the other folds' windows; a fold without others has none."""
    scratch = Scratch(windows.sparkSession, "ridge-folds")
    size = lags + 1 + ahead
    folds = [r["fold"] for r in windows.select("fold").distinct().collect()]  # a number a fold
    most = max(1, HELD // (8 * size * size))
    rows = usable(windows, lags, ahead).select("fold", "x", "y")
    rows = rows if len(folds) <= most else rows.sortWithinPartitions("fold")
    parts = rows.mapInArrow(_products(size, block, most), BLOCKS)
    for level in (F.pmod("part", F.lit(width * width)), F.pmod("part", F.lit(width)), F.lit(0)):
        parts = parts.withColumn("part", level.cast("int")).groupBy("fold", "i", "j", "part").applyInArrow(_added, BLOCKS)
    sums = scratch.table(parts, "sums")
    of = windows.sparkSession.createDataFrame([(f,) for f in folds], "of int")
    others = sums.join(F.broadcast(of), F.col("of") != F.col("fold"))
    others = others.select(F.col("of").alias("fold"), "i", "j", F.lit(0).alias("part"), "m").groupBy("fold", "i", "j", "part").applyInArrow(_added, BLOCKS)

    def one(key, table):
        import pyarrow as pa

        fit = solve(_whole(table, size, block), lags, penalty)
        held = [np.ascontiguousarray(a, np.float64).tobytes() for a in (fit.weights, fit.mean, fit.std)]
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([fit.n], pa.int64()), **{c: pa.array([v], pa.binary()) for c, v in zip("wms", held, strict=True)}})

    fitted = others.groupBy("fold").applyInArrow(one, "fold int, n long, w binary, m binary, s binary").collect()  # a row a fold
    of = lambda b: np.frombuffer(bytes(b), np.float64)
    return {r["fold"]: Fit(of(r["w"]).reshape(lags + 1, ahead).copy(), of(r["m"]), of(r["s"]), r["n"]) for r in fitted}


def with_forecast(windows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``windows`` with ``ridge``, the forecast of the fold's model; null where the history has another length or no model."""
    lags = len(next(iter(fits.values())).mean) if fits else 0
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields) + ", ridge array<double>"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [None] * batch.num_rows
            folds, sizes = batch.column("fold").to_pylist(), [None if v is None else len(v) for v in batch.column("x")]
            for fold, fit in fits.items():
                own = [k for k, (f, n) in enumerate(zip(folds, sizes, strict=True)) if f == fold and n == lags]
                if own:
                    made = _matrix(batch.column("x").take(pa.array(own))) @ fit.weights[:lags] + fit.weights[lags]
                    for k, row in zip(own, made.tolist(), strict=True):
                        out[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "ridge"])

    return windows.mapInArrow(run, spec)


def certificate(windows: DataFrame, fits: dict[int, Fit], lags: int, ahead: int, penalty: float) -> DataFrame:
    """``fold, n_fit, residual``: the greatest gradient of the penalised squared error at the weights, against that at zero.

    Gradients are sums over the windows that the fold's model was fitted to, not from the products that it was solved from.
    """

    def run(batches):
        import pandas as pd

        held = {f: [0, np.zeros((lags, ahead)), np.zeros((lags, ahead)), np.zeros(ahead), np.zeros(ahead)] for f in fits}
        for batch in batches:
            if batch.num_rows:
                x, y, folds = _matrix(batch.column("x")), _matrix(batch.column("y")), batch.column("fold").to_numpy()
                for f, fit in fits.items():
                    own = folds != f
                    z, t = (x[own] - fit.mean) / fit.std, y[own]
                    e = x[own] @ fit.weights[:lags] + fit.weights[lags] - t
                    for k, v in enumerate((len(t), z.T @ e, z.T @ t, e.sum(axis=0), t.sum(axis=0))):
                        held[f][k] = held[f][k] + v
        rows = [(f, n, a.ravel().tolist(), b.ravel().tolist(), c.tolist(), d.tolist()) for f, (n, a, b, c, d) in held.items()]
        import pyarrow as pa

        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["fold", "n", "g", "g0", "e", "t"]).astype({"fold": "int32"}), preserve_index=False)

    def judged(key, table):
        import pyarrow as pa

        add = lambda c: np.sum([np.array(v.as_py()) for v in table.column(c)], axis=0)
        fold = key[0].as_py()
        fit, n = fits[fold], sum(table.column("n").to_pylist())
        g = add("g").reshape(lags, ahead) + penalty * fit.weights[:lags] * fit.std[:, None]
        scale = max(np.abs(add("g0")).max(), np.abs(add("t")).max(), 1e-300)
        worst = max(np.abs(g).max(), np.abs(add("e")).max()) / scale
        return pa.table({"fold": pa.array([fold], pa.int32()), "n_fit": pa.array([n], pa.int64()), "residual": pa.array([float(worst)])})

    spec = "fold int, n long, g array<double>, g0 array<double>, e array<double>, t array<double>"
    sums = usable(windows, lags, ahead).select("fold", "x", "y").mapInArrow(run, spec)
    return sums.groupBy("fold").applyInArrow(judged, "fold int, n_fit long, residual double")
