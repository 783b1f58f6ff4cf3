"""Ridge regression of the hours ahead on a window's history, or on its last hours.

Each task adds up its windows' products of features and targets; the products are summed by Spark and
only the (lags + 1) x (lags + 1 + ahead) sums reach the driver, whatever the number of windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _products(lags: int, mean: np.ndarray, std: np.ndarray):
    def run(frames):
        import pandas as pd

        total = None
        for pdf in frames:
            if len(pdf):
                x = (np.array([v[-lags:] for v in pdf["x"]], float) - mean) / std
                x = np.hstack([x, np.ones((len(x), 1))])
                part = x.T @ np.hstack([x, np.stack(pdf["y"].to_numpy())])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return run


def _moments(usable: DataFrame, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each of the ``lags`` columns; a deviation below 1e-8 counts as 1."""
    each = usable.select(F.posexplode(F.slice("x", -lags, lags)).alias("i", "v"))
    found = each.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).orderBy("i").toPandas()  # lags rows
    std = found["std"].to_numpy()
    return found["mean"].to_numpy(), np.where(std < 1e-8, 1.0, std)


def fit_ridge(windows: DataFrame, penalty: float = 1.0, lags: int | None = None, standardise: bool = False) -> np.ndarray:
    """Weights, one row for each of ``lags`` values and the intercept, one column for each hour ahead.

    Without ``lags`` the whole of the longest history is used. With ``standardise`` the penalty is on the
    weights of columns less their mean and divided by their deviation; the weights returned are for plain
    values either way. The intercept is not penalised. Windows with a null in the values used, or a shorter history, are
    left out; without windows there is nothing to fit and ValueError is raised.
    """
    if lags is None:
        lags = windows.agg(F.max(F.size("x"))).first()[0]
        if lags is None or lags < 1:
            raise ValueError("no usable windows")
    usable = windows.where((F.size("x") >= lags) & F.forall(F.slice("x", -lags, lags), lambda v: v.isNotNull()) & F.forall("y", lambda v: v.isNotNull()))
    mean, std = _moments(usable, lags) if standardise else (np.zeros(lags), np.ones(lags))
    if len(mean) < lags:
        raise ValueError("no usable windows")
    sums = usable.select("x", "y").mapInPandas(_products(lags, mean, std), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if sums.empty:
        raise ValueError("no usable windows")
    whole = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
    whole[sums["i"], sums["j"]] = sums["v"]
    gram, right = whole[:, : lags + 1], whole[:, lags + 1 :]
    shrunk = gram + np.diag([*[penalty] * lags, 0.0])
    weights = np.linalg.lstsq(shrunk, right, rcond=None)[0]
    weights[:lags] /= std[:, None]
    weights[lags] -= mean @ weights[:lags]
    return weights


def with_ridge(windows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``windows`` with the array column ``ridge``, the forecast of each hour ahead; null for shorter histories."""
    lags = len(weights) - 1
    columns = F.array(*(F.lit(np.ascontiguousarray(column, float)) for column in weights.T))
    features = F.concat(F.slice("x", -lags, lags), F.array(F.lit(1.0)))
    dot = lambda column: F.aggregate(F.zip_with(features, column, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return windows.withColumn("ridge", F.when(F.size("x") >= lags, F.transform(columns, dot)))
