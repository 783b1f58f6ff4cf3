"""Training curves as streams: early stopping and the exponential mean of each run, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, best double, best_epoch int, epoch int, stopped boolean, mean double"


def _later(state: tuple, value: float | None, patience: int, min_delta: float, decay: float) -> tuple:
    """The state after one more value of the run."""
    n, best, best_epoch, epoch, stopped, mean = state
    if not stopped:
        epoch += 1
        if value is not None and value > best + min_delta:
            best, best_epoch = value, epoch
        stopped = epoch - best_epoch >= patience
    if value is not None:
        d = min(decay, (1 + n) / (10 + n))
        n, mean = n + 1, value if mean is None else d * mean + (1 - d) * value
    return n, best, best_epoch, epoch, stopped, mean


def follow_runs(stream: DataFrame, key: str, order: str, value: str, patience: int, min_delta: float = 1e-4, decay: float = 0.999) -> DataFrame:
    """``key, n, best, best_epoch, epoch, stopped, mean`` of each run that a batch adds to, for the update mode.

    The same rules as ``early_stop`` and ``moving_mean`` over the whole array. Values of a batch are taken by ``order``;
    a batch's values follow those of earlier batches. A null value is an epoch without improvement and leaves the mean
    and ``n``, the number of values in it; a null key is a run of its own. After the stop only the mean goes on.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), F.col(value).cast("double").alias("value"))

    def fold(run: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, float("-inf"), -1, -1, False, None)
        for v in pd.concat(list(frames)).sort_values("at")["value"]:
            held = _later(held, None if pd.isna(v) else float(v), patience, min_delta, decay)
        state.update(held)
        names = [c.split()[0] for c in STATE.split(", ")]
        yield pd.DataFrame([dict(zip(["key", *names], [run[0], *held], strict=True))])

    return rows.groupBy("key").applyInPandasWithState(fold, f"key string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
