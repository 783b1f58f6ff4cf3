"""Decomposition of history windows into frequency bands, and a cache of it that can be resumed.

Windows are independent, so Spark spreads them over tasks; a task handles a few at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import modes

AT_ONCE = 8  # windows of a task that are sifted together; bounds its memory
BANDS = "bands array<array<float>>, band_entropy array<float>, entropy double, n_modes int, code int"


def _length_groups(frames) -> Iterator[tuple]:
    """Rows of equal length, a few at a time; rows without usable values are left out."""
    for pdf in frames:
        usable = pdf.loc[np.array([v is not None and len(v) > 2 and all(z is not None and z == z for z in v) for v in pdf["x"]], bool)]
        for _, same in usable.groupby(usable["x"].map(len)):
            for lo in range(0, len(same), AT_ONCE):
                part = same.iloc[lo : lo + AT_ONCE]
                yield part, np.stack(part["x"].to_numpy()).astype(float)


def decompose(windows: DataFrame, keys: list[str], series: str = "x", n_bands: int = 3, trials: int = 100, noise: float = 0.2, most: int = 9, seed: int = 1234, edge: str = "anchor") -> DataFrame:
    """``keys``, ``bands`` (fastest first; they sum to the series), their entropies, the series' own, the number of
    modes and ``code``: 0 normal, 1 constant, 2 no modes, 3 fewer parts than bands, 5 an entropy at its limit.

    Null series, series of fewer than three values and those with a null or NaN are left out.
    """

    def run(frames):
        for part, x in _length_groups(frames):
            found, count, rest = modes.noise_assisted_modes(x, trials, noise, most, seed=seed, edge=edge)
            grouped = [modes.grouped_modes(x[i], found[i, : count[i]], rest[i], n_bands) for i in range(len(x))]
            out = {"bands": [g[0].astype("float32").tolist() for g in grouped], "band_entropy": [g[1].astype("float32").tolist() for g in grouped], "entropy": [modes.sample_entropy(v) for v in x], "n_modes": count, "code": [g[2] for g in grouped]}
            yield pd.DataFrame({**{k: part[k].to_numpy() for k in keys}, **out})

    chosen = windows.select(*keys, F.col(series).alias("x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keys).schema)
    return chosen.mapInPandas(run, f"{kinds}, {BANDS}")


def plain_modes(windows: DataFrame, keys: list[str], series: str = "x", most: int = 9, edge: str = "anchor") -> DataFrame:
    """``keys, mode, part``: one row for each mode of the plain decomposition, from 0; the last row is what is left."""

    def run(frames):
        for part, x in _length_groups(frames):
            found, count, rest = modes.modes(x, most, edge=edge)
            rows = [(i, k, p.tolist()) for i in range(len(x)) for k, p in enumerate([*found[i, : count[i]], rest[i]])]
            at = [r[0] for r in rows]
            yield pd.DataFrame({**{k: part[k].to_numpy()[at] for k in keys}, "mode": [r[1] for r in rows], "part": [r[2] for r in rows]})

    chosen = windows.select(*keys, F.col(series).alias("x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keys).schema)
    return chosen.mapInPandas(run, f"{kinds}, mode int, part array<double>")


def fill_cache(windows: DataFrame, keys: list[str], path: str, **settings) -> DataFrame:
    """The decompositions of ``windows`` at ``path``; only those that are not there yet are computed and appended.

    Each call's rows appear at once when its write commits, so a job that broke off is resumed by calling again.
    """
    spark = windows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    todo = windows.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if there else windows
    decompose(todo, keys, **settings).write.mode("append").parquet(path)
    return windows.select(*keys).join(spark.read.parquet(path), keys)


def band_error(series: Column, bands: Column) -> Column:
    """The largest distance between the series and the sum of its bands."""
    total = F.aggregate(bands, F.transform(series, lambda v: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return F.array_max(F.zip_with(series, total, lambda v, t: F.abs(v - t)))


def normalised_bands(bands: Column, mean: Column, std: Column) -> Column:
    """Bands of the standardised series: all divided by ``std``, the slowest less ``mean / std``."""
    last = F.size(bands) - 1
    return F.transform(bands, lambda b, i: F.transform(b, lambda v: v / std - F.when(i == last, mean / std).otherwise(0.0)))
