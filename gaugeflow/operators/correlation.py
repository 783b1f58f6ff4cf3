"""Correlations among many series as blocked matrix products: hours are never joined, series are never paired one by one.

Every series is centred and scaled to length one, so a correlation is a dot product. Series are dealt to blocks by ranges of
their keys, hours to chunks, and written once to the shared folder. A task has one block, reads those after it one by one and
multiplies chunk by chunk, so what is shuffled and written grows with the series; only the rows of the result are pairs. Some
millions at a time they come in ascending order: equal figures lie together and a written result is less than half as large.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.metrics import EPS
from gaugeflow.session import Scratch
from gaugeflow.sources.two_phase import opened


def _unit(series: DataFrame) -> DataFrame:
    """``key, n, u, energy``: the series less its mean over its length, zeros if it does not vary, and its deviation."""
    mean = F.try_divide(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), F.size("s"))
    # the mean comes as an array's only element: as a column it is put into the lambda and reckoned anew for every value
    less = F.transform(F.array(mean), lambda m: F.transform("s", lambda v: v - m))[0]
    centred = series.select(F.col("key").cast("string").alias("key"), F.size("s").alias("n"), less.alias("c"))
    length = centred.select("*", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v)).alias("length"))
    deviation = F.col("length") / F.sqrt("n")
    unit = F.transform("c", lambda v: F.when(deviation <= EPS, 0.0).otherwise(F.try_divide(v, F.col("length"))))
    return length.select("key", "n", unit.alias("u"), deviation.alias("deviation"))


def _multiplied(path: str, chunks: int, rows: int):
    """The correlations of each pair of blocks, about ``rows`` of them at a time in ascending order; the task reads both blocks from the shared folder, a chunk at a time."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, at = opened(path)

        @lru_cache(maxsize=1)
        def own(chunk, side):
            return read(chunk, side)

        def read(chunk, side):
            table = pq.read_table(f"{at}/chunk={chunk}/side={side}", columns=["key", "u"], filesystem=system).sort_by("key").combine_chunks()
            values = table.column("u").combine_chunks()
            return table.column("key").combine_chunks(), values.flatten().to_numpy().reshape(len(values), -1)

        def product(left, right):
            total = 0.0
            for chunk in range(chunks):
                (a, x), (b, y) = own(chunk, left), read(chunk, right) if left != right else own(chunk, left)
                total = total + x @ y.T
            return a, b, total, np.triu(np.ones(total.shape, bool), 1) if left == right else np.ones(total.shape, bool)

        def sorted_rows(parts):
            a, names = parts[0][0], pa.concat_arrays([b for _, b, _, _ in parts])
            corr, kept = (np.concatenate([p[k] for p in parts], axis=1).ravel() for k in (2, 3))
            order = np.flatnonzero(kept)  # without a key's own and the second of each pair
            order = order[np.argsort(corr[order])]
            for k in range(0, len(order), 1 << 16):
                some = order[k : k + (1 << 16)]
                i, j = np.divmod(some, len(names))
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i)), names.take(pa.array(j)), pa.array(np.clip(corr[some], -1.0, 1.0))], names=["a", "b", "corr"])

        for batch in batches:
            parts, seen = [], None
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if parts and (left != seen or sum(p[2].size for p in parts) >= rows):
                    yield from sorted_rows(parts)
                    parts = []
                seen = left
                parts.append(product(left, right))
            if parts:
                yield from sorted_rows(parts)

    return run


def correlations(series: DataFrame, block: int = 256, chunk: int = 4096, rows: int = 1 << 22) -> DataFrame:
    """``a, b, corr`` for every two keys of ``series`` (``key, s``), a before b: Pearson's, 0 where one does not vary.

    All series have to be of one length, without nulls; otherwise an error is raised. Keys are not repeated.
    """
    spark = series.sparkSession
    scratch = Scratch(spark, "correlations")
    unit = scratch.table(_unit(series), "unit")
    n, length, other = unit.agg(F.count("*"), F.max("n"), F.min("n")).first()
    if n and length != other:
        raise ValueError(f"series of {other} to {length} values")
    blocks, chunks = -(-n // block) or 1, -(-(length or 0) // chunk) or 1
    # the ranges are written, so a lost executor can't deal them anew
    sided = scratch.table(unit.select("key", "u").repartitionByRange(blocks, "key").withColumn("side", F.spark_partition_id()), "sided")
    placed = sided.select("key", "u", "side", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    placed = placed.select("key", F.slice("u", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("u"), "chunk", "side")
    path = scratch.path("blocks")
    placed.repartition("chunk", "side").write.partitionBy("chunk", "side").option("compression", "zstd").parquet(path)
    scratch.drop("unit", "sided")
    sides = spark.read.schema(placed.schema).parquet(path).select("side").distinct()  # a row a block, as all tables from here on
    # a task has a block and those after it: the first tasks have most, at the most twice as much as on average
    left = spark.range(0, blocks, 1, blocks).toDF("left").join(F.broadcast(sides.toDF("left")), "left")
    pairs = left.join(F.broadcast(sides.toDF("right")), F.col("left") <= F.col("right"))
    return pairs.mapInArrow(_multiplied(path, chunks, rows), "a string, b string, corr double")


def energy_shares(series: DataFrame, target: str, top: int = 2) -> DataFrame:
    """``key, corr, rms, deviation, weight, share, rank, top_share``: how much of the target's energy each other series holds.

    A series' weight is its absolute correlation with the ``target`` times its deviation, its share that of all weights (0
    if all are 0); only the ``top`` are ranked, equal weights by key; ``top_share`` is their part of all.
    """
    unit = _unit(series)
    rms = series.select(F.col("key").cast("string").alias("key"), F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v) / F.size("s")).alias("rms"))
    bar = unit.where(F.col("key") == target).select(F.col("u").alias("t"))
    others = unit.where(F.col("key") != target).join(F.broadcast(bar))  # one series
    corr = F.aggregate(F.zip_with("u", "t", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    weighed = others.select("key", "deviation", corr.alias("corr")).withColumn("weight", F.abs("corr") * F.col("deviation"))
    best = weighed.select("key", "weight", F.row_number().over(Window.orderBy(F.desc("weight"), "key")).alias("rank")).where(F.col("rank") <= top)
    sums = weighed.agg(F.sum("weight").alias("all")).join(best.agg(F.sum("weight").alias("best")))  # one row each
    part = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all")).otherwise(0.0)
    joined = weighed.join(rms, "key").join(best.select("key", "rank"), "key", "left").join(F.broadcast(sums))
    return joined.select("key", "corr", "rms", "deviation", "weight", part("weight").alias("share"), "rank", part("best").alias("top_share"))
