"""A uniform shuffle into shards of exact size (operator 7).

The rows of each source group go to target blocks by a communication matrix whose entries are drawn
from the exact multivariate hypergeometric law, given the groups' rows and the blocks' sizes. Rows
are permuted within their source group, exchanged as the matrix says, and permuted again within
their block; the blocks of a shard follow each other. Every assignment of rows to slots is equally
likely, and shard sizes differ by one at most.

A group or block is permuted by ranks of random keys, and its rows are dealt by the leading bits of the key: the
rows of a range are sorted in one task, and the counts of the ranges before it are added. Ranges follow
the number of rows (``block_rows`` each on average), so work spreads over more tasks as the data grow, while the
matrix keeps its size: the driver holds a count for each of at most ``max_parts`` source groups and draws at most
``max_parts`` by ``shards * max_blocks`` numbers, also the size of the one broadcast. Rows are keyed by
their place in a written table, so a recomputed task repeats its draws and equal rows need no key.

Defined results: nulls, ties and repeated rows are rows like any other; columns named ``shard`` and ``slot`` are
replaced, any other names are free; no rows give no rows.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import Scratch


def _rest(n: float) -> float:
    """log(n!) less Stirling's formula without its series."""
    if n < 16:
        return math.lgamma(n + 1) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    d = x - mean
    if abs(d) > 0.1 * (x + mean):
        return x * math.log(x / mean) - d
    v = d / (x + mean)
    total, term, k = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        after = total + term / k
        if after == total:
            return total
        total = after


def _log_binomial(x: int, n: int, p: float) -> float:
    """The logarithm of the binomial law's probability of x (Loader, 2000), exact to rounding for any n."""
    if x in (0, n):
        return n * math.log1p(-p) if x == 0 else n * math.log(p)
    tails = _rest(n) - _rest(x) - _rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return tails + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad are good: inversion outward from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = n / (good + bad)
    peak = math.exp(_log_binomial(mode, good, p) + _log_binomial(n - mode, bad, p) - _log_binomial(n, good + bad, p))
    while True:  # again only where rounding left the sum of all probabilities below the draw
        left = rng.random() - peak
        if left <= 0:
            return mode
        up = down = mode
        p_up = p_down = peak
        while (up < high or down > low) and p_up + p_down > 1e-300:
            if up < high:
                p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
                up += 1
                left -= p_up
                if left <= 0:
                    return up
            if down > low:
                p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
                down -= 1
                left -= p_down
                if left <= 0:
                    return down


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows of each partition go to each block; row sums are ``rows``, column sums ``sizes``."""
    rng, room, out = random.Random(seed), list(sizes), []
    for n in rows:
        total, line = sum(room), []
        for size in room:
            k = hypergeometric(rng, size, total - size, n)
            line.append(k)
            total, n = total - size, n - k
        room = [a - b for a, b in zip(room, line, strict=True)]
        out.append(line)
    return out


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def _ends(counts: list[int]) -> list[int]:
    return [sum(counts[: i + 1]) for i in range(len(counts))]


def _ranked(rows: DataFrame, keys: list[str], seed: int, ranges: int, name: str) -> DataFrame:
    """``rows`` with ``name``, the rank from 1 of each row's random key within ``keys``."""
    bits = max(0, (ranges - 1).bit_length())
    keyed = rows.withColumn("key", F.xxhash64(F.lit(seed), "row"))
    if not bits:
        return keyed.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("key", "row"))).drop("key")
    # the key's order is that of its value as a signed number, so the leading bits are shifted with the sign
    keyed = keyed.withColumn("range", F.shiftright("key", 64 - bits))
    counts = keyed.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("key", "row"))
    ranked = keyed.withColumn("own", own).join(counts, [*keys, "range"])
    return ranked.withColumn(name, F.col("before") + F.col("own")).drop("key", "range", "own", "before")


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 7, block_rows: int = 1 << 20, max_parts: int = 256, max_blocks: int = 32) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), which replace columns of these names."""
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    given = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")))
    keyed = df.select(given.alias("given"), F.monotonically_increasing_id().alias("row"), (F.spark_partition_id() % max_parts).alias("part"))
    rows = scratch.table(keyed, "rows")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    if not total:
        return rows.select("given.*", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    blocks = min(max_blocks, max(1, -(-total // (shards * block_rows))))
    sizes = [_even(n, blocks) for n in _even(total, shards)]
    lines = []
    matrix = communication_matrix([n for _, n in counts], [n for s in sizes for n in s], seed)
    for (part, _), line in zip(counts, matrix, strict=True):
        ends = _ends(line)
        by_shard = [ends[i * blocks : (i + 1) * blocks] for i in range(shards)]
        lines.append({"part": part, "shard_ends": [e[-1] for e in by_shard], "block_ends": by_shard})
    kind = "array<struct<part:int,shard_ends:array<bigint>,block_ends:array<array<bigint>>>>"
    matrix = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lines)), kind)))
    largest = max(n for _, n in counts)
    sent = _ranked(rows, ["part"], seed, -(-largest // block_rows), "rank").join(F.broadcast(matrix), "part")
    sent = sent.withColumn("shard", F.size(F.filter("shard_ends", lambda e: e < F.col("rank"))))
    sent = sent.withColumn("block", F.size(F.filter(F.get("block_ends", "shard"), lambda e: e < F.col("rank"))))
    sent = sent.select("given", "row", "shard", "block")
    before = F.array(*(F.array(*(F.lit(e - n).cast("long") for e, n in zip(_ends(s), s, strict=True))) for s in sizes))
    placed = _ranked(sent, ["shard", "block"], seed + 1, -(-max(max(s) for s in sizes) // block_rows), "place")
    slot = F.get(F.get(before, F.col("shard")), F.col("block")) + F.col("place") - 1
    return placed.select("given.*", "shard", slot.cast("long").alias("slot"))
