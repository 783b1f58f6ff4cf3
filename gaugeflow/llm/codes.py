"""Vectors as short codes of nearest codebook entries (operator 13).

A vector's components become integers floor(4096 * x); its equal consecutive parts are each replaced by the index of the
nearest entry in a codebook of that part. Codebooks are improved in rounds: the driver builds a kd-tree of each codebook
(a few entries, whatever the data) and sends the trees to the tasks; a branch-and-bound search visits every node whose
bound is no more than the best distance, so entries at equal distance are all seen and the lowest index wins; tasks add up
their parts as integers, and the sums of all tasks give the next entries. Everything is exact.

Dropped: vectors that are null or empty, that hold a null or a component that is not finite, and those whose length is not
that of the kept vector with the smallest id, or no multiple of ``parts``. A null id comes after all others; rows with equal
ids are vectors of their own, taken in the order of their components. With fewer vectors than entries the codebooks are
smaller. Components too large for 64-bit distances are reckoned with Python's integers; an error beyond a long is then
null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import Scratch


def usable(vector: str) -> Column:
    """Is the vector there, with finite components only?"""
    x = F.col(vector)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.forall(x, fine), F.lit(False))


def _bound(length: int) -> int:
    """Vectors of that length whose integers are all smaller have squared distances within 64 bits."""
    return 1 << (61 - length.bit_length()) // 2


def _integers(column, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors of an Arrow list column, row by row; as Python's integers if they are large."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        rows = np.floor(values * scale).reshape(len(column), -1)  # a scale that is a power of two makes no rounding error
    if (np.abs(rows) < _bound(rows.shape[1])).all():
        return rows.astype(np.int64)
    exact = [int(x) * scale if x == np.floor(x) else int(np.floor(x * scale)) for x in values.tolist()]
    return np.array([*exact, None], object)[:-1].reshape(rows.shape)


@dataclass
class Node:
    """A box that holds the entries ``index``, and its halves along ``axis`` if it has any."""

    low: np.ndarray
    high: np.ndarray
    index: list[int]
    axis: int = 0
    cut: int = 0
    below: Node | None = None
    above: Node | None = None


def kd_tree(entries: np.ndarray, index: list[int] | None = None, leaf: int = 2) -> Node:
    """Halves at the median of the widest axis down to ``leaf`` entries; equal entries stay together."""
    index = list(range(len(entries))) if index is None else index
    held = entries[index]
    node = Node(held.min(axis=0), held.max(axis=0), index)
    width = node.high - node.low
    axis = int(np.argmax(width))
    if len(index) > leaf and width[axis] > 0:
        order = sorted(index, key=lambda i: (entries[i][axis], i))
        cut = entries[order[(len(order) - 1) // 2]][axis]
        cut = cut if cut < node.high[axis] else max(entries[i][axis] for i in index if entries[i][axis] < node.high[axis])
        node.axis, node.cut = axis, cut
        node.below = kd_tree(entries, [i for i in index if entries[i][axis] <= cut], leaf)
        node.above = kd_tree(entries, [i for i in index if entries[i][axis] > cut], leaf)
    return node


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index and squared distance of the entry nearest to each point; of equal ones the lowest index."""
    best = np.full(len(points), -1, np.int64)
    distance = np.zeros(len(points), points.dtype)

    def visit(node: Node, some: np.ndarray) -> None:
        p = points[some]
        gap = np.maximum(np.maximum(node.low - p, p - node.high), 0)
        near = (best[some] < 0) | ((gap * gap).sum(axis=1) <= distance[some])
        some, p = some[near], p[near]
        if not len(some):
            return
        if node.below is None:
            for i in node.index:
                gap = p - entries[i]
                d = (gap * gap).sum(axis=1)
                held = best[some]
                better = (held < 0) | (d < distance[some]) | ((d == distance[some]) & (i < held))
                best[some[better]], distance[some[better]] = i, d[better]
            return
        first = (p[:, node.axis] <= node.cut).astype(bool)
        visit(node.below, some[first])
        visit(node.above, some)
        visit(node.below, some[~first])

    visit(tree, np.arange(len(points)))
    return best, distance


def _assigned(batch, codebooks: list[np.ndarray], trees: list[Node], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its integers, and the index and distance of the nearest entry."""
    whole = _integers(batch.column("vector"), scale)
    width = whole.shape[1] // len(codebooks)
    for k, (entries, tree) in enumerate(zip(codebooks, trees, strict=True)):
        points = whole[:, k * width : (k + 1) * width]
        if points.dtype != entries.dtype:
            points, entries = points.astype(object), entries.astype(object)
            tree = kd_tree(entries)
        yield points, *nearest(tree, entries, points)


def _sums(codebooks: list[np.ndarray], trees: list[Node], scale: int):
    """A task's count and component sums of the parts nearest to each entry, as decimal text."""

    def run(batches):
        import pyarrow as pa

        count = [np.zeros(len(c), np.int64) for c in codebooks]
        total = [np.zeros(c.shape, object) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, (points, index, _) in enumerate(_assigned(batch, codebooks, trees, scale)):
                count[k] += np.bincount(index, minlength=len(count[k]))
                for i in np.unique(index):
                    total[k][i] += points[index == i].sum(axis=0).astype(object)
        rows = [(k, i, int(n), ",".join(map(str, total[k][i]))) for k in range(len(count)) for i, n in enumerate(count[k]) if n]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "total"])

    return run


def _added(rows):
    """One row of a part's entry: the sums of all tasks."""
    import pandas as pd

    total = None
    for text in rows["total"]:
        one = np.array([int(x) for x in text.split(",")], object)
        total = one if total is None else total + one
    first = rows.iloc[0]
    return pd.DataFrame({"part": [first["part"]], "entry": [first["entry"]], "n": [int(rows["n"].sum())], "total": [",".join(map(str, total))]})


def _coder(codebooks: list[np.ndarray], trees: list[Node], scale: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            index, error = [], 0
            for _, i, d in _assigned(batch, codebooks, trees, scale):
                index.append(i)
                error = error + d
            code = ["".join(f"{i:02x}" for i in row) for row in np.stack(index, axis=1).tolist()]
            error = [int(e) if e < 2**63 else None for e in error.tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def _narrow(entries: np.ndarray, length: int) -> np.ndarray:
    """64-bit where distances fit, else Python's integers."""
    small = all(abs(int(x)) < _bound(length) for x in entries.ravel())
    return entries.astype(np.int64 if small else object)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` for every kept vector, and the codebooks, one array of entries a part."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(usable("vector"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    head = rows.orderBy(*order).limit(1).select(F.size("vector")).first()
    length = head[0] if head is not None and head[0] % parts == 0 else -1
    rows = rows.where(F.size("vector") == length)
    start = [r["vector"] for r in rows.orderBy(*order).limit(entries).select("vector").collect()]
    if not start:
        return scratch.table(rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes"), []
    import pyarrow as pa

    first = _integers(pa.array(start, pa.list_(pa.float64())), scale)
    codebooks = [_narrow(c, length) for c in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        found = rows.select("vector").mapInArrow(_sums(codebooks, [kd_tree(c) for c in codebooks], scale), "part int, entry int, n long, total string")
        sums = found.groupBy("part", "entry").applyInPandas(_added, found.schema)
        changed = [c.astype(object) for c in codebooks]
        for r in sums.collect():  # one row an entry
            changed[r["part"]][r["entry"]] = np.array([int(x) // r["n"] for x in r["total"].split(",")], object)
        codebooks = [_narrow(c, length) for c in changed]
    kind = vectors.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(_coder(codebooks, [kd_tree(c) for c in codebooks], scale), f"vec_id long, label {kind}, code string, error long")
    return scratch.table(coded, "codes"), codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """Of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()


def decode(code: str, codebooks: list[np.ndarray], scale: int = 4096) -> np.ndarray:
    """The vector that a code stands for: the middle of the integers' cells."""
    return np.concatenate([(c[int(code[2 * k : 2 * k + 2], 16)].astype(float) + 0.5) / scale for k, c in enumerate(codebooks)])
