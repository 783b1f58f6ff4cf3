"""Removal of word sequences that an earlier document already has (operator 5).

A window is ``window`` consecutive words of one document. Windows that also start in a document with a
smaller doc_id are repeats, and every word that a repeat covers is removed.

First pass: the count-min sketch. A window is counted under its anchor, the smallest hash among the
word grams inside it; equal windows have equal anchors, so the count of an anchor is never below the number of
documents that hold the window. The sketch has ``depth`` rows of counters, each with a hash of its own; its width
follows the number of anchors of the whole corpus. Each partition sketches its documents' anchors, holding
the counters that are not zero, and the partitions' sketches are summed block by block. The least of an anchor's
counters estimates its number of documents from above. Nothing of the sketch is broadcast or collected.
Second pass: only windows whose anchor is estimated at two or more are hashed (128 bits) and grouped
exactly. Overestimates cost work, never a repeat. Documents with the same words as an earlier one
are found by a digest of all their words first: they are repeats as a whole, so their windows need
no grouping.

Defined results: null text has no words; documents shorter than a window lose nothing; rows that share
a doc_id do not remove each other's words, and each gives its row; a null doc_id loses nothing and removes
nothing. Columns besides id and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.words import Block, binaries, blocks, mix
from gaugeflow.session import Scratch


COUNTERS = 1 << 15  # counters in a block of the sketch


def _anchors(b: Block, window: int, gram: int) -> np.ndarray:
    """The anchor of the window that starts at each word; those that leave their text are to be skipped."""
    low = b.windows(b.hashes(), gram)
    span, have = window - gram + 1, 1
    while have < span and len(low):
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64((1 << 40) - 1)).view(np.int64)  # 40 bits: equal ones by chance only raise an estimate


def _counters(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    """Each anchor's counter in a row of the sketch."""
    shift = np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(anchors.view(np.uint64) + shift) % np.uint64(width)).astype(np.int64)


def _partial_sketch(width: int, depth: int, held: int = 4_000_000):
    """The sketch of a partition's anchors: for each block the places of its counters and their values, 255 at most."""

    def summed(codes: list[np.ndarray]):
        import pyarrow as pa

        at, n = np.unique(np.concatenate(codes), return_counts=True)
        block, first = np.unique(at // COUNTERS, return_index=True)
        places, values = (at % COUNTERS).astype("<u2"), np.minimum(n, 255).astype(np.uint8)
        edges = [*zip(first, [*first[1:], len(at)], strict=True)]
        columns = [[x[i:j].tobytes() for i, j in edges] for x in (places, values)]
        return pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "places", "n"])

    def run(batches):
        codes, size = [], 0
        for batch in batches:
            anchors = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            codes += [row * width + _counters(anchors, row, width) for row in range(depth)]
            size += depth * len(anchors)
            if size > held:
                yield summed(codes)
                codes, size = [], 0
        if size:
            yield summed(codes)

    return run


def _repeated_counters(width: int):
    """The merged counters of one block that stand at two or more."""

    def run(pdf):
        import pandas as pd

        total = np.zeros(COUNTERS, np.int64)
        for places, n in zip(pdf["places"], pdf["n"], strict=True):
            total[np.frombuffer(places, "<u2")] += np.frombuffer(n, np.uint8)
        code = int(pdf["block"].iloc[0]) * COUNTERS + np.flatnonzero(total >= 2)
        return pd.DataFrame({"row": (code // width).astype(np.int32), "counter": code % width})

    return run


def _looked_up(width: int, depth: int):
    """A row for each document and anchor: the anchor's counter in each row of the sketch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            anchors = lists.flatten().to_numpy(zero_copy_only=False)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            counters = [pa.array(_counters(anchors, row, width)) for row in range(depth)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *counters], names=["doc_id", *(f"c{r}" for r in range(depth))])

    return run


def sketch_width(documents: DataFrame, load: float = 0.25) -> int:
    """The counters of a row for ``documents`` (``doc_id, anchors``), in whole blocks; ``load`` anchors share one on average."""
    total = documents.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    return max(COUNTERS, -(-int(total / load) // COUNTERS) * COUNTERS)


def estimated_repeats(documents: DataFrame, scratch: Scratch, width: int, depth: int = 2) -> DataFrame:
    """``doc_id, counter``, the first row's counters of those anchors of a document that the count-min sketch of all
    ``documents`` puts at two documents or more."""
    parts = documents.select("anchors").mapInArrow(_partial_sketch(width, depth), "block long, places binary, n binary")
    merged = parts.groupBy("block").applyInPandas(_repeated_counters(width), "row int, counter long")
    sketch = scratch.table(merged, "sketch")
    kinds = "doc_id long, " + ", ".join(f"c{r} long" for r in range(depth))
    found = documents.select("doc_id", "anchors").mapInArrow(_looked_up(width, depth), kinds)
    for r in reversed(range(depth)):
        found = found.join(sketch.where(F.col("row") == r).select(F.col("counter").alias(f"c{r}")), f"c{r}", "left_semi")
        found = found.drop(*[f"c{r}"] * (r > 0))
    return found.select("doc_id", F.col("c0").alias("counter"))


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _counter(window: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, n, key, anchors = binaries(batch.column(1)), [], [], []
            for b in blocks(texts):
                anchor = _anchors(b, window, gram)
                for j in range(b.hi - b.lo):
                    lo, hi = int(b.first[j]), int(b.first[j + 1])
                    n.append(hi - lo)
                    long = hi - lo >= window
                    key.append(_key(texts[b.lo + j].split()) if long else None)
                    anchors.append(np.unique(anchor[lo : hi - window + 1]) if long else anchor[:0])
            ends = np.cumsum([0, *map(len, anchors)], dtype=np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *anchors]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "n_words", "key", "anchors"])

    return run


def _window_hashes(window: int, gram: int, width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts, hot = batch.column(0).to_pylist(), binaries(batch.column(1)), batch.column(2)
            for b in blocks(texts):
                anchor, h1 = _anchors(b, window, gram), b.windows(b.hashes(), window)
                h2 = b.windows(b.hashes(seed=5), window, seed=6)
                rows = []
                for j in range(b.hi - b.lo):
                    lo, hi = int(b.first[j]), int(b.first[j + 1])
                    if hi - lo >= window:
                        own = hot[b.lo + j].values.to_numpy(zero_copy_only=False)
                        at = np.flatnonzero(np.isin(_counters(anchor[lo : hi - window + 1], 0, width), own))
                        if len(at):
                            rows.append((ids[b.lo + j], _key(texts[b.lo + j].split()), at, h1[lo + at], h2[lo + at]))
                if rows:
                    size = [len(r[2]) for r in rows]
                    key = pa.array([r[1] for r in rows], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), size)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], size), pa.int64()), key, pa.array(np.concatenate([r[2] for r in rows]), pa.int32()), *(pa.array(np.concatenate([r[k] for r in rows]).view(np.int64)) for k in (3, 4))], names=["doc_id", "key", "start", "h1", "h2"])

    return run


def _cutter(window: int, single_spaces: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts, whole, found = batch.column(0), binaries(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, n_removed, out, spans = [], [], [], []
            for text, all_of_it, repeats in zip(texts, whole, found, strict=True):
                words = (text or b"").split()
                starts = []
                if len(words) >= window and (all_of_it or repeats):
                    key = _key(words)
                    starts = range(len(words) - window + 1) if key in (all_of_it or ()) else sorted(s for r in repeats or () if r["key"] == key for s in r["starts"])
                cut: list[list[int]] = []
                for s in starts:
                    if cut and s <= cut[-1][1]:
                        cut[-1][1] = s + window
                    else:
                        cut.append([s, s + window])
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in cut))
                spans.append([{"first": s, "end": e} for s, e in cut])
                if cut and not single_spaces:
                    b = next(blocks([text]))
                    edges = [0, *(x for c in cut for x in c), len(words)]
                    kept = [b.data[b.start[s] : b.end[e - 1]] for s, e in zip(edges[::2], edges[1::2], strict=True) if s < e]
                    out.append(b" ".join(kept))
                elif single_spaces:
                    out.append(b" ".join([w for s, e in zip([0, *(c[1] for c in cut)], [*(c[0] for c in cut), len(words)], strict=True) for w in words[s:e]]))
                else:
                    out.append(text)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)], names=["doc_id", "text", "n_words", "n_removed", "removed"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16,
    depth: int = 2, load: float = 0.25, single_spaces: bool = False,
) -> DataFrame:
    """``doc_id, text, n_words, n_removed, removed`` for every row of ``docs``.

    ``text`` is what is kept: unchanged where nothing is removed, else the kept runs with their own
    spacing, joined by a space; with ``single_spaces`` always all kept words joined by one space.
    ``removed`` lists the word ranges [first, end) that went. ``depth`` and ``load`` shape the sketch.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = scratch.table(texts.mapInArrow(_counter(window, gram), "doc_id long, n_words long, key binary, anchors array<long>"), "base")
    known = base.where("doc_id is not null and key is not null")
    first = known.groupBy("key").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    copied = known.select("doc_id", "key").join(first.where("earliest < latest"), "key").where("doc_id > earliest").select("doc_id", "key").distinct()
    copied = scratch.table(copied, "copied")

    single = known.join(copied, ["doc_id", "key"], "left_anti").select("doc_id", "anchors")
    width = sketch_width(single, load)
    hot = estimated_repeats(single, scratch, width, depth).groupBy("doc_id").agg(F.collect_set("counter").alias("hot"))
    windows = texts.join(hot, "doc_id").select("doc_id", "text", "hot").mapInArrow(_window_hashes(window, gram, width), "doc_id long, key binary, start int, h1 long, h2 long")
    windows = scratch.table(windows, "windows")
    grouped = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count("*").alias("n"))
    repeated = scratch.table(grouped.where("earliest < latest"), "repeated")
    # a window with more than a 1000th of all rows meets its rows where they lie: there are at most 1000 such
    # windows, so they can be broadcast, and only the others' rows are dealt by hash
    common = repeated.where(F.col("n") > windows.count() / 1000)
    usual = windows.join(F.broadcast(common), ["h1", "h2"], "left_anti").join(repeated, ["h1", "h2"])
    found = windows.join(F.broadcast(common), ["h1", "h2"]).unionByName(usual).where("doc_id > earliest")
    repeats = found.groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"))
    repeats = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("key", "starts")).alias("repeats"))
    whole = copied.groupBy("doc_id").agg(F.collect_list("key").alias("whole"))
    cuts = scratch.table(whole.join(repeats, "doc_id", "full_outer"), "cuts")
    scratch.drop("base", "copied", "sketch", "windows", "repeated")
    joined = texts.join(cuts, "doc_id", "left").select("doc_id", "text", "whole", "repeats")
    return joined.mapInArrow(_cutter(window, single_spaces), "doc_id long, text string, n_words long, n_removed long, removed array<struct<first:long,end:long>>")
