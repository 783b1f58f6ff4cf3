"""Packing of token pieces into as few sequences as possible (operator 8).

Pieces are dealt evenly into partitions and each is packed best-fit decreasing. A family of dual
feasible functions bounds the partition's bin count from below. Where the count equals the bound the
partition is certified: it keeps its bins but for the emptiest, whose rest the others can use. A
partition with a gap gives up all bins that are not full. What is given up is dealt anew over fewer
partitions and packed again, until one partition holds all of it or the rounds end; then every bin
stays. A partition's size is bounded by ``part_rows`` and nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.tokens import encoder
from gaugeflow.session import Scratch


def token_pieces(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: each whole text's ids and ``end_id``, cut into ``capacity`` pieces.

    Only texts longer than ``capacity`` are cut; the first piece takes what the others leave over. ``ids``
    are little-endian unsigned 32-bit numbers. Null and empty texts give one piece of ``end_id``.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        encode = encoder(*vocabulary)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(i, k, s, e - s, ids[4 * s : 4 * e]) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual feasible functions u_e, e = 0..capacity/2: lengths over capacity - e count as
    whole bins, those under e as nothing, and the rest fill what the lengths over half leave."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n_up, s_up = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    e = np.arange(half + 1)
    big = n_up[capacity] - n_up[half]
    middle_n, middle_s = n_up[capacity - e] - n_up[half], s_up[capacity - e] - s_up[half]
    small = s_up[half] - np.where(e > 0, s_up[np.maximum(e - 1, 0)], 0)
    return int(np.max(big + np.maximum(0, -((middle_n * capacity - middle_s - small) // capacity))))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each length's bin and its offset there, and each bin's fill."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fill = 0, []  # open_: bit r is set if some bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            rooms[room - n].append(b)
            open_ |= 1 << (room - n)
    return place, offset, np.array(fill, np.int64)


def _packer(capacity: int, k: int, last: bool):
    def run(pdf):
        lengths = pdf["length"].to_numpy()
        bins, offset, fill = best_fit_decreasing(lengths, capacity)
        stays = np.ones(len(fill), bool)
        if not last and len(fill) == lower_bound(lengths, capacity):
            stays[np.argmin(fill)] = False
        elif not last:
            stays = fill == capacity
        pdf["sequence_id"] = 2 * (((k << 22) + pdf["part"].to_numpy(np.int64)) * (1 << 20) + bins)
        pdf["offset"], pdf["stays"] = offset, stays[bins]
        return pdf[["_row", "length", "sequence_id", "offset", "stays"]]

    return run


def pack(pieces: DataFrame, capacity: int = 2048, part_rows: int = 20_000, rounds: int = 6, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; existing columns of these names are replaced.

    Lengths must be 1..capacity (else the job fails); a piece of full length is a sequence of its own.
    Repeated rows are separate pieces. No rows give no rows.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    fits = F.col(length_col).between(1, capacity)
    checked = pieces.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("a length is not in 1..capacity")).cast("boolean")))
    kept = scratch.table(checked.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    placed = kept.where(F.col(length_col) == capacity).select("_row", (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = kept.where(F.col(length_col) < capacity).select("_row", F.col(length_col).cast("long").alias("length"))
    for k in range(rounds):
        n = rest.count()
        if not n:
            break
        parts = -(-n // part_rows)
        last = parts == 1 or k == rounds - 1

        dealt = rest.withColumn("part", F.pmod(F.xxhash64("_row", F.lit(k)), F.lit(parts)))
        done = scratch.table(dealt.groupBy("part").applyInPandas(_packer(capacity, k, last), "_row long, length long, sequence_id long, offset long, stays boolean"), f"round-{k}")
        placed = placed.union(done.where("stays").select("_row", "sequence_id", "offset"))
        rest = done.where("not stays").select("_row", "length")
    return kept.join(placed, "_row").drop("_row")
