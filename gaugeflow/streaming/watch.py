"""Folders of runs that are watched: a board kept up to date, and work that waits for files."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.operators import reports
from gaugeflow.sources.ledger import Ledger, exists
from gaugeflow.sources.runs import SUMMARY, run_name

SEEN = "batch long, run string, dev_median_nse double, modified timestamp"
BOARD = "batch long, place long, run string, value double, delta double, class string"


def file_ages(spark: SparkSession, files: str, now: str | None = None) -> DataFrame:
    """``run, file, minutes``: how long ago each file was written, as of ``now`` (the current time without it). The files
    themselves are not read; those without content are not listed."""
    found = spark.read.format("binaryFile").load(files).select(run_name().alias("run"), F.col("_metadata.file_name").alias("file"), "modificationTime")
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return found.select("run", "file", ((at.cast("double") - F.col("modificationTime").cast("double")) / 60).alias("minutes"))


def board_of(seen: DataFrame, bar: float) -> DataFrame:
    """The board of the latest summary of each run that has a score."""
    last = seen.groupBy("run").agg(F.max_by("dev_median_nse", F.struct("modified", "batch")).alias("dev"))
    return reports.board(last.where("dev is not null"), "dev", bar)


def watch_board(spark: SparkSession, root: str, out: str, bar: float, every: str | None = "30 seconds", files: str = "summary*.json") -> StreamingQuery:
    """Follows the ``files`` in the folders of ``root`` and publishes a board in ``out`` after each batch of new files; ``current_board`` reads it.

    Without ``every`` it takes what is there and ends. Batches are pieces of two ledgers named by their number, so a
    batch that is done again after a kill replaces its rows. A file counts once, when it appears; a run that is scored
    again writes another file that matches.
    """
    seen, boards = Ledger(spark, f"{out}/seen", SEEN, "batch"), Ledger(spark, f"{out}/boards", BOARD, "batch")
    found = spark.readStream.schema(SUMMARY).option("multiLine", True).option("allowNonNumericNumbers", True).json(f"{root}/*/{files}")
    rows = found.select(run_name().alias("run"), "dev_median_nse", F.col("_metadata.file_modification_time").alias("modified"))

    def publish(batch: DataFrame, number: int) -> None:
        own = spark.range(1).select(F.lit(number).cast("long").alias("batch"))
        seen.write(batch.withColumn("batch", F.lit(number).cast("long")), own)
        boards.write(board_of(seen.read(), bar).withColumn("batch", F.lit(number).cast("long")), own)

    writer = rows.writeStream.foreachBatch(publish).option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def current_board(spark: SparkSession, out: str) -> DataFrame:
    """The board of the last batch that is published."""
    boards = Ledger(spark, f"{out}/boards", BOARD, "batch")
    last = boards.committed().agg(F.max("batch").alias("batch"))
    return boards.read().join(F.broadcast(last), "batch").drop("batch")  # one row


def wait_for_files(spark: SparkSession, folder: str, names: Sequence[str], action: Callable[[], None], out: str, every: float = 30.0, rounds: int | None = None) -> bool:
    """Runs ``action`` once all of ``names`` have appeared in ``folder``, and says whether it has run.

    It looks every ``every`` seconds, ``rounds`` times or without end; empty files count. That the action ended is kept in
    ``out``: one that failed or was killed runs again, one that ended never does.
    """
    done = Ledger(spark, f"{out}/done", "name string", "name")
    wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    look = 0
    while not done.pending(wanted).isEmpty():
        if rounds is not None and look >= rounds:
            return False
        if look:
            time.sleep(every)
        look += 1
        if all(exists(spark, f"{folder}/{n}") for n in names):
            action()
            done.commit(wanted)
    return True
