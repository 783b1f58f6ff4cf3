"""Tables written piece by piece that survive being killed: a piece counts when, and only when, its commit is recorded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _filesystem(spark, path)
    return fs.exists(at)


class Ledger:
    """A table partitioned by the column ``key`` and the list of the pieces, its key values, that are done.

    ``write`` replaces whole pieces (dynamic partition overwrite) and then appends their commit, so a writer that dies in
    between leaves data that nobody reads and that the next attempt replaces; doing a piece twice changes nothing. ``root`` has
    to be a folder that driver and executors share. Keys are not null.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.kind = self.schema[key].dataType
        for part in ("data", "commits"):
            fs, at = _filesystem(spark, f"{self.root}/{part}")
            fs.mkdirs(at)

    def committed(self) -> DataFrame:
        """The pieces that are done, each once."""
        return self.spark.read.schema(f"`{self.key}` {self.kind.simpleString()}").parquet(f"{self.root}/commits").distinct()

    def pending(self, pieces: DataFrame) -> DataFrame:
        """The rows of ``pieces`` whose piece is not done."""
        return pieces.join(self.committed(), self.key, "left_anti")

    def read(self) -> DataFrame:
        """The rows of all pieces that are done."""
        data = self.spark.read.schema(self.schema).parquet(f"{self.root}/data")
        return data.join(self.committed(), self.key, "left_semi").select(self.schema.names)

    def write(self, rows: DataFrame, pieces: DataFrame | None = None) -> None:
        """Writes ``rows`` and commits ``pieces``, those of the rows if none are given; a piece without rows is empty."""
        held = rows.select(self.schema.names)
        held.write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(self.key).mode("overwrite").parquet(f"{self.root}/data")
        if pieces is None:
            pieces = self.spark.read.schema(self.schema).parquet(f"{self.root}/data").select(self.key).join(rows.select(self.key).distinct(), self.key, "left_semi")
        self.commit(pieces)

    def commit(self, pieces: DataFrame) -> None:
        pieces.select(F.col(self.key).cast(self.kind)).distinct().coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def run(self, inputs: DataFrame, make: Callable[[DataFrame], DataFrame], steps: int = 1) -> DataFrame:
        """``read`` after all pieces of ``inputs`` are done; ``make`` turns rows of whole pieces into rows of the table.

        The pieces are dealt to ``steps`` by hash and committed step by step, so at most one step is done again after a kill.
        """
        for step in range(steps):
            left = self.pending(inputs.where(F.pmod(F.xxhash64(self.key), F.lit(steps)) == step))
            if not left.isEmpty():
                pieces = left.select(self.key).distinct()
                self.write(make(left), pieces.persist())
                pieces.unpersist()
        return self.read()


def settings_key(settings: dict) -> str:
    """The first twelve digits of the SHA-256 of the settings' canonical text, as ``configs.merge_configs`` gives it."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:12]


def cached(spark: SparkSession, root: str, name: str, settings: dict, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table of ``make`` under a path named by its settings: read if it is there whole, else made and written."""
    path = f"{root.rstrip('/')}/{name}_{settings_key(settings)}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to a CSV folder; once this returns they can be read, whatever happens to the writer."""
    rows.write.mode("append").csv(path, header=True)
