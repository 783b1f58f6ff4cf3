"""Tables that outlive executors: written to the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; on a cluster
    executors would not share that, so there RuntimeError is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gaugeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_COLLECTED: list[list[Scratch]] = []


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Deletes the tables of every ``Scratch`` made within at the end; what is to stay has to be written to one made before."""
    made: list[Scratch] = []
    _COLLECTED.append(made)
    try:
        yield
    finally:
        _COLLECTED.remove(made)
        for scratch in made:
            scratch.drop("")


class Scratch:
    """Written tables of one job under the shared folder.

    ``table`` writes a DataFrame as Parquet and reads it again, so that the lineage ends there and a
    lost executor costs a reread. ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        for made in _COLLECTED:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
