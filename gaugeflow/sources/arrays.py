"""Tables of arrays in npz files: a Python data source, and the windows and normalizers kept in such files.

A member with one axis is a column of scalars, with two a column of arrays, with three one of arrays of arrays; a member without
axes is the same value in every row. ``row`` is a row's place in its file. A partition is a file, read some rows at a time,
and only the members that the schema names are. Filters by ``=`` and ``in`` on scalar members are applied by the reader
first: a file without a match is not read any further (with ``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gaugeflow.sources.two_phase import TwoPhaseWriter, listed, opened

# The names of a window's channels, in the order of their places.
CHANNELS = (
    "convective_fraction", "longwave_radiation", "potential_energy", "potential_evaporation", "pressure", "shortwave_radiation",
    "specific_humidity", "temperature", "total_precipitation", "wind_u", "wind_v", "specific_discharge",
)
SPLITS = {"train": 0, "validation": 1}  # fixed values of the flag

_KINDS = {"f4": T.FloatType(), "f8": T.DoubleType(), "f2": T.FloatType(), "i8": T.LongType(), "i4": T.IntegerType(), "i2": T.ShortType(), "i1": T.ByteType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "b1": T.BooleanType()}
_STORED = {T.FloatType: "f4", T.DoubleType: "f8", T.LongType: "i8", T.IntegerType: "i4", T.ShortType: "i2", T.ByteType: "i1", T.BooleanType: "b1", T.StringType: "U"}


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)


class _Members:
    """The members of one npz file, whole or some rows at a time."""

    def __init__(self, path: str, at: str):
        self.zip = zipfile.ZipFile(opened(path)[0].open_input_file(at))
        self.shapes = {}
        for name in self.zip.namelist():
            with self.zip.open(name) as f:
                self.shapes[name.removesuffix(".npy")] = _header(f)
        self.rows = max((shape[0] for shape, _, _ in self.shapes.values() if shape), default=1)

    def whole(self, name: str) -> np.ndarray:
        with self.zip.open(f"{name}.npy") as f:
            return np.lib.format.read_array(f, allow_pickle=False)

    def blocks(self, name: str, size: int) -> Iterator[np.ndarray]:
        shape, fortran, kind = self.shapes[name]
        if not shape or fortran:
            all_of = np.broadcast_to(self.whole(name), (self.rows,)) if not shape else self.whole(name)
            yield from (all_of[lo : lo + size] for lo in range(0, self.rows, size))
            return
        width = kind.itemsize * int(np.prod(shape[1:]))
        with self.zip.open(f"{name}.npy") as f:
            _header(f)
            for lo in range(0, self.rows, size):
                n = min(size, self.rows - lo)
                yield np.frombuffer(f.read(n * width), kind).reshape((n, *shape[1:]))


def _type(shape: tuple[int, ...], kind: np.dtype) -> T.DataType:
    found = T.StringType() if kind.kind == "U" else _KINDS[kind.str[1:]]
    for _ in shape[1:]:
        found = T.ArrayType(found)
    return found


def _arrow(values: np.ndarray, kind):
    import pyarrow as pa

    if values.ndim == 1:
        return pa.array(values.tolist() if values.dtype.kind in "Ub" else values.astype(values.dtype.newbyteorder("=")), kind)
    n = values.shape[1]
    inner = _arrow(values.reshape((-1, *values.shape[2:])), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * n), inner)


class _File(InputPartition):
    def __init__(self, at: str):
        self.at = at


class NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, block: int):
        self.path, self.schema, self.block, self.wanted = path, schema, block, []

    def pushFilters(self, filters: list[Filter]):
        scalar = {f.name for f in self.schema.fields if not isinstance(f.dataType, T.ArrayType) and f.name != "row"}
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in scalar and getattr(f, "value", 0) is not None:
                self.wanted.append((f.attribute[0], [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]))
            else:
                yield f

    def partitions(self):
        return [_File(at) for at in listed(self.path, ".npz")]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        members, arrow = _Members(self.path, partition.at), to_arrow_schema(self.schema)
        keep = np.ones(members.rows, bool)
        for name, values in self.wanted:
            keep &= np.isin(members.whole(name), values)  # a member without axes is one value for all rows
        if not keep.any():
            return
        streams = {f.name: members.blocks(f.name, self.block) for f in self.schema.fields if f.name != "row"}
        for lo in range(0, members.rows, self.block):
            some = {name: next(s) for name, s in streams.items()}
            of = np.flatnonzero(keep[lo : lo + self.block])
            if len(of):
                some["row"] = lo + np.arange(min(self.block, members.rows - lo))
                yield pa.RecordBatch.from_arrays([_arrow(some[f.name][of], f.type) for f in arrow], schema=arrow)


class NpzWriter(TwoPhaseWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, rows: int):
        super().__init__(path, overwrite)
        self.schema, self.rows = schema, rows

    def parts(self, batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, self.rows):
                held.append(batch.slice(lo, self.rows))
                n += held[-1].num_rows
                if n >= self.rows:
                    yield self._part(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield self._part(pa.Table.from_batches(held))

    def _part(self, table) -> tuple[str, bytes]:
        members = {f.name: _stacked(f.name, table.column(f.name).combine_chunks(), f.dataType) for f in self.schema.fields}
        out = io.BytesIO()
        np.savez(out, **members)
        return f"part-{uuid.uuid4().hex}.npz", out.getvalue()


def _stacked(name: str, column, kind: T.DataType) -> np.ndarray:
    """An Arrow column as one array; nulls are NaN in floats and not allowed elsewhere, nor are arrays of several lengths."""
    n, shape = len(column), []
    while isinstance(kind, T.ArrayType):
        size = np.diff(column.offsets.to_numpy())
        if column.null_count or (size != size[:1]).any():
            raise ValueError(f"arrays of {name} are null or differ in length")
        shape.append(int(size[0]) if len(size) else 0)
        column, kind = column.flatten(), kind.elementType
    if type(kind) not in _STORED:
        raise ValueError(f"{name} has a type that npz files don't hold: {kind.simpleString()}")
    if column.null_count and not isinstance(kind, T.FloatType | T.DoubleType):
        raise ValueError(f"{name} holds nulls")
    stored = _STORED[type(kind)]
    values = np.array(column.to_pylist(), "U") if stored == "U" else column.to_numpy(zero_copy_only=False).astype(stored)
    return values.reshape((n, *shape))


class NpzSource(DataSource):
    """Format ``npz``: options ``path``, ``block`` (rows read at a time) and ``rows`` (of a written file, at most)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        files = listed(self.options["path"], ".npz")
        if not files:
            raise ValueError(f"no npz files in {self.options['path']}")
        found = _Members(self.options["path"], files[0]).shapes
        return T.StructType([T.StructField("row", T.LongType()), *(T.StructField(n, _type(shape, kind)) for n, (shape, _, kind) in found.items())])

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(self.options["path"], schema, int(self.options.get("block", 1024)))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], schema, overwrite, int(self.options.get("rows", 4096)))


def read_npz(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(NpzSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("npz")
    return (reader.schema(schema) if schema else reader).load(path)


def write_npz(rows: DataFrame, path: str, mode: str = "overwrite", per_file: int = 4096) -> None:
    rows.sparkSession.dataSource.register(NpzSource)
    rows.write.format("npz").option("rows", per_file).mode(mode).save(path)


def read_windows(spark: SparkSession, path: str, split: str, channels: Sequence[str] = CHANNELS, names: Sequence[str] = CHANNELS) -> DataFrame:
    """``row, basin_id, split, y`` and an array over the hours for each of ``channels``, of one side: train, validation or all.

    Files without targets are test files; they have the sides test and all, and no ``split`` and ``y``. Unknown sides and
    channels raise ValueError before anything is read. The side is filtered by the reader.
    """
    unknown = [c for c in channels if c not in names]
    if unknown:
        raise ValueError(f"unknown channels: {', '.join(unknown)}")
    labelled = "y" in read_npz(spark, path).columns
    sides = (*SPLITS, "all") if labelled else ("test", "all")
    if split not in sides:
        raise ValueError(f"the split has to be one of {', '.join(sides)}, not {split}")
    own = "row long, basin_id int, split int, X array<array<float>>, y array<float>" if labelled else "row long, basin_id int, X array<array<float>>"
    found = read_npz(spark, path, own)
    if split in SPLITS:
        found = found.where(F.col("split") == SPLITS[split])
    channel = lambda c: F.transform("X", lambda hour: hour[names.index(c)]).alias(c)
    return found.select("row", "basin_id", *(["split", "y"] if labelled else []), *(channel(c) for c in channels))


def write_normalizer(norm: DataFrame, path: str, strategy: str) -> None:
    """``basin_id, channel, mean, std`` with places from 0 without gaps, as a file of one row a basin."""
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("channel", c))), lambda x: x[c]).alias(c)
    rows = norm.groupBy("basin_id").agg(of("mean"), of("std")).withColumn("strategy", F.lit(strategy))
    write_npz(rows.repartitionByRange(1, "basin_id").sortWithinPartitions("basin_id"), path, per_file=1 << 20)


def read_normalizer(spark: SparkSession, path: str) -> DataFrame:
    """``basin_id, channel, mean, std, strategy``; without ids in the file a basin's id is its row's place."""
    found = read_npz(spark, path)
    basin = F.col("basin_id" if "basin_id" in found.columns else "row").cast("int").alias("basin_id")
    strategy = (F.col("strategy") if "strategy" in found.columns else F.lit(None).cast("string")).alias("strategy")
    each = found.select(basin, strategy, F.posexplode(F.arrays_zip("mean", "std")).alias("channel", "m"))
    return each.select("basin_id", "channel", F.col("m.mean").alias("mean"), F.col("m.std").alias("std"), "strategy")
