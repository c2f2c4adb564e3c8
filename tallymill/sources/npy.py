"""Arrays in `.npy` files as a Spark source and a resumable sink.

A path is one file or a folder of part files. A part is named by the rows it holds (`rows-<first>-<end>.npy`), so a folder is an array cut
into ranges and a part that is there need not be written again. Reading is by ranges of rows: each partition maps its own bytes of one
file and no task sees the whole; comparisons of the row index with constants are settled by the ranges themselves and never reach Spark.

Rows are (`position`, `value`) for arrays of one dimension and (`embedding_index`, `vector`) for two. Text arrays give strings. A header that is
not of the format, an array in Fortran order, of another rank or of objects, a file shorter or longer than its header says, and part
names with gaps or overlaps are errors before any task starts.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tallymill.sources.files import InvalidInput

#: Rows of a partition, and of a part file.
ROWS = 16_384
#: Bytes of one Arrow batch.
BATCH_BYTES = 1 << 22
_NAME = re.compile(r"rows-(\d+)-(\d+)\.npy$")
_KINDS = {"f4": T.FloatType(), "f8": T.DoubleType(), "i4": T.IntegerType(), "i8": T.LongType()}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    uri = path if "://" in path or path.startswith("/") else re.sub(r"^file:/*", "file:///", path)
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Part:
    """One file: rows first to first + rows of the array, from byte `offset` on."""

    path: str
    first: int
    rows: int
    width: int
    dtype: str
    offset: int

    @property
    def kind(self) -> str:
        return "U" if np.dtype(self.dtype).kind == "U" else self.dtype[1:]

    @property
    def row_bytes(self) -> int:
        return max(1, self.width) * np.dtype(self.dtype).itemsize


def header(fs: pafs.FileSystem, path: str, first: int = 0) -> Part:
    """A file's header, checked against its size."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        head = io.BytesIO(f.read(min(size, 1 << 16)))
    try:
        version = np.lib.format.read_magic(head)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(head)
    except (ValueError, EOFError) as e:
        raise InvalidInput(f"{path}: not an array file: {e}") from e
    plain = dtype.kind == "U" or dtype.str[1:] in _KINDS
    if fortran or len(shape) not in (1, 2) or not plain or dtype.byteorder == ">" or (dtype.kind == "U" and len(shape) == 2):
        raise InvalidInput(f"{path}: needs one or two dimensions of plain numbers, or one of text, in C order")
    part = Part(path, first, shape[0], shape[1] if len(shape) == 2 else 0, dtype.str, head.tell())
    if size != part.offset + part.rows * part.row_bytes and math.prod(shape):
        raise InvalidInput(f"{path}: {size} bytes where the header asks for {part.offset + part.rows * part.row_bytes}")
    return part


def parts_of(path: str) -> list[Part]:
    """The files of an array in order. Only headers are read."""
    fs, at = opened(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [header(fs, at)]
    named = sorted((int(m[1]), int(m[2]), i.path) for i in fs.get_file_info(pafs.FileSelector(at)) if (m := _NAME.search(i.path)))
    if not named:
        raise InvalidInput(f"no part files in {path}")
    out, end = [], 0
    for first, stop, p in named:
        part = header(fs, p, first)
        if first != end or stop != first + part.rows or (out and (part.width, part.kind) != (out[0].width, out[0].kind)):
            raise InvalidInput(f"{p}: does not go on where the part before ends ({end}), or is of another kind")
        out.append(part)
        end = stop
    return out


@dataclass
class RowRange(InputPartition):
    part: Part
    start: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int, schema: T.StructType) -> None:
        self.path, self.rows, self.index = path, rows, schema[0].name
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of the index are settled here; a list of indexes only narrows the range."""
        for f in filters:
            mine = getattr(f, "attribute", None) == (self.index,)
            if mine and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, int):
                self._narrow(f.value, f.value + 1)
            elif mine and isinstance(f, GreaterThan):
                self._narrow(f.value + 1, self.high)
            elif mine and isinstance(f, GreaterThanOrEqual):
                self._narrow(f.value, self.high)
            elif mine and isinstance(f, LessThan):
                self._narrow(self.low, f.value)
            elif mine and isinstance(f, LessThanOrEqual):
                self._narrow(self.low, f.value + 1)
            elif not (mine and isinstance(f, IsNotNull)):
                known = [v for v in f.value if v is not None] if mine and isinstance(f, In) else []
                if known:
                    self._narrow(min(known), max(known) + 1)
                yield f

    def _narrow(self, low: int, high: int) -> None:
        self.low, self.high = max(self.low, low), min(self.high, high)

    def partitions(self) -> list[RowRange]:
        out = []
        for p in parts_of(self.path):
            start, stop = max(self.low, p.first), min(self.high, p.first + p.rows)
            out += [RowRange(p, a, min(a + self.rows, stop)) for a in range(start, stop, self.rows)]
        return out or [RowRange(Part(self.path, 0, 0, 0, "<f4", 0), 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        p, step = partition.part, max(1, BATCH_BYTES // partition.part.row_bytes)
        if partition.start >= partition.stop:
            return
        fs, _ = opened(self.path)
        local = isinstance(fs, pafs.LocalFileSystem)
        with pa.memory_map(p.path) if local else fs.open_input_file(p.path) as f:
            for a in range(partition.start, partition.stop, step):
                b = min(a + step, partition.stop)
                raw = f.read_at((b - a) * p.row_bytes, p.offset + (a - p.first) * p.row_bytes)
                yield _batch(np.frombuffer(raw, dtype=p.dtype), p.width, a, b)


def _batch(values: np.ndarray, width: int, a: int, b: int) -> pa.RecordBatch:
    index = pa.array(np.arange(a, b, dtype=np.int64))
    if not width:
        return pa.record_batch({"position": index, "value": pa.array(values.tolist(), type=pa.string()) if values.dtype.kind == "U" else pa.array(values)})
    ends = pa.array(np.arange(0, (b - a + 1) * width, width, dtype=np.int32))
    return pa.record_batch({"embedding_index": index, "vector": pa.ListArray.from_arrays(ends, pa.array(values))})


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class NpyWriter(DataSourceArrowWriter):
    """Rows come by part and in order; each part is written aside and then named, so that a part is whole or not there."""

    def __init__(self, path: str, rows: int, width: int) -> None:
        self.path, self.rows, self.width, self.run = path, rows, width, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        names, held, number = [], [], None
        for batch in iterator:
            index = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            turns = np.flatnonzero(np.diff(index // self.rows)) + 1
            for a, b in zip(np.append(0, turns), np.append(turns, len(index)), strict=True):
                if a == b:
                    continue
                if number is not None and index[a] // self.rows != number:
                    names.append(self._save(fs, at, held))
                    held = []
                number = index[a] // self.rows
                held.append((index[a:b], batch.column(1).slice(a, b - a)))
        if held:
            names.append(self._save(fs, at, held))
        return Written(names)

    def _save(self, fs: pafs.FileSystem, at: str, held: list) -> str:
        index = np.concatenate([i for i, _ in held])
        first = int(index[0])
        if first % self.rows or (index != first + np.arange(len(index))).any():
            raise InvalidInput(f"indexes from {first} on repeat, skip or lack their beginning")
        array = np.concatenate([self._values(v) for _, v in held])
        name, aside = f"rows-{first:015d}-{first + len(index):015d}.npy", f"{at}/_{self.run}-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            np.lib.format.write_array_header_2_0(f, np.lib.format.header_data_from_array_1_0(array))
            f.write(np.ascontiguousarray(array).tobytes())
        fs.move(aside, f"{at}/{name}")
        return name

    def _values(self, column: pa.Array) -> np.ndarray:
        if not self.width:
            got = column.to_pylist() if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
            if column.null_count or (isinstance(got, list) and any("\0" in x for x in got)):
                raise InvalidInput("an array has no place for nulls, nor text for NUL")
            return np.array(got)
        flat = column.flatten()
        if column.null_count or flat.null_count or len(flat) != len(column) * self.width or (np.diff(column.offsets.to_numpy()) != self.width).any():
            raise InvalidInput(f"vectors must have {self.width} components, none of them null")
        return flat.to_numpy(zero_copy_only=False).reshape(-1, self.width)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        """Parts that are whole stay: the next run goes on from them."""
        self._clear()

    def _clear(self) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            for i in fs.get_file_info(pafs.FileSelector(at)):
                if i.base_name.startswith(f"_{self.run}"):
                    fs.delete_file(i.path)


class NpySource(DataSource):
    """spark.read.format("npy").load(path); options: rows, of a partition or a part file, and width, for writing."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        p = parts_of(self.options["path"])[0]
        kind = T.StringType() if np.dtype(p.dtype).kind == "U" else _KINDS[p.dtype[1:]]
        if p.width:
            return T.StructType([T.StructField("embedding_index", T.LongType()), T.StructField("vector", T.ArrayType(kind))])
        return T.StructType([T.StructField("position", T.LongType()), T.StructField("value", kind)])

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", ROWS)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NpyWriter:
        if overwrite:
            raise InvalidInput("an array is added to, not replaced")
        return NpyWriter(self.options["path"], int(self.options.get("rows", ROWS)), int(self.options.get("width", 0)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(embedding_index, vector) or (position, value) of an array, `rows` rows to a partition."""
    register(spark)
    return spark.read.format("npy").option("rows", rows).load(path)


def stored_parts(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(part, stored): which parts are there, whole, with how many rows. As many rows as files."""
    fs, at = opened(path)
    found = []
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        for i in fs.get_file_info(pafs.FileSelector(at)):
            m = _NAME.search(i.path)
            if m:
                try:
                    p = header(fs, i.path, int(m[1]))
                except InvalidInput:
                    continue
                if p.first % rows == 0 and p.first + p.rows == int(m[2]):
                    found.append((p.first // rows, p.rows))
    return spark.createDataFrame(found, "part long, stored long")


def write_npy(df: DataFrame, path: str, index: str, values: str, rows: int = ROWS) -> DataFrame:
    """Writes the parts that are not there with as many rows as df has for them, and returns (part, rows, written) for all parts.

    index: numbers from 0 without gaps; values: vectors of one length, numbers or text. A run that was stopped goes on where it
    was; what is there whole is neither read from df's values nor written again. Stale parts of other sizes are replaced.
    """
    spark = df.sparkSession
    register(spark)
    placed = df.select(F.col(index).cast("long").alias("at"), F.col(values).alias("value"), F.floor(F.col(index) / F.lit(rows)).cast("long").alias("part"))
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    there = stored_parts(spark, path, rows)
    todo = counts.join(there, (counts.part == there.part) & (F.col("rows") == F.col("stored")), "left_anti")
    plan = counts.join(todo.select("part", F.lit(True).alias("written")), "part", "left").select("part", "rows", F.coalesce("written", F.lit(False)).alias("written"))
    report = [tuple(r) for r in plan.collect()]  # as many rows as files
    _drop_stale(path, rows, {p: n for p, n, _ in report})
    width = 0
    if isinstance(df.schema[values].dataType, T.ArrayType):
        first = df.where(F.col(values).isNotNull()).select(F.size(values).alias("n")).first()
        width = first.n if first else 0
    missing = [p for p, _, w in report if w]
    if missing:
        wanted = spark.createDataFrame([(p,) for p in missing], "part long")
        ready = placed.join(wanted, "part", "left_semi").repartition(len(missing), "part").sortWithinPartitions("part", "at").select("at", "value")
        ready.write.format("npy").option("rows", rows).option("width", width).mode("append").save(path)
    return spark.createDataFrame(report, "part long, rows long, written boolean")


def _drop_stale(path: str, rows: int, counts: dict[int, int]) -> None:
    """Parts that are damaged or of another size than they should be now."""
    fs, at = opened(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return
    for i in fs.get_file_info(pafs.FileSelector(at)):
        if m := _NAME.search(i.path):
            first, stop = int(m[1]), int(m[2])
            try:
                whole = header(fs, i.path, first).rows == stop - first
            except InvalidInput:
                whole = False
            if not whole or first % rows or counts.get(first // rows) != stop - first:
                fs.delete_file(i.path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(position, id) of a list of ids in an array; blank or repeated ids are an error."""
    df = read_npy(spark, path).select("position", F.col("value").cast("string").alias("id"))
    if df.isEmpty() or df.where("id is null or trim(id) = ''").limit(1).count() or df.groupBy("id").count().where("count > 1").limit(1).count():
        raise InvalidInput(f"ids of {path} are empty, blank or repeated")
    return df
