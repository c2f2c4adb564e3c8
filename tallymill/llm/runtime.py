"""What the operators of this subpackage share: input columns, shared folders, partition counts, small codecs."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.operators.components import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The shuffle width the session asks for. Buckets follow it, so that memory per bucket stays as it is when the input grows."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a local session without it (tests, a laptop) gets one under /tmp."""
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: rows are in the shared folder and outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own setting: a query's shuffle files go when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one job in a folder of its own in the shared folder. Lineage ends in them as in a checkpoint, and the shuffle
    files behind each go once it is written, so that the disk a job needs is that of its widest step."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.path, self.tables = spark, new_path(spark, what), {}

    def save(self, df: DataFrame) -> DataFrame:
        path, before = f"{self.path}/{len(self.tables)}", self.spark.conf.get(FREE, None)
        self.spark.conf.set(FREE, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(FREE) if before is None else self.spark.conf.set(FREE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[path] = out
        return out

    def clear(self, but: DataFrame | None = None) -> None:
        """Removes the tables, all but one that a result still reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p, t in self.tables.items() if t is not but]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            self.tables[path] = None


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def text_bytes(column) -> F.Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def quoted(name: str) -> str:
    """A column's name for expressions, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> F.Column:
    """All columns as one struct, `rest`."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("rest")


def nullable(kind: T.DataType) -> T.DataType:
    """The type with every part nullable: what Python tasks return is declared so."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def with_rest(fields: str, docs: DataFrame) -> T.StructType:
    """The fields given as text and `rest`."""
    return T.StructType([*T.StructType.fromDDL(fields), T.StructField("rest", nullable(T.StructType(docs.schema.fields)))])


def _loose(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _loose(f.type), metadata=f.metadata) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(pa.field(kind.key_field.name, _loose(kind.key_type), False), pa.field(kind.item_field.name, _loose(kind.item_type)))
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _loose(kind.value_type)))
    return kind


def texts_of(batch, text_column: str) -> list[bytes]:
    """A batch's texts as UTF-8: its `text` column, or the field of `rest`, so that a text travels once."""
    if "text" in batch.schema.names:
        return batch.column("text").to_pylist()
    rest = batch.column("rest")
    return [b"" if t is None else t for t in rest.field(rest.type.get_field_index(text_column)).cast(pa.binary()).to_pylist()]


def in_rest(docs: DataFrame, text_column: str) -> bool:
    """Whether `rest` has the text as it is wanted."""
    return isinstance(docs.schema[text_column].dataType, T.StringType) and docs.columns.count(text_column) == 1


def loosened(column):
    """An Arrow column of a Python task as nullable() declares it."""
    return column.cast(_loose(column.type))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of fixed width, one after the other; read back by unpack with the same dtypes."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    return struct.pack(f"<{len(parts)}q", *(len(a) for a in parts)) + b"".join(a.tobytes() for a in parts)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(dtypes)}q", blob), 8 * len(dtypes), []
    for n, t in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(blob, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out
