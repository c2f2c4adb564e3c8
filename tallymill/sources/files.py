"""Readers and writers with the checks that records need: strict schemas, positions, digests, create-once markers."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import images as I
from tallymill.functions import vectors as V
from tallymill.operators.tables import violations


class InvalidInput(ValueError):
    """A source breaks its contract."""


def checked(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The frame itself, once no row breaks a rule."""
    bad = violations(df, key, rules).limit(5).collect()
    if bad:
        raise InvalidInput(f"rows break rules: {[(r[0], r['rule']) for r in bad]}")
    return df


def typed_csv(spark: SparkSession, path: str, schema: str, key: str, rules: dict[str, Column] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return checked(df, key, rules) if rules else df


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; a byte-order mark before the first name goes; no rows is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if df.isEmpty():
        raise InvalidInput(f"no rows in {path}")
    return df


def metric_report(spark: SparkSession, path: str) -> DataFrame:
    """A class report of unique labels."""
    df = text_csv(spark, path)
    if df.groupBy("label").count().where("count > 1").limit(1).count():
        raise InvalidInput("labels repeat")
    return df.withColumn("support", F.col("support").cast("long"))


def ordered_ids(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """(position, id) of a csv, json or text list; ids are unique and not blank. Position is the line's."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "json":
        items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "id"))
    else:
        lines = F.split(F.col("value"), r"\r?\n")
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("position", "line")).where("line != ''")
        items = rows.where("position > 0").select((F.col("position") - 1).alias("position"), F.split_part("line", F.lit(","), F.lit(1)).alias("id")) if kind == "csv" else rows.select("position", F.col("line").alias("id"))
    if items.isEmpty() or items.where("id is null or trim(id) = ''").limit(1).count() or items.groupBy("id").count().where("count > 1").limit(1).count():
        raise InvalidInput(f"ids of {path} are empty, blank or repeated")
    return items


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(embedding_index, vector)."""
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")


def agencies(df: DataFrame) -> DataFrame:
    """The six routing columns of agencies that have a place in range."""
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return df.where(ok).select("id", "name", "category", "latitude", "longitude", "is_active")


def seed_agencies(spark: SparkSession, path: str) -> DataFrame:
    return agencies(spark.read.option("multiLine", True).json(path))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def image_facts(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """The kept columns, `code` (64 bits of a PNG's upright grey values at 9 x 8; null without), `problem` (missing, unreadable or null) and
    `findings` (what its metadata gives away) of a column of file bytes. A damaged file is a row like any other."""

    def run(it):
        for pdf in it:
            small, problem, findings = [], [], []
            for data in pdf["content"]:
                values = None
                if data is not None and len(data):
                    try:
                        values = I.small_grey(bytes(data))
                    except (I.Unreadable, struct.error):
                        values = None
                small.append(values)
                there = data is not None and len(data)
                problem.append(None if values is not None else "unreadable" if there else "missing")
                findings.append(I.metadata_findings(bytes(data)) if there else [])
            yield pdf[keep].assign(small=small, problem=problem, findings=findings)

    rows = df.select(*keep, F.col(content).alias("content"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in df.select(*keep).dtypes)
    got = rows.mapInPandas(run, f"{kinds}, small array<int>, problem string, findings array<string>")
    return got.select(*keep, V.grey_code(F.col("small")).alias("code"), "problem", "findings")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _hadoop(path: str):
    """The file system of a path that is not local, and the path in it; None for local ones."""
    if "://" not in path or path.startswith("file:"):
        return None
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _local(path: str) -> Path:
    return Path("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else Path(path)


def _put(fs, at, data: bytes, overwrite: bool) -> None:
    out = fs.create(at, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def replace_file(fs, at, data: bytes) -> None:
    """Puts a file of a Hadoop file system in the place of one that may be there; readers see the one or the other."""
    spark = SparkSession.active()
    jvm = spark._jvm
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    _put(fs, part, data, True)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(part, at, how)


def create_file(fs, at, data: bytes) -> None:
    """Makes a file of a Hadoop file system that must not be there."""
    try:
        _put(fs, at, data, False)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise FileExistsError(at.toString()) from None
        raise


def write_json(path: str, value) -> None:
    """Whole or not at all, in a local folder or on any file system that Spark knows."""
    data, remote = (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode(), _hadoop(path)
    if remote:
        replace_file(*remote, data)
        return
    at = _local(path)
    part = at.with_name(f"{at.name}.{uuid.uuid4().hex}")
    part.write_bytes(data)
    os.replace(part, at)


def create_once(path: str, value) -> None:
    """A marker that can be set one time, by whoever comes first; the second attempt fails. The file system itself refuses a name that
    is there."""
    data, remote = canonical_json(value).encode(), _hadoop(path)
    if remote:
        create_file(*remote, data)
        return
    with open(_local(path), "xb") as f:
        f.write(data)


def file_record(path: str) -> dict:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return {"name": os.path.basename(path), "bytes": os.path.getsize(path), "sha256": digest.hexdigest()}


def write_predictions(df: DataFrame, path: str) -> None:
    """Gzip CSV with ten significant digits."""

    def short(c: str) -> Column:  # the formatter keeps zeros at the end
        digits = F.regexp_replace(F.format_string("%.10g", c), r"(\.\d*?)0+(e|$)", "$1$2")
        return F.when(F.col(c).isNotNull(), F.regexp_replace(digits, r"\.(e|$)", "$1"))

    as_text = [short(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*as_text).write.option("header", True).option("compression", "gzip").csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split; an existing output is refused."""
    df.write.partitionBy(split).mode("errorifexists").parquet(path)
