"""Tables behind a paged JSON interface as a Spark source, with filters and columns sent to where the rows are.

A path is an `http(s)://` address that answers like a REST view of a table (columns in `select`, comparisons as `column=op.value`, `order`,
`limit`, `offset`, the number of rows in `Content-Range`), or a folder of page files written by `write_pages`. Each page is a partition. The
columns of the schema that the reader is given are all that is asked for; comparisons with constants, `in` and null tests on them are
put into each request, or, for files, first held against the page's least and greatest values, so that pages without a row of interest
are not opened. What a source can't test is left to Spark.

Every row is checked against the schema: a column that is missing or of another type is an error, as is a page that is shorter than asked for
or changes between the count and the read. A request is tried again a few times after a refusal or a server's error, never after a client's
error; headers (credentials among them) are options named `header.<name>` and never shown in errors.
"""

from __future__ import annotations

import json
import math
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

from tallymill.sources.files import InvalidInput
from tallymill.sources.npy import opened

PAGE_ROWS, TRIES, SECONDS = 1000, 4, 30
#: The column of the index that names a page, and its number of rows.
INDEX = "_pages.json"


@dataclass(frozen=True)
class Test:
    """A comparison that a page can be asked for."""

    column: str
    op: str
    value: object = None

    def query(self) -> tuple[str, str]:
        if self.op == "in":
            return self.column, "in.(" + ",".join(_literal(v, quote=True) for v in self.value) + ")"
        if self.op in ("null", "notnull"):
            return self.column, "is.null" if self.op == "null" else "not.is.null"
        if isinstance(self.value, bool):
            return self.column, f"is.{_literal(self.value)}"
        return self.column, f"{self.op}.{_literal(self.value)}"

    def holds(self, v) -> bool:
        if self.op in ("null", "notnull"):
            return (v is None) == (self.op == "null")
        if v is None:
            return False
        return v in self.value if self.op == "in" else _COMPARE[self.op](v, self.value)

    def may_hold(self, low, high, nulls: int, rows: int) -> bool:
        """Whether a page whose values lie from low to high can have such a row."""
        if self.op == "null":
            return nulls > 0
        if nulls == rows:
            return False
        if low is None or self.op == "notnull":
            return True
        if self.op == "in":
            return any(low <= x <= high for x in self.value)
        return {"eq": low <= self.value <= high, "gt": high > self.value, "gte": high >= self.value, "lt": low < self.value, "lte": low <= self.value}[self.op]


#: As Spark compares: NaN is above every number.
_COMPARE: dict[str, Callable] = {"eq": lambda a, b: a == b, "gt": lambda a, b: a != a or a > b, "gte": lambda a, b: a != a or a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
_OPS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


def _literal(v, quote: bool = False) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str) and quote:
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(v)


def _test(f: Filter, kinds: dict[str, T.DataType]) -> Test | None:
    """The filter as a comparison of a column with constants, if it is one that both sides understand alike."""
    at = getattr(f, "attribute", ())
    kind = kinds.get(at[0]) if len(at) == 1 else None
    if kind is None or not isinstance(kind, (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType)):
        return None
    if isinstance(f, (IsNull, IsNotNull)):
        return Test(at[0], "null" if isinstance(f, IsNull) else "notnull")
    plain = lambda v: isinstance(v, (str, int, bool)) or (isinstance(v, float) and math.isfinite(v))
    if isinstance(f, In) and f.value and all(plain(v) for v in f.value):
        return Test(at[0], "in", tuple(f.value))
    op = _OPS.get(type(f))
    # Order of text and of truth values differs between systems; doubles order NaN last here and there not at all.
    ordered = op == "eq" or isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType))
    return Test(at[0], op, f.value) if op and ordered and plain(f.value) else None


@dataclass
class Page(InputPartition):
    number: int
    rows: int
    name: str = ""
    tests: list[Test] = field(default_factory=list)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.rows, self.order = int(options.get("rows", PAGE_ROWS)), options.get("order", schema[0].name)
        self.headers = {k[len("header.") :]: v for k, v in options.items() if k.lower().startswith("header.")}
        self.tests: list[Test] = []

    @property
    def remote(self) -> bool:
        return self.path.startswith(("http://", "https://"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            test = _test(f, kinds)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Page]:
        if self.remote:
            _, total = self._get(0, 1)
            return [Page(n, min(self.rows, total - n * self.rows), tests=self.tests) for n in range(-(-total // self.rows))] or [Page(0, 0)]
        fs, at = opened(self.path)
        with fs.open_input_file(f"{at}/{INDEX}") as f:
            pages = [json.loads(x) for x in f.read().decode().splitlines() if x]
        keep = [Page(p["page"], p["rows"], p["file"], self.tests) for p in pages if self._may_have(p)]
        return keep or [Page(0, 0)]

    def _may_have(self, page: dict) -> bool:
        for t in self.tests:
            s = page["columns"].get(t.column)
            if s is not None and not t.may_hold(s.get("low"), s.get("high"), s["nulls"], page["rows"]):
                return False
        return True

    def _get(self, offset: int, limit: int) -> tuple[list[dict], int]:
        """Rows from an offset, and how many there are that pass the tests."""
        query = [("select", ",".join(f.name for f in self.schema)), *[t.query() for t in self.tests], ("order", self.order), ("limit", limit), ("offset", offset)]
        url = f"{self.path}{'&' if '?' in self.path else '?'}{urllib.parse.urlencode(query)}"
        request = urllib.request.Request(url, headers={"Accept": "application/json", "Prefer": "count=exact", **self.headers})
        for turn in range(TRIES):
            try:
                with urllib.request.urlopen(request, timeout=SECONDS) as got:
                    rows, span = json.loads(got.read()), got.headers.get("Content-Range", "")
                break
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or turn + 1 == TRIES:
                    raise InvalidInput(f"{self.path} answers {e.code}") from None
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if turn + 1 == TRIES:
                    raise InvalidInput(f"{self.path} can't be reached: {e}") from None
            time.sleep(0.2 * 2**turn)
        total = re.search(r"/(\d+)$", span)
        if not total or not isinstance(rows, list):
            raise InvalidInput(f"{self.path} does not answer with rows and their number")
        return rows, int(total[1])

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.rows:
            return
        if self.remote:
            rows, _ = self._get(partition.number * self.rows, partition.rows)
            if len(rows) != partition.rows:
                raise InvalidInput(f"page {partition.number} of {self.path} has {len(rows)} rows, not {partition.rows}")
        else:
            fs, at = opened(self.path)
            with fs.open_input_file(f"{at}/{partition.name}") as f:
                rows = [json.loads(x) for x in f.read().decode().splitlines() if x]
            if len(rows) != partition.rows:
                raise InvalidInput(f"{partition.name} of {self.path} has {len(rows)} rows, not {partition.rows}")
            rows = [r for r in rows if all(t.holds(r.get(t.column)) for t in partition.tests)]
        for r in rows:
            yield tuple(_checked(r, f) for f in self.schema)


_TAKES = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.BooleanType: bool}


def _checked(row: dict, f: T.StructField):
    if f.name not in row:
        raise InvalidInput(f"a row has no {f.name}")
    v = row[f.name]
    if v is None:
        return None
    if not isinstance(v, _TAKES[type(f.dataType)]) or (isinstance(v, bool) and not isinstance(f.dataType, T.BooleanType)):
        raise InvalidInput(f"{f.name} is not of type {f.dataType.simpleString()}")
    return float(v) if isinstance(f.dataType, T.DoubleType) else v


class PagedSource(DataSource):
    """spark.read.format("paged").schema(columns wanted).load(address or folder)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise InvalidInput("name the columns wanted: .schema(...)")

    def reader(self, schema: T.StructType) -> PagedReader:
        odd = [f.name for f in schema if type(f.dataType) not in _TAKES]
        if odd:
            raise InvalidInput(f"pages hold text, whole numbers, doubles and truth values, not {odd}")
        return PagedReader(dict(self.options), schema)


def read_pages(spark: SparkSession, path: str, schema: str, rows: int = PAGE_ROWS, order: str | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """The named columns of a paged table. Filters on the result go to the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    r = spark.read.format("paged").schema(schema).option("rows", rows)
    r = r.option("order", order) if order else r
    for k, v in (headers or {}).items():
        r = r.option(f"header.{k}", v)
    return r.load(path)


def write_pages(df: DataFrame, path: str, order: list[str], rows: int = PAGE_ROWS) -> int:
    """Writes df as page files of about `rows` rows in ranges of `order`, with an index of each page's least and greatest values, and
    returns the number of pages. Columns are text, whole numbers, doubles and truth values."""
    spark = df.sparkSession
    pages = max(1, math.ceil(df.count() / rows))
    names = df.columns
    numeric = [n for n, k in df.dtypes if k in ("int", "bigint", "double")]

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [r for b in it for r in b.to_pylist()]
        if not held:
            return
        fs, at = opened(path)
        fs.create_dir(at, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"page-{number:06d}.jsonl"
        aside = f"{at}/_{name}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(aside) as f:
            f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in held).encode())
        fs.move(aside, f"{at}/{name}")
        columns = {}
        for n in names:
            known = [r[n] for r in held if r[n] is not None]
            columns[n] = {"nulls": len(held) - len(known)} | ({"low": min(known), "high": max(known)} if known and n in numeric and not any(isinstance(x, float) and not math.isfinite(x) for x in known) else {})
        yield pa.record_batch({"line": pa.array([json.dumps({"page": number, "file": name, "rows": len(held), "columns": columns})])})

    cut = df.repartitionByRange(pages, *order).sortWithinPartitions(*order) if pages > 1 else df.coalesce(1)
    lines = [r.line for r in cut.mapInArrow(save, "line string").collect()]  # a line for each page
    fs, at = opened(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/_index") as f:
        f.write("\n".join(sorted(lines, key=lambda x: json.loads(x)["page"])).encode())
    fs.move(f"{at}/_index", f"{at}/{INDEX}")
    return len(lines)


def agencies(spark: SparkSession, path: str, slugs: list[str], headers: dict[str, str] | None = None, rows: int = PAGE_ROWS) -> DataFrame:
    """The routing columns of agencies that have a place, from a paged registry: an unknown category, a place out of range and an empty
    registry are errors."""
    schema = "id string, name string, category string, latitude double, longitude double, is_active boolean"
    placed = read_pages(spark, path, schema, rows, "id", headers).where("latitude is not null and longitude is not null")
    known = F.coalesce(F.col("category"), F.lit("")).isin(slugs)
    inside = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    bad = placed.agg(F.count("*").alias("n"), F.count_if(~known).alias("odd"), F.count_if(~inside).alias("out")).first()
    if bad.odd or bad.out or not bad.n:
        raise InvalidInput(f"registry of {bad.n} agencies: {bad.odd} of unknown category, {bad.out} out of range")
    return placed.withColumn("is_active", F.coalesce("is_active", F.lit(True)))
