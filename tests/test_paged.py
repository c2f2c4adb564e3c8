import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tallymill.sources import paged
from tallymill.sources.files import InvalidInput

SCHEMA = "id string, name string, category string, latitude double, longitude double, is_active boolean"
ROWS = [(f"a{i:03d}", f"agency {i}, \"x\"", "abc"[i % 3], None if i % 7 == 0 else -8.0 + i / 10, 106.0, None if i % 5 == 0 else i % 2 == 0) for i in range(95)]


class Registry(BaseHTTPRequestHandler):
    """Answers as a REST view of a table does."""

    rows: list[dict] = []
    seen: list[dict] = []
    failures = 0

    def do_GET(self):
        q = urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query)
        type(self).seen.append({"query": q, "key": self.headers.get("apikey")})
        if type(self).failures > 0:
            type(self).failures -= 1
            self.send_error(503)
            return
        if self.headers.get("apikey") != "secret":
            self.send_error(401)
            return
        rows, args = list(type(self).rows), dict(q)
        for column, test in q:
            if column in ("select", "order", "limit", "offset"):
                continue
            op, _, value = test.partition(".")
            kind = type(next((r[column] for r in rows if r[column] is not None), ""))
            of = lambda v, kind=kind: v == "true" if kind is bool else kind(v)
            if test in ("is.null", "not.is.null"):
                rows = [r for r in rows if (r[column] is None) == (test == "is.null")]
            elif op == "in":
                rows = [r for r in rows if r[column] in [of(json.loads(v) if v.startswith('"') else v) for v in value[1:-1].split(",")]]
            else:
                compare = {"eq": lambda a, b: a == b, "is": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
                rows = [r for r in rows if r[column] is not None and compare(r[column], of(value))]
        rows.sort(key=lambda r: r[args["order"]])
        offset, limit = int(args["offset"]), int(args["limit"])
        body = json.dumps([{c: r[c] for c in args["select"].split(",")} for r in rows[offset : offset + limit]]).encode()
        self.send_response(200)
        self.send_header("Content-Range", f"{offset}-{offset + limit - 1}/{len(rows)}")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    Registry.rows, Registry.seen, Registry.failures = [dict(zip(names, r, strict=True)) for r in ROWS], [], 0
    s = ThreadingHTTPServer(("127.0.0.1", 0), Registry)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/agencies"
    s.shutdown()


HEADERS = {"apikey": "secret"}


def test_filters_and_columns_go_to_the_server(spark, server, capsys):
    df = paged.read_pages(spark, server, "id string, latitude double", rows=10, headers=HEADERS).where("latitude >= -5.0 and latitude < 0 and id != 'a040'")
    want = [(r[0], r[3]) for r in ROWS if r[3] is not None and -5 <= r[3] < 0 and r[0] != "a040"]
    assert sorted(map(tuple, df.collect())) == want
    q = Registry.seen[-1]["query"]
    assert ("select", "id,latitude") in q and ("latitude", "gte.-5.0") in q and ("latitude", "lt.0.0") in q and ("latitude", "not.is.null") in q
    pages = {dict(x["query"])["offset"] for x in Registry.seen if dict(x["query"])["limit"] != "1"}
    assert pages == {str(n) for n in range(0, 43, 10)}
    df.explain()
    plan = capsys.readouterr().out
    left = [line for line in plan.splitlines() if " Filter " in line]
    assert len(left) == 1 and "a040" in left[0] and "latitude" not in left[0]


@pytest.mark.parametrize("test", ["is_active", "is_active = false", "category = 'b'", "category in ('a', 'c') and latitude is not null", "latitude is null", "name = 'agency 4, \"x\"'", "category > 'a'", "latitude > 100", "latitude = -7.9 or id = 'a001'"])
def test_server_and_files_equal_spark(spark, server, tmp_path, test):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(map(tuple, df.where(test).collect()))
    assert sorted(map(tuple, paged.read_pages(spark, server, SCHEMA, 20, headers=HEADERS).where(test).collect())) == want
    assert paged.write_pages(df, f"file://{tmp_path}/p", ["latitude", "id"], rows=20) == 5
    assert sorted(map(tuple, paged.read_pages(spark, f"{tmp_path}/p", SCHEMA).where(test).collect())) == want


def test_pages_without_such_rows_are_not_opened(spark, tmp_path):
    rows = [(i, float(i), None if i < 40 else i) for i in range(100)]
    schema = "k long, x double, n long"
    assert paged.write_pages(spark.createDataFrame(rows, schema), f"{tmp_path}/p", ["k"], rows=10) == 10
    df = paged.read_pages(spark, f"{tmp_path}/p", schema)
    every = df.rdd.getNumPartitions()
    for test, pages in {"x >= 95": 1, "k = 7": 1, "n is not null": 6, "n > 5": 6, "k in (1, 99)": 2, "x < -1": 1}.items():
        got = df.where(test)
        assert got.rdd.getNumPartitions() <= pages + 1 < every
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in spark.createDataFrame(rows, schema).where(test).collect())


def test_failures(spark, server, tmp_path):
    Registry.failures = 2  # tried again
    assert paged.read_pages(spark, server, SCHEMA, headers=HEADERS).count() == 95
    with pytest.raises(Exception, match="answers 401") as e:
        paged.read_pages(spark, server, SCHEMA, headers={"apikey": "wrong-key"}).count()
    assert "wrong-key" not in str(e.value).split("JVM stacktrace")[0] and len([1 for x in Registry.seen if x["key"] == "wrong-key"]) == 1
    with pytest.raises(Exception, match="no elsewhere|not of type"):
        paged.read_pages(spark, server, "id long", headers=HEADERS).collect()
    with pytest.raises(Exception, match="pages hold"):
        paged.read_pages(spark, server, "id array<string>", headers=HEADERS).collect()
    df = spark.createDataFrame(ROWS, SCHEMA)
    paged.write_pages(df, f"{tmp_path}/p", ["id"], rows=50)
    page = next((tmp_path / "p").glob("page-*.jsonl"))
    page.write_text("\n".join(page.read_text().splitlines()[:-1]))
    with pytest.raises(Exception, match="rows, not"):
        paged.read_pages(spark, f"{tmp_path}/p", SCHEMA).collect()


def test_registry_rules(spark, server, tmp_path):
    got = paged.agencies(spark, server, ["a", "b", "c"], HEADERS, rows=30)
    assert got.count() == sum(r[3] is not None for r in ROWS) and got.where("is_active is null").count() == 0
    with pytest.raises(InvalidInput, match="unknown category"):
        paged.agencies(spark, server, ["a", "b"], HEADERS)
    far = spark.createDataFrame([("x", "n", "a", 95.0, 0.0, True)], SCHEMA)
    paged.write_pages(far, f"{tmp_path}/far", ["id"])
    paged.write_pages(far.where("false"), f"{tmp_path}/none", ["id"])
    for name in ("far", "none"):
        with pytest.raises(InvalidInput):
            paged.agencies(spark, f"{tmp_path}/{name}", ["a"])
    nan = spark.createDataFrame([("x", "n", "a", float("nan"), 0.0, True), ("y", "n", "a", 1.0, 0.0, True)], SCHEMA)
    paged.write_pages(nan, f"{tmp_path}/nan", ["id"])
    assert [r.id for r in paged.read_pages(spark, f"{tmp_path}/nan", SCHEMA).where(F.col("latitude") > 0.5).orderBy("id").collect()] == ["x", "y"]
