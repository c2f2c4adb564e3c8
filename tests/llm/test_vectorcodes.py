import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import vectorcodes as V
from tallymill.llm.queries import QUERIES


def plain(rows, parts=16, entries=64, rounds=2):
    """(id, vector, label) rows coded by comparing every part with every entry."""
    sized = sorted(((i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], len(r[1])))
    if not sized:
        return []
    n = len(sized[0][1])
    good = [(i, v, y) for i, v, y in rows if v and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    edges = V.Shape(n, parts).edges.tolist()
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in good]
    cut = [[tuple(w[a:b]) for a, b in zip(edges, edges[1:])] for w in whole]
    first = [c for _, _, c in sorted((i, w, c) for (i, _, _), w, c in zip(good, whole, cut, strict=True) if i is not None)][:entries]
    books = [[c[p] for c in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        got = [[nearest(c[p], books[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    out, errors = [], {}
    for (i, _, y), c in zip(good, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[y] = errors.get(y, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, y])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[y], digest) for i, c, e, y in out), key=str)


def got(df):
    return sorted(map(tuple, df.select(df.columns[0], "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(QUERIES["op12_vector_codes"](spark, sf)) == plain(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).astype("f4").tolist(), i % 3 if i % 5 else None) for i in range(90)]
    rows += [(i, rows[i][1], 1) for i in range(30)]  # repeated ids
    rows += [(200 + i, [0.5] * 32, None) for i in range(40)]  # copies: ties everywhere
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [math.nan] * 32, 1), (303, [math.inf] + [0.0] * 31, 1), (304, [], 1), (305, [1.0] * 31, 1), (None, [-0.001] * 32, 2), (-5, [-0.25] * 32, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(V.compress(df.repartition(5))) == plain(rows)
    assert got(V.compress(df.withColumnRenamed("label", "at"), label_column="at", parts=5, entries=7, rounds=3)) == plain(rows, 5, 7, 3)


def test_few_and_no_rows(spark):
    rows = [(3, [1.0] * 16, None), (2, [2.0] * 16, None), (2, [2.0] * 16, 1)]
    assert got(V.compress(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    for none in ([], [(1, None, 1)], [(None, [1.0] * 16, 1)]):
        assert got(V.compress(spark.createDataFrame(none, SCHEMA))) == []


def test_far_components_stay_in_range(spark):
    rows = [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)] + [(4 + i, [float(i)] * 64, 2) for i in range(70)]
    out = V.compress(spark.createDataFrame(rows, SCHEMA), rounds=1).collect()
    assert len(out) == 73 and all(r.error >= 0 for r in out)
    most = V.Shape(64, 16).most
    assert 64 * (2 * most) ** 2 < 1 << 63 and most > 260_000 * 256


def test_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1, "a", 2)], "vec_id long, embedding array<double>, label int, `my col` string, id int")
    assert got(V.compress(df)) == plain([(1, [1.0] * 16, 1)])


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_tree_finds_the_lowest_of_the_nearest(data):
    dims, n = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 70))
    values = st.integers(-3, 3) if data.draw(st.booleans()) else st.integers(-10_000, 10_000)
    book = np.array(data.draw(st.lists(st.lists(values, min_size=dims, max_size=dims), min_size=n, max_size=n)), dtype=np.int64)
    points = np.array(data.draw(st.lists(st.lists(values, min_size=dims, max_size=dims), min_size=1, max_size=50)), dtype=np.int64)
    index, far = V.Search(book).nearest(points)
    all_far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()


def test_codes_lose_little(spark):
    """Decoded vectors are nearer to the vectors than the mean vector is, by far."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    shape, books = V.train_codebooks(df)
    coded = V.encode(df, shape, books).collect()
    y = V.decode([r.code for r in coded], shape, books)
    errors = [((x[r.id] - v) ** 2).sum() for r, v in zip(coded, y, strict=True)]
    mean = np.mean(list(x.values()), axis=0)
    assert np.mean(errors) < 0.6 * np.mean([((v - mean) ** 2).sum() for v in x.values()])


@pytest.mark.parametrize("size,parts", [(64, 16), (7, 3), (16, 16), (3, 5)])
def test_parts(size, parts):
    edges = V.Shape(size, parts).edges
    assert edges[0] == 0 and edges[-1] == size and (np.diff(edges) >= 0).all() and np.ptp(np.diff(edges)) <= 1
