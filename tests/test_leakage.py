from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.operators import tables

WORDS = "road lamp water tree park report street city river bridge night light stone wheel market garden".split()


def groups(df, **more):
    found = {}
    for r in tables.leakage_groups(df, "id", "text", **more).collect():
        found.setdefault(r.group, set()).add(r.id)
    return sorted(map(sorted, found.values()))


def test_texts_that_are_alike_but_not_to_the_smallest_of_their_code(spark, monkeypatch):
    """1, 2, 3 share a code, 4 is one bit off; 2, 3 and 4 are alike, and 1 is alike to none."""
    monkeypatch.setattr(tables.T, "text_simhash64", lambda c: F.when(F.col(c).contains("zeta"), 1).otherwise(0).cast("long"))
    base = " ".join(WORDS * 2 + WORDS[::-1])
    rows = [(1, "something else entirely"), (2, base), (3, base + " end"), (4, base + " zeta"), (5, "apart from all zeta")]
    assert groups(spark.createDataFrame(rows, "id long, text string")) == [[1], [2, 3, 4], [5]]


def test_only_a_text_that_is_not_the_smallest_links_across_codes(spark, monkeypatch):
    monkeypatch.setattr(tables.T, "text_simhash64", lambda c: F.when(F.col(c).contains("zeta"), 1).otherwise(0).cast("long"))
    base = " ".join(WORDS * 2 + WORDS[::-1])
    rows = [(1, "something else entirely"), (2, base), (4, base + " zeta")]
    assert groups(spark.createDataFrame(rows, "id long, text string")) == [[1], [2, 4]]


def test_near_images(spark):
    rows = [(1, "one text", 0), (2, "other words", 0b11111), (3, "third thing", 0b1111111111), (4, "no picture", None), (5, "none either", None), (6, "same again", 0), (7, "far off", -1)]
    df = spark.createDataFrame(rows, "id long, text string, image long")
    assert groups(df, image="image") == [[1, 2, 3, 6], [4], [5], [7]]
    assert len(groups(df)) == 7


def test_codes_of_texts_are_those_of_their_runs(spark):
    texts = ["", "a", "ab", "abc", "straße 日本語 text", "x" * 5000, "lorem ipsum " * 40, "😀😀 smile"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(T.text_simhash64("t").alias("a"), T.simhash64(T.char_shingles(F.col("t"))).alias("b")).collect())


def test_white_space_of_any_kind_is_stripped(spark):
    df = spark.createDataFrame([("\u00a0\tx y\n",), (" \u2003\t",), (None,)], "t string")
    assert [r.s for r in df.select(T.stripped(F.col("t")).alias("s")).collect()] == ["x y", "", None]
    assert [r.s for r in df.select(T.first_filled(F.col("t"), F.lit("z")).alias("s")).collect()] == ["x y", "z", "z"]


def test_pairs_within_a_radius_where_high_bits_are_constant(spark):
    import random

    r = random.Random(4)
    codes = {r.getrandbits(20) for _ in range(200)}
    codes |= {c ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)) for c in list(codes)[:80]} | {-1, -2}
    rows = list(enumerate(sorted(codes)))
    for radius in (3, 5):
        got = {(x.a, x.b) for x in tables.hamming_pairs(spark.createDataFrame(rows, "n long, c long"), "n", "c", radius).collect()}
        assert got == {(i, j) for i, c in rows for j, d in rows if i < j and ((c ^ d) % 2**64).bit_count() <= radius}


def united(rows, keys=("case",), radius=3, threshold=0.82, image_radius=5):
    """Groups and falls in the number of groups, row by row: (id, text, image, problem, keys...)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
        return a != b

    norm = [r["norm"] for r in rows]
    falls = {"exact_text_edges": 0, "near_text_edges": 0, "near_image_edges": 0, "explicit_group_edges": 0}
    near = lambda a, b, r: ((a ^ b) % 2**64).bit_count() <= r
    alike = lambda a, b: len(a & b) >= threshold * len(a | b)
    for kind, test in {
        "exact_text_edges": lambda i, j: norm[i] and norm[i] == norm[j],
        "near_text_edges": lambda i, j: norm[i] and norm[j] and near(rows[i]["code"], rows[j]["code"], radius) and alike(rows[i]["runs"], rows[j]["runs"]),
        "near_image_edges": lambda i, j: rows[i]["image"] is not None and rows[j]["image"] is not None and near(rows[i]["image"], rows[j]["image"], image_radius),
        "explicit_group_edges": lambda i, j: any(rows[i][k] is not None and rows[i][k] == rows[j][k] for k in keys),
    }.items():
        for i in range(len(rows)):
            for j in range(i):
                if test(i, j):
                    falls[kind] += join(i, j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), set()).add(r["id"])
    return sorted(map(sorted, groups.values())), falls


def test_receipt_and_groups_against_union_find(spark):
    from tallymill.plans import QUERIES
    from tallymill.plans.records import pictured

    sf = "/root/testdata/sf0.001"
    d = pictured(spark, sf)
    norm = T.normalised(F.col("text"))
    rows = [
        {"id": r.doc_id, "norm": r.norm, "code": r.code, "runs": set(r.runs), "image": r.image, "case": r.case and r.case.lower()}
        for r in d.withColumn("norm", norm).select("doc_id", "norm", "image", "case", T.text_simhash64("norm").alias("code"), T.char_shingles(F.col("norm")).alias("runs")).collect()
    ]
    want, falls = united(rows)
    found, receipt = tables.grouped(d, "doc_id", "text", keys=["case"], image="image", image_problem="problem")
    got = {}
    for r in found.collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == want and all(falls.values())
    n = sum(r["image"] is None for r in rows)
    r = receipt.first()
    assert {k: r[k] for k in falls} == falls and r.unreadable_images == sum(x["id"] % 5 == 1 for x in rows) and r.missing_images == n - r.unreadable_images
    q = QUERIES["c1_grouping_receipt"](spark, sf).first()
    assert q.groups == len(want) and q.largest_group == max(map(len, want)) and q.explicit_group_edges == falls["explicit_group_edges"]


def test_ids_must_be_unique_and_not_null(spark):
    import pytest

    for bad in ([(1, "a b c"), (1, "x y z"), (2, "x y z")], [(None, "a"), (2, "b")]):
        with pytest.raises(ValueError, match="unique"):
            tables.leakage_groups(spark.createDataFrame(bad, "id long, text string"), "id", "text")
