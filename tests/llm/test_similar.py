import brute
import numpy as np
import pytest
from conftest import ROWS, prose
from pyspark.sql import functions as F

from tallymill.llm import similar
from tallymill.llm.similar import keep_one


def copies(n, edits, count):
    base = prose(77, n).split()
    rng = np.random.default_rng(5)
    for _ in range(count):
        w = list(base)
        for k in rng.choice(n, edits, replace=False):
            w[k] = f"new{rng.integers(10**9)}"
        yield " ".join(w)


def shingles(t, n=5):
    w = brute.words(brute.fold(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def likeness(a, b):
    s, t = shingles(a), shingles(b)
    return len(s & t) / len(s | t) if s | t else 1.0


def stay(rows):
    """The (id, text) of the smallest id of each component of all links, for rows whose ids are known and tell texts apart."""
    distinct = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    texts = sorted({t or "" for _, t in distinct})
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    code = {t: brute.fingerprint(t) for t in texts}
    for i, t in enumerate(texts):
        for u in texts[:i]:
            if (code[t] ^ code[u]).bit_count() <= 3 or likeness(t, u) >= 0.8:
                parent[find(t)] = find(u)
    low = {}
    for d, t in distinct:
        low.setdefault(find(t or ""), d)
    return sorted(low.values())


def test_similar_texts_beyond_the_radius(spark):
    base = prose(77, 300)
    near = [base, *copies(300, 5, 12)]
    far = list(copies(300, 60, 6))
    rows = [(i, t) for i, t in enumerate(near + far)]
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(likeness(base, t) >= 0.8 for t in near[1:]) and all(likeness(base, t) < 0.8 for t in far)
    assert sorted(kept) == stay(rows) and kept >= {0} | {i for i, _ in rows if i >= len(near)}


def test_special_cases(spark, tricky, empty):
    out = keep_one(tricky).collect()
    named = [r.doc_id for r in out if r.doc_id is not None]
    assert sorted(named) == stay([(d, t) for d, t in ROWS if d is not None]) and len(out) - len(named) == 2
    assert keep_one(tricky).dtypes == tricky.dtypes and keep_one(empty).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_text(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(7, a, "x"), (7, b, "x"), (7, b, "y"), (8, b, "x"), (9, c, "z"), (9, a, "z")]
    out = sorted((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert out == sorted([(7, a), (7, b), (9, c)])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == stay(rows)


@pytest.mark.parametrize("seed", range(3))
def test_every_alike_pair_is_a_candidate(spark, seed):
    """Sets by token: the pair search alone, without any link before it, proposes each pair that is alike."""
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(60)]
    sets += [np.unique(np.concatenate((s[rng.random(len(s)) > 0.08], rng.integers(0, 60, 1)))) for s in sets[:40]]
    often = np.bincount(np.concatenate(sets), minlength=60)
    rows = []
    for node, s in enumerate(sets):
        order = s[np.lexsort((s, often[s]))]
        rows += [(int(x), node, node, len(s), p) for p, x in enumerate(order[: len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1])]
    meeting = spark.createDataFrame(rows, "token long, node long, component long, size long, pos int")
    found = {(r.a, r.b) for r in similar.all_pairs(meeting, 0.8).collect()}
    alike = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t)) - 1e-9}
    assert alike and alike <= found and len(found) < len(sets) ** 2 / 4


def test_a_large_family_costs_no_pairs_of_its_own(spark):
    """Links of the first search join a family, so the second has nothing to pair there."""
    family = list(copies(200, 2, 80))
    docs = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    assert [r.doc_id for r in keep_one(docs.withColumn("source", F.lit("s"))).collect()] == [0]
