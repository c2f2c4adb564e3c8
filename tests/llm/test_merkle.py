import zlib
from collections import defaultdict

import pytest
from conftest import ROWS

from tallymill.llm import merkle as M
from tallymill.llm.merkle import digest_of, fold, manifest, tampered
from tallymill.llm.queries import QUERIES
from tallymill.llm.runtime import Scratch


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity=2):
    """All levels, and each leaf's siblings from below."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest_of(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    proofs = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i // arity * arity
            path += [h for k, h in enumerate(level[run : run + arity]) if run + k != i]
            i //= arity
        proofs.append("".join(path))
    return levels[-1][0], proofs


def plain(rows, touch=True):
    """(doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        leaf = digest_of(*map(field, r))
        hit = touch and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        changed = digest_of(*map(field, (*r[:3], r[3] + 1, r[4]))) if hit else leaf
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf), r[0], leaf, changed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {}
    for g in names:
        groups[g].sort()
        done[g] = tree([leaf for _, _, leaf, _ in groups[g]])
    root, tops = tree([done[g][0] for g in names]) if names else (None, [])
    out = []
    for place, g in enumerate(names):
        subroot, proofs = done[g]
        for i, (_, d, leaf, changed) in enumerate(groups[g]):
            proof = proofs[i] + tops[place]
            up, at = fold(changed, i, len(proofs), proof)
            folded, end = fold(up, place, len(names), proof, at)
            assert end == len(proof)
            out.append((d, leaf, subroot, root, digest_of(proof), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*M.FIELDS).collect()]
    assert got(QUERIES["op13_merkle_manifest"](spark, sf)) == plain(rows)


@pytest.mark.parametrize("range_rows,widen", [(1, 2), (3, 2), (7, 3), (10_000, 512)])
def test_ranges_blocks_and_groups(spark, range_rows, widen):
    sizes = {None: 5, "": 1, "a": 37, "b": 64, "ü": 2, "Z": 17}
    rows, n = [], 0
    for lang, size in sizes.items():
        for k in range(size):
            n += 1
            rows.append((n * 7919 % 1009, None if k % 4 == 0 else "s", lang, None if k % 5 == 0 else k, None if k % 6 == 0 else f"é {k}"))
    out = got(manifest(table(spark, rows).repartition(3), present=tampered(), range_rows=range_rows, widen=widen))
    assert out == plain(rows) and {r[-1] for r in out} == {True, False}


def test_odd_rows(spark, tricky, odd_columns, empty):
    rows = [(i, "s1" if k % 3 else None, "en", None if t is None else len(t), t) for k, (i, t) in enumerate(ROWS)]
    assert got(manifest(tricky, present=tampered())) == plain(rows)
    assert got(manifest(odd_columns, present=tampered(), range_rows=4)) == plain(rows)
    assert got(manifest(empty, present=tampered())) == []


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_tables(spark, n):
    rows = [(i, None, "x", 1, "t") for i in range(n)]
    untouched = got(manifest(table(spark, rows)))
    assert untouched == plain(rows, touch=False) and all(r[-1] for r in untouched)
    repeated = [(1, None, "x", 1, "t")] * n + [(2, None, None, None, None)]
    assert got(manifest(table(spark, repeated), present=tampered())) == plain(repeated)


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("n", [1, 2, 9, 10, 26, 125])
def test_combiner_in_any_order(arity, n):
    leaves = [digest_of(str(i)) for i in range(n)]
    root, proofs = tree(leaves, arity)
    c = M.Combiner(n, arity, keep=True)
    for i in sorted(range(n), key=lambda i: i * 7919 % 127):
        c.put(0, i, leaves[i])
    assert c.top == root and not c.open and list(c.frontier()) == [(len(c.sizes) - 1, 0, root)]
    told, memo = {(len(c.sizes) - 1, 0): ""}, {}
    for i in range(n):
        assert c.above(0, i, told, memo) == proofs[i] and fold(leaves[i], i, n, proofs[i], arity=arity) == (root, len(proofs[i]))


def test_frontiers_are_small(spark, tmp_path):
    """A range of leaves leaves two nodes a level at most, and ranges unite to the root."""
    n, at, whole = 5000, 0, M.Combiner(5000, 2)
    leaves = [digest_of(str(i)) for i in range(n)]
    for size in (1, 777, 1024, 2048, 1150):
        c = M.Combiner(n, 2)
        for i in range(at, at + size):
            c.put(0, i, leaves[i])
        edge = list(c.frontier())
        assert len(edge) <= 2 * len(c.sizes)
        for node in edge:
            whole.put(*node)
        at += size
    assert whole.top == tree(leaves)[0]


def test_wider_trees(spark):
    rows = spark.createDataFrame([("", i, bytes([i]) * 32) for i in range(100)], "group string, id long, digest binary")
    forest = M.Forest(rows, ["id"], Scratch(spark, "wide"), arity=5, range_rows=6, widen=2)
    assert forest.roots().first().digest.hex() == tree([(bytes([i]) * 32).hex() for i in range(100)], 5)[0]
