import collections
import math
import zlib

import brute
import numpy as np
import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from tallymill.llm import kneser_ney
from tallymill.llm.queries import QUERIES


def plain(train):
    """Interpolated modified Kneser-Ney over all counts: a function of (a, b, w)."""
    tri = brute.trigrams(train)
    count = collections.Counter(w for (_, _, w), n in tri.items() for _ in range(n))
    raw, follow = collections.Counter(), collections.Counter()
    for (a, b, w), n in tri.items():
        raw[b, w] += n
        follow[b, w] += 1
    follow = {k: raw[k] if k[0] == "<s>" else n for k, n in follow.items()}
    types = collections.Counter(w for _, w in follow)
    of = lambda v: [collections.Counter(v)[i] for i in (1, 2, 3, 4)]
    d3, d2, d1 = (kneser_ney.discounts(of(x.values())) for x in (tri, follow, types))
    off = lambda d, n: d[min(n, 3) - 1] if n else 0.0
    freed = sum(off(d1, n) for n in types.values())
    after2, after3 = collections.defaultdict(dict), collections.defaultdict(dict)
    for (b, w), n in follow.items():
        after2[b][w] = n
    for (a, b, w), n in tri.items():
        after3[a, b][w] = n

    def p(a, b, w):
        out = max(types[w] - off(d1, types[w]), 0) / len(follow) + freed / len(follow) / (len(count) + 1)
        for d, c in ((d2, after2[b]), (d3, after3[a, b] if (a, b) != ("<s>", "<s>") else {})):
            if c:
                s = sum(c.values())
                out = (c.get(w, 0) - off(d, c.get(w, 0))) / s + sum(off(d, n) for n in c.values()) / s * out
        return out

    return p


def check(rows, got):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    p = plain([t for d, t in rows if not held(d)])
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    count = collections.Counter(w for d, t in rows if not held(d) for w in [*brute.words(brute.fold(t)), "</s>"])
    total = sum(count.values())
    have = collections.defaultdict(list)
    for r in got:
        have[r.id].append((r.score, r.base_score))
    assert have.keys() == texts.keys()
    for d, own in texts.items():
        want = []
        for t in own:
            y = ["<s>", "<s>", *brute.words(brute.fold(t)), "</s>"]
            base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in y[2:])
            want.append((sum(math.log10(p(*y[i - 2 : i + 1])) for i in range(2, len(y))), base))
        # Rows of one id are told apart by their scores, each once.
        assert len(want) == len(have[d])
        for w, g in zip(sorted(want), sorted(have[d]), strict=True):
            assert math.isclose(w[0], g[0], rel_tol=1e-9) and math.isclose(w[1], g[1], rel_tol=1e-9)


def test_all_counts_against_plain_kneser_ney(spark, tricky):
    check(ROWS, kneser_ney.score_documents(tricky, least=1).collect())


def test_query_scores_by_all_counts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, QUERIES["op9_kneser_ney"](spark, sf).withColumn("id", F.col("doc_id")).collect())


@pytest.mark.parametrize("n", [0, 1, 40, 20_000])
def test_short_keys_are_found(tmp_path, n):
    keys = np.sort(np.random.default_rng(n).integers(0, 2**64, 2 * n, dtype=np.uint64))
    mine, other = np.sort(keys[::2]), np.sort(keys[1::2])
    kneser_ney._save_ngrams(str(tmp_path / "t"), mine, [np.arange(n)])
    t = kneser_ney.Ngrams(str(tmp_path / "t"), 1)
    found, row = t.find(mine)
    assert found.all() and (row == np.arange(n)).all() and (t.column(0, row) == np.arange(n)).all()
    assert not t.find(other)[0].any()
