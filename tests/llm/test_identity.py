"""Texts and words that structured hashes confuse stay apart in every operator."""

import collections
import math

import brute
import numpy as np
import pytest
from conftest import prose, twins

from tallymill.llm import kernels as K
from tallymill.llm import kneser_ney
from tallymill.llm.decontaminate import contamination
from tallymill.llm.similar import _shingles
from tallymill.llm.sketch import fingerprint_edits, sketches
from tallymill.llm.substring import remove_repeats

SIZES = [1 << 10, 1 << 11, 1 << 12, 1 << 13]


@pytest.mark.parametrize("n", SIZES)
def test_words_and_sequences(n):
    words = K.Words([" ".join(twins(n)).encode()]).hashes()
    assert words[0] != words[1]
    h = K.Words([" ".join(" ".join(t) for t in twins(n)).encode()]).hashes()
    assert len(np.unique(K.sequence_hashes(h, [0, n], [n, 2 * n]))) == 2
    for width in (2, 3, 8, 13, 64, n):
        each = [K.window_hashes(K.Words([" ".join(t).encode()]).hashes(), width) for t in twins(n)]
        for t, got in zip(twins(n), each, strict=True):
            runs = [t[i : i + width] for i in range(n - width + 1)]
            assert len(np.unique(got)) == len(set(runs))
        assert len(np.unique(np.concatenate(each))) == len({t[i : i + width] for t in twins(n) for i in range(n - width + 1)})


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 13, 21, 50])
def test_windows_are_their_words(width):
    words = np.random.default_rng(width).integers(0, 3, 400).astype(np.uint64)
    h = K.window_hashes(K.mix(words + np.uint64(1)), width)
    seen = collections.defaultdict(set)
    for i in range(len(words) - width + 1):
        seen[words[i : i + width].tobytes()].add(int(h[i]))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("n", SIZES)
def test_op1_keeps_what_repeats_nowhere(spark, n):
    rows = [(i + 1, prose(1, 12) + " " + t) for i, t in enumerate(twins(n))]
    rows += [(i + 3, " ".join(t)) for i, t in enumerate(twins(n))]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), join_words=" ").collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in out) == brute.kept(rows)


@pytest.mark.parametrize("n", SIZES)
def test_op3_finds_both(spark, n):
    rows = [(i + 1, prose(1, 12) + " " + t) for i, t in enumerate(twins(n))]
    both = [spark.createDataFrame(rows, f"{c} long, text string") for c in ("doc_id", "item_id")]
    got = sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in contamination(*both).collect())
    assert got == [(1, 13, 13, ["1"]), (2, 13, 13, ["2"])]


@pytest.mark.parametrize("n", SIZES)
def test_op8_tells_them_apart(spark, n):
    rows = [(i, " ".join(t)) for i, t in enumerate(twins(n))] + [(i + 2, t) for i, t in enumerate(twins(n))]
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in got}) == 4
    assert len({s.whole for s in sketches([t.encode() for _, t in rows])}) == 4


@pytest.mark.parametrize("n", SIZES[:1])
def test_op9_counts_words_apart(spark, n):
    texts = [twins(n)[0]] * 30 + [twins(n)[1]] * 9
    rows = list(enumerate(texts))
    got = kneser_ney.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()
    train = collections.Counter(t for d, t in rows if not next(r for r in got if r.id == d).held_out)
    total = 2 * sum(train.values())
    for r in got:
        want = sum(math.log10((c + 1) / (total + 4)) for c in (train[texts[r.id]], sum(train.values())))
        assert math.isclose(r.base_score, want, rel_tol=1e-12) and r.n_known == 2


def test_shingle_sets_differ():
    a, b = _shingles([" ".join(t).encode() for t in twins(1 << 10)], 2000)
    assert a.tolist() != b.tolist()
