"""Bootstraps against plain versions over the same streams, and against ordinary resampling."""

import numpy as np
import pytest

from tallymill.operators import inference as I
from tallymill.operators.ordered import numbered, running_sums
from pyspark.sql import functions as F


@pytest.mark.parametrize("clusters, block", [(1, 4), (4, 4), (5, 4), (23, 4), (300, 256)])
def test_blocks_share_out_a_stratum(monkeypatch, clusters, block):
    monkeypatch.setattr(I, "BLOCK", block)
    times = np.hstack([I.block_times(7, "s", clusters, b, 2000) for b in range(-(-clusters // block))])
    assert times.shape == (2000, clusters) and (times.sum(axis=1) == clusters).all()
    # A cluster's count is binomial(n, 1 / n).
    assert np.abs(times.mean(axis=0) - 1).max() < 0.15 and abs(times.var() - (1 - 1 / clusters)) < 0.05


def test_streams_are_children_of_the_seed():
    first, second = np.random.SeedSequence(7).spawn(2)
    assert I.stream(7, 0).bit_generator.state == np.random.default_rng(first).bit_generator.state
    rng = np.random.default_rng(second)
    assert (I.seed_draws(7, 5, 40) == [rng.integers(0, 5, size=5) for _ in range(40)]).all()


Y = [0, 0, 1, 1, 0, 1]
CLUSTER = list("aabbcc")
STRATUM = {"a": "m0", "b": "m1", "c": "m0"}
REFERENCE = [[0, 1, 1, 1, 0, 0], [0, 0, 0, 1, 0, 1]]
CHALLENGER = [[0, 0, 1, 1, 0, 1], [0, 1, 1, 1, 0, 1]]


def sure(pred):
    return [0.8, 0.2] if pred == 0 else [0.2, 0.8]


def plain(draws, seed, redraw, order):
    """Row by row: repeat every cluster as often as it was drawn, average the drawn seeds, count correct rows. order: member numbers."""
    members = {"m0": sorted("ac", key=order.get), "m1": ["b"]}
    times = {c: I.block_times(seed, s, len(m), 0, draws)[:, i] for s, m in members.items() for i, c in enumerate(m)}
    positions = I.seed_draws(seed, 2, draws)
    out = []
    for d in range(draws):
        chosen = positions[d] if redraw else [0, 1]
        n = right_a = right_b = 0
        for i, c in enumerate(CLUSTER):
            pa, pb = (np.mean([sure(system[s][i]) for s in chosen], axis=0).argmax() for system in (REFERENCE, CHALLENGER))
            k = int(times[c][d])
            n, right_a, right_b = n + k, right_a + k * (pa == Y[i]), right_b + k * (pb == Y[i])
        out.append((d, n, right_a, right_b))
    return out


def test_fixed_ensemble(spark):
    fixed = [[int(np.mean([sure(s[i]) for s in system], axis=0).argmax() == Y[i]) for i in range(6)] for system in (REFERENCE, CHALLENGER)]
    stats = [(STRATUM[c], c, sum(x == c for x in CLUSTER), *[sum(f[i] for i in range(6) if CLUSTER[i] == c) for f in fixed]) for c in "abc"]
    df = spark.createDataFrame(stats, "stratum string, cluster string, n long, a long, b long")
    # Members follow the numbering of the clusters, not their names.
    order = {r.cluster: r.number for r in numbered(df, "stratum", "cluster").collect()}
    assert sorted((order["a"], order["c"])) == [0, 1] and order["b"] == 0
    got = sorted(tuple(r) for r in I.cluster_bootstrap(df, ["n", "a", "b"], 200, 7).collect())
    assert got == plain(200, 7, False, order)
    assert I.cluster_bootstrap(df.where("false"), ["n", "a", "b"], 5, 7).count() == 0


def test_training_seeds_are_drawn_for_both_systems(spark):
    rows = [(c, y, [sure(s[i]) for s in REFERENCE], [sure(s[i]) for s in CHALLENGER]) for i, (c, y) in enumerate(zip(CLUSTER, Y))]
    df = spark.createDataFrame(rows, "cluster string, y int, a array<array<double>>, b array<array<double>>").repartition(3)
    strata = spark.createDataFrame(list(STRATUM.items()), "cluster string, stratum string")
    got = sorted(tuple(r) for r in I.seed_sensitivity(df, strata, 2, 200, 7).collect())
    order = {r.cluster: r.number for r in numbered(strata, "stratum", "cluster").collect()}
    assert got == plain(200, 7, True, order)


def test_interval_agrees_with_ordinary_resampling(spark):
    rng = np.random.default_rng(1)
    gain = rng.integers(-3, 5, 700)
    df = spark.createDataFrame([(f"s{i % 2}", i, int(g)) for i, g in enumerate(gain)], "stratum string, cluster long, d long")
    got = np.array([r.d for r in I.cluster_bootstrap(df, ["d"], 3000, 5).collect()])
    own = sum(gain[s::2][rng.integers(0, 350, (3000, 350))].sum(axis=1) for s in (0, 1))
    assert np.abs(np.quantile(got, [0.025, 0.5, 0.975]) - np.quantile(own, [0.025, 0.5, 0.975])).max() < 0.12 * own.std() + 3


def test_running_sums(spark):
    rows = [(g, k, n) for g in ("x", None) for k, n in [(None, 5), (0.5, 1), (-2.0, 2), (float("nan"), 7), (9.0, 3), (3.25, 4)]]
    df = spark.createDataFrame(rows, "g string, k double, n long")
    for down in (False, True):
        got = running_sums(df, "k", {"seen": "n"}, ["g"], down).collect()
        place = {"None": 0, "-2.0": 1, "0.5": 2, "3.25": 3, "9.0": 4, "nan": 5}
        for r in got:
            mine = place[str(r.k)]
            assert r.seen == sum(n for g, k, n in rows if g == r.g and (place[str(k)] >= mine if down else place[str(k)] <= mine))
        assert len(got) == len(rows)
    assert running_sums(df.where("false"), "k", {"seen": "n"}).count() == 0
    wide = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    assert running_sums(wide, "k", {"seen": "n"}).where("seen <> k + 1").count() == 0
    same = wide.withColumn("g", F.lit("g"))
    assert [r.number for r in numbered(same, "g", "k").orderBy("number").collect()] == list(range(5000))


def macro_f1(y, p, classes):
    out = []
    for c in range(classes):
        tp = sum(a == c == b for a, b in zip(y, p, strict=True))
        den = sum(b == c for b in p) + sum(a == c for a in y)
        out.append(2 * tp / den if den else 0.0)
    return float(np.mean(out))


def test_ensembles_are_judged_by_their_mean_probabilities(spark):
    """Two seeds that are wrong alone and right together: the gain in macro-F1 is 2 / 3, not the mean of the seeds' own gains."""
    y = [0, 1, 0, 1]
    two = lambda pred, sure: [[sure, 1 - sure] if k == 0 else [1 - sure, sure] for k in pred]
    reference = [two([0] * 4, 0.9), two([1] * 4, 0.9)]
    challenger = [two(y, 0.9), two([1 - k for k in y], 0.51)]
    mean = lambda systems: np.mean(systems, axis=0).argmax(axis=1).tolist()
    rows = [("abcd"[i], y[i], int(mean(reference)[i]), int(mean(challenger)[i])) for i in range(4)]
    df = spark.createDataFrame(rows, "cluster string, y int, a int, b int")
    strata = spark.createDataFrame([(c, "2026-01") for c in "abcd"], "cluster string, stratum string")
    got = {r.metric: r for r in I.paired_bootstrap(df, strata, 2, 100, 19).collect()}
    assert got["macro_f1"].delta == pytest.approx(2 / 3) and got["accuracy"].delta == pytest.approx(0.5)
    assert got["macro_f1"].low <= 2 / 3 and got["macro_f1"].p_nonnegative == 1.0 and 0 < got["macro_f1"].p_nonpositive < 1


def test_intervals_of_both_metrics_against_resampled_rows(spark):
    rng = np.random.default_rng(8)
    n, classes, draws, seed = 300, 4, 200, 5
    y, a, b = rng.integers(0, 3, n), rng.integers(0, classes, n), rng.integers(0, 3, n)  # no row is of class 3, some are given to it
    b = np.where(rng.random(n) < 0.4, y, b)
    cluster = rng.integers(0, 40, n)
    rows = list(zip(cluster.tolist(), y.tolist(), a.tolist(), b.tolist(), strict=True)) + [(None, 0, 0, 1)]
    df = spark.createDataFrame(rows, "cluster long, y int, a int, b int")
    strata = spark.createDataFrame([(int(c), f"s{c % 3}") for c in np.unique(cluster)], "cluster long, stratum string")
    got = {r.metric: r for r in I.paired_bootstrap(df, strata, classes, draws, seed, level=0.9).collect()}
    placed = {r.cluster: (r.stratum, r.number) for r in numbered(strata, "stratum", "cluster").collect()}
    sizes = {s: sum(p[0] == s for p in placed.values()) for s in ("s0", "s1", "s2")}
    times = {s: I.block_times(seed, s, k, 0, draws) for s, k in sizes.items()}
    gains = {"accuracy": [], "macro_f1": []}
    for d in range(draws):
        take = np.concatenate([np.repeat(np.flatnonzero(cluster == c), times[s][d, k]) for c, (s, k) in placed.items()])
        gains["accuracy"].append((b[take] == y[take]).mean() - (a[take] == y[take]).mean())
        gains["macro_f1"].append(macro_f1(y[take], b[take], classes) - macro_f1(y[take], a[take], classes))
    for m, g in gains.items():
        low, high = np.quantile(g, [0.05, 0.95])
        assert (got[m].low, got[m].high) == pytest.approx((low, high), abs=1e-12)
        assert got[m].p_nonpositive == pytest.approx((sum(x <= 0 for x in g) + 1) / (draws + 1))
    assert got["macro_f1"].delta == pytest.approx(macro_f1(y, b, classes) - macro_f1(y, a, classes))
