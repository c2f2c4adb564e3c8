import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import linear as N
from tallymill.operators import metrics as M

TEXTS = ["The river, the RIVER bridge", "river bridge a b c", None, "", "Straße über_9 straße", "日本 語 日本 語x", "bridge the river the", "lamp lamp lamp"]


def grams(t):
    w = re.findall(r"\w\w+", (t or "").lower())
    return w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]


def test_terms_and_vocabulary_against_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    assert {r.i: r.g for r in df.select("i", N.terms(F.col("t")).alias("g")).collect()} == {i: grams(t) for i, t in enumerate(TEXTS)}
    n, have = Counter(g for t in TEXTS for g in grams(t)), Counter(g for t in TEXTS for g in set(grams(t)))
    for min_df, most in ((1, 100), (2, 100), (2, 3), (1, 5)):
        want = sorted(sorted((g for g in n if have[g] >= min_df), key=lambda g: (-n[g], g))[:most])
        got = sorted(map(tuple, N.vocabulary(df, "t", min_df=min_df, most=most).collect()), key=lambda r: r[3])
        assert got == [(g, have[g], n[g], i) for i, g in enumerate(want)]


def test_weights_against_the_formula(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    words = N.vocabulary(df, "t", min_df=2)
    known = {r.term: (r["index"], r.df) for r in words.collect()}
    for r in N.features(df, "t", words, len(TEXTS), ["i"]).collect():
        tf = Counter(g for g in grams(TEXTS[r.i]) if g in known)
        w = {known[g][0]: (1 + math.log(k)) * (1 + math.log((1 + len(TEXTS)) / (1 + known[g][1]))) for g, k in tf.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        assert dict(zip(r["index"], r.value, strict=True)) == pytest.approx({i: x / size for i, x in w.items()})


def test_margins_and_a_step_against_plain_sums():
    rng = np.random.default_rng(1)
    model = N.Linear(rng.normal(size=(3, 10)), rng.normal(size=3))
    starts, index, value = np.array([0, 2, 2, 5]), np.array([1, 7, 0, 7, 9]), rng.normal(size=5)
    want = [[sum(model.weights[c, index[k]] * value[k] for k in range(a, b)) + model.intercept[c] for a, b in zip(starts, starts[1:])] for c in range(3)]
    assert np.allclose(model.margins(index, value, starts), want)
    p = model.probabilities(np.array(want))
    assert p.shape == (3, 3) and np.allclose(p.sum(axis=1), 1)


def labelled(spark, n, partitions):
    rng, words = np.random.default_rng(7), [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.15) if i % 3 else 2  # one class is rare
        own = words[y * 12 : y * 12 + 12]
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.5 else words) for _ in range(15)), y))
    rows += [(n, "w1 w2", None), (n + 1, None, 0)]
    return spark.createDataFrame(rows, "id long, text string, y int").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 5])
def test_held_out_accuracy(spark, partitions):
    d = labelled(spark, 1200, partitions)
    train, held = d.where("id % 4 != 0"), d.where("id % 4 = 0 and y is not null")
    words = N.vocabulary(train, "text")
    size, n = words.count(), train.count()
    model = N.train_linear(N.features(train, "text", words, n, ["y"]), 3, size)
    got = M.predicted(N.linear_probabilities(N.features(held, "text", words, n, ["id", "y"]), model, ["id", "y"]))
    report = {r["class"]: r.recall for r in M.class_report(got, 3).collect()}
    assert min(report.values()) > 0.85


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "y int, index array<long>, value array<double>")
    model = N.train_linear(none, 4, 3)
    rows = spark.createDataFrame([(1, [0, 2], [0.6, 0.8]), (2, [], [])], "id long, index array<long>, value array<double>")
    assert all(r.p == [0.25] * 4 for r in N.linear_probabilities(rows, model, ["id"]).collect())


def test_guesses_follow_the_shares(spark):
    shares = [0.5, 0.0, 0.3, 0.2]
    got = Counter(r.g for r in spark.range(20_000).select(N.stratified_guess(F.col("id"), shares, 3).alias("g")).collect())
    assert got[1] == 0 and all(abs(got[c] / 20_000 - s) < 0.015 for c, s in enumerate(shares))
    again = spark.range(50).select(N.stratified_guess(F.col("id"), shares, 3).alias("g"), N.stratified_guess(F.col("id"), shares, 4).alias("h")).collect()
    assert [r.g for r in again] != [r.h for r in again]
