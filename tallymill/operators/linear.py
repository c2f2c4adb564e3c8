"""Word 1- and 2-gram features and a linear classifier on them, trained by averaged stochastic gradient descent in every task at once.

The vocabulary is counted and cut to its size in Spark; what reaches tasks is bounded by that size, whatever the number of texts. Training is
iterative parameter mixing: in each round every task starts from the same weights, goes through its rows once and returns the mean
of the weights it passed; the rounds' result is their mean by rows. Rows stay where they are, and a lost task is run again
with the same outcome.

Special cases: a null text is empty; a text without known terms has the probabilities of the intercepts; null labels are left out of
training; a class without rows gets the weight of none; without rows every class is as likely.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.operators.components import checkpoint_dir

#: A term is a run of two word characters or more.
TERM = r"[\p{L}\p{N}_]{2,}"
BATCH = 64


def terms(text: Column, low: int = 1, high: int = 2) -> Column:
    """The n-grams of a text's lower-case terms, n from low to high, with repeats."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))

    def of_size(w: Column, n: int) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))

    def grams(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in range(low, high + 1)])

    return _once(words, grams)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, even where f uses it at every entry of an array."""
    return F.get(F.transform(F.array(value), f), 0)


def vocabulary(train: DataFrame, text: str, *, low: int = 1, high: int = 2, min_df: int = 2, most: int = 100_000) -> DataFrame:
    """(term, df, n, index): the terms of `min_df` texts or more, the `most` of them that occur most often (ties: the smaller term), numbered
    in their order. One shuffle of partial counts; the only ordering is of the result's bounded rows."""
    new = lambda t: F.transform(t, lambda x, i: F.struct(x.alias("term"), F.coalesce(F.get(t, i - 1) != x, F.lit(True)).cast("long").alias("new")))
    marked = train.select(_once(F.sort_array(terms(F.col(text), low, high)), new).alias("t"))
    counts = marked.select(F.inline("t")).groupBy("term").agg(F.sum("new").alias("df"), F.count("*").alias("n")).where(F.col("df") >= min_df)
    kept = counts.orderBy(F.desc("n"), "term").limit(most)
    return kept.withColumn("index", F.row_number().over(W.orderBy("term")) - 1)


def features(df: DataFrame, text: str, words: DataFrame, texts: int, keep: list[str], *, low: int = 1, high: int = 2) -> DataFrame:
    """The kept columns and index, value: arrays of term numbers and weights (1 + ln tf) (1 + ln((1 + texts) / (1 + df))), of length 1 together.

    words: the vocabulary, which is small; the texts are not shuffled, as each is looked up in a map of it.
    """
    weight = 1 + F.log((F.lit(texts) + 1) / (F.col("df") + 1))
    table = {r.term: (r["index"], r.idf) for r in words.select("term", "index", weight.alias("idf")).collect()}  # at most `most` terms
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(it):
        for pdf in it:
            index, value = [], []
            for grams in pdf["grams"]:
                found, tf = np.unique([sent.value[g][0] for g in grams if g in sent.value] or np.empty(0, dtype=np.int64), return_counts=True)
                idf = {i: w for i, w in (sent.value[g] for g in grams if g in sent.value)}
                v = (1 + np.log(tf)) * np.array([idf[i] for i in found]) if len(found) else np.empty(0)
                index.append(found.astype(np.int64))
                value.append(v / np.sqrt((v * v).sum()) if len(v) else v)
            yield pdf.drop(columns="grams").assign(index=index, value=value)

    rows = df.select(*keep, terms(F.col(text), low, high).alias("grams"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "grams")
    return rows.mapInPandas(run, f"{kinds}, index array<long>, value array<double>")


@dataclass
class Linear:
    """One weight vector and intercept for each class, against all others."""

    weights: np.ndarray
    intercept: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(classes, rows) of rows that begin at starts, the last start being the end."""
        run = np.concatenate((np.zeros((len(self.intercept), 1)), np.cumsum(self.weights[:, index] * value, axis=1)), axis=1)
        return run[:, starts[1:]] - run[:, starts[:-1]] + self.intercept[:, None]

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """(rows, classes), each class's own probability over their sum."""
        p = 1 / (1 + np.exp(-np.clip(margins, -35, 35)))
        return (p / p.sum(axis=0)).T


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(x) for x in pdf["index"]]))).astype(np.int64)
    join = lambda c, t: np.concatenate([np.asarray(x, dtype=t) for x in pdf[c]]) if starts[-1] else np.empty(0, dtype=t)
    return join("index", np.int64), join("value", np.float64), starts


def _pass(model: Linear, balance: np.ndarray, alpha: float, step: float, seen: int, pdfs):
    """One task's rows once: the mean of the weights on the way, and how many rows there were."""
    w, b = model.weights.copy(), model.intercept.copy()
    mean_w, mean_b, rows, turns = np.zeros_like(w), np.zeros_like(b), 0, 0
    for pdf in pdfs:
        index, value, starts = _flat(pdf)
        y = pdf["y"].to_numpy().astype(np.int64)
        for lo in range(0, len(y), BATCH):
            hi = min(lo + BATCH, len(y))
            i, v, s = index[starts[lo] : starts[hi]], value[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
            m = Linear(w, b).margins(i, v, s)
            # Each row counts by the rarity of its class.
            g = (1 / (1 + np.exp(-np.clip(m, -35, 35))) - (np.arange(len(b))[:, None] == y[lo:hi])) * balance[y[lo:hi]]
            rate = step / (1 + step * alpha * (seen + rows))
            w *= max(0.0, 1 - rate * alpha * (hi - lo))
            each = np.repeat(np.arange(hi - lo), np.diff(s))
            for c in range(len(b)):
                w[c] -= rate * np.bincount(i, weights=g[c, each] * v, minlength=w.shape[1])
            b -= rate * g.sum(axis=1)
            rows, turns = rows + hi - lo, turns + 1
            mean_w += (w - mean_w) / turns
            mean_b += (b - mean_b) / turns
    return mean_w, mean_b, rows


def train_linear(rows: DataFrame, classes: int, size: int, *, alpha: float = 1e-4, step: float = 0.5, rounds: int = 8) -> Linear:
    """Logistic loss, classes balanced, by `rounds` rounds over rows (y, index, value). size: terms of the vocabulary."""
    checkpoint_dir(rows.sparkSession)
    spark, kept = rows.sparkSession, rows.where(F.col("y").isNotNull()).select(F.col("y").cast("int").alias("y"), "index", "value").checkpoint(eager=True)
    count = {r.y: r.n for r in kept.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total, model = sum(count.values()), Linear(np.zeros((classes, size)), np.zeros(classes))
    balance = np.array([total / (max(1, len(count)) * count[c]) if c in count else 0.0 for c in range(classes)])
    for turn in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast(model)  # classes x terms

        def run(it, sent=sent, seen=turn * total):
            w, b, n = _pass(sent.value, balance, alpha, step, seen, it)
            if n:
                yield pd.DataFrame({"group": [TaskContext.get().partitionId() % 16], "n": [n], "load": [np.concatenate((w, b[:, None]), axis=1).astype("f8").tobytes()]})

        def add(key, pdf):
            n = pdf["n"].sum()
            load = sum(k * np.frombuffer(x, dtype="f8") for k, x in zip(pdf["n"], pdf["load"], strict=True)) / n
            return pd.DataFrame({"group": [0], "n": [n], "load": [load.tobytes()]})

        schema = "group long, n long, load binary"
        # Sums in two steps, so that no task holds every task's weights.
        parts = kept.mapInPandas(run, schema).groupBy("group").applyInPandas(add, schema)
        got = parts.groupBy("group").applyInPandas(add, schema).first()
        both = np.frombuffer(got["load"], dtype="f8").reshape(classes, size + 1)
        model = Linear(both[:, :-1].copy(), both[:, -1].copy())
        sent.unpersist()
    return model


def linear_probabilities(rows: DataFrame, model: Linear, keep: list[str]) -> DataFrame:
    """The kept columns and p: class probabilities of rows with index, value."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    named = rows.select(*keep, "index", "value")

    def run(it):
        for pdf in it:
            p = sent.value.probabilities(sent.value.margins(*_flat(pdf)))
            yield pdf[keep].assign(p=list(p))

    kinds = ", ".join(f"`{c}` {k}" for c, k in named.select(*keep).dtypes)
    return named.mapInPandas(run, f"{kinds}, p array<double>")


def stratified_guess(key: Column, shares: list[float], seed: int) -> Column:
    """A class drawn for each key by the shares of the classes, from a seeded hash: the same on every run."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    ends = np.cumsum(shares)
    out = F.lit(max([c for c, s in enumerate(shares) if s > 0], default=0))
    for c in reversed(range(len(shares))):
        out = F.when(u < F.lit(float(ends[c])), F.lit(c)).otherwise(out)
    return out
