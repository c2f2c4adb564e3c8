"""Paired comparison of two systems: exact tests, corrections and whole-cluster bootstraps."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.operators.ordered import numbered


def mcnemar(df: DataFrame, reference: str, challenger: str) -> DataFrame:
    """(b, c, delta, p_value) from two correctness columns: discordant counts, accuracy gain, exact two-sided p."""
    n = df.agg(F.count_if(F.col(reference) & ~F.col(challenger)).alias("b"), F.count_if(~F.col(reference) & F.col(challenger)).alias("c"), F.count("*").alias("n"))
    return n.select("b", "c", ((F.col("c") - F.col("b")) / F.col("n")).alias("delta"), binomial_two_sided(F.least("b", "c"), F.col("b") + F.col("c")).alias("p_value"))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Twice the tail up to k of n fair draws, at most 1; 1 without draws. Terms are added as logarithms."""
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.exp(-n * F.ln(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1) / i)
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda a: a["sum"])
    tail = F.when(k < 1, F.exp(-n * F.ln(F.lit(2.0)))).otherwise(tail)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """With adjusted: Holm's step-down values, at most 1. One row for each comparison."""
    by = W.orderBy(p, *order)
    n = F.count("*").over(W.partitionBy())
    scaled = F.least(F.lit(1.0), (n - F.row_number().over(by) + 1) * F.col(p))
    return df.withColumn("scaled", scaled).withColumn("adjusted", F.max("scaled").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("scaled")


def cluster_differences(df: DataFrame, cluster: str, reference: str, challenger: str) -> DataFrame:
    """(cluster, d, n): gain in correct rows of each cluster."""
    return df.groupBy(cluster).agg(F.sum(F.col(challenger).cast("long") - F.col(reference).cast("long")).alias("d"), F.count("*").alias("n"))


def sign_flip(differences: DataFrame, exact_up_to: int = 20, draws: int = 20_000, seed: int = 314159) -> DataFrame:
    """(delta, informative, p_value) of cluster gains under random signs.

    With few informative clusters all sign patterns are counted as ways to each sum; else seeded draws with one added to both counts. Gains
    are first counted by value, so what reaches the driver are distinct gains.
    """
    spark = differences.sparkSession
    counted = differences.groupBy("d").agg(F.count("*").alias("clusters"), F.sum("n").alias("rows")).collect()
    rows, observed = sum(r.rows for r in counted), sum(r.d * r.clusters for r in counted)
    sizes = [(abs(r.d), r.clusters) for r in counted if r.d]
    informative = sum(k for _, k in sizes)
    if informative == 0:
        p = 1.0
    elif informative <= exact_up_to:
        ways = {0: 1}
        for size, k in sizes:
            for _ in range(k):
                step: dict[int, int] = {}
                for s, w in ways.items():
                    for t in (s + size, s - size):
                        step[t] = step.get(t, 0) + w
                ways = step
        p = sum(w for s, w in ways.items() if abs(s) >= abs(observed)) / 2**informative
    else:
        rng, total = np.random.default_rng(seed), np.zeros(draws, dtype=np.int64)
        for size, k in sorted(sizes):
            total += size * (2 * rng.binomial(k, 0.5, draws) - k)
        p = (1 + int((np.abs(total) >= abs(observed)).sum())) / (draws + 1)
    return spark.createDataFrame([(observed / rows if rows else float("nan"), informative, float(p))], "delta double, informative long, p_value double")


def cluster_design(df: DataFrame, cluster: str, y: str, ts: str) -> DataFrame:
    """(cluster, n, label, month, stratum, composition): majority label, smallest on ties; earliest UTC month."""
    by_label = df.groupBy(cluster, y).agg(F.count("*").alias("n"), F.min(F.date_format(ts, "yyyy-MM")).alias("month"))
    top = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("n"), y))
    parts = F.array_sort(F.collect_list(F.struct(F.col(y).alias("k"), F.col("n").alias("v"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda s: F.concat(F.lit('"'), s["k"].cast("string"), F.lit('":'), s["v"].cast("string"))), ","), F.lit("}"))
    out = by_label.withColumn("top", top).groupBy(cluster).agg(F.sum("n").alias("n"), F.max(F.when(F.col("top") == 1, F.col(y))).alias("label"), F.min("month").alias("month"), text.alias("composition"))
    return out.withColumn("stratum", F.concat(F.lit("utc_month="), F.col("month"), F.lit("|majority_label="), F.col("label").cast("string")))


def stream(seed: int, *path: int) -> np.random.Generator:
    """PCG64 of a descendant of the seed: below its first child for clusters, its second child for training seeds."""
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=path))


#: Clusters of a block: a matrix of draws spans one block of a stratum.
BLOCK = 256


def block_times(seed: int, stratum: str, clusters: int, block: int, draws: int) -> np.ndarray:
    """(draws, clusters of the block): how often each cluster of a stratum comes when as many as it has are drawn with replacement.

    The stratum's draws are shared out by halves of its blocks, a binomial for each node with a stream of its own, then among the
    block's clusters. So blocks can be made anywhere, in any order, and their counts still add up to the stratum's size.
    """
    name = int.from_bytes(hashlib.sha256(stratum.encode()).digest()[:8], "little")
    lo, hi, left = 0, -(-clusters // BLOCK), np.full(draws, clusters, dtype=np.int64)
    size = lambda a, b: min(b * BLOCK, clusters) - a * BLOCK
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = stream(seed, 0, name, lo, hi).binomial(left, size(lo, mid) / size(lo, hi))
        lo, hi, left = (lo, mid, first) if block < mid else (mid, hi, left - first)
    m = size(lo, hi)
    return stream(seed, 0, name, lo, hi).multinomial(left, np.full(m, 1 / m))


def seed_draws(seed: int, seeds: int, draws: int) -> np.ndarray:
    """(draws, seeds): positions of training seeds drawn with replacement, from the seed's second child."""
    return stream(seed, 1).integers(0, seeds, size=(draws, seeds))


def draw_table(spark: SparkSession, strata: dict[str, int], draws: int, seed: int) -> DataFrame:
    """(draw, stratum, member, times): the counts that block_times gives, those above zero."""
    names = spark.createDataFrame(list(strata.items()), "stratum string, clusters long")
    blocks = names.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("clusters") / BLOCK) - 1)).alias("block"))

    def run(it):
        for pdf in it:
            for stratum, clusters, block in pdf.itertuples(index=False):
                times = block_times(seed, stratum, clusters, block, draws)
                draw, member = np.nonzero(times)
                yield pd.DataFrame({"draw": draw, "stratum": stratum, "member": member + block * BLOCK, "times": times[draw, member]})

    return blocks.mapInPandas(run, "draw long, stratum string, member long, times long")


def cluster_bootstrap(clusters: DataFrame, statistics: list[str], draws: int, seed: int, *, stats: str | None = None, columns: np.ndarray | None = None) -> DataFrame:
    """(draw, statistic sums): clusters (stratum, cluster, statistics...) resampled inside strata, the same clusters for every statistic.

    Clusters are numbered in their stratum and packed in blocks of BLOCK; a task adds up its blocks for all draws and sends one row a draw,
    so neither clusters nor draws are shuffled against each other. stats, columns: an array column that holds the statistics instead,
    and which of its entries each draw takes. Null strata are a stratum; an empty table has no draws.
    """
    packed = clusters.select(F.coalesce("stratum", F.lit("")).alias("stratum"), "cluster", (F.col(stats) if stats else F.array(*[F.col(s).cast("double") for s in statistics])).alias("x"))
    member = numbered(packed, "stratum", "cluster", "member")
    blocks = member.groupBy("stratum", F.floor(F.col("member") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("member", "x"))).alias("rows"))
    sizes = packed.groupBy("stratum").agg(F.count("*").alias("clusters"))
    sized = blocks.join(sizes, "stratum").select("stratum", "clusters", "block", F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"), F.size("rows").alias("m"))

    def run(it):
        total = None
        for pdf in it:
            for stratum, n, block, x, m in pdf.itertuples(index=False):
                sums = block_times(seed, stratum, n, block, draws) @ np.asarray(x, dtype=np.float64).reshape(m, -1)
                mine = sums if columns is None else np.take_along_axis(sums, columns, axis=1)
                total = mine if total is None else total + mine
        if total is not None:
            yield pd.DataFrame({"draw": np.arange(draws)} | {s: total[:, i] for i, s in enumerate(statistics)})

    schema = ", ".join(["draw long", *[f"{s} double" for s in statistics]])
    return sized.mapInPandas(run, schema).groupBy("draw").agg(*[F.sum(s).alias(s) for s in statistics])


def paired_names(classes: int) -> list[str]:
    """The sums that both metrics of two systems follow from: rows of a class, rows given to it, and right ones, by system."""
    return [f"{k}{c}" for k in ("y", "a", "ta", "b", "tb") for c in range(classes)]


def paired_counts(rows: DataFrame, classes: int) -> DataFrame:
    """(cluster, the sums of paired_names) of rows (cluster, y, a, b), a and b being two systems' predictions. Rows without a cluster
    are left out."""
    of = {"y": lambda c: F.col("y") == c, "a": lambda c: F.col("a") == c, "ta": lambda c: (F.col("a") == c) & (F.col("y") == c), "b": lambda c: F.col("b") == c, "tb": lambda c: (F.col("b") == c) & (F.col("y") == c)}
    return rows.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(*[F.count_if(f(c)).alias(f"{k}{c}") for k, f in of.items() for c in range(classes)])


def metric_differences(sums: DataFrame, classes: int) -> DataFrame:
    """With accuracy and macro_f1: what system b gains over a, from the sums of paired_names. A class that is neither there nor given
    counts as 0, and every class counts."""
    add = lambda k: reduce(lambda x, y: x + y, [F.col(f"{k}{c}") for c in range(classes)])

    def f1(side: str) -> Column:
        each = [F.coalesce(2.0 * F.col(f"t{side}{c}") / F.nullif((F.col(f"{side}{c}") + F.col(f"y{c}")).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in range(classes)]
        return reduce(lambda x, y: x + y, each) / classes

    return sums.withColumns({"accuracy": (add("tb") - add("ta")) / add("y"), "macro_f1": f1("b") - f1("a")})


def paired_bootstrap(rows: DataFrame, strata: DataFrame, classes: int, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """(metric, delta, low, high, p_nonpositive, p_nonnegative, p_two_sided) for accuracy and macro-F1 of two fixed systems.

    rows: (cluster, y, a, b); strata: (cluster, stratum). Whole clusters are drawn within strata, the same for both systems and both
    metrics; each cluster is its class counts, so a draw costs clusters, not rows. Tail shares count the point itself once.
    """
    names, counts = paired_names(classes), paired_counts(rows, classes)
    drawn = metric_differences(cluster_bootstrap(counts.join(strata.select("cluster", "stratum"), "cluster"), names, draws, seed), classes)
    point = metric_differences(counts.agg(*[F.sum(c).alias(c) for c in names]), classes).select("accuracy", "macro_f1")
    tail, out = (1 - level) / 2, []
    for m in ("accuracy", "macro_f1"):
        below, above = ((F.count_if(t) + 1) / (draws + 1) for t in (F.col(m) <= 0, F.col(m) >= 0))
        ends = drawn.agg(F.percentile(m, F.lit(tail)).alias("low"), F.percentile(m, F.lit(1 - tail)).alias("high"), below.alias("p_nonpositive"), above.alias("p_nonnegative"))
        both = ends.join(F.broadcast(point.select(F.col(m).alias("delta"))))  # a row each
        out.append(both.select(F.lit(m).alias("metric"), "delta", "low", "high", "p_nonpositive", "p_nonnegative", F.least(F.lit(1.0), 2 * F.least("p_nonpositive", "p_nonnegative")).alias("p_two_sided")))
    return out[0].unionByName(out[1])


def seed_sensitivity(rows: DataFrame, strata: DataFrame, seeds: int, draws: int, seed: int) -> DataFrame:
    """(draw, n, a, b): rows, and correct rows of two systems whose training seeds are drawn anew beside the clusters.

    rows: (cluster, y, a, b) with each system's class probabilities for each seed. A draw's seeds are the same for both systems; the
    sampled probabilities are averaged, the smallest class wins a tie. strata: (cluster, stratum). Cluster draws are those of
    cluster_bootstrap with this seed. Draws that hold the same seeds share one prediction, so a row is judged once for each such
    multiset and clusters keep one sum for each.
    """
    drawn = seed_draws(seed, seeds, draws)
    taken = np.stack([(drawn == s).sum(axis=1) for s in range(seeds)], axis=1)
    kinds, kind = np.unique(taken, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    k = len(kinds)

    def judge(it):
        for pdf in it:
            if not len(pdf):
                continue
            y, out = pdf["y"].to_numpy(), [np.ones((len(pdf), 1))]
            for system in ("a", "b"):
                p = np.array([np.stack(list(v)) for v in pdf[system]], dtype=np.float64)
                out.append(np.einsum("ks,rsc->rkc", kinds / seeds, p).argmax(axis=2) == y[:, None])
            names, code = np.unique(pdf["cluster"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(names), 1 + 2 * k))
            np.add.at(sums, code, np.hstack(out).astype(np.float64))
            yield pd.DataFrame({"cluster": names, "x": list(sums)})

    kept = rows.where(F.col("cluster").isNotNull()).select("cluster", "y", "a", "b")
    part = kept.mapInPandas(judge, f"cluster {dict(kept.dtypes)['cluster']}, x array<double>")
    entry = part.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"))
    sums = entry.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("x"))
    columns = np.stack((np.zeros(draws, dtype=np.int64), 1 + kind, 1 + k + kind), axis=1)
    return cluster_bootstrap(sums.join(strata.select("cluster", "stratum"), "cluster"), ["n", "a", "b"], draws, seed, stats="x", columns=columns)


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1 - tail)).alias("high"), F.avg((F.col(column) <= 0).cast("double")).alias("tail_low"), F.avg((F.col(column) >= 0).cast("double")).alias("tail_high"))
