"""Cleaning, validation, distribution, leakage, split and audit operators over record tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.operators.components import checkpoint_dir, connected_components
from tallymill.operators.ordered import running_sums


def cleaned(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of rows that lack none of them and whose trimmed text is not empty."""
    return df.select(*columns).dropna().withColumn(text, T.stripped(F.col(text))).where(F.length(text) > 0)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order. Only keys and order are ranked when the order names a row."""
    return df.withColumn("first_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("first_rank = 1").drop("first_rank")


def shares(df: DataFrame, label: str, classes: DataFrame | None = None) -> DataFrame:
    """(label, n, percent): counts in the order of all classes, percent of all rows at two digits."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    if classes is not None:
        n = classes.join(n, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("rows"))).select(label, "n", F.round(100 * F.col("n") / F.col("rows"), 2).alias("percent"))


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """(label, weight): rows over classes times class rows, which count one at least."""
    grid = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    n = grid.join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    return n.crossJoin(df.agg(F.count("*").alias("rows"))).select(label, (F.col("rows") / (classes * F.greatest("n", F.lit(1)))).alias("weight"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks. A rule that is null holds, as in SQL checks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def label_mismatches(df: DataFrame, names: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """The first examples of rows whose label name is not that of their label id."""
    return df.join(names, "label_id", "left").where(~F.col("label").eqNullSafe(F.col("expected"))).orderBy(key).select(key, "label_id", "label", "expected").limit(limit)


def group_ranges(df: DataFrame, group: str, time: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def temporal_split(df: DataFrame, group: str, time: str, val_start: str, test_start: str) -> DataFrame:
    """(group, first, last, n, split): whole groups on one side of each cutoff; groups across one are quarantined."""
    g, v, t = group_ranges(df, group, time), F.lit(val_start).cast("timestamp"), F.lit(test_start).cast("timestamp")
    split = F.when(F.col("last") < v, "train").when((F.col("first") >= v) & (F.col("last") < t), "val").when(F.col("first") >= t, "test").otherwise("quarantine")
    return g.withColumn("split", split)


def ordered_cutoffs(df: DataFrame, group: str, time: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(val_start, test_start): start times of the groups at the given shares of all groups in order of start.

    Start times are counted by value first, then added up in ranges of time.
    """
    starts = group_ranges(df, group, time).groupBy("first").agg(F.count("*").alias("k"))
    run = running_sums(starts, "first", {"upto": "k"})
    n = run.crossJoin(run.agg(F.max("upto").alias("n")))
    at = lambda share: F.floor(F.lit(share) * F.col("n"))
    return n.agg(F.min(F.when(F.col("upto") > at(train), F.col("first"))).alias("val_start"), F.min(F.when(F.col("upto") > at(train + val), F.col("first"))).alias("test_start"))


def split_ranges(df: DataFrame, split: str, time: str) -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def strictly_ordered(ranges: DataFrame, split: str, order: list[str]) -> DataFrame:
    """(ordered): whether each split ends before the next begins."""
    edge = ranges.agg(*[F.max(F.when(F.col(split) == s, F.col(c))).alias(f"{c}_{s}") for s in order for c in ("first", "last")])
    return edge.select(reduce(lambda a, b: a & b, [F.col(f"last_{a}") < F.col(f"first_{b}") for a, b in zip(order, order[1:], strict=False)]).alias("ordered"))


def cross_overlap(df: DataFrame, split: str, values: list[str], salt: str = "") -> DataFrame:
    """(column, left, right, n, examples): values that two splits share, with five hashed examples."""
    long = df.select(split, F.explode(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("string"))])).alias("column", "value")).where("value is not null").distinct()
    a = long.select("column", "value", F.col(split).alias("left"))
    b = long.select("column", "value", F.col(split).alias("right"))
    both = a.join(b, ["column", "value"]).where("left < right").withColumn("place", F.row_number().over(W.partitionBy("column", "left", "right").orderBy("value")))
    code = F.substring(F.sha2(F.concat(F.lit(salt), "value"), 256), 1, 16)
    return both.groupBy("column", "left", "right").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= 5, code))).alias("examples"))


def shared_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): keys that more than one split has."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def aligned(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """(rows, differ): two ordered lists compared place by place."""
    j = a.select(position, F.col(value).alias("x")).join(b.select(position, F.col(value).alias("y")), position, "full_outer")
    return j.agg(F.count("*").alias("rows"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differ"))


def reconciled(declared: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, finding): missing, undeclared or mismatched entries of two manifests."""
    j = declared.select(key, F.col(digest).alias("d"), F.lit(True).alias("in_d")).join(actual.select(key, F.col(digest).alias("a"), F.lit(True).alias("in_a")), key, "full_outer")
    finding = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_d").isNull(), "undeclared").when(~F.col("d").eqNullSafe(F.col("a")), "mismatched")
    return j.select(key, finding.alias("finding")).where("finding is not null")


def class_map_digest(classes: DataFrame, label_id: str, label: str, version: int) -> DataFrame:
    """(classes, digest) of the ordered map of label ids and names; a row for each class, so a list of them is small."""
    entry = F.struct(F.col(label_id).alias("label_id"), F.col(label).alias("label_name"))
    ordered = classes.agg(F.array_sort(F.collect_list(entry)).alias("c"))
    text = T.canonical_json(classes=F.col("c"), label_id_column=F.lit(label_id), label_name_column=F.lit(label), schema_version=F.lit(version))
    return ordered.select(F.size("c").cast("long").alias("classes"), F.sha2(text, 256).alias("digest"))


def split_manifest(df: DataFrame, split: str, group: str, time: str) -> DataFrame:
    """(split, rows, groups, largest_group, first, last) of each split."""
    by_group = df.groupBy(split, group).agg(F.count("*").alias("n"), F.min(time).alias("low"), F.max(time).alias("high"))
    return by_group.groupBy(split).agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.max("n").alias("largest_group"), F.min("low").alias("first"), F.max("high").alias("last"))


# Near-duplicate groups.

#: Most ids that are broadcast to find the texts that have a candidate.
SENT_IDS = 500_000


def key_edges(df: DataFrame, node: str, key: str) -> DataFrame:
    """(a, b): each row of a shared non-null key with the key's smallest row."""
    rows = df.where(F.col(key).isNotNull())
    low = rows.groupBy(key).agg(F.min(node).alias("b"), F.count("*").alias("n")).where("n > 1")
    return rows.join(low, key).where(F.col(node) > F.col("b")).select(F.col(node).alias("a"), "b")


def hamming_pairs(df: DataFrame, node: str, code: str, radius: int) -> DataFrame:
    """(a, b, distance): rows with codes within the radius, one row of each code.

    Of radius + 2 parts, each every so-many-th bit, two codes within the radius are equal in two at least. Parts run through
    the whole code, so bits that are constant in a table weaken all parts a little and none much.
    """
    once = df.groupBy(code).agg(F.min(node).alias("n"))
    parts = [sum(1 << i for i in range(k, 64, radius + 2)) for k in range(radius + 2)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(code).bitwiseAND(F.lit(signed(x | y))).alias("part")) for i, (x, y) in enumerate(combinations(parts, 2))])
    banded = once.select("n", F.col(code).alias("c"), F.inline(bands))
    a, b = banded.select("band", "part", F.col("n").alias("a"), F.col("c").alias("ca")), banded.select("band", "part", F.col("n").alias("b"), F.col("c").alias("cb"))
    near = a.join(b, ["band", "part"]).where((F.col("a") < F.col("b")) & (T.hamming(F.col("ca"), F.col("cb")) <= radius))
    return near.select("a", "b", T.hamming(F.col("ca"), F.col("cb")).alias("distance")).distinct()


def verified_pairs(pairs: DataFrame, sets: DataFrame, node: str, shingles: str, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs that are alike enough.

    Pairs travel with codes of their sets, two hashes with different seeds, and each pair of codes is verified once: many rows can have one
    set. The sizes of compressed files say little about those of sets, so neither sets nor codes are broadcast for them.
    """
    size = F.size(shingles)  # hashes pass over nulls
    coded = sets.where(F.col(shingles).isNotNull()).select(F.col(node).alias("node"), F.col(shingles).alias("set"), F.xxhash64(shingles, size).alias("h"), F.xxhash64(F.lit(1), shingles, size).alias("g"))
    codes, once = coded.select("node", "h", "g"), coded.groupBy("h", "g").agg(F.first("set").alias("set"))
    both = lambda left, right, *on: left.join(right.hint("merge"), [*on])
    j = both(both(pairs, codes.toDF("a", "ha", "ga"), "a"), codes.toDF("b", "hb", "gb"), "b")
    of_a, of_b = ["ha", "ga"], ["hb", "gb"]
    kinds = both(both(j.select(*of_a, *of_b).distinct(), once.toDF(*of_a, "sa"), *of_a), once.toDF(*of_b, "sb"), *of_b)
    alike = kinds.select(*of_a, *of_b, T.jaccard(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
    return j.join(alike, [*of_a, *of_b]).select("a", "b", "likeness")


def unique_ids(df: DataFrame, node: str) -> DataFrame:
    """The frame itself, once no id is null or comes twice: rows of one id would join what is unlike."""
    bad = df.groupBy(node).count().where(F.col(node).isNull() | (F.col("count") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"{node} must be unique and not null: {[r[0] for r in bad]}")
    return df


def grouped(df: DataFrame, node: str, text: str, keys: list[str] | None = None, radius: int = 3, threshold: float = 0.82, image: str | None = None, image_radius: int = 5, image_problem: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Leakage groups and their receipt.

    Groups: (node, group, members), rows joined by equal normalised texts, verified near texts, near images (64-bit codes; null is
    none) and shared explicit keys. Receipt, one row: how many edges of each kind unite what no kind before did (exact_text_edges,
    near_text_edges, near_image_edges, explicit_group_edges), as the fall in the number of components, whatever the order of rows; and
    missing_images and unreadable_images (rows without a code, by whether image_problem says `unreadable`).

    Exact copies and keys give star edges to the smallest row. Of distinct texts with codes within the radius, each is verified with the
    smallest of them first, and then the pairs that this has left apart; a group of near copies still costs its pairs of ids. Each
    kind's edges are contracted to the components before it, so a round of components sees only what is not yet united. Ids must be
    unique and not null; texts are equal if their SHA-256 digests are.
    """
    rows = unique_ids(df, node)
    checkpoint_dir(df.sparkSession)
    merged, united = None, {}
    for kind, edges in _edges_by_kind(rows, node, text, keys or [], radius, threshold, image, image_radius):
        merged, fall = _contracted(merged, edges(merged))
        united[kind] = united.get(kind, 0) + fall
    placed = rows.select(node).join(merged.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    named = placed.groupBy("component").agg(T.group_name(F.collect_list(F.col(node).cast("string"))).alias("group"), F.count("*").alias("members"))
    none = F.col(image).isNull() if image else F.lit(True)
    broken = (F.coalesce(F.col(image_problem), F.lit("")) == "unreadable") if image_problem else F.lit(False)
    receipt = df.agg(*[F.lit(n).cast("long").alias(f"{kind}_edges") for kind, n in united.items()], F.count_if(none & ~broken).alias("missing_images"), F.count_if(none & broken).alias("unreadable_images"))
    return placed.join(named, "component").select(node, "group", "members"), receipt


def _edges_by_kind(rows: DataFrame, node: str, text: str, keys: list[str], radius: int, threshold: float, image: str | None, image_radius: int):
    """(kind, edges by what is united so far), in turns."""
    # One pass over the texts; what travels is their digests and codes. Texts themselves travel only if they have a candidate.
    norm = lambda df: df.select(node, T.normalised(F.col(text)).alias("norm")).where("norm != ''")
    coded = norm(rows).withColumn("code", T.text_simhash64("norm")).select(node, F.unhex(F.sha2("norm", 256)).alias("digest"), "code").checkpoint(eager=True)
    yield "exact_text", lambda merged: key_edges(coded, node, "digest")
    once = coded.groupBy("digest").agg(F.min(node).alias(node), F.min("code").alias("code"))
    near = hamming_texts(once.select(node, "code"), node, radius).checkpoint(eager=True)
    needed = near.select(F.col("a").alias(node)).union(near.select(F.col("b").alias(node))).distinct().checkpoint(eager=True)
    texts = norm(rows.join(F.broadcast(needed) if needed.count() <= SENT_IDS else needed, node, "left_semi")).checkpoint(eager=True)
    # Each text with the smallest near it first: that unites most families, and pairs inside what is united need no look.
    stars = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").checkpoint(eager=True)
    yield "near_text", lambda merged: _alike(stars, texts, node, threshold)
    yield "near_text", lambda merged: _alike(_apart(near.join(stars, ["a", "b"], "left_anti"), merged), texts, node, threshold)
    none = rows.select(F.col(node).alias("a"), F.col(node).alias("b")).limit(0)
    if image:
        coded = rows.where(F.col(image).isNotNull())
        none = key_edges(coded, node, image).union(hamming_pairs(coded, node, image, image_radius).select("a", "b"))
    yield "near_image", lambda merged: none
    every = rows.select(F.col(node).alias("a"), F.col(node).alias("b")).limit(0)
    for k in keys:
        every = every.union(key_edges(rows.withColumn(k, F.nullif(T.normalised(F.col(k).cast("string")), F.lit(""))), node, k))
    yield "explicit_group", lambda merged: every


def _apart(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    up = merged.select("node", "component")
    j = pairs.join(up.toDF("a", "up_a"), "a", "left").join(up.toDF("b", "up_b"), "b", "left")
    return j.where(F.coalesce("up_a", "a") != F.coalesce("up_b", "b")).select("a", "b")


def _alike(pairs: DataFrame, texts: DataFrame, node: str, threshold: float) -> DataFrame:
    """The pairs whose normalised texts, none of them empty, are alike enough. Texts travel, not their sets of runs, which take many times
    their room; in lambdas the sets of a pair are made once."""
    a, b = texts.select(F.col(node).alias("a"), F.col("norm").alias("ta")), texts.select(F.col(node).alias("b"), F.col("norm").alias("tb"))
    sets = F.array(F.struct(T.char_shingles(F.col("ta")).alias("a"), T.char_shingles(F.col("tb")).alias("b")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("both"), (F.size(s["a"]) + F.size(s["b"])).alias("sum")))
    return pairs.join(a, "a").join(b, "b").where(F.exists(sizes, lambda n: n["both"] / (n["sum"] - n["both"]) >= threshold)).select("a", "b")


def _contracted(merged: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) after these edges too, and how many components fewer there are."""
    if merged is not None:
        for side in ("a", "b"):
            there = merged.select(F.col("node").alias("there"), F.col("component").alias("up"))
            edges = edges.join(there, F.col(side) == F.col("there"), "left").withColumn(side, F.coalesce("up", side)).select("a", "b")
    new = connected_components(edges, "a", "b").checkpoint(eager=True)
    fall = new.agg(F.count("*") - F.countDistinct("component")).first()[0]
    if merged is None:
        return new, fall
    there = new.select(F.col("node").alias("there"), F.col("component").alias("up"))
    moved = merged.join(there, F.col("component") == F.col("there"), "left").select("node", F.coalesce("up", "component").alias("component"))
    return moved.union(new.join(merged, "node", "left_anti").select("node", "component")).checkpoint(eager=True), fall


def leakage_groups(df: DataFrame, node: str, text: str, keys: list[str] | None = None, radius: int = 3, threshold: float = 0.82, image: str | None = None, image_radius: int = 5) -> DataFrame:
    """(node, group, members) of grouped."""
    return grouped(df, node, text, keys, radius, threshold, image, image_radius)[0]


def hamming_texts(once: DataFrame, node: str, radius: int) -> DataFrame:
    """Each pair of texts with codes within the radius, those of one code too."""
    low = once.groupBy("code").agg(F.min(node).alias("low"))
    member = once.join(low, "code").select("low", F.col(node).alias("id"))
    x, y = member.select(F.col("low").alias("a"), F.col("id").alias("x")), member.select(F.col("low").alias("b"), F.col("id").alias("y"))
    across = hamming_pairs(once, node, "code", radius).select("a", "b").join(x, "a").join(y, "b")
    within = x.join(y, F.col("a") == F.col("b")).where("x < y")
    return across.select("x", "y").union(within.select("x", "y")).toDF("a", "b")


# Audits.


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high); null without trials."""
    p = successes / F.nullif(n, F.lit(0))
    den = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / den, z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / den
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def quotas(sizes: DataFrame, label: str, total: int, least: int) -> DataFrame:
    """(label, size, quota): `least` from each stratum, the rest in proportion to what is left of it, by largest remainder.

    A row for each stratum, so the ordering is over strata. What one round of remainders cannot place, as strata are full, the
    next ones do.
    """
    n = F.count("*").over(W.partitionBy())
    s = sizes.withColumn("capacity", F.col("size") - least).withColumn("raw", (total - least * n) * F.col("capacity") / F.nullif(F.sum("capacity").over(W.partitionBy()), F.lit(0)))
    s = s.withColumn("base", least + F.least("capacity", F.floor(F.coalesce("raw", F.lit(0.0))))).withColumn("left", total - F.sum("base").over(W.partitionBy()))
    order = W.orderBy(F.desc(F.col("raw") - F.floor("raw")), F.desc("size"), F.desc(label))
    open_ = F.when(F.col("base") < F.col("size"), 1).otherwise(0)
    s = s.withColumn("turn", F.sum(open_).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return s.select(label, "size", (F.col("base") + F.when((open_ == 1) & (F.col("turn") <= F.col("left")), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, label: str, key: str, quota: DataFrame, seed: int) -> DataFrame:
    """Rows of each stratum with the smallest seeded hashes of their key, up to its quota; the hash is SHA-256 of `seed:key`, so that
    any system draws the same rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    ranked = df.withColumn("turn", F.row_number().over(W.partitionBy(label).orderBy(h, key)))
    return ranked.join(quota.select(label, "quota"), label).where("turn <= quota").drop("turn", "quota")


def audit_summary(df: DataFrame, label: str, ok: str, population: DataFrame) -> DataFrame:
    """(micro, low, high, macro, scored): design-weighted rate with finite-population variance, and the mean over strata."""
    s = df.where(F.col(ok).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.avg(F.col(ok).cast("double")).alias("rate"))
    j = population.join(s, label).withColumn("weight", F.col("size") / F.sum("size").over(W.partitionBy()))
    var = F.when((F.col("n") > 1) & (F.col("size") > 1), F.pow("weight", F.lit(2)) * F.greatest(F.lit(0.0), 1 - F.col("n") / F.col("size")) * F.col("rate") * (1 - F.col("rate")) / (F.col("n") - 1)).otherwise(0.0)
    a = j.agg(F.sum(F.col("weight") * F.col("rate")).alias("micro"), F.sum(var).alias("var"), F.avg("rate").alias("macro"), F.sum("n").alias("scored"))
    half = 1.959963984540054 * F.sqrt("var")
    return a.select("micro", F.greatest(F.lit(0.0), F.col("micro") - half).alias("low"), F.least(F.lit(1.0), F.col("micro") + half).alias("high"), "macro", "scored")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(observed, kappa) of two 0/1 raters; kappa is null where agreement by chance is certain."""
    m = df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    e = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("observed", F.when(e < 1, (F.col("observed") - e) / F.nullif(1 - e, F.lit(0.0))).alias("kappa"))


def screen(df: DataFrame, text: str) -> DataFrame:
    """(pattern, occurrences, rows) of every personal-data pattern."""
    counts = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias("k")) for n, p in T.SCREENS.items()])
    return df.select(F.inline(counts)).groupBy("pattern").agg(F.sum("k").alias("occurrences"), F.count_if(F.col("k") > 0).alias("rows"))


def private_findings(df: DataFrame, text: str, id: str, salt: str, others: str | None = None) -> DataFrame:
    """(private_row_id, finding_types) of rows with personal data: the salted id and the names of the patterns found, sorted.

    The salt is a secret of 16 characters or more. Null ids have one null code; a null text has no findings. others: a column with
    further findings of a row, as those of its picture's metadata.
    """
    if len(salt) < 16:
        raise ValueError("the salt needs at least 16 characters")
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in T.SCREENS.items()])))
    if others:
        found = F.array_sort(F.array_union(found, F.coalesce(F.col(others), F.array().cast("array<string>"))))
    return df.select(T.salted_id(F.col(id), salt).alias("private_row_id"), found.alias("finding_types")).where(F.size("finding_types") > 0)


# Exact reconstruction of counts from rates at four decimals, in whole numbers.


def displays_as(num: Column, den: Column, shown: Column) -> Column:
    """Whether num / den, rounded half up to four decimals, is shown / 10000."""
    return (den > 0) & ((2 * shown - 1) * den <= 20000 * num) & (20000 * num < (2 * shown + 1) * den)


def reconstruct(report: DataFrame, samples: int) -> DataFrame:
    """(label, tp, fn, fp): every count triple that shows the reported precision, recall and F1.

    Recall leaves few true positives for a class, before false positives are spread out; precision bounds those.
    """
    r = report.select("label", F.col("support").cast("long").alias("s"), *[T.four_decimals(F.col(c)).cast("long").alias(c[0]) for c in ("precision", "recall", "f1")])
    tp = r.withColumn("tp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s")))).where(displays_as(F.col("tp"), F.col("s"), F.col("r")))
    fp = tp.withColumn("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples) - F.col("s"))))
    hit = fp.where(displays_as(F.col("tp"), F.col("tp") + F.col("fp"), F.col("p")) & displays_as(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("s"), F.col("f")))
    return hit.select("label", "tp", (F.col("s") - F.col("tp")).alias("fn"), "fp")


def margins(counts: DataFrame) -> DataFrame:
    """Sums and macro averages of reconstructed counts."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return counts.agg(F.sum(F.col("tp") + F.col("fn")).alias("samples"), F.sum("tp").alias("correct"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))
