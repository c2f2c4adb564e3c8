"""Queries over record tables: cleaning, validation, distribution, leakage, splits, duplicates, audits, reconstruction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.functions import vectors as V
from tallymill.operators import tables as O
from tallymill.operators.metrics import predicted
from tallymill.plans.fixtures import CLASSES, HEADS_CTE, PRED_CTE, head, heads
from tallymill.plans.registry import query, table

#: Raw agency names, by part number, that exercise every rule.
RAW = ["Suku Dinas Bina Marga", "satpol pp kota", "UP Perparkiran", "Kelurahan Menteng", "Dinas Pertamanan", "Sumber Daya Air Timur", "Tata Ruang", "PT Jakarta", "Perumda Air", "Dinas Kehutanan", "Biro Umum", "Lalu Lintas Jalan Raya"]
_RAW_SQL = "[" + ", ".join(f"'{x}'" for x in RAW) + "]"
_RULES_SQL = (
    "CASE "
    + " ".join("WHEN " + " OR ".join([f"contains(up, '{p}')" for p in phrases] + [f"starts_with(up, '{p}')" for p in prefixes]) + f" THEN '{name}'" for name, phrases, prefixes in T.PHRASES)
    + f" ELSE '{T.CLASSES[-1]}' END"
)
_NAMED = f"named AS (SELECT p_partkey AS id, label FROM (SELECT p_partkey, {_RULES_SQL} AS label FROM (SELECT p_partkey, upper(({_RAW_SQL})[p_partkey % 12 + 1]) AS up FROM part)))"
_MAP_SQL = "list_position([" + ", ".join(f"'{c}'" for c in T.CLASSES) + "], label) - 1"


def raw(spark, sf):
    names = F.array(*[F.lit(x) for x in RAW])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names[(F.col("p_partkey") % 12).cast("int")].alias("raw"))


def named(spark, sf):
    return raw(spark, sf).select("id", T.agency_class(F.col("raw")).alias("label"))


@query("p1_clean", "SELECT o_orderkey, trim(o_orderpriority) AS text FROM orders WHERE o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL AND length(trim(o_orderpriority)) > 0")
def clean(spark, sf):
    return O.cleaned(table(spark, sf, "orders").withColumn("text", F.col("o_orderpriority")), "text", ["o_orderkey", "text"])


@query("p2_agency_class", f"WITH {_NAMED} SELECT id, label FROM named")
def agency_class(spark, sf):
    return named(spark, sf)


@query("f7_string_tests", "SELECT p_partkey AS id, upper(p_name) AS up, contains(p_type, 'A') AS has, starts_with(p_brand, 'Brand#1') AS begins FROM part")
def string_tests(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("up"), F.col("p_type").contains("A").alias("has"), F.col("p_brand").startswith("Brand#1").alias("begins"))


@query("x5_row_function", f"WITH {_NAMED} SELECT id, lower(label) AS label FROM named")
def row_function(spark, sf):
    return named(spark, sf).select("id", F.lower("label").alias("label"))


@query("p3_label_ids", f"WITH {_NAMED} SELECT id, CAST({_MAP_SQL} AS INTEGER) AS label_id, ({[*T.SLUGS]})[{_MAP_SQL} + 1] AS slug FROM named")
def label_ids(spark, sf):
    return named(spark, sf).select("id", T.mapped(F.col("label"), [(c, i) for i, c in enumerate(T.CLASSES)]).alias("label_id"), T.mapped(F.col("label"), list(zip(T.CLASSES, T.SLUGS, strict=True))).alias("slug"))


@query("p4_default_enum", f"SELECT event_id, CASE WHEN event_id % 12 < 9 THEN ({[*T.SLUGS]})[event_id % 12 + 1] ELSE 'instansi_lain' END AS slug FROM events")
def default_enum(spark, sf):
    code = F.concat(F.lit("c"), (F.col("event_id") % 12).cast("string"))
    return table(spark, sf, "events").select("event_id", T.mapped(code, [(f"c{i}", s) for i, s in enumerate(T.SLUGS)], T.CATCH_ALL).alias("slug"))


@query("p5_integrity", "SELECT count(*) AS rows, count(*) FILTER (WHERE l_quantity IS NULL) AS missing, count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) AS broken, count(*) FILTER (WHERE l_linenumber < 0 OR l_linenumber >= 5) AS outside FROM lineitem")
def integrity(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("rows"), F.count_if(F.col("l_quantity").isNull()).alias("missing"), F.count_if(F.col("l_quantity") != F.floor("l_quantity")).alias("broken"), F.count_if((F.col("l_linenumber") < 0) | (F.col("l_linenumber") >= 5)).alias("outside"))


@query("p6_required", "SELECT 'created_at' AS missing UNION ALL SELECT 'laporan'")
def required(spark, sf):
    have = set(table(spark, sf, "orders").columns)
    lacking = sorted({"o_orderkey", "laporan", "created_at"} - have)
    return spark.createDataFrame([(c,) for c in lacking], "missing string")


_LABELLED = f"{_NAMED}, lab AS (SELECT id, CAST({_MAP_SQL} AS INTEGER) AS label_id, CASE WHEN id % 97 = 0 THEN 'Kelurahan' ELSE label END AS label FROM named)"


def labelled(spark, sf):
    n = named(spark, sf)
    return n.select("id", T.mapped(F.col("label"), [(c, i) for i, c in enumerate(T.CLASSES)]).alias("label_id"), F.when(F.col("id") % 97 == 0, "Kelurahan").otherwise(F.col("label")).alias("label"))


def class_names(spark):
    return spark.createDataFrame(list(enumerate(T.CLASSES)), "label_id int, expected string")


@query("p7_label_mismatch", f"WITH {_LABELLED} SELECT id, label_id, label, ({[*T.CLASSES]})[label_id + 1] AS expected FROM lab WHERE label IS DISTINCT FROM ({[*T.CLASSES]})[label_id + 1] ORDER BY id LIMIT 5")
def label_mismatch(spark, sf):
    return O.label_mismatches(labelled(spark, sf), class_names(spark), "id")


@query("c5_class_map", f"WITH {_LABELLED} SELECT label_id, min(label) AS label, count(DISTINCT label) AS names FROM lab GROUP BY label_id")
def class_map(spark, sf):
    return labelled(spark, sf).groupBy("label_id").agg(F.min("label").alias("label"), F.countDistinct("label").alias("names"))


@query("w7_first_text", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def first_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return O.first_of(d, ["digest"], ["doc_id"])


@query("w8_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_on(spark, sf):
    return O.first_of(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w12_row_index", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_id FROM embeddings")
def row_index(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("row_id"))


@query("f6_without_urls", r"SELECT page_id, trim(regexp_replace(regexp_replace('see ' || url || ' now', 'https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def without_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.without_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("text"))


@query("a1_shares", f"WITH {_NAMED}, n AS (SELECT label, count(*) AS n FROM named GROUP BY label) SELECT c.label, coalesce(n, 0) AS n, round(100.0::DOUBLE * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 2) AS percent FROM (SELECT unnest({[*T.CLASSES]}) AS label) c LEFT JOIN n ON n.label = c.label")
def shares(spark, sf):
    return O.shares(named(spark, sf), "label", class_names(spark).select(F.col("expected").alias("label")))


@query("a2_share_spread", "WITH s AS (SELECT o_orderstatus AS split, o_orderpriority AS label, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority) SELECT label, max(share) - min(share) AS spread FROM s GROUP BY label", "spread")
def share_spread(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("split")))
    return s.groupBy("label").agg((F.max("share") - F.min("share")).alias("spread"))


@query("a3_extremes", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT max(n) AS most, min(n) AS least, arg_max(label, (n, -label)) AS largest, arg_min(label, (n, label)) AS smallest, max(n) / min(n) AS imbalance FROM n", "imbalance")
def extremes(spark, sf):
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.max_by("label", F.struct("n", -F.col("label"))).alias("largest"), F.min_by("label", F.struct("n", "label")).alias("smallest"), (F.max("n") / F.min("n")).alias("imbalance"))


@query("a4_class_weights", "SELECT CAST(c AS INTEGER) AS label, (SELECT count(*) FROM embeddings) / (12 * greatest((SELECT count(*) FROM embeddings WHERE label = c), 1)) AS weight FROM range(0, 12) t(c)", "weight")
def class_weights(spark, sf):
    return O.class_weights(table(spark, sf, "embeddings"), "label", 12)


@query("a5_describe", "SELECT count(n) AS n, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS least, max(n) AS most, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, CAST(sum(round_even(n / 4, 0)) AS BIGINT) AS tokens FROM (SELECT length(text) AS n FROM documents)", "mean std p50 p90 p99")
def describe(spark, sf):
    n = table(spark, sf, "documents").select(F.length("text").cast("long").alias("n"))
    cuts = [F.percentile("n", F.lit(q)).alias(name) for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return n.agg(F.count("n").alias("n"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), *cuts, F.sum(F.bround(F.col("n") / 4, 0).cast("long")).alias("tokens"))


@query("a6_coverage", "SELECT t AS cut, avg(CASE WHEN length(text) <= t THEN 100.0 ELSE 0.0 END) AS percent FROM documents, (VALUES (128), (512), (2048)) v(t) GROUP BY t", "percent")
def coverage(spark, sf):
    n = table(spark, sf, "documents").select(F.length("text").alias("n"), F.explode(F.array(*[F.lit(t) for t in (128, 512, 2048)])).alias("cut"))
    return n.groupBy("cut").agg((F.avg((F.col("n") <= F.col("cut")).cast("double")) * 100).alias("percent"))


# Splits and leakage.

V0, T0 = "1995-06-01", "1996-06-01"
_SPLIT = f"grp AS (SELECT l_orderkey AS g, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY l_orderkey), sp AS (SELECT *, CASE WHEN last < TIMESTAMP '{V0}' THEN 'train' WHEN first >= TIMESTAMP '{V0}' AND last < TIMESTAMP '{T0}' THEN 'val' WHEN first >= TIMESTAMP '{T0}' THEN 'test' ELSE 'quarantine' END AS split FROM grp)"


def split_groups(spark, sf):
    return O.temporal_split(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate", V0, T0)


@query("c4_temporal_split", f"WITH {_SPLIT} SELECT g AS l_orderkey, split, n FROM sp")
def temporal_split(spark, sf):
    return split_groups(spark, sf).select("l_orderkey", "split", "n")


@query("p8_case", f"WITH {_SPLIT} SELECT split, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM sp GROUP BY split")
def case(spark, sf):
    return split_groups(spark, sf).groupBy("split").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


@query("a7_group_ranges", "SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def group_ranges(spark, sf):
    return O.group_ranges(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


@query("j1_map_back", f"WITH {_SPLIT} SELECT l_orderkey, l_linenumber, l_partkey, split FROM lineitem JOIN sp ON g = l_orderkey")
def map_back(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(split_groups(spark, sf).select("l_orderkey", "split"), "l_orderkey", "left")


@query("w9_cutoffs", "WITH f AS (SELECT min(l_shipdate) AS s FROM lineitem GROUP BY l_orderkey), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM f) SELECT min(s) FILTER (WHERE i > floor(0.7::DOUBLE * n)) AS val_start, min(s) FILTER (WHERE i > floor(CAST(0.85 AS DOUBLE) * n)) AS test_start FROM r")
def cutoffs(spark, sf):
    return O.ordered_cutoffs(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


@query("a11_split_ranges", f"WITH {_SPLIT} SELECT split, count(*) AS n, min(first) AS first, max(first) AS last FROM sp GROUP BY split")
def split_ranges(spark, sf):
    return O.split_ranges(split_groups(spark, sf).select("split", F.col("first").alias("t")), "split", "t")


@query("d3_strict_order", f"WITH {_SPLIT}, r AS (SELECT split, min(first) AS lo, max(last) AS hi FROM sp GROUP BY split) SELECT (SELECT hi FROM r WHERE split = 'train') < (SELECT lo FROM r WHERE split = 'val') AND (SELECT hi FROM r WHERE split = 'val') < (SELECT lo FROM r WHERE split = 'test') AS ordered")
def strict_order(spark, sf):
    g = split_groups(spark, sf).where("split != 'quarantine'")
    return O.strictly_ordered(g.groupBy("split").agg(F.min("first").alias("first"), F.max("last").alias("last")), "split", ["train", "val", "test"])


@query("a8_shared_keys", f"WITH {_SPLIT}, x AS (SELECT l_suppkey, split FROM lineitem JOIN sp ON g = l_orderkey) SELECT l_suppkey, count(DISTINCT split) AS splits FROM x GROUP BY l_suppkey HAVING count(DISTINCT split) > 1")
def shared_keys(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(split_groups(spark, sf).select("l_orderkey", "split"), "l_orderkey")
    return O.shared_keys(x, "l_suppkey", "split")


@query("a9_crosstab", "SELECT o_orderstatus AS split, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def crosstab(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return n.select("split", F.coalesce("`1-URGENT`", F.lit(0)).alias("urgent"), F.coalesce("`5-LOW`", F.lit(0)).alias("low"))


@query("a10_group_sizes", "WITH n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS groups, max(n) AS largest, count(*) FILTER (WHERE labels > 1) AS mixed FROM n")
def group_sizes(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("labels"))
    return n.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.count_if(F.col("labels") > 1).alias("mixed"))


_PARTS = "parts AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'val' ELSE 'test' END AS split, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority FROM orders)"


def parts(spark, sf):
    m = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select("o_orderkey", F.when(m == 0, "train").when(m == 1, "val").otherwise("test").alias("split"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderpriority").alias("priority"))


_LONG = f"""{_PARTS}, long AS (SELECT DISTINCT split, 'customer' AS "column", customer AS value FROM parts UNION SELECT DISTINCT split, 'priority', priority FROM parts)"""


@query(
    "j9_cross_overlap",
    f"""WITH {_LONG}, b AS (SELECT x."column", x.split AS "left", y.split AS "right", x.value, row_number() OVER (PARTITION BY x."column", x.split, y.split ORDER BY x.value) AS i FROM long x JOIN long y ON x."column" = y."column" AND x.value = y.value AND x.split < y.split)
    SELECT "column", "left", "right", count(*) AS n, list_sort(list(substr(sha256(value), 1, 16)) FILTER (WHERE i <= 5)) AS examples FROM b GROUP BY ALL""",
)
def cross_overlap(spark, sf):
    return O.cross_overlap(parts(spark, sf), "split", ["customer", "priority"])


@query("c7_leakage_audit", f"""WITH {_LONG} SELECT x."column", count(*) AS shared, count(*) > 0 AND x."column" = 'customer' AS fatal FROM long x JOIN long y ON x."column" = y."column" AND x.value = y.value AND x.split < y.split GROUP BY 1""")
def leakage_audit(spark, sf):
    o = O.cross_overlap(parts(spark, sf), "split", ["customer", "priority"])
    return o.groupBy("column").agg(F.sum("n").alias("shared")).withColumn("fatal", (F.col("shared") > 0) & (F.col("column") == "customer"))


@query("u2_intersection", f"WITH {_PARTS} SELECT count(*) AS n FROM (SELECT customer FROM parts WHERE split = 'train' INTERSECT SELECT customer FROM parts WHERE split = 'val')")
def intersection(spark, sf):
    p = parts(spark, sf)
    return p.where("split = 'train'").select("customer").intersect(p.where("split = 'val'").select("customer")).agg(F.count("*").alias("n"))


@query("u3_difference", f"WITH {_PARTS} SELECT customer FROM parts WHERE split = 'train' EXCEPT SELECT customer FROM parts WHERE split = 'val'")
def difference(spark, sf):
    p = parts(spark, sf)
    return p.where("split = 'train'").select("customer").subtract(p.where("split = 'val'").select("customer"))


@query("o7_hashed_examples", "SELECT list_sort(list(substr(sha256(v), 1, 16))) AS examples FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY v LIMIT 5)")
def hashed_examples(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("v")).distinct().orderBy("v").limit(5)
    return v.agg(F.array_sort(F.collect_list(F.substring(F.sha2("v", 256), 1, 16))).alias("examples"))


@query("j10_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("j11_disjoint", f"WITH {_PARTS} SELECT (SELECT count(*) FROM (SELECT DISTINCT customer FROM parts WHERE split = 'test' AND customer IN (SELECT customer FROM parts WHERE split = 'train'))) AS shared, (SELECT count(*) FROM (SELECT DISTINCT customer FROM parts WHERE split = 'test' AND customer NOT IN (SELECT customer FROM parts WHERE split = 'train'))) AS fresh")
def disjoint(spark, sf):
    p = parts(spark, sf)
    a, b = p.where("split = 'test'").select("customer").distinct(), p.where("split = 'train'").select("customer").distinct()
    return a.join(b, "customer", "left_semi").agg(F.count("*").alias("shared")).crossJoin(a.join(b, "customer", "left_anti").agg(F.count("*").alias("fresh")))


@query("j12_alignment", "SELECT count(*) AS rows, count(*) FILTER (WHERE x IS DISTINCT FROM y) AS differ FROM (SELECT vec_id, label AS x FROM embeddings) a FULL JOIN (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN label + 1 ELSE label END AS y FROM embeddings WHERE vec_id <> 7) b USING (vec_id)")
def alignment(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    b = e.where("vec_id != 7").withColumn("label", F.when(F.col("vec_id") % 50 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return O.aligned(e, b, "vec_id", "label")


@query("j13_annotators", "SELECT count(*) AS paired, count(*) FILTER (WHERE quality IS DISTINCT FROM toxic) AS differ FROM labels")
def annotators(spark, sf):
    l = table(spark, sf, "labels")
    return O.aligned(l.select("doc_id", F.col("quality").alias("v")), l.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v").select(F.col("rows").alias("paired"), "differ")


@query("j14_paired_systems", f"WITH {HEADS_CTE} SELECT count(*) AS rows, count(*) FILTER (WHERE a.y <> b.y) AS mismatched FROM heads a JOIN heads b ON a.id = b.id AND a.h = 0 AND b.h = 2")
def paired_systems(spark, sf):
    h = heads(spark, sf)
    j = h.where("h = 0").select("id", F.col("y").alias("ya")).join(h.where("h = 2").select("id", F.col("y").alias("yb")), "id")
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("ya") != F.col("yb")).alias("mismatched"))


@query("c17_phase_b", f"WITH {_SPLIT} SELECT count(*) AS groups, count(*) FILTER (WHERE first <= TIMESTAMP '{V0}') AS early FROM sp WHERE split IN ('val', 'test')")
def phase_b(spark, sf):
    later = split_groups(spark, sf).where(F.col("split").isin("val", "test"))
    return later.agg(F.count("*").alias("groups"), F.count_if(F.col("first") <= F.lit(V0).cast("timestamp")).alias("early"))


@query("c18_gates", f"WITH {_SPLIT}, g AS (SELECT 'train_present' AS gate, bool_or(split = 'train') AS passed FROM sp UNION ALL SELECT 'test_present', bool_or(split = 'test') FROM sp UNION ALL SELECT 'no_quarantine', bool_and(split <> 'quarantine') FROM sp) SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS total, bool_and(passed) AS ready FROM g")
def gates(spark, sf):
    s = split_groups(spark, sf).agg(F.bool_or(F.col("split") == "train").alias("train_present"), F.bool_or(F.col("split") == "test").alias("test_present"), F.bool_and(F.col("split") != "quarantine").alias("no_quarantine"))
    g = s.select(F.explode(F.create_map(*[x for c in s.columns for x in (F.lit(c), F.col(c))])).alias("gate", "passed"))
    return g.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.bool_and("passed").alias("ready"))


@query("d1_parse_time", "SELECT event_id, try_cast(CASE WHEN event_id % 10 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) IS NULL AS bad FROM events")
def parse_time(spark, sf):
    text = F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).isNull().alias("bad"))


@query("d2_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def month(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("d5_windows", "SELECT max(o_orderdate) FILTER (WHERE o_orderkey % 2 = 0) < TIMESTAMP '2030-01-01' AND min(o_orderdate) <= max(o_orderdate) AS ordered FROM orders")
def windows(spark, sf):
    return table(spark, sf, "orders").agg(((F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))) < F.lit("2030-01-01").cast("timestamp")) & (F.min("o_orderdate") <= F.max("o_orderdate"))).alias("ordered"))


@query("d7_overdue", "SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY < TIMESTAMP '1997-01-01' AS overdue FROM orders")
def overdue(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS") < F.lit("1997-01-01").cast("timestamp")).alias("overdue"))


# Vectors.


@query("j2_gather", "SELECT d.doc_id, e.embedding[1] AS first FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def gather(spark, sf):
    wanted = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("vec_id"))
    return wanted.join(table(spark, sf, "embeddings"), "vec_id").select("doc_id", F.col("embedding")[0].alias("first"))


_FUSE = "list_transform({0}, lambda x: x / greatest(sqrt(list_sum(list_transform({0}, lambda v: v * v))), 1e-9))"
_SIDES = "side AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[17:32], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"


def sides(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", V.doubles(F.slice("embedding", 1, 16)).alias("a"), V.doubles(F.slice("embedding", 17, 16)).alias("b"))


@query("v1_l2", f"WITH {_SIDES} SELECT vec_id, {_FUSE.format('a')} AS v FROM side", "", "v")
def unit(spark, sf):
    return sides(spark, sf).select("vec_id", V.l2(F.col("a")).alias("v"))


@query("v2_early_fusion", f"WITH {_SIDES} SELECT vec_id, list_concat({_FUSE.format('a')}, {_FUSE.format('b')}) AS v FROM side", "", "v")
def early_fusion(spark, sf):
    return sides(spark, sf).select("vec_id", V.early_fusion(F.col("a"), F.col("b")).alias("v"))


@query("j3_two_gathers", f"WITH {_SIDES} SELECT vec_id, list_concat(a, b) AS v FROM side", "", "v")
def two_gathers(spark, sf):
    s = sides(spark, sf)
    return s.select("vec_id", "a").join(s.select("vec_id", "b"), "vec_id").select("vec_id", F.concat("a", "b").alias("v"))


@query("c23_fusion_recheck", "SELECT count(*) AS rows, 0::BIGINT AS differ FROM embeddings")
def fusion_recheck(spark, sf):
    stored = early_fusion(spark, sf).withColumnRenamed("v", "stored")
    return stored.join(early_fusion(spark, sf), "vec_id").agg(F.count("*").alias("rows"), F.count_if(~F.col("stored").eqNullSafe(F.col("v"))).alias("differ"))


@query("v4_mean_pool", f"WITH {_SIDES} SELECT vec_id, list_transform(range(1, 17), lambda k: (a[k] + b[k] * (vec_id % 2)) / (1 + vec_id % 2)) AS v FROM side", "", "v")
def mean_pool(spark, sf):
    return sides(spark, sf).select("vec_id", V.mean_pool(F.array("a", "b"), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"))).alias("v"))


@query("v10_cosine", f"WITH {_SIDES} SELECT vec_id, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cosine FROM side", "cosine")
def cosine(spark, sf):
    return sides(spark, sf).select("vec_id", V.cosine(F.col("a"), F.col("b")).alias("cosine"))


@query("v11_edges", "SELECT CAST(i AS INTEGER) AS i, low + (high - low) * i / 15.0::DOUBLE AS edge FROM (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem), range(0, 16) t(i)", "edge")
def edges(spark, sf):
    # Even edges from the least to the greatest price.
    span = table(spark, sf, "lineitem").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return span.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select("i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / 15.0).alias("edge"))


# Duplicates.


@query("j4_equal_texts", "SELECT d.doc_id AS a, low AS b FROM documents d JOIN (SELECT text, min(doc_id) AS low FROM documents GROUP BY text) m ON m.text = d.text WHERE d.doc_id > low")
def equal_texts(spark, sf):
    return O.key_edges(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key")), "doc_id", "key")


@query("j8_shared_groups", "SELECT o_orderkey AS a, low AS b FROM orders JOIN (SELECT o_custkey, min(o_orderkey) AS low FROM orders GROUP BY o_custkey) USING (o_custkey) WHERE o_orderkey > low")
def shared_groups(spark, sf):
    return O.key_edges(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


_CODES = "codes AS (SELECT o_orderkey AS id, CAST((o_custkey * 2654435761 + (o_orderkey % 4) * 17) % 9007199254740992 AS BIGINT) AS code FROM orders)"


def codes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") * F.lit(2654435761) + (F.col("o_orderkey") % 4) * 17) % F.lit(9007199254740992)).alias("code"))


@query("j5_near_codes", f"WITH {_CODES}, once AS (SELECT code, min(id) AS id FROM codes GROUP BY code) SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.code, y.code)) AS INTEGER) AS distance FROM once x JOIN once y ON x.id < y.id AND bit_count(xor(x.code, y.code)) <= 3")
def near_codes(spark, sf):
    return O.hamming_pairs(codes(spark, sf), "id", "code", 3)


@query("j7_near_images", f"WITH {_CODES}, once AS (SELECT code, min(id) AS id FROM codes GROUP BY code) SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.code, y.code)) AS INTEGER) AS distance FROM once x JOIN once y ON x.id < y.id AND bit_count(xor(x.code, y.code)) <= 5")
def near_images(spark, sf):
    return O.hamming_pairs(codes(spark, sf), "id", "code", 5)


@query("f5_hamming", f"WITH {_CODES} SELECT id, CAST(bit_count(xor(code, 12345)) AS INTEGER) AS distance FROM codes")
def hamming(spark, sf):
    return codes(spark, sf).select("id", T.hamming(F.col("code"), F.lit(12345).cast("long")).alias("distance"))


_SH = "list_distinct(list_transform(range(1, greatest(length(t) + 2 - 4 + 1, 1) + 1), lambda i: substr(' ' || t || ' ', i, 4)))"


@query("f3_shingles", f"SELECT p_partkey AS id, list_sort({_SH}) AS shingles FROM (SELECT p_partkey, lower(p_name) AS t FROM part)")
def shingles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_sort(T.char_shingles(F.lower("p_name"))).alias("shingles"))


@query("j6_jaccard", f"WITH s AS (SELECT p_partkey AS id, p_brand, {_SH} AS s FROM (SELECT p_partkey, p_brand, lower(p_name) AS t FROM part)) SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS likeness FROM s x JOIN s y ON y.id = x.id + 1", "likeness")
def jaccard(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.char_shingles(F.lower("p_name")).alias("s"))
    pairs = s.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return O.verified_pairs(pairs, s, "id", "s", 0.0)


@query("j6_verified", f"WITH s AS (SELECT p_partkey AS id, {_SH} AS s FROM (SELECT p_partkey, lower(p_name) AS t FROM part)), j AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS likeness FROM s x JOIN s y ON y.id > x.id AND y.id <= x.id + 20) SELECT * FROM j WHERE likeness >= 0.2", "likeness")
def verified(spark, sf):
    # Each part against the next twenty; few pairs are alike enough.
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.char_shingles(F.lower("p_name")).alias("s"))
    pairs = s.select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 20)).alias("b"))
    return O.verified_pairs(pairs, s, "id", "s", 0.2)


@query("f4_simhash")
def simhash(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.simhash64(T.char_shingles(F.lower("p_name"))).alias("code"))


@query("c1_leakage_groups")
def leakage_groups(spark, sf):
    return O.leakage_groups(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def pictured(spark, sf):
    """Documents with what grouping goes by: a text, an explicit key that some share, and a code that stands for a picture, if there is one."""
    k = F.col("doc_id")
    code = F.xxhash64((k % 60).cast("string")).bitwiseXOR(F.when(F.floor(k / 60) % 2 == 0, F.lit(5)).otherwise(0).cast("long"))
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(k % 11 == 0, F.concat(F.lit("Case "), (k % 7).cast("string"))).alias("case"))
    return d.withColumns({"image": F.when(k % 5 == 0, code), "problem": F.when(k % 5 == 1, "unreadable").when(k % 5 != 0, "missing")})


@query("c1_grouping_receipt")
def grouping_receipt(spark, sf):
    """The receipt and the number and sizes of groups by text, picture and key."""
    groups, receipt = O.grouped(pictured(spark, sf), "doc_id", "text", keys=["case"], image="image", image_problem="problem")
    sizes = groups.groupBy("group").agg(F.first("members").alias("members")).agg(F.count("*").alias("groups"), F.max("members").alias("largest_group"))
    return receipt.join(F.broadcast(sizes))  # a row each


@query(
    "c2_components",
    "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - p_partkey % 7 AS b FROM part), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS c FROM n UNION SELECT r.a, n.b FROM r JOIN n ON n.a = r.c) SELECT a AS node, min(c) AS component FROM r WHERE a IN (SELECT a FROM n x WHERE x.a <> x.b) GROUP BY a",
)
def components(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - F.col("p_partkey") % 7).alias("b"))
    return O.connected_components(p, "a", "b")


@query("f10_group_names", "SELECT 'g_' || substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(31) ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 16) AS name, count(*) AS members FROM orders GROUP BY o_custkey")
def group_names(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(T.group_name(F.collect_list(F.col("o_orderkey").cast("string"))).alias("name"), F.count("*").alias("members")).select("name", "members")


@query("f1_normalised")
def normalised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalised("text"), 256).alias("digest"))


@query("f2_squeezed", r"SELECT page_id, lower(trim(regexp_replace(coalesce(url, ''), '\s+', ' ', 'g'))) AS text FROM pages")
def squeezed(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.squeezed(F.col("url")).alias("text"))


@query("f1_ascii", r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]+', '', 'g')), '[\s\x0b\x1c-\x1f]+', ' ', 'g')) AS text FROM documents")
def normalised_ascii(spark, sf):
    # The same normalisation where SQL can follow it: on what is ASCII.
    return table(spark, sf, "documents").select("doc_id", T.normalised(F.regexp_replace("text", r"[^\x00-\x7F]+", "")).alias("text"))


@query("f2_folded", r"SELECT page_id, trim(regexp_replace(lower(regexp_replace(coalesce(url, ''), '[^\x00-\x7F]+', '', 'g')), '[\s\x0b\x1c-\x1f]+', ' ', 'g')) AS text FROM pages")
def folded(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.folded(F.regexp_replace("url", r"[^\x00-\x7F]+", "")).alias("text"))


@query("f24_prefix", "SELECT page_id, 'query: ' || url AS text FROM pages")
def prefix(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("query: "), "url").alias("text"))


# Label audits and privacy.


@query("a34_wilson", "SELECT lang, count(*) AS n, ((k / n + z * z / (2 * n)) - z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS low, ((k / n + z * z / (2 * n)) + z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS high FROM (SELECT lang, sum(toxic) AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM labels JOIN documents USING (doc_id) GROUP BY lang) GROUP BY ALL".replace("count(*) AS n, ((k", "n, ((k", 1).replace(" GROUP BY ALL", ""), "low high")
def wilson(spark, sf):
    n = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return n.withColumn("w", O.wilson(F.col("k"), F.col("n"))).select("lang", "n", "w.low", "w.high")


_STRATA = "str AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), sc AS (SELECT lang, count(*) AS n, avg(quality) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


@query("a35_audit_summary", f"WITH {_STRATA}, j AS (SELECT *, size / sum(size) OVER () AS w FROM str JOIN sc USING (lang)), a AS (SELECT sum(w * rate) AS micro, sum(CASE WHEN n > 1 AND size > 1 THEN w * w * greatest(0.0, 1 - n / size) * rate * (1 - rate) / (n - 1) ELSE 0 END) AS v, avg(rate) AS macro, CAST(sum(n) AS BIGINT) AS scored FROM j) SELECT micro, greatest(0.0, micro - 1.959963984540054 * sqrt(v)) AS low, least(1.0, micro + 1.959963984540054 * sqrt(v)) AS high, macro, scored FROM a", "micro low high macro")
def audit_summary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    return O.audit_summary(rows, "lang", "quality", docs.groupBy("lang").agg(F.count("*").alias("size")))


@query("a36_kappa", "SELECT o AS observed, (o - e) / (1 - e) AS kappa FROM (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS o, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e FROM labels)", "observed kappa")
def kappa(spark, sf):
    return O.kappa(table(spark, sf, "labels"), "quality", "toxic")




@query("a37_set_agreement", "WITH s AS (SELECT list_distinct([o_custkey % 3, o_custkey % 2]) AS a, list_distinct([o_orderkey % 3, o_orderkey % 2]) AS b FROM orders) SELECT avg(CASE WHEN list_sort(a) = list_sort(b) THEN 1.0 ELSE 0.0 END) AS exact, avg(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) AS likeness FROM s", "exact likeness")
def set_agreement(spark, sf):
    s = table(spark, sf, "orders").select(F.array_distinct(F.array(F.col("o_custkey") % 3, F.col("o_custkey") % 2)).alias("a"), F.array_distinct(F.array(F.col("o_orderkey") % 3, F.col("o_orderkey") % 2)).alias("b"))
    return s.agg(F.avg((F.array_sort("a") == F.array_sort("b")).cast("double")).alias("exact"), F.avg(T.jaccard(F.col("a"), F.col("b"))).alias("likeness"))


@query("u4_row_sets", "SELECT o_orderkey, len(list_intersect([o_custkey % 3, o_custkey % 5], [1, 2])) AS common FROM orders")
def row_sets(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.size(F.array_intersect(F.array(F.col("o_custkey") % 3, F.col("o_custkey") % 5), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).cast("long").alias("common"))


@query("u5_ordered_distinct", "SELECT o_orderkey, CASE WHEN x = y THEN [x] ELSE [x, y] END AS items FROM (SELECT o_orderkey, o_custkey % 3 AS x, o_custkey % 2 AS y FROM orders)")
def ordered_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_distinct(F.array(F.col("o_custkey") % 3, F.col("o_custkey") % 2)).alias("items"))


_QUOTA = "sz AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), q AS (SELECT *, (60 - 3 * count(*) OVER ()) * (size - 3) / sum(size - 3) OVER () AS raw FROM sz), b AS (SELECT *, 3 + least(size - 3, CAST(floor(raw) AS BIGINT)) AS base FROM q), o AS (SELECT *, 60 - sum(base) OVER () AS left_, sum(CASE WHEN base < size THEN 1 ELSE 0 END) OVER (ORDER BY raw - floor(raw) DESC, size DESC, label DESC) AS turn FROM b)"


@query("w10_quotas", f"WITH {_QUOTA} SELECT label, size, CAST(base + CASE WHEN base < size AND turn <= left_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM o")
def quotas(spark, sf):
    return O.quotas(table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("size")), "label", 60, 3)


_DRAWN = f"""{_QUOTA}, qu AS (SELECT label, base + CASE WHEN base < size AND turn <= left_ THEN 1 ELSE 0 END AS quota FROM o),
drawn AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('13:' || vec_id), vec_id) AS place FROM embeddings) JOIN qu USING (label) WHERE place <= quota)"""


@query("w11_stratified_sample", f"WITH {_DRAWN} SELECT vec_id, label FROM drawn")
def stratified_sample(spark, sf):
    return O.stratified_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", quotas(spark, sf), 13)


@query("c19_label_audit", f"""WITH {_DRAWN}, sc AS (SELECT label, count(*) AS n, avg(CASE WHEN vec_id % 5 <> 0 THEN 1.0 ELSE 0.0 END) AS rate FROM drawn GROUP BY label),
j AS (SELECT *, size / sum(size) OVER () AS w FROM sz JOIN sc USING (label)),
a AS (SELECT sum(w * rate) AS micro, sum(CASE WHEN n > 1 AND size > 1 THEN w * w * greatest(0.0, 1 - n / size) * rate * (1 - rate) / (n - 1) ELSE 0 END) AS v, avg(rate) AS macro, CAST(sum(n) AS BIGINT) AS scored FROM j)
SELECT micro, greatest(0.0, micro - 1.959963984540054 * sqrt(v)) AS low, least(1.0, micro + 1.959963984540054 * sqrt(v)) AS high, macro, scored FROM a""", "micro low high macro")
def label_audit(spark, sf):
    s = stratified_sample(spark, sf).withColumn("ok", (F.col("vec_id") % 5 != 0).cast("int"))
    return O.audit_summary(s, "label", "ok", table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("size")))


@query("f16_yes_no", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS answer FROM events")
def yes_no(spark, sf):
    text = F.element_at(F.array(*[F.lit(x) for x in (" Ya ", "tidak", "TRUE", "0", "maybe")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.yes_no(text).alias("answer"))


@query("f17_label_sets", "SELECT event_id, list_sort(list_distinct(list_filter(list_transform(string_split('b| a |' || event_type || '||b', '|'), lambda x: trim(x)), lambda x: x <> ''))) AS items FROM events")
def label_sets(spark, sf):
    return table(spark, sf, "events").select("event_id", T.label_set(F.concat(F.lit("b| a |"), "event_type", F.lit("||b"))).alias("items"))


@query("f18_first_filled", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS id FROM events")
def first_filled(spark, sf):
    a = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("  "))
    return table(spark, sf, "events").select("event_id", T.first_filled(a, F.col("user_id").cast("string")).alias("id"))


@query("f9_salted_ids", "SELECT c_custkey, sha256('salt:' || CAST(c_custkey AS VARCHAR)) AS code FROM customer")
def salted_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.salted_id(F.col("c_custkey"), "salt").alias("code"))


@query("f15_patterns", "SELECT c_custkey, regexp_full_match(sha256(c_name), '[0-9a-f]{64}') AS digest, regexp_full_match(c_name, '[0-9a-f]{64}') AS other FROM customer")
def patterns(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.is_sha256(F.sha2("c_name", 256)).alias("digest"), T.is_sha256(F.col("c_name")).alias("other"))


@query("a38_screen")
def screen(spark, sf):
    return O.screen(table(spark, sf, "documents"), "text")


@query("a38_plain_patterns", r"""WITH k AS (SELECT len(regexp_extract_all(coalesce(text, ''), '(?i)https?://\S+|www\.\S+')) AS url, len(list_filter(regexp_extract_all(coalesce(text, ''), '\d+'), lambda x: length(x) = 16)) AS ids FROM documents)
SELECT 'url' AS pattern, CAST(sum(url) AS BIGINT) AS occurrences, count(*) FILTER (WHERE url > 0) AS rows FROM k UNION ALL SELECT 'long_numeric_id', CAST(sum(ids) AS BIGINT), count(*) FILTER (WHERE ids > 0) FROM k""")
def plain_patterns(spark, sf):
    # The patterns that need no look-behind to be told in SQL.
    return screen(spark, sf).where(F.col("pattern").isin("url", "long_numeric_id"))


@query("f8_url_screen", r"SELECT page_id, len(regexp_extract_all(url, '(?i)https?://\S+|www\.\S+')) AS n FROM pages")
def url_screen(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_count("url", F.lit(T.PATTERNS["url"])).cast("long").alias("n"))


@query("c20_privacy_audit")
def privacy_audit(spark, sf):
    return O.private_findings(table(spark, sf, "documents"), "text", "doc_id", "a salt for queries alone")


# Reconstruction. A published report of nine classes, as four-decimal text.
REPORT = [
    ("Roads and public works", "0.8644", "0.8797", "0.8720", 2029),
    ("Public order police", "0.8432", "0.8699", "0.8564", 1261),
    ("Transportation", "0.8443", "0.8699", "0.8569", 1752),
    ("Urban village administration", "0.8103", "0.6939", "0.7476", 1797),
    ("Parks and forestry", "0.8924", "0.9122", "0.9022", 900),
    ("Water resources", "0.5577", "0.7417", "0.6367", 391),
    ("Building, spatial planning, and land", "0.8398", "0.8778", "0.8584", 221),
    ("Regional-owned enterprises", "0.6711", "0.7937", "0.7273", 252),
    ("Other agency (catch-all)", "0.5486", "0.4857", "0.5152", 663),
]
def shown(num: str, den: str) -> str:
    """A rate at four decimals, half up, in ten-thousandths; zero without a denominator."""
    return f"coalesce((20000 * {num} + {den}) // (2 * nullif({den}, 0)), 0)"


#: The class report of head 0 as it would be printed.
_REPORT = f"""{PRED_CTE}, cnt AS (SELECT CAST(g.class AS VARCHAR) AS label, (SELECT count(*) FROM pred WHERE y = g.class) AS s, (SELECT count(*) FROM pred WHERE pred.pred = g.class) AS d,
  (SELECT count(*) FROM pred WHERE y = g.class AND pred.pred = g.class) AS c FROM range(0, 10) g(class)),
rep AS (SELECT label, {shown("c", "d")} AS p, {shown("c", "s")} AS r, {shown("2 * c", "(d + s)")} AS f, s, (SELECT count(*) FROM pred) AS n FROM cnt)"""
_REBUILT = f"""{_REPORT}, tp AS (SELECT * FROM (SELECT *, unnest(range(0, s + 1)) AS tp FROM rep) WHERE (2 * r - 1) * s <= 20000 * tp AND 20000 * tp < (2 * r + 1) * s),
rec AS (SELECT label, tp, s - tp AS fn, j AS fp FROM (SELECT *, unnest(range(0, n - s + 1)) AS j FROM tp) WHERE tp + j > 0 AND (2 * p - 1) * (tp + j) <= 20000 * tp AND 20000 * tp < (2 * p + 1) * (tp + j) AND (2 * f - 1) * (tp + j + s) <= 40000 * tp AND 40000 * tp < (2 * f + 1) * (tp + j + s))"""


def printed_report(spark, sf):
    """(label, precision, recall, f1, support): rates as text of four decimals."""
    marks = F.array(F.struct(F.col("y").alias("k"), F.lit(1).alias("s"), F.lit(0).alias("d"), F.col("correct").cast("int").alias("c")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("s"), F.lit(1).alias("d"), F.lit(0).alias("c")))
    seen = head(spark, sf).select(F.inline(marks)).groupBy("k").agg(F.sum("s").alias("support"), F.sum("d").alias("decided"), F.sum("c").alias("tp"))
    c = spark.range(CLASSES).withColumnRenamed("id", "k").join(seen, "k", "left").fillna(0).select(F.col("k").cast("string").alias("label"), "support", "decided", "tp")
    rate = lambda n, d: F.when(F.expr(d) > 0, F.expr(f"(20000 * {n} + {d}) div (2 * ({d}))")).otherwise(0)
    text = lambda x: F.format_string("%d.%04d", F.floor(x / 10000), x % 10000)
    rates = {"precision": rate("tp", "decided"), "recall": rate("tp", "support"), "f1": rate("(2 * tp)", "(decided + support)")}
    return c.select("label", *[text(v).alias(k) for k, v in rates.items()], "support")


@query("v13_reconstruct", f"WITH {_REBUILT} SELECT label, tp, fn, fp FROM rec")
def reconstruct(spark, sf):
    return O.reconstruct(printed_report(spark, sf), table(spark, sf, "embeddings").count())


@query("a39_margins", f"WITH {_REBUILT} SELECT CAST(sum(tp + fn) AS BIGINT) AS samples, CAST(sum(tp) AS BIGINT) AS correct, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, avg(tp / (tp + fp)) AS macro_precision, avg(tp / (tp + fn)) AS macro_recall, avg(2 * tp / (2 * tp + fp + fn)) AS macro_f1 FROM rec", "macro_precision macro_recall macro_f1")
def margins(spark, sf):
    return O.margins(O.reconstruct(printed_report(spark, sf), table(spark, sf, "embeddings").count()))


@query("v14_correct_counts", f"""WITH {HEADS_CTE}, k AS (SELECT h, list_position(p, list_max(p)) - 1 = y AS ok FROM heads), a AS (SELECT h, count(*) AS n, count(*) FILTER (WHERE ok) AS c FROM k GROUP BY h), v AS (SELECT h, n, {shown("c", "n")} AS shown FROM a)
SELECT h, CAST(shown AS INTEGER) AS shown, correct FROM (SELECT *, unnest(range(0, n + 1)) AS correct FROM v) WHERE (2 * shown - 1) * n <= 20000 * correct AND 20000 * correct < (2 * shown + 1) * n""")
def correct_counts(spark, sf):
    """The numbers of correct rows that show the accuracy of each head."""
    a = predicted(heads(spark, sf)).groupBy("h").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    v = a.select("h", "n", F.expr("(20000 * c + n) div (2 * n)").cast("int").alias("shown"))
    every = v.withColumn("correct", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return every.where(O.displays_as(F.col("correct"), F.col("n"), F.col("shown"))).select("h", "shown", "correct")


@query("v12_display", "SELECT l_orderkey, l_linenumber, (2 * q - 1) * 50 <= 20000 * n AND 20000 * n < (2 * q + 1) * 50 AS shown FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CAST(l_quantity AS BIGINT) * 200 + l_linenumber % 2 AS q FROM lineitem)")
def display(spark, sf):
    n = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", O.displays_as(n, F.lit(50), n * 200 + F.col("l_linenumber") % 2).alias("shown"))


@query("f19_four_decimals", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 8073 WHEN 1 THEN 10000 END AS value FROM events")
def four_decimals(spark, sf):
    text = F.element_at(F.array(*[F.lit(x) for x in ("0.8073", "1.0000", "1.0001", ".5")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.four_decimals(text).alias("value"))


@query("f22_format", "SELECT l_orderkey, l_linenumber, printf('%.4f', l_discount) AS text FROM lineitem")
def four_digits(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.4f", "l_discount").alias("text"))
