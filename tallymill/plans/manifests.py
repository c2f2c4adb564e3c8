"""Queries over manifests, digests, plans and the remaining readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.functions import vectors as V
from tallymill.operators import baselines as B
from tallymill.operators import linear as N
from tallymill.operators import metrics as M
from tallymill.operators import store as R
from tallymill.operators import tables as O
from tallymill.plans.registry import query, table
from tallymill.plans.scans import _folder
from tallymill.sources import files as S
from tallymill.streaming import live as L


@query("f11_canonical_digest", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def canonical_digest(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(T.canonical_json(n_regionkey=F.col("n_regionkey"), n_name=F.col("n_name"), n_nationkey=F.col("n_nationkey")), 256).alias("digest"))


@query("f12_class_map_digest", """SELECT count(*) AS classes, sha256('{"classes":[' || string_agg('{"label_id":' || r_regionkey || ',"label_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || '],"label_id_column":"r_regionkey","label_name_column":"r_name","schema_version":1}') AS digest FROM region""")
def class_map_digest(spark, sf):
    return O.class_map_digest(table(spark, sf, "region"), "r_regionkey", "r_name", 1)


_WRITTEN = """w AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+07:00' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN '2999-01-01T00:00:00Z' ELSE 'soon' END AS t FROM events)"""


@query("d4_utc_problems", f"WITH {_WRITTEN} SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'not UTC' WHEN 3 THEN 'no zone' WHEN 4 THEN 'future' WHEN 5 THEN 'not ISO 8601' END AS problem FROM w")
def utc_problems(spark, sf):
    at, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 6
    written = F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.lit("+00:00"))).when(k == 2, F.concat(at, F.lit("+07:00"))).when(k == 3, at).when(k == 4, "2999-01-01T00:00:00Z").otherwise("soon")
    return table(spark, sf, "events").select("event_id", T.utc_problem(written, F.current_timestamp()).alias("problem"))


@query(
    "c6_split_manifest",
    "SELECT split, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, max(n) AS largest_group, min(low) AS first, max(high) AS last FROM (SELECT count(*) AS n, min(l_shipdate) AS low, max(l_shipdate) AS high, CASE WHEN max(l_shipdate) < TIMESTAMP '1995-06-01' THEN 'train' WHEN min(l_shipdate) >= TIMESTAMP '1995-06-01' AND max(l_shipdate) < TIMESTAMP '1996-06-01' THEN 'val' WHEN min(l_shipdate) >= TIMESTAMP '1996-06-01' THEN 'test' ELSE 'quarantine' END AS split FROM lineitem GROUP BY l_orderkey) GROUP BY split",
)
def split_manifest(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    split = O.temporal_split(rows, "l_orderkey", "l_shipdate", "1995-06-01", "1996-06-01").select("l_orderkey", "split")
    return O.split_manifest(rows.join(split, "l_orderkey"), "split", "l_orderkey", "l_shipdate")


@query("c13_test_plan", "SELECT n_nationkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS plan FROM (SELECT n_nationkey, [r_name, n_name, 'CHINA', 'ASIA', r_name, n_name] AS l FROM nation JOIN region ON r_regionkey = n_regionkey)")
def plan_of_tests(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", T.tested_candidates(F.col("r_name"), F.array("n_name", F.lit("CHINA")), F.lit("ASIA"), F.array("r_name", "n_name")).alias("plan"))


@query("q12_new_users", "SELECT user_id AS id, 'citizen' AS role, min(ts) AS created_at FROM events GROUP BY user_id HAVING user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT c_custkey, 'staff', TIMESTAMP '1992-01-01' FROM customer WHERE c_acctbal < 0")
def new_users(spark, sf):
    # Those in debt stand for profiles that are already there.
    known = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("staff").alias("role"), F.lit("1992-01-01").cast("timestamp").alias("created_at"))
    joined = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.lit("citizen").alias("role"), F.min("ts").alias("created_at"))
    return known.unionByName(joined.join(known, "id", "left_anti"))


@query("s2_text_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def text_scan(spark, sf):
    path = _folder(spark, "text")
    table(spark, sf, "nation").withColumnRenamed("n_nationkey", "﻿n_nationkey").write.option("header", True).csv(path)
    return S.text_csv(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("s4_ordered_ids", "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS position, n_name AS id FROM nation")
def ordered_ids(spark, sf):
    # One JSON array, as an id list is; the table has 25 rows at any scale.
    path = f"{_folder(spark, 'ids')}.json"
    table(spark, sf, "nation").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("value")).write.text(path)
    return S.ordered_ids(spark, path)


@query("s6_manifest_scan", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS size FROM nation")
def manifest_scan(spark, sf):
    path = _folder(spark, "manifest")
    entry = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("size"))
    table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(entry).alias("files"))).alias("value")).write.text(path)
    return S.manifest(spark, path, "files array<struct<name:string,size:long>>").select(F.inline("files"))


@query("s12_predictions", "SELECT o_orderkey, CAST(printf('%.10g', o_totalprice / 7) AS DOUBLE) AS p FROM orders", "p")
def predictions(spark, sf):
    path = _folder(spark, "predictions")
    S.write_predictions(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("p")), path)
    return S.typed_csv(spark, path, "o_orderkey long, p double", "o_orderkey")


_GREY = "list_concat(embedding, list_slice(embedding, 1, 8))"


@query("v20_grey_codes", f"SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda k: CASE WHEN g[k // 8 * 9 + k % 8 + 2] > g[k // 8 * 9 + k % 8 + 1] THEN CASE WHEN k = 63 THEN -9223372036854775808 ELSE 1::BIGINT << k END ELSE 0::BIGINT END), lambda a, b: a | b) AS code FROM (SELECT vec_id, {_GREY} AS g FROM embeddings)")
def grey_codes(spark, sf):
    # 64 dimensions and the first 8 again stand for 9 x 8 grey values.
    return table(spark, sf, "embeddings").select("vec_id", V.grey_code(F.concat("embedding", F.slice("embedding", 1, 8))).alias("code"))


@query("d6_stamped", """WITH cur AS (SELECT c_custkey AS id, c_name AS name, TIMESTAMP '1992-01-01' AS created_at, TIMESTAMP '1992-01-02' AS updated_at FROM customer WHERE c_custkey % 3 <> 0),
inc AS (SELECT c_custkey AS id, c_name || '!' AS name, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '1993-01-01' END AS created_at FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM cur WHERE id NOT IN (SELECT id FROM inc) UNION ALL SELECT inc.id, inc.name, coalesce(cur.created_at, inc.created_at, TIMESTAMP '2000-01-01'), TIMESTAMP '2000-01-01' FROM inc LEFT JOIN cur USING (id)""")
def stamped(spark, sf):
    c, at = table(spark, sf, "customer"), lambda d: F.lit(d).cast("timestamp")
    current = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), at("1992-01-01").alias("created_at"), at("1992-01-02").alias("updated_at"))
    incoming = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("!")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, at("1993-01-01")).alias("created_at"))
    return R.stamped(current, incoming, "id", at("2000-01-01"))


@query("t6_row_changes", """WITH v AS (SELECT user_id AS id, event_id AS version, event_type AS status, event_id % 4 = 0 AS early FROM events),
st AS (SELECT id, max(version) AS low FROM v WHERE early GROUP BY id),
line AS (SELECT v.* FROM v LEFT JOIN st USING (id) WHERE (early AND version = low) OR (NOT early AND (low IS NULL OR version > low))),
seen AS (SELECT *, lag(status) OVER w AS old_status, row_number() OVER w AS turn FROM line WINDOW w AS (PARTITION BY id ORDER BY version))
SELECT id, version, CASE WHEN turn = 1 THEN 'insert' ELSE 'update' END AS kind, old_status, status AS new_status FROM seen WHERE NOT early AND (turn = 1 OR status IS DISTINCT FROM old_status)""")
def row_changes(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"))
    state = L.newest(v.where("version % 4 = 0"), "id", ["version"])
    return L.row_changes(state, v.where("version % 4 <> 0"), "id", ["version"], ["status"])


@query("c24_class_prior", "SELECT k AS class, (SELECT count(*) FILTER (WHERE label = k) / count(*) FROM embeddings) AS share FROM range(0, 10) t(k)", "share")
def class_prior(spark, sf):
    return B.class_prior(table(spark, sf, "embeddings"), "label", 10).select(F.posexplode("p").alias("class", "share")).select(F.col("class").cast("long").alias("class"), "share")


@query("c24_text_classifier")
def text_classifier(spark, sf):
    """Class report of the linear baseline on the language of a text, over all rows it was fitted on."""
    langs = ["de", "en", "es", "fr"]
    d = table(spark, sf, "documents").select("doc_id", "text", (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("y")).where("y >= 0")
    model = B.fit_text_classifier(d, "text", "y")
    return M.class_report(M.predicted(B.text_probabilities(d, model, "text", ["doc_id", "y"])), len(langs))


_LANGS = ["de", "en", "es", "fr"]
#: Documents held out by a hash of their id.
_HELD = "crc32(cast(doc_id as string)) % 5 = 0"


def _tongues(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", (F.array_position(F.array(*[F.lit(x) for x in _LANGS]), F.col("lang")) - 1).cast("int").alias("y")).where("y >= 0")


@query("c24_vocabulary", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1),
c AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY n DESC, term LIMIT 5000)
SELECT term, df, n, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index FROM c""")
def word_vocabulary(spark, sf):
    return N.vocabulary(table(spark, sf, "documents"), "text", most=5000)


@query("c24_held_out_report")
def held_out_report(spark, sf):
    """Class report of 1- and 2-grams under averaged gradient descent on the language of a text, on documents that training does not see."""
    d = _tongues(spark, sf)
    train = d.where(f"not ({_HELD})")
    words = N.vocabulary(train, "text", most=20_000).checkpoint(eager=True)
    size, n = words.count(), train.count()
    model = N.train_linear(N.features(train, "text", words, n, ["y"]), len(_LANGS), size)
    held = N.features(d.where(_HELD), "text", words, n, ["doc_id", "y"])
    return M.class_report(M.predicted(N.linear_probabilities(held, model, ["doc_id", "y"])), len(_LANGS))


@query("c24_stratified_guess", """WITH s AS (SELECT label, sum(count(*)) OVER (ORDER BY label) AS upto, sum(count(*)) OVER () AS n FROM embeddings GROUP BY label),
u AS (SELECT vec_id, CAST(('0x' || substr(sha256('17:' || vec_id), 1, 8)) AS BIGINT) AS u FROM embeddings)
SELECT vec_id, (SELECT min(label) FROM s WHERE u.u * n < upto * 4294967296) AS guess FROM u""")
def stratified_guess(spark, sf):
    e = table(spark, sf, "embeddings")
    shares = B.class_prior(e, "label", 10).first().p
    return e.select("vec_id", N.stratified_guess(F.col("vec_id"), shares, 17).alias("guess"))
