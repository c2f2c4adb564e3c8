"""Queries over agencies, reports and their lifecycle, derived arithmetically from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.functions import vectors as V
from tallymill.operators import routing as R
from tallymill.operators import store as S
from tallymill.operators import tables as O
from tallymill.plans.registry import query, table
from tallymill.streaming import live as L

_SLUG = f"({[*T.SLUGS]})"
_STATUS = f"({[*S.STATUSES]})"
_AG = f"ag AS (SELECT s_suppkey AS agency_id, s_name AS name, {_SLUG}[s_suppkey % 7 + 1] AS category, -6.5::DOUBLE + (s_suppkey % 100) / 100.0::DOUBLE AS latitude, 106.5::DOUBLE + (s_suppkey * 7 % 100) / 100.0::DOUBLE AS longitude, s_suppkey % 10 <> 0 AS active FROM supplier)"
_REC = f"rec AS (SELECT c_custkey AS id, {_SLUG}[c_custkey % 9 + 1] AS category, CASE WHEN c_custkey % 13 <> 0 THEN -6.4::DOUBLE + (c_custkey % 89) / 100.0::DOUBLE END AS latitude, 106.6::DOUBLE + (c_custkey % 83) / 100.0::DOUBLE AS longitude, (c_custkey % 101) / 100.0::DOUBLE AS confidence FROM customer)"
_REP = f"""rp AS (SELECT event_id AS id, 'u' || CAST(user_id % 50 AS VARCHAR) AS user_id, {_SLUG}[event_id % 9 + 1] AS category, {_STATUS}[event_id % 5 + 1] AS status, CASE WHEN event_id % 3 <> 0 THEN 'public' ELSE 'private' END AS visibility,
  -6.5::DOUBLE + (event_id % 977) / 1000.0::DOUBLE AS latitude, 106.5::DOUBLE + (event_id % 911) / 1000.0::DOUBLE AS longitude, ts AS created_at, 'report ' || event_type AS description FROM events)"""


def _pick(items: list[str], key: F.Column, n: int) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (key % n + 1).cast("int"))


def agencies(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("agency_id"), F.col("s_name").alias("name"), _pick(T.SLUGS, k, 7).alias("category"), (F.lit(-6.5) + (k % 100) / 100.0).alias("latitude"), (F.lit(106.5) + (k * 7 % 100) / 100.0).alias("longitude"), (k % 10 != 0).alias("active"))


def records(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), _pick(T.SLUGS, k, 9).alias("category"), F.when(k % 13 != 0, F.lit(-6.4) + (k % 89) / 100.0).alias("latitude"), (F.lit(106.6) + (k % 83) / 100.0).alias("longitude"), ((k % 101) / 100.0).alias("confidence"))


def reports(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("user_id"), _pick(T.SLUGS, k, 9).alias("category"), _pick(S.STATUSES, k, 5).alias("status"), F.when(k % 3 != 0, "public").otherwise("private").alias("visibility"), (F.lit(-6.5) + (k % 977) / 1000.0).alias("latitude"), (F.lit(106.5) + (k % 911) / 1000.0).alias("longitude"), F.col("ts").alias("created_at"), F.concat(F.lit("report "), "event_type").alias("description"))


_FAR = "6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"
_HAV = "pow(sin(radians(a.latitude - r.latitude) / 2), 2) + cos(radians(r.latitude)) * cos(radians(a.latitude)) * pow(sin(radians(a.longitude - r.longitude) / 2), 2)"
_NEAR = f"near AS (SELECT id, arg_min(agency_id, (d, agency_id)) AS agency_id, round(min(d), 2) AS distance_m FROM (SELECT id, agency_id, {_FAR} AS d FROM (SELECT r.id, a.agency_id, {_HAV} AS h FROM rec r JOIN ag a ON a.category = r.category AND a.active WHERE r.category <> 'instansi_lain' AND r.latitude IS NOT NULL)) GROUP BY id)"


@query("v9_haversine", f"WITH {_REC} SELECT id, round({_FAR}, 2) AS metres FROM (SELECT id, pow(sin(radians(-6.2 - r.latitude) / 2), 2) + cos(radians(r.latitude)) * cos(radians(-6.2)) * pow(sin(radians(106.8 - r.longitude) / 2), 2) AS h FROM rec r)")
def haversine(spark, sf):
    return records(spark, sf).select("id", F.round(V.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(-6.2), F.lit(106.8)), 2).alias("metres"))


@query("j15_nearest_agency", f"WITH {_AG}, {_REC}, {_NEAR} SELECT rec.id, agency_id, distance_m FROM rec LEFT JOIN near USING (id)")
def nearest_agency(spark, sf):
    return R.nearest(records(spark, sf), agencies(spark, sf), "id", T.CATCH_ALL)


_OWN = "list_filter([CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN category = 'instansi_lain' THEN 'catch_all_class' END], lambda x: x IS NOT NULL)"
_REG = "list_filter([CASE WHEN category = 'instansi_lain' THEN 'catch_all_class' WHEN latitude IS NULL THEN 'routing_location_missing' WHEN category NOT IN (SELECT category FROM ag WHERE active) THEN 'routing_registry_gap' END], lambda x: x IS NOT NULL)"


@query("v18_review_reasons", f"WITH {_REC} SELECT id, {_OWN} AS reasons FROM rec")
def review_reasons(spark, sf):
    return records(spark, sf).select("id", R.review_reasons(F.col("category"), F.col("confidence"), 0.5, T.CATCH_ALL).alias("reasons"))


@query("j16_registry_reasons", f"WITH {_AG}, {_REC} SELECT id, {_REG} AS routing_reasons FROM rec")
def registry_reasons(spark, sf):
    return R.registry_reasons(records(spark, sf), agencies(spark, sf), "id", T.CATCH_ALL)


@query("c21_routed", f"WITH {_AG}, {_REC}, {_NEAR}, rs AS (SELECT id, {_OWN} AS own, {_REG} AS reg FROM rec), ev AS (SELECT id, list_concat(own, list_filter(reg, lambda x: NOT list_contains(own, x))) AS reasons FROM rs) SELECT id, reasons, CASE WHEN len(reasons) = 0 THEN agency_id END AS agency_id, CASE WHEN len(reasons) = 0 THEN distance_m END AS distance_m FROM ev LEFT JOIN near USING (id)")
def routed(spark, sf):
    return R.routed(records(spark, sf), agencies(spark, sf), "id", T.CATCH_ALL, 0.5)


@query("a41_coverage_gaps", f"WITH {_AG} SELECT slug AS category FROM (SELECT unnest({[*T.SLUGS]}) AS slug) WHERE slug NOT IN (SELECT category FROM ag WHERE active)")
def coverage_gaps(spark, sf):
    return R.coverage_gaps(spark.createDataFrame([(s,) for s in T.SLUGS], "category string"), agencies(spark, sf))


@query("c22_registry_status", f"WITH {_AG} SELECT 'incomplete' AS status, count(*) AS agencies FROM ag")
def registry_status(spark, sf):
    n, gaps = agencies(spark, sf).count(), coverage_gaps(spark, sf).count()
    return spark.createDataFrame([(R.registry_status(n, gaps), n)], "status string, agencies long")


@query("s7_agency_scan", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 11 <> 0")
def agency_scan(spark, sf):
    from tallymill.sources.files import agencies as scan

    a = agencies(spark, sf).select(F.col("agency_id").alias("id"), "name", "category", F.when(F.col("agency_id") % 11 != 0, F.col("latitude")).alias("latitude"), "longitude", F.col("active").alias("is_active"))
    return scan(a).select("id", "name")


@query("v16_coarse", f"WITH {_REP} SELECT id, CAST(round(CAST(latitude AS DECIMAL(18, 10)), 2) AS DOUBLE) AS latitude FROM rp")
def coarse(spark, sf):
    return reports(spark, sf).select("id", S.coarse(F.col("latitude")).alias("latitude"))


_PUBLIC = "visibility = 'public' AND status <> 'rejected' AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
_REDACT = f"id, '{S.NOBODY}' AS user_id, '{S.SOMEONE}' AS reporter_name, category, category AS ai_prediction, '{S.HIDDEN}' AS description, CAST(round(CAST(latitude AS DECIMAL(18, 10)), 2) AS DOUBLE) AS latitude, CAST(round(CAST(longitude AS DECIMAL(18, 10)), 2) AS DOUBLE) AS longitude, '{S.AREA}' AS address, status, created_at"


@query("p11_redacted", f"WITH {_REP} SELECT {_REDACT} FROM rp WHERE {_PUBLIC}")
def redacted(spark, sf):
    return S.redacted(S.public_rows(reports(spark, sf)))


@query("q7_public_feed", f"WITH {_REP} SELECT {_REDACT} FROM rp WHERE {_PUBLIC} ORDER BY created_at DESC, id LIMIT 200")
def public_feed(spark, sf):
    return S.public_feed(reports(spark, sf), 500)


@query("x3_feed_of_five", f"WITH {_REP} SELECT {_REDACT} FROM rp WHERE {_PUBLIC} ORDER BY created_at DESC, id LIMIT 5")
def feed_of_five(spark, sf):
    return S.public_feed(reports(spark, sf), 5)


@query("p18_clamp", "SELECT event_id, greatest(1, least(event_id - 5, 200)) AS n FROM events")
def clamp(spark, sf):
    return table(spark, sf, "events").select("event_id", F.greatest(F.lit(1).cast("long"), F.least(F.col("event_id") - 5, F.lit(200).cast("long"))).alias("n"))


@query("p10_open_list", f"WITH {_REP} SELECT id FROM rp WHERE status NOT IN ('rejected', 'resolved') AND category = 'kelurahan'")
def open_list(spark, sf):
    return reports(spark, sf).where(~F.col("status").isin("rejected", "resolved") & (F.col("category") == "kelurahan")).select("id")


_SEE = "(user_id = 'u7' OR category = 'dinas_sda')"


@query("p12_visible", f"WITH {_REP} SELECT id FROM rp WHERE {_SEE}")
def visible(spark, sf):
    return reports(spark, sf).where(S.can_see(F.col("user_id"), F.col("category"), "u7", "agency_admin", "dinas_sda")).select("id")


@query("p13_policies", f"WITH {_REP} SELECT count(*) FILTER (WHERE user_id = 'u7') AS citizen, count(*) FILTER (WHERE {_SEE}) AS agency, count(*) AS everyone FROM rp")
def policies(spark, sf):
    see = lambda role, agency=None: F.count_if(S.can_see(F.col("user_id"), F.col("category"), "u7", role, agency))
    return reports(spark, sf).agg(see("citizen").alias("citizen"), see("agency_admin", "dinas_sda").alias("agency"), see("super_admin").alias("everyone"))


@query("p21_scopes", f"WITH {_REP} SELECT 'citizen' AS role, count(*) AS n FROM rp WHERE user_id = 'u7' UNION ALL SELECT 'agency_admin', count(*) FROM rp WHERE category = 'dinas_sda' UNION ALL SELECT 'super_admin', count(*) FROM rp")
def scopes(spark, sf):
    r = reports(spark, sf)
    counts = [S.scope(r, "u7", role, "dinas_sda").agg(F.lit(role).alias("role"), F.count("*").alias("n")) for role in ("citizen", "agency_admin", "super_admin")]
    return counts[0].union(counts[1]).union(counts[2])


@query("q3_access", f"WITH {_REP} SELECT id, {_SEE} AS access FROM rp")
def access(spark, sf):
    return reports(spark, sf).select("id", S.can_see(F.col("user_id"), F.col("category"), "u7", "agency_admin", "dinas_sda").alias("access"))


_PROFILES = "prof AS (SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN 'super_admin' WHEN 1 THEN 'agency_admin' WHEN 2 THEN NULL ELSE 'citizen' END AS role, c_custkey % 17 = 0 AS flag FROM customer)"


def profiles(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), F.when(k % 10 == 0, "super_admin").when(k % 10 == 1, "agency_admin").when(k % 10 != 2, "citizen").alias("role"), (k % 17 == 0).alias("flag"))


@query("q1_moderators", f"WITH {_PROFILES} SELECT id FROM prof WHERE role IN ('agency_admin', 'super_admin') OR flag")
def moderators(spark, sf):
    return profiles(spark, sf).where(F.col("role").isin("agency_admin", "super_admin") | F.col("flag")).select("id")


@query("q2_current_role", f"WITH {_PROFILES} SELECT o_orderkey, coalesce(role, 'citizen') AS role FROM orders LEFT JOIN prof ON id = o_custkey")
def current_role(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(profiles(spark, sf), "id", "left").select("o_orderkey", F.coalesce("role", F.lit("citizen")).alias("role"))


@query("x1_sql_function", f"WITH {_PROFILES} SELECT id, coalesce(role, 'citizen') = 'super_admin' AS is_super FROM prof")
def sql_function(spark, sf):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tallymill_is_super(role STRING) RETURNS BOOLEAN RETURN coalesce(role, 'citizen') = 'super_admin'")
    return profiles(spark, sf).select("id", F.expr("tallymill_is_super(role)").alias("is_super"))


@query("j17_access_join", f"WITH {_REP}, {_PROFILES} SELECT count(*) AS n FROM rp LEFT JOIN prof ON prof.id = 21 WHERE rp.user_id = 'u21' OR prof.role = 'super_admin' OR (prof.role = 'agency_admin' AND rp.category = 'kelurahan')")
def access_join(spark, sf):
    one = profiles(spark, sf).where("id = 21").select("role")  # a profile by its key: one row
    j = reports(spark, sf).join(F.broadcast(one), F.lit(True), "left")
    return j.where((F.col("user_id") == "u21") | (F.col("role") == "super_admin") | ((F.col("role") == "agency_admin") & (F.col("category") == "kelurahan"))).agg(F.count("*").alias("n"))


_STEPS = ", ".join(f"'{a}>{b}'" for a, b in S.TRANSITIONS)


@query("p15_transitions", f"WITH {_REP} SELECT id, list_contains([{_STEPS}], status || '>' || {_STATUS}[(id + 1) % 5 + 1]) AS ok FROM rp")
def transitions(spark, sf):
    return reports(spark, sf).select("id", S.allowed(F.col("status"), _pick(S.STATUSES, F.col("id") + 1, 5)).alias("ok"))


@query("p14_constraints", f"WITH {_REC} SELECT id, rule FROM (SELECT id, unnest([CASE WHEN NOT (confidence >= 0 AND confidence <= 0.9) THEN 'confidence' END, CASE WHEN NOT (latitude >= -6.4 AND latitude <= -5.6) THEN 'coordinates' END, CASE WHEN category = 'instansi_lain' THEN 'catch_all' END]) AS rule FROM rec) WHERE rule IS NOT NULL")
def constraints(spark, sf):
    return O.violations(records(spark, sf), "id", {"confidence": F.col("confidence").between(0, 0.9), "coordinates": F.col("latitude").between(-6.4, -5.6), "catch_all": F.col("category") != T.CATCH_ALL})


@query("p16_changed", "SELECT event_id, (CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END) IS DISTINCT FROM (CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 2 END) AS changed FROM events")
def changed(spark, sf):
    k = F.col("event_id")
    a, b = F.when(k % 4 != 0, k % 3), F.when(k % 6 != 0, k % 2)
    return table(spark, sf, "events").select("event_id", (~a.eqNullSafe(b)).alias("changed"))


@query("p17_blank_to_null", "SELECT event_id, nullif(trim(CASE WHEN event_id % 3 = 0 THEN '   ' ELSE ' ' || event_type END), '') AS text FROM events")
def blank_to_null(spark, sf):
    return table(spark, sf, "events").select("event_id", T.blank_to_null(F.when(F.col("event_id") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "event_type"))).alias("text"))


@query("p20_place_pairs", f"WITH {_REC} SELECT id, (latitude IS NULL) <> (longitude IS NULL) AS half, coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS ok FROM rec")
def place_pairs(spark, sf):
    return records(spark, sf).select("id", (F.col("latitude").isNull() != F.col("longitude").isNull()).alias("half"), F.coalesce(S.on_earth(F.col("latitude"), F.col("longitude")), F.lit(False)).alias("ok"))


@query("p22_validators", r"""SELECT c_custkey, CASE WHEN regexp_full_match(m, '[^@\s]+@[^@\s]+\.[^@\s]+') THEN NULL ELSE 'invalid' END AS email, CASE WHEN length(p) < 10 OR length(p) > 15 THEN 'invalid' END AS phone, CASE WHEN length(c_name) < 8 OR NOT regexp_matches(c_name, '[A-Z]') OR NOT regexp_matches(c_name, '[a-z]') OR NOT regexp_matches(c_name, '[0-9]') THEN 'invalid' END AS password
FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'nobody' ELSE 'c' || c_custkey || '@x.org' END AS m, regexp_replace('+62 ' || c_custkey || ' 555 1234', '[^0-9+]', '', 'g') AS p FROM customer)""")
def validators(spark, sf):
    k = F.col("c_custkey").cast("string")
    mail = F.when(F.col("c_custkey") % 4 == 0, "nobody").otherwise(F.concat(F.lit("c"), k, F.lit("@x.org")))
    return table(spark, sf, "customer").select("c_custkey", T.problem_of("email", mail).alias("email"), T.problem_of("phone", F.concat(F.lit("+62 "), k, F.lit(" 555 1234"))).alias("phone"), T.problem_of("password", F.col("c_name")).alias("password"))


@query("p23_repair", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 50 - 0.2)) END AS v FROM events", "v")
def repair(spark, sf):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 50 - 0.2)
    return table(spark, sf, "events").select("event_id", F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).alias("v"))


_CH = f"ch AS (SELECT event_id AS id, {_STATUS}[(event_id + 1) % 5 + 1] AS new_status, CASE WHEN event_id % 7 = 0 THEN 'kelurahan' END AS new_category, CASE WHEN event_id % 2 = 0 THEN 'no' END AS note, CASE WHEN event_id % 3 = 0 THEN 'report-images/u/x' END AS photo FROM events WHERE event_id % 4 <> 0)"
_OK = f"coalesce((list_contains([{_STEPS}], status || '>' || new_status) OR (status = 'verified' AND new_status = 'verified' AND new_category IS NOT NULL AND new_category IS DISTINCT FROM category)) AND NOT (new_status = 'resolved' AND photo IS NULL) AND NOT (new_status = 'rejected' AND note IS NULL), false)"


@query("q5_status_change", f"WITH {_REP}, {_CH}, j AS (SELECT rp.*, new_status, new_category, note, {_OK} AS ok FROM rp LEFT JOIN ch USING (id)), t AS (SELECT *, CASE WHEN ok THEN coalesce(new_category, category) ELSE category END AS target FROM j) SELECT id, CASE WHEN ok THEN new_status ELSE status END AS status, target AS category, CASE WHEN target IS DISTINCT FROM category THEN ['manual_agency_reassignment'] ELSE CAST([] AS VARCHAR[]) END AS review_reasons, CASE WHEN target IS NOT DISTINCT FROM category THEN 'a' || CAST(id % 9 AS VARCHAR) END AS assigned_agency_id, CASE WHEN ok AND new_status = 'rejected' THEN note END AS rejection_reason, ok AS changed FROM t")
def status_change(spark, sf):
    r = reports(spark, sf).withColumns({"review_reasons": F.array().cast("array<string>"), "assigned_agency_id": F.concat(F.lit("a"), (F.col("id") % 9).cast("string"))})
    k = F.col("event_id")
    c = table(spark, sf, "events").where("event_id % 4 != 0").select(k.alias("id"), _pick(S.STATUSES, k + 1, 5).alias("new_status"), F.when(k % 7 == 0, "kelurahan").alias("new_category"), F.when(k % 2 == 0, "no").alias("note"), F.when(k % 3 == 0, "report-images/u/x").alias("photo"))
    return S.status_change(r, c)


@query("q4_submit", f"WITH {_REC}, s AS (SELECT id, {_SLUG}[id % 8 + 1] <> category AS over, id % 6 = 0 AS asked, confidence, latitude, longitude FROM rec) SELECT id, over AS overridden, asked OR over AS review_required, CASE WHEN over THEN ['user_category_override'] WHEN asked THEN ['client_review_required'] ELSE CAST([] AS VARCHAR[]) END AS review_reasons, latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND confidence BETWEEN 0 AND 1 AS accepted FROM s")
def submit(spark, sf):
    r = records(spark, sf).withColumns({"prediction": _pick(T.SLUGS, F.col("id"), 8), "review_required": F.col("id") % 6 == 0, "reasons": F.array().cast("array<string>"), "description": F.lit("a pothole in the road")})
    return S.submitted(r)


@query("q6_attest", f"WITH {_REC} SELECT id, id % 3 = 0 AS release_found, id % 5 <> 0 AS probabilities_ok, 'b' AS prediction FROM rec")
def attest(spark, sf):
    k = F.col("id")
    p = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0.2), F.lit(0.5), F.when(k % 5 == 0, 0.4).otherwise(0.3)))
    names = ["manifest", "class_map", "model_name", "model_version", "method"]
    e = records(spark, sf).select("id", p.alias("probabilities"), F.lit(0.5).alias("confidence"), *[F.when(F.lit(n == "model_version") & (k % 3 != 0), "old").otherwise("x").alias(n) for n in names])
    releases = spark.createDataFrame([("x", "x", "x", "x", "x", True), ("x", "x", "x", "old", "x", False)], "manifest string, class_map string, model_name string, model_version string, method string, enabled boolean")
    return S.attested(e, releases, ["a", "b", "c"])


@query("j21_release_match", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1")
def release_match(spark, sf):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    enabled = spark.createDataFrame([("A", "F", 1)], "l_returnflag string, l_linestatus string, l_linenumber int")
    return table(spark, sf, "lineitem").select(*keys, "l_orderkey").join(enabled, keys, "left_semi").select("l_orderkey", "l_linenumber")


@query("a44_probability_maps", "SELECT event_id, abs(0.2 + 0.5 + CASE WHEN event_id % 5 = 0 THEN 0.4 ELSE 0.3 END - 1) <= 1e-6 AS sums, 3 AS keys FROM events")
def probability_maps(spark, sf):
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0.2), F.lit(0.5), F.when(F.col("event_id") % 5 == 0, 0.4).otherwise(0.3)))
    return table(spark, sf, "events").select("event_id", (F.abs(V.total(F.map_values(m)) - 1) <= 1e-6).alias("sums"), F.size(F.map_keys(m)).alias("keys"))


@query("f21_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has FROM events")
def json_access(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.try_element_at(m, F.lit("k")).cast("long").alias("k"), F.map_contains_key(m, "k").alias("has"))


@query("q8_detail", f"""WITH {_REP} SELECT id, CASE WHEN {_SEE} THEN 'full' WHEN {_PUBLIC} THEN 'public' ELSE 'none' END AS kind FROM rp""")
def detail(spark, sf):
    d = S.detail(reports(spark, sf), "u7", "agency_admin", "dinas_sda")
    kind = F.when(F.col("body").isNull(), "none").when(F.get_json_object("body", "$.description") == S.HIDDEN, "public").otherwise("full")
    return d.select("id", kind.alias("kind"))


_URLS = "urls AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'https://x/storage/v1/object/public/report-images/u/' || event_id || '.jpg' WHEN 1 THEN 'https://x/object/sign/report-images/u/' || event_id || '.jpg?token=1' WHEN 2 THEN 'report-images/u/' || event_id || '.jpg' ELSE 'broken' END AS url FROM events)"
_PARSE = "CASE id % 4 WHEN 3 THEN NULL ELSE {0} END"


def urls(spark, sf):
    k, s = F.col("event_id"), F.col("event_id").cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://x/storage/v1/object/public/report-images/u/"), s, F.lit(".jpg"))).when(k % 4 == 1, F.concat(F.lit("https://x/object/sign/report-images/u/"), s, F.lit(".jpg?token=1"))).when(k % 4 == 2, F.concat(F.lit("report-images/u/"), s, F.lit(".jpg"))).otherwise("broken")
    return table(spark, sf, "events").select(k.alias("id"), url.alias("url"))


@query("f20_storage_refs", f"WITH {_URLS} SELECT id, CASE WHEN id % 4 <> 3 THEN 'report-images' END AS bucket, CASE WHEN id % 4 <> 3 THEN 'u/' || id || '.jpg' END AS object_path FROM urls")
def storage_refs(spark, sf):
    return urls(spark, sf).select("id", T.storage_ref(F.col("url")).alias("r")).select("id", "r.bucket", "r.object_path")


@query("j19_lateral", f"WITH {_URLS} SELECT id, 'report-images' AS bucket, 'u/' || id || '.jpg' AS object_path FROM urls WHERE id % 4 <> 3")
def lateral(spark, sf):
    return urls(spark, sf).select("id", F.filter(F.array(T.storage_ref(F.col("url"))), lambda r: r.isNotNull()).alias("refs")).select("id", F.inline("refs"))


@query("x2_table_function", f"WITH {_URLS} SELECT id, 'report-images' AS bucket FROM urls WHERE id % 4 <> 3")
def table_function(spark, sf):
    from pyspark.sql.functions import udtf

    @udtf(returnType="bucket string, object_path string")
    class Ref:
        def eval(self, url: str):
            rest = url.split("/object/public/")[-1].split("/object/sign/")[-1].split("?")[0]
            bucket, slash, path = rest.partition("/")
            if slash and path:
                yield bucket, path

    spark.udtf.register("tallymill_storage_ref", Ref)
    urls(spark, sf).createOrReplaceTempView("tallymill_urls")
    return spark.sql("SELECT u.id, r.bucket FROM tallymill_urls u, LATERAL tallymill_storage_ref(u.url) r")


@query("f25_client_refs", f"WITH {_URLS} SELECT id, CASE WHEN id % 4 <> 3 THEN 'report-images' END AS bucket FROM urls")
def client_refs(spark, sf):
    return urls(spark, sf).select("id", T.client_ref(F.col("url")).alias("r")).select("id", "r.bucket")


@query("f26_joined_parts", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ', Jakarta' END AS place FROM supplier")
def joined_parts(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", T.filled_list(F.col("s_name"), F.lit("  "), F.when(F.col("s_suppkey") % 3 != 0, "Jakarta")).alias("place"))


@query("q9_evidence", f"WITH {_URLS} SELECT id AS report_id, kind, 'report-images' AS bucket, 'u/' || id || '.jpg' AS object_path FROM urls, (VALUES ('initial'), ('resolution')) v(kind) WHERE id % 4 <> 3 AND (kind = 'initial' OR id % 2 = 0)")
def evidence(spark, sf):
    u = urls(spark, sf)
    return S.evidence_rows(u.select("id", F.col("url").alias("image_url"), F.when(F.col("id") % 2 == 0, F.col("url")).alias("resolution_url")))


_VER = "ver AS (SELECT user_id % 200 AS report, event_id AS version, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'a' || CAST(event_id % 3 AS VARCHAR) END AS agency FROM events)"


def versions(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select((F.col("user_id") % 200).alias("report"), k.alias("version"), F.when(k % 6 != 0, F.concat(F.lit("a"), (k % 3).cast("string"))).alias("agency"))


@query("q10_assignments", f"WITH {_VER}, c AS (SELECT *, lag(agency) OVER w AS before, row_number() OVER w AS turn FROM ver WINDOW w AS (PARTITION BY report ORDER BY version)), d AS (SELECT *, lead(version) OVER (PARTITION BY report ORDER BY version) IS NULL AS newest FROM c WHERE turn = 1 OR before IS DISTINCT FROM agency) SELECT report, version, agency, CASE WHEN newest THEN 'active' ELSE 'superseded' END AS status FROM d WHERE agency IS NOT NULL")
def assignments(spark, sf):
    return S.assignment_history(versions(spark, sf), "report", "version", "agency")


@query("q11_profile_update", f"WITH {_PROFILES} SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN 'agency_admin' END, role, 'citizen') AS role FROM prof")
def profile_update(spark, sf):
    p = profiles(spark, sf)
    return p.select("id", F.coalesce(F.when(F.col("id") % 4 == 0, "agency_admin"), "role", F.lit("citizen")).alias("role"))


@query("q13_backfill", f"WITH {_REP} SELECT id, category = 'instansi_lain' AND status <> 'rejected' AS flagged FROM rp")
def backfill(spark, sf):
    return reports(spark, sf).select("id", ((F.col("category") == T.CATCH_ALL) & (F.col("status") != "rejected")).alias("flagged"))


@query("j18_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
def not_exists(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("j20_update_from", "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def update_from(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return S.updated_from(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name"), n, "s_nationkey", "s_name").select("s_suppkey", "s_name")


@query("j23_reconcile", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'missing' WHEN s_suppkey % 5 = 0 THEN 'undeclared' ELSE 'mismatched' END AS finding FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0 OR s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0 OR (s_suppkey % 11 = 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0)")
def reconcile(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("digest"))
    declared = s.where("s_suppkey % 5 != 0")
    actual = s.where("s_suppkey % 7 != 0").withColumn("digest", F.when(F.col("s_suppkey") % 11 == 0, "other").otherwise(F.col("digest")))
    return O.reconciled(declared, actual, "s_suppkey", "digest")


@query("s16_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT -1, 'new'")
def upsert(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    new = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name")).union(spark.createDataFrame([(-1, "new")], "s_suppkey long, s_name string"))
    return S.upserted(s, new, "s_suppkey")


@query("q14_seed", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT -1, 'seed'")
def seed(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return S.upserted(s, spark.createDataFrame([(-1, "seed")], "s_suppkey long, s_name string"), "s_suppkey")


@query("s17_insert_ignore", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT -1, 'new'")
def insert_ignore(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    new = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name")).union(spark.createDataFrame([(-1, "new")], "s_suppkey long, s_name string"))
    return S.inserted(s, new, ["s_suppkey"])


@query("v17_append_once", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['x', 'y'] ELSE ['y'] END AS items FROM events")
def append_once(spark, sf):
    have = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", V.appended_once(have, "y").alias("items"))


@query("o3_newest_orders", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def newest_orders(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey")


@query("o4_history", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def order_history(spark, sf):
    o = table(spark, sf, "orders")
    first = o.agg(F.min("o_custkey").alias("o_custkey"))
    return o.join(F.broadcast(first), "o_custkey").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("o5_top_classes", "SELECT vec_id, list_transform(list_slice(list_sort(list_transform(range(0, 10), lambda k: {'n': -CAST(embedding[k + 1] AS DOUBLE), 'k': k})), 1, 3), lambda s: CAST(s.k AS INTEGER)) AS top FROM embeddings")
def top_classes(spark, sf):
    pairs = F.transform(F.slice("embedding", 1, 10), lambda x, k: F.struct((-x.cast("double")).alias("n"), k.alias("k")))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda s: s["k"]).alias("top"))


@query("o6_previews", "(SELECT 'new' AS list, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 12) UNION ALL (SELECT 'dear', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def previews(spark, sf):
    o = table(spark, sf, "orders")
    a = o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(12).select(F.lit("new").alias("list"), "o_orderkey")
    return a.union(o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.lit("dear").alias("list"), "o_orderkey"))


@query("o8_by_ordinal", f"WITH {_AG} SELECT agency_id, list_position({_SLUG}, category) - 1 AS ordinal, row_number() OVER (PARTITION BY category ORDER BY name) AS place FROM ag")
def by_ordinal(spark, sf):
    from pyspark.sql import Window as W

    a = agencies(spark, sf)
    return a.select("agency_id", (F.array_position(F.array(*[F.lit(s) for s in T.SLUGS]), F.col("category")) - 1).cast("int").alias("ordinal"), F.row_number().over(W.partitionBy("category").orderBy("name")).cast("long").alias("place"))


@query("a40_status_counts", f"WITH {_REP} SELECT status, count(*) AS n FROM rp GROUP BY status")
def status_counts(spark, sf):
    return reports(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


# Live lists: the same views over the newest version of each report.

_STATE = "st AS (SELECT id, user_id, category, status, created_at FROM (SELECT id % 300 AS id, user_id, category, status, created_at, row_number() OVER (PARTITION BY id % 300 ORDER BY created_at DESC, id DESC) AS r FROM rp) WHERE r = 1)"


def state(spark, sf):
    r = reports(spark, sf).select((F.col("id") % 300).alias("id"), F.col("id").alias("sequence"), "user_id", "category", "status", "created_at")
    return L.newest(r, "id", ["created_at", "sequence"]).drop("sequence")


@query("t1_user_list", f"WITH {_REP}, {_STATE} SELECT id, status FROM st WHERE user_id = 'u7'")
def user_list(spark, sf):
    return L.of_user(state(spark, sf), "u7").select("id", "status")


@query("t2_category_list", f"WITH {_REP}, {_STATE} SELECT id, status FROM st WHERE category = 'kelurahan' AND status <> 'rejected'")
def category_list(spark, sf):
    return L.of_category(state(spark, sf), "kelurahan").select("id", "status")


@query("t3_latest", f"WITH {_REP}, {_STATE} SELECT id, status FROM st ORDER BY created_at DESC, id LIMIT 200")
def latest(spark, sf):
    return L.latest(state(spark, sf)).select("id", "status")


@query("t5_history", f"WITH {_REP}, {_STATE} SELECT id FROM st WHERE user_id = 'u3' ORDER BY created_at, id LIMIT 100")
def history(spark, sf):
    return L.history(state(spark, sf), "u3").select("id")
