"""Hand-computed and published facts."""

import math

import pytest
from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.functions import vectors as V
from tallymill.operators import ensemble, inference, metrics, routing, selective, store
from tallymill.operators import tables as O
from tallymill.operators.components import connected_components
from tallymill.plans.records import REPORT


def scores(spark, u, correct=None):
    rows = [(i, x, True if correct is None else correct[i]) for i, x in enumerate(u)]
    return spark.createDataFrame(rows, "id long, u double, correct boolean")


def test_threshold_and_its_later_use(spark):
    r = selective.thresholds(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.9]), "u", [0.8]).first()
    assert (r.threshold, r.coverage, r.retained) == (0.4, 0.8, 4)
    later = scores(spark, [0.05, 0.35, 0.45, 0.8]).where(F.col("u") <= r.threshold)
    assert later.count() == 2


def test_ties_stay_whole(spark):
    r = selective.thresholds(scores(spark, [0.1, 0.2, 0.2, 0.2, 0.9]), "u", [0.4]).first()
    assert (r.retained, r.coverage) == (4, 0.8)


def test_error_detection(spark):
    df = scores(spark, [0.1, 0.2, 0.9, 0.3], [True, True, False, True]).withColumn("wrong", ~F.col("correct"))
    assert metrics.rank_auc(df, "u", "wrong").first().auc == 1.0
    assert metrics.rank_auc(df.where("correct"), "u", "wrong").first().auc is None


def test_mcnemar(spark):
    y, a, b = [0, 0, 1, 1], [0, 1, 0, 1], [0, 0, 1, 1]
    df = spark.createDataFrame([(x == z, x == w) for x, z, w in zip(y, a, b, strict=True)], "a boolean, b boolean")
    r = inference.mcnemar(df, "a", "b").first()
    assert (r.b, r.c, r.delta, r.p_value) == (0, 2, 0.5, 0.5)
    assert inference.mcnemar(df.where("a = b"), "a", "b").first().p_value == 1.0


def test_two_opposed_heads(spark):
    df = spark.createDataFrame([(1, [0.9, 0.1]), (1, [0.1, 0.9])], "id long, p array<double>")
    r = ensemble.mean_probabilities(df, ["id"]).first()
    h = -(0.9 * math.log(0.9) + 0.1 * math.log(0.1))
    assert r.mutual_information == pytest.approx(math.log(2) - h) and r.p == [0.5, 0.5]


def test_joint_gate_on_opposite_rankings(spark):
    df = spark.createDataFrame([(float(i), float(9 - i)) for i in range(10)], "a double, b double")
    r = selective.joint_gate(df, ["a", "b"], 0.8).first()
    assert (r.coverage, r.quantile) == (0.8, 0.9)


def test_boundary_group_is_quarantined(spark):
    rows = [("a", "2026-01-01"), ("b", "2026-01-20"), ("b", "2026-02-10"), ("c", "2026-02-15"), ("d", "2026-03-05")]
    df = spark.createDataFrame(rows, "g string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.g: (r.split, r.n) for r in O.temporal_split(df, "g", "t", "2026-02-01", "2026-03-01").collect()}
    assert got == {"a": ("train", 1), "b": ("quarantine", 2), "c": ("val", 1), "d": ("test", 1)}


def test_spacing_and_case_make_one_group(spark):
    df = spark.createDataFrame([(1, "jalan rusak"), (2, "Jalan   rusak"), (3, "banjir besar di sini"), (4, None), (5, "  ")], "id long, text string")
    got = {r.id: r.group for r in O.leakage_groups(df, "id", "text").collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def test_explicit_keys_join(spark):
    df = spark.createDataFrame([(1, "a b c d e", "K1"), (2, "v w x y z", " k1 "), (3, "q", None)], "id long, text string, k string")
    got = {r.id: (r.group, r.members) for r in O.leakage_groups(df, "id", "text", ["k"]).collect()}
    assert got[1] == got[2] and got[1][1] == 2 and got[3][1] == 1


def test_chain_of_edges(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "a long, b long")
    got = connected_components(df, "a", "b").collect()
    assert {r.component for r in got} == {0} and len(got) == 61
    assert connected_components(df.where("false"), "a", "b").count() == 0


def test_quotas(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 50), ("c", 25)], "label string, size long")
    got = {r.label: r.quota for r in O.quotas(sizes, "label", 40, 5).collect()}
    assert sum(got.values()) == 40 and min(got.values()) >= 5


def test_privacy_screen(spark):
    df = spark.createDataFrame([(1, "write to a.b@example.org"), (2, "call 0812 3456 7890"), (3, "nothing"), (4, None)], "id long, text string")
    got = {r.pattern: r.rows for r in O.screen(df, "text").collect()}
    assert got["email"] == 1 and got["phone"] == 1 and got["url"] == 0


def test_published_report_has_one_reconstruction(spark):
    df = spark.createDataFrame(REPORT, "label string, precision string, recall string, f1 string, support long")
    rows = O.reconstruct(df, 9266)
    got = {r.label: (r.tp, r.fn, r.fp) for r in rows.collect()}
    assert len(got) == rows.count() == 9 and got["Transportation"] == (1524, 228, 281) and got["Water resources"] == (290, 101, 230)
    m = O.margins(rows).first()
    assert (m.samples, m.correct, m.fn, m.fp) == (9266, 7480, 1786, 1786)
    assert [round(x, 4) for x in (m.macro_precision, m.macro_recall, m.macro_f1)] == [0.7635, 0.7916, 0.7747]


def test_exact_sign_flip(spark):
    d = spark.createDataFrame([(1, 2, 4), (2, 1, 3), (3, 0, 2), (4, -1, 3)], "c long, d long, n long")
    r = inference.sign_flip(d).first()
    # Of 8 sign patterns of 2, 1, 1 the sums are 4, 2, 2, 0 and their opposites: 6 reach 2.
    assert (r.informative, r.p_value) == (3, 6 / 8) and r.delta == pytest.approx(2 / 12)


def test_bootstrap_keeps_clusters_whole(spark):
    stats = spark.createDataFrame([("s", f"c{i}", 10 + i) for i in range(4)], "stratum string, cluster string, n long")
    a = inference.cluster_bootstrap(stats, ["n"], 50, 7).orderBy("draw").collect()
    assert len(a) == 50 and a == inference.cluster_bootstrap(stats, ["n"], 50, 7).orderBy("draw").collect()
    assert all(40 <= r.n <= 52 for r in a)


def test_simhash_and_shingles(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcdef",)], "t string")
    got = [r.s for r in df.select(T.char_shingles(F.col("t")).alias("s")).collect()]
    assert got == [[], [" ab "], [" abc", "abcd", "bcde", "cdef", "def "]]
    codes = [r.c for r in df.select(T.simhash64(T.char_shingles(F.col("t"))).alias("c")).collect()]
    assert codes[0] == 0 and codes[1] != codes[2]


def test_full_normal_form(spark):
    df = spark.createDataFrame([("Straße  ﬁne  X",), (None,)], "t string")
    assert [r.n for r in df.select(T.normalised("t").alias("n")).collect()] == ["strasse fine x", ""]


def test_display_rounds_half_up(spark):
    r = spark.range(1).select(O.displays_as(F.lit(1), F.lit(20000), F.lit(1)).alias("a"), O.displays_as(F.lit(1), F.lit(20000), F.lit(0)).alias("b")).first()
    assert (r.a, r.b) == (True, False)


def test_empty_acceptance_is_not_a_number(spark):
    df = metrics.predicted(spark.createDataFrame([(0, [0.6, 0.4]), (1, [0.7, 0.3])], "y int, p array<double>"))
    r = metrics.accepted_risk(df, F.col("confidence") > 2, 2).first()
    assert r.retained == 0 and math.isnan(r.risk) and math.isnan(r.macro_f1)


def test_last_bin_closed_or_open(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.99999, 1.0)], "x double")
    assert [r.b for r in df.select(metrics.bin_of(F.col("x"), 10).alias("b")).collect()] == [0, 3, 9, 9]
    assert df.select(metrics.bin_of(F.col("x"), 10, closed=False).alias("b")).collect()[-1].b is None


def test_routing_holds_back_reviewed_records(spark):
    rec = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.9), (2, "a", 0.0, 0.0, 0.1), (3, "b", 0.0, 0.0, 0.9), (4, "a", None, 0.0, 0.9), (5, "z", 0.0, 0.0, 0.9)], "id long, category string, latitude double, longitude double, confidence double")
    ag = spark.createDataFrame([(1, "a", 0.0, 1.0, True), (2, "a", 0.0, 0.5, True), (3, "a", 0.0, 0.1, False), (4, "a", 0.0, -0.5, True)], "agency_id long, category string, latitude double, longitude double, active boolean")
    got = {r.id: (r.reasons, r.agency_id) for r in routing.routed(rec, ag, "id", "z", 0.5).collect()}
    assert got == {1: ([], 2), 2: (["low_confidence"], None), 3: (["routing_registry_gap"], None), 4: (["routing_location_missing"], None), 5: (["catch_all_class"], None)}
    assert routing.registry_status(0, 0) == "unavailable" and routing.registry_status(3, 0, False) == "untrusted_fallback"


def test_redacted_rows_carry_no_person(spark):
    cols = "id long, user_id string, category string, status string, visibility string, latitude double, longitude double, created_at timestamp, description string"
    df = spark.createDataFrame([(1, "u", "a", "submitted", "public", -6.125, 106.815, None, "secret"), (2, "u", "a", "rejected", "public", 0.0, 0.0, None, "x")], cols)
    rows = store.public_feed(df).collect()
    assert len(rows) == 1 and rows[0].user_id == store.NOBODY and "secret" not in str(rows[0]) and rows[0].latitude == -6.13
    assert store.clamped(None) == 200 and store.clamped(0) == 1 and store.clamped(999) == 200


def test_assignment_history(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (2, 1, None), (2, 2, "c")], "r long, v long, agency string")
    got = {(r.r, r.v): r.status for r in store.assignment_history(df, "r", "v", "agency").collect()}
    assert got == {(1, 1): "superseded", (1, 3): "superseded", (2, 2): "active"}


def test_vectors(spark):
    r = spark.range(1).select(
        V.l2(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("cos"),
        V.argmax(F.array(F.lit(0.4), F.lit(0.4))).alias("tie"),
        V.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("soft"),
        V.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
    ).first()
    assert r.zero == [0.0, 0.0] and r.cos == 1.0 and r.tie == 0 and r.soft == [0.5, 0.5] and r.half == pytest.approx(math.pi * 6371000)
