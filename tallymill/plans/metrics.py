"""Queries over probability heads: reports, calibration, selective risk, ensembles, inference, leaderboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import vectors as V
from tallymill.operators import ensemble as E
from tallymill.operators import inference as I
from tallymill.operators import metrics as M
from tallymill.operators import selective as S
from tallymill.plans.fixtures import CLASSES, ENSEMBLE_CTE, HEADS_CTE, PRED_CTE, ensemble, head, heads
from tallymill.plans.registry import query, table

_P = f"WITH {PRED_CTE}"
_E = f"WITH {ENSEMBLE_CTE}"
_H = f"WITH {HEADS_CTE}"
_GRID = "(SELECT CAST(range AS INTEGER) AS class FROM range(0, 10))"


def report_sql(source: str) -> str:
    """Per-class counts and rates of a relation (y, pred)."""
    return f"""SELECT class, coalesce(tp / nullif(decided, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2.0 * tp / nullif(decided + support, 0), 0) AS f1, support, tp FROM (
      SELECT class, (SELECT count(*) FROM {source} s WHERE s.y = g.class) AS support, (SELECT count(*) FROM {source} s WHERE s.pred = g.class) AS decided,
             (SELECT count(*) FROM {source} s WHERE s.y = g.class AND s.pred = g.class) AS tp FROM {_GRID} g)"""


_AVERAGES = """sum(tp) / sum(support) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(precision) AS macro_precision,
  avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1"""
_AVERAGE_NAMES = "accuracy balanced_accuracy macro_precision macro_recall macro_f1 weighted_f1"


@query("a13_class_report", f"{_P} {report_sql('pred')}", "precision recall f1")
def class_report(spark, sf):
    return M.class_report(head(spark, sf), CLASSES)


@query("a12_confusion", f"{_P}, n AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL) SELECT a.class AS y, b.class AS pred, coalesce(n, 0) AS n, coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY a.class), 0) AS share FROM {_GRID} a CROSS JOIN {_GRID} b LEFT JOIN n ON n.y = a.class AND n.pred = b.class", "share")
def confusion(spark, sf):
    return M.confusion(head(spark, sf), CLASSES)


@query("a14_averages", f"{_P} SELECT {_AVERAGES} FROM ({report_sql('pred')})", _AVERAGE_NAMES)
def averages(spark, sf):
    return M.averages(M.class_report(head(spark, sf), CLASSES))


@query("a15_log_loss", f"{_P} SELECT avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p[y + 1])))) AS log_loss FROM pred", "log_loss")
def log_loss(spark, sf):
    return head(spark, sf).agg(M.log_loss().alias("log_loss"))


_BRIER = "avg(list_sum(list_transform(range(0, 10), lambda k: (p[k + 1] - CASE WHEN k = y THEN 1 ELSE 0 END) ** 2)))"


@query("a16_brier", f"{_P} SELECT {_BRIER} AS brier FROM pred", "brier")
def brier(spark, sf):
    return head(spark, sf).agg(M.brier(CLASSES).alias("brier"))


def reliability_sql(bins: int, closed: bool) -> str:
    last = f"OR (b = {bins - 1} AND confidence = 1)" if closed else ""
    return f"""SELECT CAST(b AS INTEGER) AS bin, b / {bins}.0::DOUBLE AS low, (b + 1) / {bins}.0::DOUBLE AS high, count(id) AS n, avg(confidence) AS confidence, avg(CASE WHEN correct THEN 1.0 WHEN id IS NOT NULL THEN 0.0 END) AS accuracy
      FROM range(0, {bins}) t(b) LEFT JOIN pred ON (confidence >= b / {bins}.0::DOUBLE AND confidence < (b + 1) / {bins}.0::DOUBLE) {last} GROUP BY b"""


@query("a17_calibration_error", f"{_P}, t AS ({reliability_sql(15, True)}) SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM t", "ece")
def calibration_error(spark, sf):
    return M.calibration_error(M.reliability(head(spark, sf), 15))


@query("a18_reliability", f"{_P} {reliability_sql(15, True)}", "low high confidence accuracy")
def reliability(spark, sf):
    return M.reliability(head(spark, sf), 15)


@query("a19_calibration_curve", f"{_P} {reliability_sql(10, False)}", "low high confidence accuracy")
def curve(spark, sf):
    return M.reliability(head(spark, sf), 10, closed=False)


def auc_sql(source: str, score: str, positive: str, by: str = "") -> str:
    """Rank-sum area with average ranks."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {group}CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN (sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))) END AS auc FROM (
      SELECT *, sum(n) OVER ({part}ORDER BY s) - n + (n + 1) / 2 AS rank FROM (
        SELECT {group}{score} AS s, count(*) AS n, count(*) FILTER (WHERE {positive}) AS pos FROM {source} GROUP BY ALL)) {f'GROUP BY {by}' if by else ''}"""


@query("a20_macro_auc", f"{_P}, long AS (SELECT y, k, p[k + 1] AS score FROM pred, range(0, 10) t(k)) SELECT CASE WHEN count(auc) = 10 THEN avg(auc) END AS macro_auc FROM ({auc_sql('long', 'score', 'y = k', 'k')})", "macro_auc")
def macro_auc(spark, sf):
    return M.macro_auc(head(spark, sf), CLASSES)


_UNC = "predictive_entropy"


@query(
    "a21_uncertainty_quality",
    f"""{_E}, t AS (SELECT {_UNC} AS s, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS e FROM ens GROUP BY ALL),
    up AS (SELECT sum(n * w / seen) / sum(n) AS aurc FROM (SELECT n, sum(e) OVER (ORDER BY s) AS w, sum(n) OVER (ORDER BY s) AS seen FROM t)),
    down AS (SELECT sum(e * f / seen) / nullif(sum(e), 0) AS average_precision FROM (SELECT e, sum(e) OVER (ORDER BY s DESC) AS f, sum(n) OVER (ORDER BY s DESC) AS seen FROM t))
    SELECT auc, aurc, average_precision FROM ({auc_sql('ens', _UNC, 'NOT correct')}), up, down""",
    "auc aurc average_precision",
)
def uncertainty_quality(spark, sf):
    df = ensemble(spark, sf)
    auc = M.rank_auc(df.withColumn("wrong", ~F.col("correct")), _UNC, "wrong")
    return auc.crossJoin(M.area_under_risk(df, _UNC)).crossJoin(M.average_precision(df, _UNC))


@query("a23_ensemble", f"{_E} SELECT id, y, p, members, expected_entropy, predictive_entropy, mutual_information FROM ens", "expected_entropy predictive_entropy mutual_information", "p")
def ensemble_mean(spark, sf):
    return E.mean_probabilities(heads(spark, sf), ["id", "y"])


@query("a24_equal_weights", f"{_H}, c AS (SELECT id, k, avg(p[k]) AS x FROM heads, range(1, 11) t(k) WHERE abs(list_sum(p) - 1) <= 1e-5 GROUP BY ALL), q AS (SELECT id, list(x ORDER BY k) AS p FROM c GROUP BY id) SELECT id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM q", "", "p")
def equal_weights(spark, sf):
    ok = heads(spark, sf).where(V.valid_probabilities(F.col("p"), CLASSES))
    return E.mean_probabilities(ok, ["id"]).select("id", "p")


_ENT = "-list_sum(list_transform({0}, lambda x: x * ln(greatest(x, 1e-12))))"


@query("a25_virtual_ensembles", f"{_H} SELECT id, avg({_ENT.format('p')}) AS expected_entropy, max({_ENT.format('p')}) AS widest FROM heads WHERE h < 3 GROUP BY id", "expected_entropy widest")
def virtual_ensembles(spark, sf):
    stacks = heads(spark, sf).where("h < 3").groupBy("id").agg(F.collect_list("p").alias("stack"))
    own = F.transform("stack", V.entropy)
    return stacks.select("id", (V.total(own) / F.size(own)).alias("expected_entropy"), F.array_max(own).alias("widest"))


@query("c8_prediction_frame", f"{_P} SELECT id, y, CAST(pred AS INTEGER) AS pred, confidence, correct, p[1] AS prob_0, p[10] AS prob_9 FROM pred", "confidence prob_0 prob_9")
def prediction_frame(spark, sf):
    return head(spark, sf).select("id", "y", "pred", "confidence", "correct", F.col("p")[0].alias("prob_0"), F.col("p")[9].alias("prob_9"))


@query(
    "c9_metric_bundle",
    f"{_P}, t AS ({reliability_sql(15, True)}) SELECT * FROM (SELECT {_AVERAGES} FROM ({report_sql('pred')})), (SELECT avg(-ln(greatest(2.220446049250313e-16, p[y + 1]))) AS log_loss, {_BRIER} AS brier FROM pred), (SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM t)",
    _AVERAGE_NAMES + " log_loss brier ece",
)
def bundle(spark, sf):
    df = head(spark, sf)
    return M.averages(M.class_report(df, CLASSES)).crossJoin(df.agg(M.log_loss().alias("log_loss"), M.brier(CLASSES).alias("brier"))).crossJoin(M.calibration_error(M.reliability(df, 15)))


@query(
    "c25_ensemble_recheck",
    f"{_E} SELECT count(*) AS rows, count(*) FILTER (WHERE abs(mutual_information - greatest(0, predictive_entropy - expected_entropy)) > 5e-9) AS differ FROM ens",
)
def ensemble_recheck(spark, sf):
    stored = ensemble(spark, sf).select("id", "p", "mutual_information", "confidence")
    again = E.mean_probabilities(heads(spark, sf), ["id"]).select("id", F.col("p").alias("p2"), F.col("mutual_information").alias("mi2"))
    j = stored.join(again, "id")
    off = ~V.same_number(F.col("mutual_information"), F.col("mi2"), 5e-9) | ~V.same_number(F.col("confidence"), F.array_max("p2"), 5e-9)
    return j.agg(F.count("*").alias("rows"), F.count_if(off).alias("differ"))


# Array functions.


@query("v5_softmax_sigmoid", f"{_H} SELECT id, p, 1 / (1 + exp(-e)) AS s1 FROM (SELECT id, p, CAST(embedding[1] AS DOUBLE) AS e FROM heads JOIN embeddings ON id = vec_id WHERE h = 1)", "s1", "p")
def softmax_sigmoid(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("e"))
    return heads(spark, sf).where("h = 1").join(e, "id").select("id", "p", V.two_class(F.col("e"))[1].alias("s1"))


@query("v6_entropy", f"{_H} SELECT id, h, {_ENT.format('p')} AS entropy FROM heads", "entropy")
def entropy(spark, sf):
    return heads(spark, sf).select("id", "h", V.entropy(F.col("p")).alias("entropy"))


@query("v7_validation", f"{_H} SELECT h, count(*) AS rows, count(*) FILTER (WHERE abs(list_sum(list_transform(p, lambda x: x * CASE WHEN id % 7 = 0 THEN 1.1 ELSE 1 END)) - 1) > 1e-5) AS bad FROM heads GROUP BY h")
def validation(spark, sf):
    df = heads(spark, sf).withColumn("p", F.transform("p", lambda x: x * F.when(F.col("id") % 7 == 0, 1.1).otherwise(1.0)))
    return df.groupBy("h").agg(F.count("*").alias("rows"), F.count_if(~V.valid_probabilities(F.col("p"), CLASSES)).alias("bad"))


@query("v8_ordered_vector", f"{_H} SELECT id, list_transform(range(0, 10), lambda k: CASE WHEN k < 8 THEN p[k + 1] ELSE 0 END) AS v FROM heads WHERE h = 2", "", "v")
def ordered_vector(spark, sf):
    m = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k.cast("string")), F.slice("p", 1, 8))
    return heads(spark, sf).where("h = 2").select("id", V.by_class(m, CLASSES).alias("v"))


@query("v19_one_hot", "SELECT vec_id AS id, list_transform(range(0, 10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM embeddings")
def one_hot(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.one_hot(F.col("label"), CLASSES).alias("v"))


# Selective risk.


@query("w2_thresholds", f"{_E}, r AS (SELECT u, sum(n) OVER (ORDER BY u) AS seen FROM (SELECT {_UNC} AS u, count(*) AS n FROM ens GROUP BY ALL)), n AS (SELECT count(*) AS n FROM ens) SELECT target, min(u) AS threshold, CAST(min(seen) AS BIGINT) AS retained, min(seen) / any_value(n) AS coverage FROM r, n, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) t(target) WHERE seen >= ceil(target * n - 1e-12) GROUP BY target", "threshold coverage")
def thresholds(spark, sf):
    return S.thresholds(ensemble(spark, sf), _UNC, [0.5, 0.8, 0.9])


_CURVE = f"""r AS (SELECT u, seen, wrong FROM (SELECT u, sum(n) OVER (ORDER BY u) AS seen, sum(e) OVER (ORDER BY u) AS wrong FROM (SELECT {_UNC} AS u, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS e FROM ens GROUP BY ALL))), n AS (SELECT count(*) AS n FROM ens)"""


@query("w3_risk_curve", f"{_E}, {_CURVE} SELECT target, min(u) AS threshold, CAST(min(seen) AS BIGINT) AS retained, min(seen) / any_value(n) AS coverage, arg_min(wrong, u) / min(seen) AS risk FROM r, n, (VALUES (1.0::DOUBLE), (0.9::DOUBLE), (0.7::DOUBLE), (0.5::DOUBLE)) t(target) WHERE seen >= ceil(target * n - 1e-12) GROUP BY target", "threshold coverage risk")
def risk_curve(spark, sf):
    return S.risk_curve(ensemble(spark, sf), _UNC, [1.0, 0.9, 0.7, 0.5])


@query("w1_tie_groups", f"{_P}, t AS (SELECT round(confidence, 2) AS u, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS errors FROM pred GROUP BY ALL) SELECT u, n, errors, CAST(sum(n) OVER (ORDER BY u) AS BIGINT) AS seen, CAST(sum(errors) OVER (ORDER BY u) AS BIGINT) AS wrong FROM t", "u")
def tie_groups(spark, sf):
    return M.tie_groups(head(spark, sf).withColumn("u", F.round("confidence", 2)), "u")


@query(
    "w4_joint_gate",
    f"""{_E}, k AS (SELECT *, greatest(rank() OVER (ORDER BY u1), rank() OVER (ORDER BY u2)) AS j, rank() OVER (ORDER BY u1) AS r1, rank() OVER (ORDER BY u2) AS r2 FROM (SELECT {_UNC} AS u1, 1 - confidence AS u2 FROM ens)),
    g AS (SELECT count(*) AS n, CAST(ceil(0.8 * count(*) - 1e-12) AS BIGINT) AS t FROM k),
    s AS (SELECT greatest((SELECT t FROM g), (SELECT min(j) FROM (SELECT j, count(*) OVER (ORDER BY j) AS seen FROM k), g WHERE seen >= t)) AS rank)
    SELECT s.rank, s.rank / any_value(n) AS quantile, count(*) FILTER (WHERE j <= s.rank) AS retained, count(*) FILTER (WHERE j <= s.rank) / any_value(n) AS coverage,
      max(u1) FILTER (WHERE r1 <= s.rank) AS threshold_u1, max(u2) FILTER (WHERE r2 <= s.rank) AS threshold_u2 FROM k, g, s GROUP BY s.rank""",
    "quantile coverage threshold_u1 threshold_u2",
)
def joint_gate(spark, sf):
    df = ensemble(spark, sf).select(F.col(_UNC).alias("u1"), (1 - F.col("confidence")).alias("u2"))
    return S.joint_gate(df, ["u1", "u2"], 0.8)


@query("a31_accepted_risk", f"{_P}, acc AS (SELECT * FROM pred WHERE confidence >= 0.3) SELECT (SELECT count(*) FROM acc) AS retained, (SELECT count(*) FROM acc) / (SELECT count(*) FROM pred) AS coverage, (SELECT count(*) FILTER (WHERE NOT correct) / count(*) FROM acc) AS risk, avg(f1) AS macro_f1 FROM ({report_sql('acc')})", "coverage risk macro_f1")
def accepted_risk(spark, sf):
    return M.accepted_risk(head(spark, sf), F.col("confidence") >= 0.3, CLASSES)


@query("a43_sweep", f"{_P} SELECT cut, count(*) / (SELECT count(*) FROM pred) AS coverage, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, 1 - count(*) / (SELECT count(*) FROM pred) AS manual FROM pred JOIN (SELECT i / 20.0::DOUBLE AS cut FROM range(5, 19) t(i)) ON confidence >= cut GROUP BY cut", "coverage accuracy manual")
def sweep(spark, sf):
    return S.sweep(head(spark, sf), [i / 20 for i in range(5, 19)])


@query("p9_routable", f"{_P} SELECT count(*) AS rows, count(*) FILTER (WHERE pred <> 9) AS routable, count(*) FILTER (WHERE pred <> 9 AND confidence >= 0.3) / count(*) AS coverage FROM pred", "coverage")
def routable(spark, sf):
    return head(spark, sf).agg(F.count("*").alias("rows"), F.count_if(F.col("pred") != 9).alias("routable"), (F.count_if((F.col("pred") != 9) & (F.col("confidence") >= 0.3)) / F.count("*")).alias("coverage"))


@query("p19_gates", f"{_E} SELECT id, {_UNC} <= 2.0 AND mutual_information <= 0.2 AND confidence >= 0.2 AS accepted FROM ens")
def gates(spark, sf):
    return ensemble(spark, sf).select("id", ((F.col(_UNC) <= 2.0) & (F.col("mutual_information") <= 0.2) & (F.col("confidence") >= 0.2)).alias("accepted"))


_POLICY = f"""{_CURVE}, pol AS (SELECT target, min(u) AS threshold FROM r, n, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) t(target) WHERE seen >= ceil(target * n - 1e-12) GROUP BY target)"""


@query("c11_review_policy", f"{_E} SELECT 1 - max(u) AS minimum_confidence FROM (SELECT 1 - confidence AS u, rank() OVER (ORDER BY 1 - confidence) AS r, count(*) OVER () AS n FROM ens) WHERE r <= ceil(0.8 * n - 1e-12)", "minimum_confidence")
def review_policy(spark, sf):
    df = ensemble(spark, sf).select((1 - F.col("confidence")).alias("u"))
    return S.joint_gate(df, ["u"], 0.8).select((1 - F.col("threshold_u")).alias("minimum_confidence"))


@query("c12_frozen_thresholds", f"{_E}, {_POLICY} SELECT target, threshold, count(*) FILTER (WHERE e.u <= threshold) AS retained, count(*) FILTER (WHERE e.u <= threshold) / count(*) AS coverage FROM pol, (SELECT {_UNC} * 0.98 AS u FROM ens) e GROUP BY ALL", "threshold coverage")
def frozen_thresholds(spark, sf):
    df = ensemble(spark, sf)
    frozen = S.thresholds(df, _UNC, [0.5, 0.8]).select("target", "threshold")
    later = df.select((F.col(_UNC) * 0.98).alias("u"))
    hit = later.crossJoin(F.broadcast(frozen))  # two rows
    return hit.groupBy("target", "threshold").agg(F.count_if(F.col("u") <= F.col("threshold")).alias("retained"), (F.count_if(F.col("u") <= F.col("threshold")) / F.count("*")).alias("coverage"))


@query("a32_parity", f"""{_H}, d AS (SELECT a.id, k, abs(a.p[k] - b.p[k]) AS e FROM heads a JOIN heads b ON a.id = b.id AND a.h = 0 AND b.h = 1, range(1, 11) t(k)) SELECT max(e) AS largest, avg(e) AS mean, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.99) AS p99,
(SELECT avg(CASE WHEN list_position(a.p, list_max(a.p)) = list_position(b.p, list_max(b.p)) THEN 1.0 ELSE 0.0 END) FROM heads a JOIN heads b ON a.id = b.id AND a.h = 0 AND b.h = 1) AS agreement FROM d""", "largest mean p50 p95 p99 agreement")
def parity(spark, sf):
    h = heads(spark, sf)
    j = h.where("h = 0").select("id", F.col("p").alias("a")).join(h.where("h = 1").select("id", F.col("p").alias("b")), "id")
    e = j.select(F.explode(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("e"))
    stats = e.agg(F.max("e").alias("largest"), F.avg("e").alias("mean"), *[F.percentile("e", F.lit(q)).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    same = j.agg(F.avg((V.argmax(F.col("a")) == V.argmax(F.col("b"))).cast("double")).alias("agreement"))
    return stats.crossJoin(same)


@query("a33_tensor_parity", f"""{_H}, j AS (SELECT a.p AS a, b.p AS b FROM heads a JOIN heads b ON a.id = b.id AND a.h = 0 AND b.h = 1) SELECT min(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))) AS least_cosine FROM j""", "least_cosine")
def tensor_parity(spark, sf):
    h = heads(spark, sf)
    j = h.where("h = 0").select("id", F.col("p").alias("a")).join(h.where("h = 1").select("id", F.col("p").alias("b")), "id")
    return j.agg(F.min(V.cosine(F.col("a"), F.col("b"))).alias("least_cosine"))


# Paired inference: system a is the mean of heads 0 to 2, system b of heads 2 to 4.


def systems(spark, sf):
    h = heads(spark, sf)
    part = lambda lo, name: M.predicted(E.mean_probabilities(h.where(F.col("h").between(lo, lo + 2)), ["id", "y"])).select("id", "y", F.col("pred").alias(f"pred_{name}"), F.col("correct").alias(name))
    return part(0, "a").join(part(2, "b").drop("y"), "id").withColumn("cluster", F.col("id") % 60)


_S = f"""WITH {HEADS_CTE}, sys AS (SELECT id, y, s, list(x ORDER BY k) AS p FROM (SELECT id, y, s, k, avg(p[k]) AS x FROM heads JOIN (VALUES ('a', 0), ('b', 2)) v(s, lo) ON h BETWEEN lo AND lo + 2, range(1, 11) t(k) GROUP BY ALL) GROUP BY ALL),
pair AS (SELECT id, any_value(y) AS y, id % 60 AS cluster, bool_or(s = 'a' AND list_position(p, list_max(p)) - 1 = y) AS a, bool_or(s = 'b' AND list_position(p, list_max(p)) - 1 = y) AS b FROM sys GROUP BY id)"""


@query("a26_mcnemar", f"""{_S}, n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE b AND NOT a) AS c, count(*) AS n FROM pair) SELECT b, c, (c - b) / n AS delta, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, least(b, c) + 1) t(i))) END AS p_value FROM n""", "delta p_value")
def mcnemar(spark, sf):
    return I.mcnemar(systems(spark, sf), "a", "b")


@query("a27_cluster_differences", f"{_S} SELECT cluster, CAST(sum(CAST(b AS INTEGER) - CAST(a AS INTEGER)) AS BIGINT) AS d, count(*) AS n FROM pair GROUP BY cluster")
def cluster_differences(spark, sf):
    return I.cluster_differences(systems(spark, sf), "cluster", "a", "b")


@query("a27_sign_flip_exact", f"""{_S.replace('WITH', 'WITH RECURSIVE', 1)}, d AS (SELECT row_number() OVER (ORDER BY g) AS i, d FROM (SELECT id % 14 AS g, CAST(sum(CAST(b AS INTEGER) - CAST(a AS INTEGER)) AS BIGINT) AS d FROM pair GROUP BY g) WHERE d <> 0),
w AS (SELECT 0 AS i, 0::BIGINT AS s UNION ALL SELECT w.i + 1, s + f * d FROM w JOIN d ON d.i = w.i + 1, (VALUES (1), (-1)) v(f)),
o AS (SELECT coalesce(sum(d), 0) AS o, count(*) AS k FROM d)
SELECT (SELECT o FROM o) / (SELECT count(*) FROM pair) AS delta, (SELECT k FROM o) AS informative, (SELECT count(*) FILTER (WHERE abs(s) >= abs((SELECT o FROM o))) / count(*) FROM w WHERE i = (SELECT k FROM o)) AS p_value""", "delta p_value")
def sign_flip_exact(spark, sf):
    return I.sign_flip(I.cluster_differences(systems(spark, sf).withColumn("cluster", F.col("id") % 14), "cluster", "a", "b"))


@query("a27_sign_flip_drawn")
def sign_flip_drawn(spark, sf):
    return I.sign_flip(I.cluster_differences(systems(spark, sf), "cluster", "a", "b"))


def design(spark, sf):
    ts = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    rows = systems(spark, sf).join(ts, "id").withColumn("ts", F.add_months("ts", (F.col("id") % 3).cast("int")).cast("timestamp"))
    return rows, I.cluster_design(rows, "cluster", "y", "ts")


_DESIGN = f"""{_S}, c AS (SELECT cluster, y, count(*) AS n, min(strftime(ts + to_months(CAST(id % 3 AS INTEGER)), '%Y-%m')) AS month FROM pair JOIN events ON event_id = id GROUP BY ALL),
des AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS n, arg_min(y, (-n, y)) AS label, min(month) AS month, '{{' || string_agg('"' || y || '":' || n, ',' ORDER BY y) || '}}' AS composition FROM c GROUP BY cluster)"""


@query("a28_cluster_design", f"{_DESIGN} SELECT *, 'utc_month=' || month || '|majority_label=' || label AS stratum FROM des")
def cluster_design(spark, sf):
    return design(spark, sf)[1]


@query("f23_strata", f"{_DESIGN} SELECT 'utc_month=' || month || '|majority_label=' || label AS stratum, count(*) AS clusters FROM des GROUP BY ALL")
def strata(spark, sf):
    return design(spark, sf)[1].groupBy("stratum").agg(F.count("*").alias("clusters"))


#: Resamples of every bootstrap.
DRAWS = 10_000


@query("a29_cluster_bootstrap")
def bootstrap(spark, sf):
    rows, plan = design(spark, sf)
    stats = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("long")).alias("a"), F.sum(F.col("b").cast("long")).alias("b"))
    draws = I.cluster_bootstrap(stats.join(plan.select("cluster", "stratum"), "cluster"), ["n", "a", "b"], DRAWS, 271828)
    return I.interval(draws.withColumn("delta", (F.col("b") - F.col("a")) / F.col("n")), "delta")


def predictions(spark, sf):
    """(cluster, y, a, b): the predictions of two systems."""
    pair = M.predicted(heads(spark, sf).where("h in (0, 1)")).groupBy("id", "y").agg(F.max(F.when(F.col("h") == 0, F.col("pred"))).alias("a"), F.max(F.when(F.col("h") == 1, F.col("pred"))).alias("b"))
    return pair.select((F.col("id") % 60).alias("cluster"), "y", "a", "b")


@query("a29_paired_bootstrap")
def paired_bootstrap(spark, sf):
    """Point difference, interval and tail shares for both metrics."""
    rows, plan = predictions(spark, sf), design(spark, sf)[1].select("cluster", "stratum")
    return I.paired_bootstrap(rows, plan, CLASSES, DRAWS, 271828)


_SIDES = f"{_H}, both_ AS (SELECT id, y, max(pred) FILTER (WHERE h = 0) AS a, max(pred) FILTER (WHERE h = 1) AS b FROM (SELECT id, y, h, list_position(p, list_max(p)) - 1 AS pred FROM heads) GROUP BY id, y)"


def _macro(side: str) -> str:
    return f"(SELECT avg(coalesce(2.0 * c / nullif(d + s, 0), 0)) FROM (SELECT (SELECT count(*) FROM both_ WHERE y = k AND {side} = k) AS c, (SELECT count(*) FROM both_ WHERE {side} = k) AS d, (SELECT count(*) FROM both_ WHERE y = k) AS s FROM range(0, 10) t(k)))"


@query("a29_point_differences", f"{_SIDES} SELECT 'accuracy' AS metric, (SELECT avg(CAST(b = y AS DOUBLE)) - avg(CAST(a = y AS DOUBLE)) FROM both_) AS delta UNION ALL SELECT 'macro_f1', {_macro('b')} - {_macro('a')}", "delta")
def point_differences(spark, sf):
    return I.metric_differences(I.paired_counts(predictions(spark, sf), CLASSES).agg(*[F.sum(c).alias(c) for c in I.paired_names(CLASSES)]), CLASSES).select(F.explode(F.map_from_arrays(F.array(F.lit("accuracy"), F.lit("macro_f1")), F.array("accuracy", "macro_f1"))).alias("metric", "delta"))


@query("a30_seed_sensitivity")
def seed_sensitivity(spark, sf):
    """Both systems have three training seeds: heads 0 to 2, heads 2 to 4."""
    _, plan = design(spark, sf)
    by_head = F.map_from_entries(F.collect_list(F.struct("h", "p")))
    tensor = lambda lo: F.array(*[F.element_at("heads", F.lit(h)) for h in range(lo, lo + 3)])
    rows = heads(spark, sf).groupBy("id", "y").agg(by_head.alias("heads")).select((F.col("id") % 60).alias("cluster"), "y", tensor(0).alias("a"), tensor(2).alias("b"))
    draws = I.seed_sensitivity(rows, plan, 3, DRAWS, 271828)
    return I.interval(draws.withColumn("delta", (F.col("b") - F.col("a")) / F.col("n")), "delta")


@query("v21_draws")
def draws(spark, sf):
    sizes = strata(spark, sf).collect()  # a row for each month and label
    return I.draw_table(spark, {r.stratum: r.clusters for r in sizes}, 20, 271828)


_PAIRS = f"""{_H}, k AS (SELECT id, h, list_position(p, list_max(p)) - 1 = y AS ok FROM heads), d AS (SELECT x.h AS left, z.h AS right, count(*) FILTER (WHERE x.ok AND NOT z.ok) AS b, count(*) FILTER (WHERE z.ok AND NOT x.ok) AS c FROM k x JOIN k z ON x.id = z.id AND x.h < z.h GROUP BY ALL),
f AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, least(b, c) + 1) t(i))) END AS p_value FROM d),
g AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY round(p_value, 9), "left", "right") + 1) * p_value) AS s FROM f)"""


@query("c14_pairwise_family", f"""{_PAIRS} SELECT "left", "right", b, c, p_value, max(s) OVER (ORDER BY round(p_value, 9), "left", "right") AS adjusted FROM g""", "p_value adjusted")
def pairwise_family(spark, sf):
    k = M.predicted(heads(spark, sf)).select("id", "h", "correct")
    j = k.select("id", F.col("h").alias("left"), F.col("correct").alias("x")).join(k.select("id", F.col("h").alias("right"), F.col("correct").alias("z")), "id").where(F.col("left") < F.col("right"))
    d = j.groupBy("left", "right").agg(F.count_if(F.col("x") & ~F.col("z")).alias("b"), F.count_if(~F.col("x") & F.col("z")).alias("c"))
    f = d.withColumn("p_value", I.binomial_two_sided(F.least("b", "c"), F.col("b") + F.col("c"))).withColumn("key", F.round("p_value", 9))
    by = W.orderBy("key", "left", "right")
    n = F.count("*").over(W.partitionBy())
    g = f.withColumn("s", F.least(F.lit(1.0), (n - F.row_number().over(by) + 1) * F.col("p_value")))
    return g.select("left", "right", "b", "c", "p_value", F.max("s").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("adjusted"))


@query("w5_holm", "SELECT i, p, max(s) OVER (ORDER BY p, i) AS adjusted FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, i) + 1) * p) AS s FROM (SELECT event_type AS i, round(avg(value) / 1000, 6) AS p FROM events GROUP BY event_type))", "p adjusted")
def holm(spark, sf):
    # A family of one comparison for each type of event, over all events.
    family = table(spark, sf, "events").groupBy(F.col("event_type").alias("i")).agg(F.round(F.avg("value") / 1000, 6).alias("p"))
    return I.holm(family, "p", ["i"])


# Leaderboards over heads.


def board(spark, sf):
    h = M.predicted(heads(spark, sf))
    return M.averages(M.class_report(h, CLASSES, ["h"]), ["h"]).select("h", "macro_f1", "accuracy").join(h.groupBy("h").agg(M.log_loss().alias("nll"), (F.count("*") * 8).alias("bytes")), "h")


_BOARD = f"""{_H}, m AS (SELECT id, y, h, p, list_position(p, list_max(p)) - 1 AS pred FROM heads),
rep AS (SELECT h, class, (SELECT count(*) FROM m WHERE m.h = g.h AND y = class) AS s, (SELECT count(*) FROM m WHERE m.h = g.h AND pred = class) AS d, (SELECT count(*) FROM m WHERE m.h = g.h AND y = class AND pred = class) AS tp FROM (SELECT DISTINCT h FROM heads) g, {_GRID}),
board AS (SELECT r.h, macro_f1, accuracy, nll, bytes FROM (SELECT h, avg(coalesce(2.0 * tp / nullif(s + d, 0), 0)) AS macro_f1, sum(tp) / sum(s) AS accuracy FROM rep GROUP BY h) r JOIN (SELECT h, avg(-ln(greatest(2.220446049250313e-16, p[y + 1]))) AS nll, count(*) * 8 AS bytes FROM m GROUP BY h) USING (h))"""


@query("o1_leaderboard", f"{_BOARD} SELECT h, macro_f1, accuracy, nll, bytes, CAST(row_number() OVER (ORDER BY macro_f1 DESC, nll, bytes, h) AS INTEGER) AS place FROM board", "macro_f1 accuracy nll")
def leaderboard(spark, sf):
    # One row for each candidate.
    by = W.orderBy(F.desc_nulls_last("macro_f1"), "nll", "bytes", "h")
    return board(spark, sf).withColumn("place", F.row_number().over(by))


@query("o2_top", f"{_BOARD} SELECT h, macro_f1 FROM board ORDER BY macro_f1 DESC, nll, bytes, h LIMIT 1", "macro_f1")
def top(spark, sf):
    return board(spark, sf).orderBy(F.desc_nulls_last("macro_f1"), "nll", "bytes", "h").limit(1).select("h", "macro_f1")


@query("o9_best_two", f"{_BOARD} SELECT h, accuracy FROM board ORDER BY accuracy DESC, h LIMIT 2", "accuracy")
def best_two(spark, sf):
    return board(spark, sf).orderBy(F.desc("accuracy"), "h").limit(2).select("h", "accuracy")


@query("w6_global_rank", f"{_BOARD} SELECT h, place FROM (SELECT h, CAST(row_number() OVER (ORDER BY macro_f1 DESC, nll, bytes, h) AS INTEGER) AS place FROM board) WHERE h % 2 = 0")
def global_rank(spark, sf):
    return leaderboard(spark, sf).select("h", "place").where("h % 2 = 0")


@query("o10_argmax", f"{_P} SELECT id, CAST(pred AS INTEGER) AS pred FROM pred")
def argmax(spark, sf):
    return head(spark, sf).select("id", "pred")


@query("a22_seed_spread", f"{_BOARD} SELECT avg(macro_f1) AS mean, coalesce(stddev_samp(macro_f1), 0) AS spread, count(*) AS seeds FROM board", "mean spread")
def seed_spread(spark, sf):
    return board(spark, sf).agg(F.avg("macro_f1").alias("mean"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("spread"), F.count("*").alias("seeds"))


_FUSED = f"""{_H}, g AS (SELECT i / 10.0::DOUBLE AS w FROM range(0, 11) t(i)), f AS (SELECT a.id, a.y, w, list_transform(range(1, 11), lambda k: w * a.p[k] + (1 - w) * b.p[k]) AS p FROM heads a JOIN heads b ON a.id = b.id AND a.h = 0 AND b.h = 1, g)"""


def fused(spark, sf):
    h = heads(spark, sf)
    j = h.where("h = 0").select("id", "y", F.col("p").alias("a")).join(h.where("h = 1").select("id", F.col("p").alias("b")), "id")
    grid = F.array(*[F.lit(i / 10) for i in range(11)])
    return j.select("id", "y", F.explode(grid).alias("w"), "a", "b").select("id", "y", "w", V.late_fusion(F.col("a"), F.col("b"), F.col("w")).alias("p"))


@query("v3_late_fusion", f"{_FUSED} SELECT w, avg(CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM f GROUP BY w", "accuracy")
def late_fusion(spark, sf):
    return M.predicted(fused(spark, sf)).groupBy("w").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


@query("o11_best_weight", f"{_FUSED}, s AS (SELECT w, count(*) FILTER (WHERE list_position(p, list_max(p)) - 1 = y) AS right FROM f GROUP BY w) SELECT w FROM s ORDER BY \"right\" DESC, abs(w - 0.5), w LIMIT 1", "w")
def best_weight(spark, sf):
    s = M.predicted(fused(spark, sf)).groupBy("w").agg(F.count_if("correct").alias("right"))
    return s.agg(F.min_by("w", F.struct(-F.col("right"), F.abs(F.col("w") - 0.5), F.col("w"))).alias("w"))


@query("c10_validation_board", f"{_BOARD}, e AS (SELECT avg(macro_f1) AS mean_f1, coalesce(stddev_samp(macro_f1), 0) AS std_f1, avg(nll) AS mean_nll, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM board) SELECT * FROM e", "mean_f1 std_f1 mean_nll")
def validation_board(spark, sf):
    return board(spark, sf).agg(F.avg("macro_f1").alias("mean_f1"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("std_f1"), F.avg("nll").alias("mean_nll"), F.sum("bytes").alias("total_bytes"))


@query("a45_sizes", f"{_BOARD} SELECT CAST(sum(bytes) AS BIGINT) AS bytes FROM board")
def sizes(spark, sf):
    return board(spark, sf).agg(F.sum("bytes").alias("bytes"))


@query("c16_recheck", f"{_BOARD} SELECT count(*) AS rows, 0::BIGINT AS differ FROM board")
def recheck(spark, sf):
    a = board(spark, sf)
    b = board(spark, sf).select("h", F.col("macro_f1").alias("f2"), F.col("nll").alias("n2"))
    same = V.same_number(F.col("macro_f1"), F.col("f2"), 1e-12) & V.same_number(F.col("nll"), F.col("n2"), 1e-12)
    return a.join(b, "h", "full_outer").agg(F.count("*").alias("rows"), F.count_if(~same).alias("differ"))


@query("v15_tolerance", "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT coalesce((a IS NULL AND b IS NULL) OR abs(a - b) <= 1e-9, false)) AS differ FROM (SELECT value AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value + CASE WHEN event_id % 5 = 0 THEN 1e-6 ELSE 0 END END AS b FROM events)")
def tolerance(spark, sf):
    e = table(spark, sf, "events").select(F.col("value").alias("a"), F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value") + F.when(F.col("event_id") % 5 == 0, 1e-6).otherwise(0.0)).alias("b"))
    return e.agg(F.count("*").alias("rows"), F.count_if(~V.same_number(F.col("a"), F.col("b"), 1e-9)).alias("differ"))


@query("a42_disagreement", f"{_H}, k AS (SELECT id, h, list_position(p, list_max(p)) - 1 = y AS ok FROM heads) SELECT count(*) FILTER (WHERE NOT a.ok AND b.ok) AS fixed, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS broken FROM k a JOIN k b ON a.id = b.id AND a.h = 0 AND b.h = 1")
def disagreement(spark, sf):
    k = M.predicted(heads(spark, sf)).select("id", "h", "correct")
    j = k.where("h = 0").select("id", F.col("correct").alias("a")).join(k.where("h = 1").select("id", F.col("correct").alias("b")), "id")
    return j.agg(F.count_if(~F.col("a") & F.col("b")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"))


@query("u6_wide_long", f"{_H} SELECT id, CAST(k AS INTEGER) AS class, p[k + 1] AS value FROM heads, range(0, 3) t(k) WHERE h = 0", "value")
def wide_long(spark, sf):
    wide = head(spark, sf).select("id", *[F.col("p")[k].alias(f"prob_{k}") for k in range(3)])
    return wide.unpivot("id", [f"prob_{k}" for k in range(3)], "class", "value").withColumn("class", F.substring_index("class", "_", -1).cast("int"))


@query("j24_grid", f"{_H}, o AS (SELECT h, count(*) AS n FROM heads WHERE NOT (h = 3) GROUP BY h) SELECT CAST(g.h AS INTEGER) AS h, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM range(0, 5) g(h) LEFT JOIN o ON o.h = g.h")
def grid(spark, sf):
    seen = heads(spark, sf).where("h != 3").groupBy("h").agg(F.count("*").alias("n"))
    return spark.range(5).select(F.col("id").cast("int").alias("h")).join(seen, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


@query("j22_product", f"{_H} SELECT candidate, seed FROM (SELECT DISTINCT h AS candidate FROM heads), (SELECT DISTINCT label AS seed FROM embeddings)")
def product(spark, sf):
    """Every candidate (a head) with every seed (a label), as arrays of what there is: both are short lists at any scale."""
    sets = heads(spark, sf).agg(F.collect_set("h").alias("c"), F.collect_set("y").alias("s"))
    return sets.select(F.explode("c").alias("candidate"), "s").select("candidate", F.explode("s").alias("seed"))


@query("c15_arms", f"{_H} SELECT h % 2 AS arm, count(*) AS rows, count(DISTINCT id) AS ids, count(*) = count(DISTINCT (id, h)) AS unique_rows FROM heads GROUP BY ALL")
def arms(spark, sf):
    return heads(spark, sf).groupBy((F.col("h") % 2).alias("arm")).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), (F.count("*") == F.countDistinct("id", "h")).alias("unique_rows"))


@query("u1_union", "SELECT 'a' AS arm, label AS y, NULL::BIGINT AS extra FROM embeddings WHERE vec_id < 100 UNION ALL SELECT 'b', label, vec_id FROM embeddings WHERE vec_id >= 100")
def union(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.where("vec_id < 100").select(F.lit("a").alias("arm"), F.col("label").alias("y"))
    b = e.where("vec_id >= 100").select(F.lit("b").alias("arm"), F.col("label").alias("y"), F.col("vec_id").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u7_insert", "SELECT 'early' AS candidate, vec_id, label FROM embeddings")
def insert(spark, sf):
    return table(spark, sf, "embeddings").select(F.lit("early").alias("candidate"), "vec_id", "label")
