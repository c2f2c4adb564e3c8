"""The operational store as views and batch changes: access, lifecycle, projections, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.functions import vectors as V

# The lifecycle's steps and the feed's constants.
TRANSITIONS = [("submitted", "verified"), ("submitted", "rejected"), ("verified", "in_progress"), ("verified", "rejected"), ("in_progress", "resolved")]
STATUSES = ["submitted", "verified", "in_progress", "resolved", "rejected"]
NOBODY, SOMEONE = "00000000-0000-0000-0000-000000000000", "Warga"
HIDDEN, AREA = "Detail laporan hanya tersedia bagi pelapor dan petugas berwenang.", "Jakarta (lokasi diperkirakan)"


def clamped(n: int | None, most: int = 200) -> int:
    return max(1, min(most if n is None else n, most))


def coarse(x: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(x.cast("decimal(18,10)"), 2).cast("double")


def on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def can_see(user: Column, category: Column, actor: str, role: str, agency: str | None) -> Column:
    """Owners, the agency's admins and super admins."""
    if role == "super_admin":
        return F.lit(True)
    own = user == actor
    return own | (category == agency) if role == "agency_admin" and agency is not None else own


def scope(reports: DataFrame, actor: str, role: str, agency: str | None) -> DataFrame:
    """The list that a role works on: all, its agency's or its own."""
    if role == "super_admin":
        return reports
    return reports.where(F.col("category") == agency) if role == "agency_admin" else reports.where(F.col("user_id") == actor)


def public_rows(reports: DataFrame) -> DataFrame:
    return reports.where((F.col("visibility") == "public") & (F.col("status") != "rejected") & on_earth(F.col("latitude"), F.col("longitude")))


def redacted(reports: DataFrame) -> DataFrame:
    """Public columns only: constants for persons, two decimals for places."""
    return reports.select(
        "id",
        F.lit(NOBODY).alias("user_id"),
        F.lit(SOMEONE).alias("reporter_name"),
        "category",
        F.col("category").alias("ai_prediction"),
        F.lit(HIDDEN).alias("description"),
        coarse(F.col("latitude")).alias("latitude"),
        coarse(F.col("longitude")).alias("longitude"),
        F.lit(AREA).alias("address"),
        "status",
        "created_at",
    )


def public_feed(reports: DataFrame, limit: int | None = None) -> DataFrame:
    return redacted(public_rows(reports)).orderBy(F.desc("created_at"), "id").limit(clamped(limit))


def detail(reports: DataFrame, actor: str, role: str, agency: str | None) -> DataFrame:
    """(id, body): the full row for those who may see it, the public one for others, null where that is hidden too."""
    full = F.to_json(F.struct("id", "category", "status", "description"))
    public = F.to_json(F.struct("id", "category", "status", F.lit(HIDDEN).alias("description")))
    shown = (F.col("visibility") == "public") & (F.col("status") != "rejected") & on_earth(F.col("latitude"), F.col("longitude"))
    return reports.select("id", F.when(can_see(F.col("user_id"), F.col("category"), actor, role, agency), full).when(shown, public).alias("body"))


def allowed(old: Column, new: Column, category: Column | None = None, wanted: Column | None = None) -> Column:
    """Whether a status may follow another; a verified report may also change its category."""
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    ok = F.array_contains(steps, F.concat(old, F.lit(">"), new))
    if category is None or wanted is None:
        return ok
    return ok | ((old == "verified") & (new == "verified") & wanted.isNotNull() & ~wanted.eqNullSafe(category))


def status_change(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Reports after one change each (id, new_status, new_category, note, photo): a new category clears the assignment and asks
    for review. Changes that are not allowed leave the report as it is."""
    j = reports.join(changes, "id", "left")
    ok = F.coalesce(allowed(F.col("status"), F.col("new_status"), F.col("category"), F.col("new_category")), F.lit(False))
    ok = ok & ~((F.col("new_status") == "resolved") & T.blank_to_null(F.col("photo")).isNull()) & ~((F.col("new_status") == "rejected") & T.blank_to_null(F.col("note")).isNull())
    target = F.when(ok, F.coalesce("new_category", "category")).otherwise(F.col("category"))
    moved = ~target.eqNullSafe(F.col("category"))
    return j.select(
        "id",
        F.when(ok, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        target.alias("category"),
        F.when(moved, V.appended_once(F.col("review_reasons"), "manual_agency_reassignment")).otherwise(F.col("review_reasons")).alias("review_reasons"),
        F.when(~moved, F.col("assigned_agency_id")).alias("assigned_agency_id"),
        F.when(ok & (F.col("new_status") == "rejected"), F.col("note")).alias("rejection_reason"),
        ok.alias("changed"),
    )


def submitted(incoming: DataFrame) -> DataFrame:
    """(id, overridden, review_required, review_reasons, accepted) of new reports: a category other than the predicted one is an override."""
    over = F.col("prediction") != F.col("category")
    need = F.coalesce("review_required", F.lit(False)) | over
    with_override = V.appended_once(F.col("reasons"), "user_category_override")
    listed = F.when(over, with_override).when(need & (F.size("reasons") == 0), F.array(F.lit("client_review_required"))).when(need, F.col("reasons")).otherwise(F.array().cast("array<string>"))
    good = F.length(F.trim("description")).between(10, 4000) & on_earth(F.col("latitude"), F.col("longitude")) & F.col("confidence").between(0, 1)
    return incoming.select("id", over.alias("overridden"), need.alias("review_required"), listed.alias("review_reasons"), good.alias("accepted"))


def attested(evidence: DataFrame, releases: DataFrame, labels: list[str]) -> DataFrame:
    """(id, release_found, probabilities_ok, prediction): evidence matched on all release keys, its probabilities checked."""
    keys = ["manifest", "class_map", "model_name", "model_version", "method"]
    known = releases.where("enabled").select(*keys, F.lit(True).alias("found"))
    p = F.col("probabilities")
    values = F.transform(F.array(*[F.lit(x) for x in labels]), lambda k: F.try_element_at(p, k))
    exact = (F.size(F.map_keys(p)) == len(labels)) & F.forall(values, lambda x: x.isNotNull())
    ok = exact & F.forall(values, lambda x: x.between(0, 1)) & (F.abs(V.total(values) - 1) <= 1e-6) & (F.abs(F.col("confidence") - F.array_max(values)) <= 1e-6)
    return evidence.join(known, keys, "left").select("id", F.coalesce("found", F.lit(False)).alias("release_found"), F.coalesce(ok, F.lit(False)).alias("probabilities_ok"), F.element_at(F.array(*[F.lit(x) for x in labels]), V.argmax(values) + 1).alias("prediction"))


def evidence_rows(changes: DataFrame) -> DataFrame:
    """(report_id, kind, bucket, object_path): up to two pieces of evidence of each report version, each once."""
    pieces = F.array(F.struct(F.lit("initial").alias("kind"), F.col("image_url").alias("url")), F.struct(F.lit("resolution").alias("kind"), F.col("resolution_url").alias("url")))
    rows = changes.select(F.col("id").alias("report_id"), F.inline(pieces)).where(T.blank_to_null(F.col("url")).isNotNull())
    refs = rows.select("report_id", "kind", T.storage_ref(F.col("url")).alias("r")).where("r is not null")
    return refs.select("report_id", "kind", "r.bucket", "r.object_path").dropDuplicates(["report_id", "kind", "object_path"])


def assignment_history(versions: DataFrame, key: str, order: str, agency: str) -> DataFrame:
    """(key, order, agency, status): a row for each version that changes the assignment; only the newest can be active.

    Clearing an assignment supersedes it and adds no row.
    """
    by = W.partitionBy(key).orderBy(order)
    changed = versions.withColumns({"before": F.lag(agency).over(by), "turn": F.row_number().over(by)}).where((F.col("turn") == 1) | ~F.col("before").eqNullSafe(F.col(agency)))
    last = changed.withColumn("newest", F.lead(order).over(by).isNull())
    return last.where(T.blank_to_null(F.col(agency)).isNotNull()).select(key, order, agency, F.when(F.col("newest"), "active").otherwise("superseded").alias("status"))


def upserted(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows win; others stay."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def inserted(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows of new keys are added; others are ignored."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def updated_from(current: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE ... FROM: the column takes the source's value where the source has the key."""
    hit = source.select(key, F.col(column).alias("new_value"), F.lit(True).alias("hit"))
    return current.join(hit, key, "left").withColumn(column, F.when(F.col("hit"), F.col("new_value")).otherwise(F.col(column))).drop("new_value", "hit")


def stamped(current: DataFrame, incoming: DataFrame, key: str, now: Column) -> DataFrame:
    """upserted, with created_at and updated_at: a new row gets now for both where created_at is null, an incoming row of a known key
    keeps the first created_at and is touched now. A key that repeats in incoming is touched in each of its rows."""
    first = current.groupBy(key).agg(F.min("created_at").alias("first_created"))
    touched = incoming.join(first, key, "left").withColumns({"created_at": F.coalesce("first_created", "created_at", now), "updated_at": now}).drop("first_created")
    return upserted(current, touched, key)
