"""Queries that run as streams: a table arrives in turns, and the query goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.plans.registry import query, table
from tallymill.plans.scans import _folder
from tallymill.plans.store import _REP, _STATE, _URLS, _VER, reports, urls, versions
from tallymill.streaming import stateful as S
from tallymill.streaming.live import LiveTable, TopView

TURNS = 3


@query("t6_stream_changes", """WITH seen AS (SELECT user_id AS id, event_id AS version, event_type AS status, lag(event_type) OVER w AS old_status, row_number() OVER w AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT id, version, CASE WHEN turn = 1 THEN 'insert' ELSE 'update' END AS kind, old_status, status AS new_status FROM seen WHERE turn = 1 OR status IS DISTINCT FROM old_status""")
def stream_changes(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"))
    return S.in_turns(v, F.col("version"), TURNS, _folder(spark, "changes"), lambda s: S.changes(s, "id", ["version"], ["status"]))


@query("q9_stream_evidence", f"WITH {_URLS} SELECT id AS report_id, kind, 'report-images' AS bucket, 'u/' || id || '.jpg' AS object_path FROM urls, (VALUES ('initial'), ('resolution')) v(kind) WHERE id % 4 <> 3 AND (kind = 'initial' OR id % 2 = 0)")
def stream_evidence(spark, sf):
    # Every report comes twice, and the second time has nothing new.
    u = urls(spark, sf).select("id", F.col("url").alias("image_url"), F.when(F.col("id") % 2 == 0, F.col("url")).alias("resolution_url"))
    twice = u.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.in_turns(twice, F.col("turn"), 2, _folder(spark, "evidence"), S.evidence_events)


@query("q10_stream_assignments", f"WITH {_VER}, c AS (SELECT *, lag(agency) OVER w AS before, row_number() OVER w AS turn FROM ver WINDOW w AS (PARTITION BY report ORDER BY version)), d AS (SELECT *, lead(version) OVER (PARTITION BY report ORDER BY version) IS NULL AS newest FROM c WHERE turn = 1 OR before IS DISTINCT FROM agency) SELECT report, version, agency, CASE WHEN newest THEN 'active' ELSE 'superseded' END AS status FROM d WHERE agency IS NOT NULL")
def stream_assignments(spark, sf):
    v = versions(spark, sf)
    events = S.in_turns(v, F.col("version"), TURNS, _folder(spark, "assignments"), lambda s: S.assignment_events(s, "report", "version", "agency"))
    return S.assignment_state(events, "report", "version", "agency")


@query("s19_expiring_lookups", """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, ts, n, FALSE AS hit, ts + INTERVAL 3540 SECOND AS expires FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.n, r.expires > o.ts, CASE WHEN r.expires > o.ts THEN r.expires ELSE o.ts + INTERVAL 3540 SECOND END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, hit, epoch_us(expires) AS expires FROM r""")
def expiring_lookups(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = S.in_turns(e, F.unix_micros("ts"), TURNS, _folder(spark, "lookups"), lambda s: S.expiring_lookups(s, "user_id", "ts", "event_id"))
    return out.select("user_id", "event_id", "hit", F.unix_micros("expires").alias("expires"))


@query("t3_live_lists", f"""WITH {_REP}, {_STATE} SELECT 'all' AS list, id, status FROM (SELECT * FROM st ORDER BY created_at DESC, id LIMIT 200)
UNION ALL SELECT 'user', id, status FROM (SELECT * FROM st WHERE user_id = 'u7' ORDER BY created_at DESC, id LIMIT 200)
UNION ALL SELECT 'category', id, status FROM (SELECT * FROM st WHERE category = 'kelurahan' AND status <> 'rejected' ORDER BY created_at DESC, id LIMIT 200)
UNION ALL SELECT 'history', id, status FROM (SELECT * FROM st WHERE user_id = 'u3' ORDER BY created_at, id LIMIT 100)""")
def live_lists(spark, sf):
    """The newest 200 rows of all, of one user and of one category, and the oldest 100 of another user, kept from batch to batch while
    reports change."""
    folder, schema = _folder(spark, "lists"), "id long, sequence long, user_id string, category string, status string, created_at timestamp"
    r = reports(spark, sf).select((F.col("id") % 300).alias("id"), F.col("id").alias("sequence"), "user_id", "category", "status", F.col("created_at").cast("timestamp").alias("created_at"))
    live = LiveTable(spark, f"{folder}/state", schema, "id", ["created_at", "sequence"])
    views = {
        "all": TopView(live, f"{folder}/all"),
        "user": TopView(live, f"{folder}/user", lambda: F.col("user_id") == "u7"),
        "category": TopView(live, f"{folder}/category", lambda: (F.col("category") == "kelurahan") & (F.col("status") != "rejected")),
        "history": TopView(live, f"{folder}/history", lambda: F.col("user_id") == "u3", limit=100, ascending=True),
    }
    for turn in range(TURNS):
        r.where(F.col("sequence") % TURNS == turn).write.mode("append").parquet(f"{folder}/source")
        live.follow(spark.readStream.schema(schema).parquet(f"{folder}/source"), f"{folder}/checkpoint", views=list(views.values())).awaitTermination()
    lists = [v.read().select(F.lit(name).alias("list"), "id", "status") for name, v in views.items()]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])
