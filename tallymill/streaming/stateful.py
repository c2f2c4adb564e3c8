"""Operators with a state for each key, in the state store: row triggers, the projections they keep, and lookups that expire.

A key's rows come in batches; within a batch they are taken in order, across batches versions at or before the newest seen are late and
change nothing. State is one row for each key (and one for each piece of evidence), so a batch reads and writes only the keys it has. A
query that starts again from its checkpoint goes on with the state it had. The rows of one key in one batch are sorted in a task's
memory: bound a batch by the source's own options (`maxFilesPerTrigger` and the like).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from tallymill.functions import text as X

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(df: DataFrame, names: list[str], renamed: dict[str, str] | None = None) -> list[T.StructField]:
    return [T.StructField((renamed or {}).get(n, n), df.schema[n].dataType) for n in names]


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Changes(StatefulProcessor):
    """Emits what a trigger on each row would see. State: the newest version and its watched values."""

    def __init__(self, key: str, version: list[str], watched: list[str], state: T.StructType, out: list[str]) -> None:
        self.key, self.version, self.watched, self.state, self.out = key, version, watched, state, out

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = len(self.version)
        last, before = (tuple(self.last.get()) if self.last.exists() else None), None
        for r in sorted((tuple(r[c] for c in (*self.version, *self.watched)) for r in rows), key=lambda r: r[:n]):
            if last is not None and r[:n] <= last[:n]:
                continue
            before, last = last, r
            if before is None or before[n:] != r[n:]:
                old = before[n:] if before else (None,) * len(self.watched)
                yield Row(**dict(zip(self.out, (key[0], *r[:n], "update" if before else "insert", *old, *r[n:]), strict=True)))
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, version: list[str], watched: list[str]) -> DataFrame:
    """(key, version, kind: insert or update, old_ and new_ values) of each row that is new or differs in a watched column from the
    version before it. Nulls are values here."""
    _ready(stream.sparkSession)
    state = T.StructType(_struct(stream, [*version, *watched]))
    fields = [*_struct(stream, [key, *version]), T.StructField("kind", T.StringType())]
    for side in ("old", "new"):
        fields += _struct(stream, watched, {c: f"{side}_{c}" for c in watched})
    out = T.StructType(fields)
    p = _Changes(key, version, watched, state, out.names)
    return stream.select(key, *version, *watched).groupBy(key).transformWithState(p, out, "Append", "None")


class _Assignments(StatefulProcessor):
    """Emits a row's new assignment as active, and the one before as superseded. State: newest version, its agency, the active version."""

    STATE = "version long, agency string, active long"

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, agency, active = tuple(self.held.get()) if self.held.exists() else (None, None, None)
        for v, a in sorted(((r[1], r[2]) for r in rows), key=lambda r: r[0]):
            if version is not None and v <= version:
                continue
            if version is None or a != agency:
                if active is not None:
                    yield Row(**dict(zip(self.names, (key[0], active, agency, "superseded"), strict=True)))
                active = None if a is None else v
                if a is not None:
                    yield Row(**dict(zip(self.names, (key[0], v, a, "active"), strict=True)))
            version, agency = v, a
        if version is not None:
            self.held.update((version, agency, active))

    def close(self) -> None:
        pass


def assignment_events(stream: DataFrame, key: str, order: str, agency: str) -> DataFrame:
    """(key, order, agency, status): an `active` row where a version changes the assignment, a `superseded` one for the assignment that
    ends there. A blank agency clears: it ends the assignment before and starts none."""
    _ready(stream.sparkSession)
    out = T.StructType([*_struct(stream, [key]), T.StructField(order, T.LongType()), T.StructField(agency, T.StringType()), T.StructField("status", T.StringType())])
    rows = stream.select(key, F.col(order).cast("long").alias(order), X.blank_to_null(F.col(agency)).alias(agency))
    return rows.groupBy(key).transformWithState(_Assignments(out.names), out, "Append", "None")


def assignment_state(events: DataFrame, key: str, order: str, agency: str) -> DataFrame:
    """The assignments as they are after these events: superseded ones stay so."""
    return events.groupBy(key, order, agency).agg(F.max("status").alias("status"))  # 'superseded' is above 'active'


class _Evidence(StatefulProcessor):
    """Emits each piece of evidence of a row once. State: the pieces that were there, by kind and path."""

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "kind string, object_path string", "bucket string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for piece in sorted({(r.kind, r.object_path, r.bucket) for r in rows}):
            at = piece[:2]
            if not self.seen.containsKey(at):
                self.seen.updateValue(at, (piece[2],))
                yield Row(report_id=key[0], kind=piece[0], bucket=piece[2], object_path=piece[1])

    def close(self) -> None:
        pass


def evidence_events(stream: DataFrame) -> DataFrame:
    """(report_id, kind, bucket, object_path): each piece of evidence of a report when it is first seen. stream: id, image_url, resolution_url.

    Addresses are parsed before the state, by column functions.
    """
    _ready(stream.sparkSession)
    pieces = F.array(F.struct(F.lit("initial").alias("kind"), F.col("image_url").alias("url")), F.struct(F.lit("resolution").alias("kind"), F.col("resolution_url").alias("url")))
    refs = stream.select(F.col("id").alias("report_id"), F.inline(pieces)).where(X.blank_to_null(F.col("url")).isNotNull()).select("report_id", "kind", X.storage_ref(F.col("url")).alias("r")).where("r is not null")
    rows = refs.select("report_id", "kind", "r.bucket", "r.object_path")
    out = T.StructType([*_struct(rows, ["report_id"]), *[T.StructField(n, T.StringType()) for n in ("kind", "bucket", "object_path")]])
    return rows.groupBy("report_id").transformWithState(_Evidence(), out, "Append", "None")


class _Lookup(StatefulProcessor):
    """Answers lookups from what an earlier one fetched, until that expires. Times are microseconds. State: the time of expiry; a timer
    takes it away."""

    def __init__(self, seconds: int, names: list[str]) -> None:
        self.life, self.names = seconds * 1_000_000, names

    def init(self, handle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "micros long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until = before = self.expiry.get()[0] if self.expiry.exists() else None
        for at, mark in sorted((r["micros"], r["mark"]) for r in rows):
            hit = until is not None and until > at
            if not hit:
                until = at + self.life
            yield Row(**dict(zip(self.names, (key[0], mark, at, hit, until), strict=True)))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            self.expiry.update((until,))
            self.handle.registerTimer(_millis(until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.expiry.exists() and _millis(self.expiry.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.expiry.clear()
        return iter(())

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first whole millisecond at or after a time."""
    return -(-micros // 1000)


def expiring_lookups(stream: DataFrame, key: str, at: str, mark: str, seconds: int = 3540, late: str = "1 hour") -> DataFrame:
    """(key, mark, at, hit, expires): whether each lookup finds what an earlier one of its key fetched, and until when that holds.

    A lookup without a live entry fetches one, for `seconds` from then; a hit does not prolong it. Times are the rows' own: rows of a batch are
    taken in their order, and expired entries leave the state once the watermark (`late` behind the newest row) has passed them.
    mark: a number or text that tells lookups of one time apart.
    """
    _ready(stream.sparkSession)
    time = F.col(at).cast("timestamp")
    out = T.StructType([*_struct(stream, [key, mark]), T.StructField("at", T.LongType()), T.StructField("hit", T.BooleanType()), T.StructField("until", T.LongType())])
    rows = stream.select(F.col(key), F.col(mark).alias("mark"), time.alias("time"), F.unix_micros(time).alias("micros")).withWatermark("time", late)
    got = rows.groupBy(key).transformWithState(_Lookup(seconds, out.names), out, "Append", "EventTime")
    return got.select(key, mark, F.timestamp_micros("at").alias(at), "hit", F.timestamp_micros("until").alias("expires"))


def run_to_end(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Takes all that a stream has now, appends it to a Parquet folder, and stops."""
    q: StreamingQuery = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def in_turns(df: DataFrame, order: Column, turns: int, folder: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replays a table as a stream: its rows arrive in `turns` ranges of `order` (a whole number), and a query over them is started anew for each,
    from the checkpoint of the one before. Returns what came out."""
    spark = df.sparkSession
    ordered = df.withColumn("replay_order", order)
    cuts = ordered.agg(F.percentile_approx("replay_order", [i / turns for i in range(1, turns)], 10_000).alias("c")).first().c or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else F.col("replay_order") > low
        inside = inside if high is None else inside & (F.col("replay_order") <= high)
        if low is None:
            inside = inside | F.col("replay_order").isNull()
        ordered.where(inside).drop("replay_order").write.mode("append").parquet(f"{folder}/source")
        run_to_end(operator(spark.readStream.schema(df.schema).parquet(f"{folder}/source")), f"{folder}/sink", f"{folder}/checkpoint")
    return spark.read.schema(operator(df.limit(0)).schema).parquet(f"{folder}/sink")
