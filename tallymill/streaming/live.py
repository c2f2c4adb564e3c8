"""Live lists: a stream of row versions kept as the newest version of each key.

Each micro-batch is reduced to its newest row of a key (by version, then sequence), compared with the stored rows of its own keys, and what
is newer is written as a further file of its bucket; nothing else is rewritten. A bucket's files are made one when what came after the
first outgrows it, so each stored row is rewritten a bounded number of times on the whole. What is written is then pointed to, so a
repeated batch gives the same state, and what no pointer names goes one batch later. Late versions never replace newer ones. Lists are
views over the state: filters and limits come after it, so a row that leaves a filter leaves the list; TopView keeps such a list
without reading the state for each batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def newest(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    return df.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(v) for v in version]))).where("turn = 1").drop("turn")


def row_changes(state: DataFrame, batch: DataFrame, key: str, version: list[str], watched: list[str]) -> DataFrame:
    """What a trigger on each row would see: batch rows that are new or differ in a watched column from the version before, which may be
    in the state or in the batch. (key, version, kind: insert or update, old_ and new_ values). Nulls are values here. Versions at or
    before the state's are late and change nothing.
    """
    names = [key, *version, *watched]
    there = state.select(*names, F.lit(True).alias("stored"))
    both = there.unionByName(batch.select(*names, F.lit(False).alias("stored")))
    by = W.partitionBy(key).orderBy(*version, "stored")  # a version that is stored comes after its copies, which are late
    seen = both.withColumns({f"old_{c}": F.lag(c).over(by) for c in watched} | {"turn": F.row_number().over(by), "known": F.max("stored").over(W.partitionBy(key)), "late": ~F.max("stored").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))})
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    fresh = seen.where(~F.col("stored") & ~(F.col("known") & F.col("late")) & ((F.col("turn") == 1) | differs))
    kind = F.when(F.col("turn") == 1, "insert").otherwise("update")
    return fresh.select(key, *version, kind.alias("kind"), *[f"old_{c}" for c in watched], *[F.col(c).alias(f"new_{c}") for c in watched])


class Pointed:
    """A folder whose content is named by a pointer: written whole, then named; the highest number counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _pointer(self) -> dict:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.getPath().getName().startswith("pointer-")]
        if not names:
            return {"batch": -1}
        last = max(names, key=lambda n: int(n.partition("-")[2]))
        return json.loads(self.spark.read.text(f"{self.path}/{last}", wholetext=True).first().value)

    def _point(self, pointer: dict, before: dict) -> None:
        """Names what is there now. Readers of the pointer before may still read what it named; what it no longer named goes."""
        part, name = self._at(f"_part-{pointer['batch']}"), self._at(f"pointer-{pointer['batch']}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        self._fs.rename(part, name)
        for unused in before.get("unused", []):
            self._fs.delete(self._at(unused), True)
        self._fs.delete(self._at(f"pointer-{before['batch']}"), False)


class LiveTable(Pointed):
    """The newest row of each key under a shared folder, in buckets of the key's hash.

    A bucket has a first file and what came after it. Choose `buckets` so that a bucket's rows fit a task; a batch writes the rows it
    changes, whatever their number, and compacts buckets whose later rows outnumber the first.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: list[str], buckets: int = 64) -> None:
        super().__init__(spark, path)
        self.schema, self.key, self.version, self.buckets = schema, key, version, buckets

    def _bucket(self):
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def _rows(self, at: dict, buckets=None) -> DataFrame:
        """All stored versions in these buckets. at: for each bucket [[batch, rows], ...]."""
        paths = [f"{self.path}/batch-{n}/bucket={b}" for b, files in at.items() if buckets is None or int(b) in buckets for n, _ in files]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        at = self._pointer().get("at", {})
        single = {b: f for b, f in at.items() if len(f) == 1}
        several = {b: f for b, f in at.items() if len(f) > 1}
        plain = self._rows(single)
        return plain.unionByName(newest(self._rows(several), self.key, self.version)) if several else plain

    def merge(self, batch: DataFrame, number: int) -> DataFrame | None:
        """Stores a batch and returns its rows that became the newest of their keys; None if this batch, or a later one, was there."""
        now = self._pointer()
        if number <= now["batch"]:
            return None
        at = now.get("at", {})
        names = [f.name for f in T.StructType.fromDDL(self.schema)]
        rows = newest(batch.select(*names), self.key, self.version).persist()
        try:
            coming = {r.b: r.n for r in rows.groupBy(self._bucket().alias("b")).agg(F.count("*").alias("n")).collect()}  # at most as many as buckets
            there = newest(self._rows(at, coming).join(rows.select(self.key), self.key, "left_semi"), self.key, self.version)
            turn = F.struct(*self.version)
            old = there.select(F.col(self.key).alias("there_key"), turn.alias("there_turn"))
            won = rows.join(old, F.col(self.key) == F.col("there_key"), "left").where(F.col("there_turn").isNull() | (turn > F.col("there_turn"))).select(*names)
            full = {b for b, n in coming.items() if (files := at.get(str(b))) and n + sum(m for _, m in files[1:]) > files[0][1]}
            path = f"{self.path}/batch-{number}"
            kept = won.where(~self._bucket().isin(*full)) if full else won
            if full:  # made one file each
                kept = kept.unionByName(newest(self._rows(at, full).unionByName(won.where(self._bucket().isin(*full))), self.key, self.version))
            kept.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = {}
            if coming:
                seen = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path)
                written = {r.bucket: r.n for r in seen.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
            after, unused = dict(at), []
            for b, n in written.items():
                files = [] if b in full else at.get(str(b), [])
                after[str(b)] = [*files, [number, n]]
                unused += [f"batch-{m}/bucket={b}" for m, _ in at.get(str(b), [])] if b in full else []
            self._point({"batch": number, "at": after, "unused": sorted(unused)}, now)
            fresh = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).drop("bucket") if written else self.spark.createDataFrame([], self.schema)
            # In compacted buckets other rows were written too; the batch's winners are those of its keys and versions.
            return fresh.join(batch.select(self.key, *self.version).distinct(), [self.key, *self.version], "left_semi") if full else fresh
        finally:
            rows.unpersist()

    def follow(self, stream: DataFrame, checkpoint: str, then: Callable[[DataFrame], None] | None = None, seconds: int | None = None, on_changes: tuple[list[str], Callable[[DataFrame, int], None]] | None = None, views: Sequence[TopView] = ()) -> StreamingQuery:
        """Starts merging a stream; seconds: poll at this interval, else take all there is and stop. views: lists kept up to date.

        on_changes: watched columns and what to do with the row_changes of each batch, before it is merged; a batch that is repeated
        after a failure gives the same changes under the same number.
        """

        def step(batch: DataFrame, number: int) -> None:
            if on_changes and number > self._pointer()["batch"]:
                watched, act = on_changes
                there = self.read().join(batch.select(self.key).distinct(), self.key, "left_semi")
                act(row_changes(there, batch, self.key, self.version, watched), number)
            won = self.merge(batch, number)
            for v in views:
                v.apply(won, number)
            if then:
                then(self.read())

        w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def _literal(value, kind: T.DataType) -> F.Column:
    """A value that was collected, as it was in the column; times without a zone never meet one."""
    return F.lit(value.isoformat(sep=" ")).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(value)


class TopView(Pointed):
    """The first `limit` rows of a live table that pass a test, in order of `order` (newest first, or oldest if `ascending`) and then the
    key, kept from batch to batch.

    The list holds up to `spare` rows more than it shows. Every row of the state that passes and stands at or above its last row, its
    floor, is in it. A batch takes the rows it changes out, puts those in that pass and stand at or above the floor, and cuts the list
    to its size. Only when rows that left bring it below `limit` is the state read again, so with s spare rows at most every s-th row that
    leaves costs a refill. `reads` counts the rows of lists, batches and refills that were read.
    """

    def __init__(self, live: LiveTable, path: str, test: Callable[[], F.Column] | None = None, order: str = "created_at", limit: int = 200, spare: int = 50, ascending: bool = False) -> None:
        super().__init__(live.spark, path)
        self.live, self.test, self.order, self.limit, self.spare, self.ascending = live, test, order, limit, spare, ascending

    def _passing(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.order).isNotNull() & self.test()) if self.test else df.where(F.col(self.order).isNotNull())

    def _first(self, df: DataFrame, n: int) -> DataFrame:
        return df.orderBy(F.asc(self.order) if self.ascending else F.desc(self.order), self.live.key).limit(n)

    def _list(self, pointer: dict) -> DataFrame:
        name = pointer.get("list")
        return self.spark.read.schema(self.live.schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.live.schema)

    def read(self) -> DataFrame:
        return self._first(self._list(self._pointer()), self.limit)

    @property
    def reads(self) -> int:
        return self._pointer().get("reads", 0)

    @property
    def refills(self) -> int:
        return self._pointer().get("refills", 0)

    def apply(self, changed: DataFrame | None, number: int) -> None:
        """changed: the rows that became the newest of their keys in this batch. A batch that was there is passed over; one that is
        missing, as after a failure between the table and the list, is made good by a refill."""
        now, most = self._pointer(), self.limit + self.spare
        if number <= now["batch"]:
            return
        behind = changed is None or (now["batch"] >= 0 and number != now["batch"] + 1)
        whole, reads, refills = now.get("whole", True), now.get("reads", 0), now.get("refills", 0)
        rows: list = []
        if not behind:
            key, held = self.live.key, self._list(now)
            rows_held = held.collect()  # at most limit + spare
            floor = None
            if rows_held:  # the last of the list: of those at the furthest time, the largest key
                far = (max if self.ascending else min)(r[self.order] for r in rows_held)
                floor = (far, max(r[key] for r in rows_held if r[self.order] == far))
            fits = F.lit(True)
            if not whole and floor is not None:
                low = _literal(floor[0], held.schema[self.order].dataType)
                nearer = F.col(self.order) < low if self.ascending else F.col(self.order) > low
                fits = nearer | ((F.col(self.order) == low) & (F.col(key) <= F.lit(floor[1])))
            stay = held.join(changed.select(key), key, "left_anti")
            both = self._first(stay.unionByName(self._passing(changed).where(fits).select(*held.columns)), most + 1)
            rows = both.collect()  # at most limit + spare + 1
            reads += len(rows_held) + changed.count()
            if not whole and floor is None:
                behind = True
        if behind or (len(rows) < self.limit and not whole):
            state = self._passing(self.live.read())
            rows = self._first(state, most + 1).collect()
            reads, refills, whole = reads + self.live.read().count(), refills + 1, True
        if len(rows) > most:
            rows, whole = rows[:most], False
        name = f"list-{number}"
        self.spark.createDataFrame(rows, self.live.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._point({"batch": number, "list": name, "whole": whole, "reads": reads, "refills": refills, "unused": [now["list"]] if "list" in now else []}, now)


def of_user(state: DataFrame, user) -> DataFrame:
    return state.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "id")


def of_category(state: DataFrame, category: str) -> DataFrame:
    return state.where((F.col("category") == category) & (F.col("status") != "rejected")).orderBy(F.desc("created_at"), "id")


def latest(state: DataFrame, limit: int = 200) -> DataFrame:
    return state.orderBy(F.desc("created_at"), "id").limit(limit)


def history(state: DataFrame, key, limit: int = 100) -> DataFrame:
    return state.where(F.col("user_id") == key).orderBy("created_at", "id").limit(limit)
