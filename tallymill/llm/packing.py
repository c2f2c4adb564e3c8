"""Conflict-constrained best-fit packing.

Documents become pieces of at most `capacity` words; full pieces fill a bin of their own, the rest of each document is
packed by best fit, longest first. A bin may hold at most `per_source` pieces of a source and one of a duplicate cluster.

Bins are ordered by residual room and carry bitmaps of their sources (one plane for each repetition) and clusters. The search
starts at the tightest residual that fits and goes on to its successors until a bin without a conflict is found; if there is
none, a bin is opened. For each source or cluster that many pieces of a group share, a count of free bins by residual lets
the search skip residuals where every bin is in conflict.

Documents are dealt by id hash into groups of bounded size, and groups are packed apart, so bins of a group never depend on
another one; at most one badly filled tail of bins comes from each group.

Results in special cases: a null or blank text has no words and gets no bin (null bin and offset); a null source or cluster conflicts with
nothing; repeated rows are packed one by one; ties go by id, then text hash, then source; a text longer than a bin is cut into pieces and none of
its words is left out; a null id is packed as any other; an empty table gives no rows. Only the id, text and source columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import text_bytes

#: Documents of a group.
GROUP_ROWS = 20_000
#: A source or cluster with so many pieces in a group has its free bins counted.
OFTEN = 64


@dataclass
class Bins:
    capacity: int
    per_source: int
    heavy: dict[tuple[str, object], int]
    room: list[int] = field(default_factory=list)
    #: Bitmaps over the group's sources, a plane for each repetition, and over its clusters.
    sources: list[list[int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        #: Open bins by residual, in order of opening.
        self.at: list[dict[int, None]] = [{} for _ in range(self.capacity + 1)]
        self.some = np.zeros(self.capacity + 1, dtype=bool)
        self.free = np.zeros((len(self.heavy), self.capacity + 1), dtype=np.int32)
        #: Heavy sources and clusters that bin b cannot take.
        self.shut: list[set[int]] = []

    def _put(self, b: int, sign: int) -> None:
        r = self.room[b]
        if sign > 0:
            self.at[r][b] = None
        else:
            del self.at[r][b]
        self.some[r] = bool(self.at[r])
        self.free[:, r] += sign
        for h in self.shut[b]:
            self.free[h, r] -= sign

    def _takes(self, b: int, source: int, cluster: int) -> bool:
        if cluster >= 0 and self.clusters[b] >> cluster & 1:
            return False
        return source < 0 or not self.sources[b][-1] >> source & 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; source and cluster are numbers in the group, or -1."""
        limits = [h for h in (self.heavy.get(("s", source)), self.heavy.get(("c", cluster))) if h is not None]
        open_ = self.some[size:]
        for h in limits:
            open_ = open_ & (self.free[h, size:] > 0)
        found = next((b for r in np.flatnonzero(open_) for b in self.at[r + size] if self._takes(b, source, cluster)), None) if not len(limits) or open_.any() else None
        if found is None:
            found = len(self.room)
            self.room.append(self.capacity)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.shut.append(set())
        else:
            self._put(found, -1)
        start = self.capacity - self.room[found]
        self.room[found] -= size
        if source >= 0:
            planes = self.sources[found]
            k = next(i for i, p in enumerate(planes) if not p >> source & 1)
            planes[k] |= 1 << source
            if k == self.per_source - 1 and ("s", source) in self.heavy:
                self.shut[found].add(self.heavy["s", source])
        if cluster >= 0:
            self.clusters[found] |= 1 << cluster
            if ("c", cluster) in self.heavy:
                self.shut[found].add(self.heavy["c", cluster])
        if self.room[found]:
            self._put(found, 1)
        return found, start


def _numbers(values: list) -> list[int]:
    seen: dict = {}
    return [-1 if v is None else seen.setdefault(v, len(seen)) for v in values]


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item in the given order of rows; items go in by descending size, then by row."""
    s, c = _numbers(sources), _numbers(clusters)
    often = [("s", k) for k, n in Counter(s).items() if n >= OFTEN and k >= 0] + [("c", k) for k, n in Counter(c).items() if n >= OFTEN and k >= 0]
    bins = Bins(capacity, per_source, {k: i for i, k in enumerate(often)})
    where, start = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where[i], start[i] = bins.place(sizes[i], s[i], c[i])
    return where, start


def _count_words(it):
    for batch in it:
        n = []
        for lo, hi in K.batches(sizes := [len(x.as_buffer()) for x in batch.column("text")]):
            n.append(np.diff(K.Words(batch.column("text").slice(lo, hi - lo).to_pylist()).bounds))
        words = np.concatenate(n) if sizes else np.empty(0, dtype=np.int64)
        yield pa.record_batch([*(batch.column(c) for c in ("id", "source", "cluster", "group")), pa.array(words, type=pa.int64())], names=["id", "source", "cluster", "group", "words"])


def _pack(key, t: pa.Table, capacity: int, per_source: int) -> pa.Table:
    group = key[0].as_py()
    t = t.sort_by([("words", "descending"), ("id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
    words = t.column("words").to_numpy()
    full, rest = words // capacity, words % capacity
    some = np.flatnonzero(rest)
    where, start = pack_group(rest[some].tolist(), t.column("source").take(pa.array(some)).to_pylist(), t.column("cluster").take(pa.array(some)).to_pylist(), capacity, per_source)
    opened = max(where, default=-1) + 1
    row = np.concatenate((np.repeat(np.arange(len(words)), full), some, none := np.flatnonzero(words == 0)))
    piece = np.concatenate((K.spread(np.zeros(len(words), dtype=np.int64), full), full[some], np.zeros(len(none), dtype=np.int64)))
    length = np.concatenate((np.full(int(full.sum()), capacity), rest[some], np.zeros(len(none), dtype=np.int64)))
    local = np.concatenate((opened + np.arange(int(full.sum())), np.array(where, dtype=np.int64), np.zeros(len(none), dtype=np.int64)))
    offset = np.concatenate((np.zeros(int(full.sum()), dtype=np.int64), np.array(start, dtype=np.int64), np.zeros(len(none), dtype=np.int64)))
    empty = length == 0
    return pa.table(
        {
            "id": t.column("id").take(pa.array(row)),
            "piece": pa.array(piece, type=pa.int64()),
            "first_word": pa.array(piece * capacity, type=pa.int64()),
            "n_words": pa.array(length, type=pa.int64()),
            "bin": pa.array((group << 32) + local, type=pa.int64(), mask=empty),
            "offset": pa.array(offset, type=pa.int64(), mask=empty),
        }
    )


def pack_documents(docs: DataFrame, *, capacity: int = 2048, per_source: int = 4, id_column: str = "doc_id", text_column: str = "text", source_column: str | None = "source", cluster: F.Column | None = None) -> DataFrame:
    """(id, piece, first_word, n_words, bin, offset): where each piece of each document goes.

    cluster: duplicate cluster of a row; by default equal texts are one.
    """
    body = text_bytes(F.col(text_column))
    source = F.col(source_column).cast("string") if source_column else F.lit(None).cast("string")
    by = (F.xxhash64(body) if cluster is None else cluster).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), source.alias("source"), by.alias("cluster"), body.alias("text"))
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("id", "cluster"), F.lit(groups)))
    counted = dealt.mapInArrow(_count_words, "id long, source string, cluster string, group long, words long")
    return counted.groupBy("group").applyInArrow(lambda key, t: _pack(key, t, capacity, per_source), "id long, piece long, first_word long, n_words long, bin long, offset long")
