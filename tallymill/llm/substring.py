"""Substring dedup by difference-cover anchors.

A window of `window` words repeats only if, at some shift below the period, both copies have an anchor (a shorter run of
words) whose position modulo the period lies in the cover. So only anchors at cover positions are hashed and compared; the
windows around shared anchors are then hashed in full and compared by their smallest document.

Documents are dealt once into buckets by id and every pass reads that same exchange. Between the passes travel packed
arrays, one row for each pair of buckets. What repeats inside a bucket is settled there: a passage that a third of all
documents share sends one entry per bucket, not one per document.

Results in special cases: a null or empty text has no words and stays; a null id is neither smaller nor larger than any, so
its row loses and removes nothing; rows that repeat an id are not smaller than each other, each gets its own result; a text
shorter than the window stays; a very long text is one row like any other; of equal windows in one document, each is judged;
an empty table gives no rows. Other columns pass through untouched, whatever their names and types.

Anchors only choose candidates, by 64 bits of a hash. Windows count as equal by 128 bits of two hashes with different seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import loosened, pack, partitions, text_bytes, unpack, whole_row, with_rest

#: Perfect or minimal difference covers: every difference modulo the period occurs between two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
ENTRY, SETTLED = 0, 1
#: Windows are equal if two hashes over words that are hashed with two seeds are: 128 bits.
SECOND = 0x5EED


@dataclass(frozen=True)
class Plan:
    window: int
    period: int
    anchor: int
    buckets: int

    @property
    def cover(self) -> tuple[int, ...]:
        return COVERS[self.period]


def plan_for(window: int, buckets: int) -> Plan:
    """The longest period that leaves an anchor of half the window at least."""
    period = max(p for p in COVERS if window - p + 1 >= max(1, window // 2))
    return Plan(window, period, window - period + 1, buckets)


@dataclass
class Bucket:
    """The rows of one bucket of documents, in one order for every pass."""

    order: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    texts: list[bytes]


def _bucket(t: pa.Table) -> Bucket:
    ids = t.column("id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    raw = ids.fill_null(0).to_numpy()
    order = np.lexsort((t.column("same").to_numpy(), raw, ~known))
    texts = t.column("text").combine_chunks().take(pa.array(order)).to_pylist()
    return Bucket(order, raw[order], known[order], texts)


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = K.group_starts(rows)
    return rows[at].astype(np.uint32), np.diff(np.append(at, len(rows))).astype(np.uint32)


def _entries(source: int, target: np.ndarray, rows: np.ndarray, ids: np.ndarray, pos: np.ndarray, *keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row for each target bucket. rows are ascending."""
    order = np.argsort(target, kind="stable")
    target, rows, pos, keys = target[order], rows[order], pos[order], [k[order] for k in keys]
    for a, b in K.runs(target):
        who, n = _runs(rows[a:b])
        yield int(target[a]), ENTRY, pack(np.array([source], dtype=np.int64), who, n, ids[who], pos[a:b].astype(np.uint32), *(k[a:b] for k in keys))


def _settled(source: int, rows: np.ndarray, pos: np.ndarray) -> bytes:
    who, n = _runs(rows)
    return pack(np.array([source], dtype=np.int64), who, n, pos.astype(np.uint32))


SENT = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("load", pa.binary())])
SENT_SQL = "to int, kind int, load binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(SENT)], schema=SENT)


def _anchors(plan: Plan, source: int, t: pa.Table) -> pa.Table:
    b = _bucket(t)
    keys, rows, pos = [], [], []
    for lo, hi in K.batches([len(x) for x in b.texts]):
        w = K.Words(b.texts[lo:hi])
        h, local = K.window_hashes(w.hashes(), plan.anchor), w.doc_of()
        m = len(h)
        if not m:
            continue
        at = np.arange(m) - w.bounds[local[:m]]
        ok = K.same_doc(w.bounds, plan.anchor, len(w)) & np.isin(at % plan.period, plan.cover) & b.known[local[:m] + lo]
        keys.append(h[ok])
        rows.append(local[:m][ok] + lo)
        pos.append(at[ok])
    if not keys:
        return _sent([])
    key, row, at = np.concatenate(keys), np.concatenate(rows), np.concatenate(pos)
    order = np.argsort(key, kind="stable")
    first = K.group_starts(key[order])
    size = np.diff(np.append(first, len(order)))
    who = b.ids[row[order]]
    several = np.repeat(np.maximum.reduceat(who, first) != np.minimum.reduceat(who, first), size) if len(first) else np.zeros(0, dtype=bool)
    # Shared inside the bucket: settled here, and the first occurrence speaks for all of them elsewhere.
    lead = np.zeros(len(order), dtype=bool)
    lead[first] = True
    send = np.sort(order[~several | lead])
    out = []
    for to, kind, load in _entries(source, (key[send] >> np.uint64(32)).astype(np.int64) % plan.buckets, row[send], b.ids, at[send], key[send].astype(np.uint32)):
        out.append((to, kind, load))
    if several.any():
        mine = np.sort(order[several])
        out.append((source % plan.buckets, SETTLED, _settled(source, row[mine], at[mine])))
    return _sent(out)


def _starts(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where each run of rows that agree in every key begins, in that order."""
    if not len(order):
        return np.empty(0, dtype=np.int64)
    turn = np.ones(len(order), dtype=bool)
    turn[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return np.flatnonzero(turn)


def _gathered(t: pa.Table, *keys: type) -> tuple[list, list]:
    """The entries that met in a bucket, and what is settled and only passes."""
    entries, passing = [], []
    for kind, load in zip(t.column("kind").to_pylist(), t.column("load"), strict=True):
        blob = load.as_buffer()
        if kind == SETTLED:
            passing.append((int(unpack(blob, np.int64, np.uint32, np.uint32, np.uint32)[0][0]), blob.to_pybytes()))
        else:
            source, who, n, ids, pos, *key = unpack(blob, np.int64, np.uint32, np.uint32, np.int64, np.uint32, *keys)
            entries.append((np.full(len(pos), source[0], dtype=np.int64), np.repeat(who, n), np.repeat(ids, n), pos, *key))
    return entries, passing


def _answers(entries: list, passing: list, keep) -> pa.Table:
    out = [(to, SETTLED, blob) for to, blob in passing]
    if entries:
        source, row, ids, pos, *keys = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.lexsort(keys[::-1])
        first = _starts(keys, order)
        size = np.diff(np.append(first, len(order)))
        who = ids[order]
        hit = order[keep(who, np.repeat(np.minimum.reduceat(who, first), size), np.repeat(np.maximum.reduceat(who, first), size))]
        source, row, pos = source[hit], row[hit], pos[hit]
        by = np.lexsort((pos, row, source))
        source, row, pos = source[by], row[by], pos[by]
        for a, b in K.runs(source):
            out.append((int(source[a]), SETTLED, _settled(int(source[a]), row[a:b], pos[a:b])))
    return _sent(out)


def _shared_anchors(t: pa.Table) -> pa.Table:
    """Anchors that occur in two documents at least, back to their buckets."""
    return _answers(*_gathered(t, np.uint32), lambda who, low, high: low != high)


def _repeated_windows(t: pa.Table) -> pa.Table:
    """Windows that also start in a smaller document, back to their buckets."""
    return _answers(*_gathered(t, np.uint64, np.uint64), lambda who, low, high: who > low)


def _positions(t: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) pairs sent to a bucket, ascending."""
    rows, pos = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for load in t.column("load"):
        _, who, k, at = unpack(load.as_buffer(), np.int64, np.uint32, np.uint32, np.uint32)
        rows.append(np.repeat(who.astype(np.int64), k))
        pos.append(at.astype(np.int64))
    row, at = np.concatenate(rows), np.concatenate(pos)
    order = np.lexsort((at, row))
    return row[order], at[order]


def _windows(plan: Plan, source: int, t: pa.Table, sent: pa.Table) -> pa.Table:
    b = _bucket(t)
    arow, apos = _positions(sent, len(b.ids))
    keys, second, rows, pos = [], [], [], []
    for lo, hi in K.batches([len(x) for x in b.texts]):
        x, y = np.searchsorted(apos_row := arow, [lo, hi])
        if x == y:
            continue
        w = K.Words(b.texts[lo:hi])
        m = len(w) - plan.window + 1
        if m <= 0:
            continue
        # A window touches a shared anchor if it starts up to period - 1 words before it.
        edge = np.zeros(m + 1, dtype=np.int32)
        at = w.bounds[apos_row[x:y] - lo] + apos[x:y]
        np.add.at(edge, np.minimum(np.maximum(at - plan.window + plan.anchor, 0), m), 1)
        np.add.at(edge, np.minimum(at + 1, m), -1)
        cand = np.flatnonzero((np.cumsum(edge[:m]) > 0) & K.same_doc(w.bounds, plan.window, len(w)))
        local = np.searchsorted(w.bounds, cand, side="right") - 1
        keys.append(K.window_hashes(w.hashes(), plan.window)[cand])
        second.append(K.window_hashes(w.hashes(seed=SECOND), plan.window)[cand])
        rows.append(local + lo)
        pos.append(cand - w.bounds[local])
    if not keys:
        return _sent([])
    key, more, row, at = (np.concatenate(x) for x in (keys, second, rows, pos))
    live = b.known[row]
    key, more, row, at = key[live], more[live], row[live], at[live]
    if not len(key):
        return _sent([])
    order = np.lexsort((b.ids[row], more, key))
    first = _starts([key, more], order)
    size = np.diff(np.append(first, len(order)))
    later = b.ids[row[order]] > np.repeat(b.ids[row[order[first]]], size)
    send = np.sort(order[~later])
    out = list(_entries(source, (key[send] >> np.uint64(32)).astype(np.int64) % plan.buckets, row[send], b.ids, at[send], key[send], more[send]))
    if later.any():
        mine = np.sort(order[later])
        out.append((source % plan.buckets, SETTLED, _settled(source, row[mine], at[mine])))
    return _sent(out)


def _cut_texts(plan: Plan, joiner: bytes | None, t: pa.Table, sent: pa.Table) -> pa.Table:
    b = _bucket(t)
    wrow, wpos = _positions(sent, len(b.ids))
    n_words, n_removed, kept = np.zeros(len(b.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64), []
    for lo, hi in K.batches([len(x) for x in b.texts]):
        w = K.Words(b.texts[lo:hi])
        x, y = np.searchsorted(wrow, [lo, hi])
        gone = K.hit_words(len(w), w.bounds[wrow[x:y] - lo] + wpos[x:y], plan.window)
        n_words[lo:hi] = np.diff(w.bounds)
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed[lo:hi] = total[w.bounds[1:]] - total[w.bounds[:-1]]
        for i in range(hi - lo):
            text, (p, q) = w.texts[i], w.bounds[i : i + 2]
            if joiner is not None:
                words = text.split()
                if n_removed[lo + i]:
                    words = [words[j] for j in np.flatnonzero(~gone[p:q])]
                text = joiner.join(words)
            elif n_removed[lo + i]:
                # Removed runs go together with the white space after them.
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone[p:q], [False])).astype(np.int8)))
                starts = np.append(w.starts[p:q] - w.offsets[i], len(text))
                piece, at = [], 0
                for s, e in zip(turn[::2], turn[1::2], strict=True):
                    piece.append(text[at : starts[s]])
                    at = int(starts[e])
                text = b"".join([*piece, text[at:]])
            kept.append(text.decode("utf-8", "replace"))
    back = np.argsort(b.order, kind="stable")
    cols = {
        "id": t.column("id"),
        "n_words": pa.array(n_words[back]),
        "n_removed": pa.array(n_removed[back]),
        "kept_text": pa.array(kept, type=pa.string()).take(pa.array(back)),
    }
    if "rest" in t.column_names:
        cols |= {"no_text": t.column("no_text"), "rest": loosened(t.column("rest"))}
    return pa.table(cols)


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = 13, join_words: str | None = None, keep_columns: bool = False) -> DataFrame:
    """Each row's text without the words that a window of `window` words covers whose words also start in a smaller document.

    Returns id, n_words, n_removed, kept_text. join_words: kept words are joined by it; None leaves the white space as it
    is. keep_columns: also `rest`, a struct of the input's columns, and `no_text`, true where the text was null.
    """
    spark = docs.sparkSession
    plan = plan_for(window, partitions(spark))
    part = F.pmod(F.xxhash64(F.col(id_column).cast("long")), F.lit(plan.buckets)).cast("int")
    body = text_bytes(F.col(text_column))
    cols = [part.alias("part"), F.col(id_column).cast("long").alias("id"), F.xxhash64(body).alias("same"), body.alias("text")]
    fields, extra = "id long, n_words long, n_removed long, kept_text string", []
    if keep_columns:
        extra = [whole_row(docs), F.col(text_column).isNull().alias("no_text")]
        fields = with_rest(f"{fields}, no_text boolean", docs)
    dealt = docs.select(*cols, *extra)
    narrow = dealt.groupBy("part")
    anchors = narrow.applyInArrow(lambda key, t: _anchors(plan, key[0].as_py(), t), SENT_SQL)
    shared = anchors.groupBy("to").applyInArrow(_shared_anchors, SENT_SQL)
    windows = narrow.cogroup(shared.groupBy("to")).applyInArrow(lambda key, t, s: _windows(plan, key[0].as_py(), t, s), SENT_SQL)
    repeated = windows.groupBy("to").applyInArrow(_repeated_windows, SENT_SQL)
    joiner = None if join_words is None else join_words.encode()
    return narrow.cogroup(repeated.groupBy("to")).applyInArrow(lambda key, t, s: _cut_texts(plan, joiner, t, s), fields)
