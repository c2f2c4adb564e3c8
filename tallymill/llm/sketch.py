"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below 2**64 / scale, so it grows with the text, the sketch of two texts together is the
union of their sketches, and Jaccard likeness and containment are estimated from the hashes below the threshold, however
unequal the texts' sizes.

A fingerprint is text: number of distinct shingles and a hash of the whole word sequence (both hex), then the sketch's hashes
in ascending order. Words are split at ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle; a
text without words has none. Likeness is 1 for equal word sequences and, where both sketches are empty, else 0. A null text
is the empty one.

Order: descending id; a null id comes last; rows that repeat an id follow each other by text hash. The only row of a table is its own
next one; an empty table gives no rows. Texts of any length count whole. Only the id and text columns are read, so others may have any
name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.ranges import bounds, order_key, range_of
from tallymill.llm.runtime import partitions

U = np.uint64
SHINGLE, SCALE = 5, 4


class Sketch:
    __slots__ = ("distinct", "whole", "hashes")

    def __init__(self, distinct: int, whole: int, hashes: np.ndarray) -> None:
        self.distinct, self.whole, self.hashes = distinct, whole, hashes

    def text(self) -> str:
        return f"{self.distinct:x}:{self.whole:016x}:{self.hashes.astype('>u8').tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> Sketch:
        n, whole, raw = text.split(":")
        return Sketch(int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(raw), dtype=">u8").astype(U))

    def merged(self, other: Sketch) -> np.ndarray:
        """The sketch of both texts' shingles together."""
        return np.union1d(self.hashes, other.hashes)

    def _common(self, other: Sketch) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard likeness of the shingle sets."""
        if (self.whole, self.distinct) == (other.whole, other.distinct):
            return 1.0
        both = self._common(other)
        return both / (len(self.hashes) + len(other.hashes) - both) if len(self.hashes) + len(other.hashes) else 0.0

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has."""
        if (self.whole, self.distinct) == (other.whole, other.distinct):
            return 1.0
        return self._common(other) / len(self.hashes) if len(self.hashes) else 0.0


def sketches(texts: list[bytes], words: int = SHINGLE, scale: int = SCALE) -> list[Sketch]:
    out: list[Sketch] = []
    top = U((1 << 64) // scale) if scale > 1 else U((1 << 64) - 1)
    for lo, hi in K.batches([len(t) for t in texts]):
        w = K.Words(texts[lo:hi])
        h = w.hashes(fold=True)
        win = K.window_hashes(h, words)
        n = np.diff(w.bounds)
        whole = K.sequence_hashes(h, w.bounds[:-1], w.bounds[1:])
        for i in range(hi - lo):
            if n[i] >= words:
                every = np.unique(win[w.bounds[i] : w.bounds[i + 1] - words + 1])
                out.append(Sketch(len(every), int(whole[i]), every[: np.searchsorted(every, top)]))
            else:
                one = whole[i : i + 1] if n[i] else whole[:0]
                out.append(Sketch(len(one), int(whole[i]), one[one < top]))
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(id, text, next text) from rows sorted by range, ghosts last. A range's last row is held until its ghost comes."""
    held = None
    for batch in it:
        for part, ghost, key, text in zip(batch.column("part").to_pylist(), batch.column("ghost").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if held is not None and held[0] == part:
                yield held[1], held[2], text
                held = None
            if not ghost:
                held = (part, key, text)


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in _pairs(it):
        rows.append(row)
        size += len(row[1])
        if size > 4 * K.BATCH_BYTES or len(rows) >= 4096:
            yield _finished(rows)
            rows, size = [], 0
    if rows:
        yield _finished(rows)


def _finished(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    own = [t.encode() for _, t, _ in rows]
    edits = [edited(t, n).encode() for _, t, n in rows]
    mine, theirs = sketches(own), sketches(edits)
    # The next row's text is usually the next one here.
    after = [None if i + 1 < len(rows) and rows[i + 1][1] == n else n for i, (_, _, n) in enumerate(rows)]
    extra = iter(sketches([n.encode() for n in after if n is not None]))
    following = [mine[i + 1] if n is None else next(extra) for i, n in enumerate(after)]
    return pa.record_batch(
        {
            "id": pa.array([r[0] for r in rows], type=pa.int64()),
            "n_chars": pa.array([len(r[1]) for r in rows], type=pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
            "fingerprint": pa.array([s.text() for s in mine]),
            "edited_fingerprint": pa.array([s.text() for s in theirs]),
            "near_edited": pa.array([a.likeness(b) for a, b in zip(mine, theirs, strict=True)]),
            "near_next": pa.array([a.likeness(b) for a, b in zip(mine, following, strict=True)]),
        }
    )


def fingerprint_texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""

    def run(it):
        for b in it:
            yield pa.record_batch({"id": b.column("id"), "fingerprint": pa.array([s.text() for s in sketches(b.column("text").to_pylist())], type=pa.string())})

    body = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_column).cast("long").alias("id"), body.alias("text")).mapInArrow(run, "id long, fingerprint string")


def fingerprint_edits(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its text half replaced by the next row's, and how near they and the next are."""
    spark = docs.sparkSession
    width = partitions(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), order_key(F.col(id_column)).alias("key"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    keys = rows.select("key")
    cuts = bounds(keys, F.col("key"), 4 * width)
    part = range_of(cuts)
    # The largest key of each range also goes, as a ghost, to the range above; the largest of all to the lowest range.
    tops = sorted((r.part, r.top) for r in keys.groupBy(part("key").alias("part")).agg(F.max("key").alias("top")).collect())
    ghosts: dict[int, list[int]] = {}
    for i, (_, top) in enumerate(tops):
        ghosts.setdefault(top, []).append(tops[(i + 1) % len(tops)][0])
    edge = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("array<struct<part:int,ghost:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        at = np.searchsorted(edge, key.to_numpy(dtype=np.int64), side="right")
        return pd.Series([[{"part": int(p), "ghost": False}, *({"part": g, "ghost": True} for g in ghosts.get(int(k), ()))] for p, k in zip(at, key, strict=True)])

    placed = rows.withColumn("place", F.explode(places("key"))).select("id", "key", "text", "place.part", "place.ghost")
    dealt = placed.repartition(width, "part").sortWithinPartitions("part", "ghost", F.desc("key"), F.xxhash64("text"))
    fields = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("id", "part", "ghost", "text").mapInArrow(_rows, fields)
