"""Compression of vectors to codes: each part of a vector becomes the number of the nearest entry in that part's codebook.

Components are whole numbers, floor(256 * x), so distances and sums are exact. In each round a kd-tree of every codebook (its size
is fixed by `entries` and the vector's length) is broadcast. Tasks search it by branch and bound, a batch of vectors at a time: a
node is visited by the vectors whose distance to its box is at most the best so far; equal bounds are visited too, so that of
entries at one distance the lowest index wins wherever it hangs. Tasks add up counts and component sums for each entry; only
those sums are shuffled, and the few thousand totals make the next codebooks on the driver.

Results in special cases: rows whose vector is null or holds null or non-finite components are dropped, and so are rows
whose vector is empty or of another length than the vector of the smallest id; a length that `parts` does not divide gives the first
parts one component more; a null id is coded but starts no entry; rows that repeat an id are coded each, and start
entries in order of their components; a table of fewer than `entries` vectors has shorter codebooks; copies of one entry are
all kept, the lowest index is used; components beyond the range in which squared distances fit 64 bits (about +-260,000 at 64
components) count as its ends; a table without vectors of known ids gives no rows. Only the three columns are read, whatever the others are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.runtime import Scratch, quoted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries below which a node of the tree is not divided.
LEAF = 8
#: A label's rows meet its total in this many places.
SALTS = 64


@dataclass
class Node:
    """A box of entries; leaves hold their indexes in ascending order."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(book: np.ndarray, which: np.ndarray | None = None) -> Node:
    """Boxes halved at the median of their widest axis."""
    which = np.arange(len(book)) if which is None else which
    own = book[which]
    node = Node(own.min(axis=0), own.max(axis=0), which)
    axis = int(np.argmax(node.high - node.low))
    if len(which) <= LEAF or node.high[axis] == node.low[axis]:
        return node
    order = which[np.argsort(own[:, axis], kind="stable")]
    half = len(order) // 2
    node.axis, node.cut = axis, int(book[order[half], axis])
    node.left, node.right = kd_tree(book, np.sort(order[:half])), kd_tree(book, np.sort(order[half:]))
    return node


class Search:
    """The nearest entry of one codebook for a batch of points."""

    def __init__(self, book: np.ndarray) -> None:
        self.book, self.root = book, kd_tree(book)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each point."""
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.index = np.full(len(points), len(self.book), dtype=np.int64)
        self._visit(self.root, points, np.arange(len(points)))
        return self.index, self.best

    def _visit(self, node: Node, points: np.ndarray, who: np.ndarray) -> None:
        # Points that the box may still serve; at an equal bound it may hold a lower index.
        own = points[who]
        out = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        keep = (out * out).sum(axis=1) <= self.best[who]
        who = who[keep]
        if not len(who):
            return
        if node.left is None:
            away = points[who][:, None, :] - self.book[node.entries][None, :, :]
            far = (away * away).sum(axis=2)
            place = far.argmin(axis=1)
            got, index = far[np.arange(len(who)), place], node.entries[place]
            better = (got < self.best[who]) | ((got == self.best[who]) & (index < self.index[who]))
            self.best[who[better]], self.index[who[better]] = got[better], index[better]
            return
        near = points[who, node.axis] < node.cut
        for side, first, then in ((near, node.left, node.right), (~near, node.right, node.left)):
            if side.any():
                self._visit(first, points, who[side])
                self._visit(then, points, who[side])


@dataclass(frozen=True)
class Shape:
    """How a vector is cut into parts."""

    size: int
    parts: int

    @property
    def edges(self) -> np.ndarray:
        width = np.full(self.parts, self.size // self.parts)
        width[: self.size % self.parts] += 1
        return np.concatenate(([0], np.cumsum(width)))

    @property
    def most(self) -> int:
        """Largest component such that the squared distances of all parts together fit 63 bits."""
        return 1 << ((62 - max(1, self.size - 1).bit_length()) // 2 - 1)


def _whole(column: pa.ChunkedArray | pa.Array, shape: Shape | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components): the rows whose vector is kept and their components as whole numbers; without a shape, its first row's."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = flat.is_valid().to_numpy(zero_copy_only=False)
    offsets = flat.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    values = flat.values.cast(pa.float64())
    bad = ~np.isfinite(values.to_numpy(zero_copy_only=False)) | values.is_null().to_numpy(zero_copy_only=False)
    run = np.concatenate(([0], np.cumsum(bad)))
    ok &= (size > 0) & (run[offsets[1:]] == run[offsets[:-1]])
    if shape is not None:
        ok &= size == shape.size
    rows = np.flatnonzero(ok)
    if shape is None:
        return rows, size[rows]
    x = values.to_numpy(zero_copy_only=False)[(offsets[:-1][rows])[:, None] + np.arange(shape.size)]
    return rows, np.clip(np.floor(SCALE * x), -shape.most, shape.most).astype(np.int64)


def _first(rows: DataFrame, entries: int, parts: int) -> tuple[Shape | None, np.ndarray]:
    """The vectors of the smallest ids, and the shape they set. At most `entries` rows reach the driver."""

    def sized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, size = _whole(b.column("vector"), None)
            yield pa.record_batch({"id": b.column("id").take(pa.array(at)), "size": pa.array(size), "vector": b.column("vector").cast(pa.list_(pa.float64())).take(pa.array(at))})

    kept = rows.where("id is not null").mapInArrow(sized, "id long, size long, vector array<double>").orderBy("id", "size", "vector")
    top = kept.limit(1).collect()
    if not top:
        return None, np.empty((0, 0), dtype=np.int64)
    shape = Shape(top[0]["size"], parts)
    most = float(shape.most)
    whole = F.transform("vector", lambda x: F.greatest(F.least(F.floor(x * F.lit(float(SCALE))).cast("double"), F.lit(most)), F.lit(-most)).cast("long"))
    got = kept.where(F.col("size") == shape.size).select("id", whole.alias("vector")).orderBy("id", "vector").limit(entries).collect()
    return shape, np.array([r.vector for r in got], dtype=np.int64).reshape(len(got), shape.size)


Books = list[np.ndarray]


def _assigned(searches: list[Search], edges: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each part, squared distance summed over parts) of each row."""
    codes, error = np.empty((len(x), len(searches)), dtype=np.uint8 if len(searches[0].book) <= 256 else np.uint16), np.zeros(len(x), dtype=np.int64)
    for p, s in enumerate(searches):
        codes[:, p], far = s.nearest(x[:, edges[p] : edges[p + 1]])
        error += far
    return codes, error


def _totals(rows: DataFrame, shape: Shape, books: Books) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each used (part, entry) its number of vectors and the sums of their components, over all rows: as many as the books have."""
    edges, sent = shape.edges, rows.sparkSession.sparkContext.broadcast([Search(b) for b in books])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = sent.value
        count = [np.zeros(len(s.book), dtype=np.int64) for s in searches]
        total = [np.zeros(s.book.shape, dtype=np.int64) for s in searches]
        for b in it:
            _, x = _whole(b.column("vector"), shape)
            codes, _ = _assigned(searches, edges, x)
            for p in range(shape.parts):
                part = x[:, edges[p] : edges[p + 1]]
                count[p] += np.bincount(codes[:, p], minlength=len(count[p]))
                np.add.at(total[p], codes[:, p], part)
        used = [(p, e) for p in range(shape.parts) for e in np.flatnonzero(count[p])]
        yield pa.record_batch(
            {
                "part": pa.array([p for p, _ in used], type=pa.int32()),
                "entry": pa.array([e for _, e in used], type=pa.int32()),
                "n": pa.array([count[p][e] for p, e in used], type=pa.int64()),
                "sums": pa.array([total[p][e].tolist() for p, e in used], type=pa.list_(pa.int64())),
            }
        )

    partial = rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    widest = int(np.diff(edges).max())
    # Wider than 64 bits, so that no number of rows overflows.
    sums = F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(28,0)")) for i in range(widest)])
    return {(r.part, r.entry): (r.n, [int(x) for x in r.sums if x is not None]) for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect()}


def _rows(df: DataFrame, id_column: str, vector_column: str, label_column: str | None = None) -> DataFrame:
    label = [F.col(quoted(label_column)).cast("string").alias("label")] if label_column else []
    return df.select(F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(vector_column)).alias("vector"), *label)


def train_codebooks(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Shape | None, Books]:
    """The codebooks: the parts of the vectors with the smallest ids, then means, rounded down, over all vectors in each round."""
    rows = _rows(df, id_column, vector_column)
    shape, start = _first(rows, entries, parts)
    if shape is None:
        return None, []
    edges = shape.edges
    books = [start[:, edges[p] : edges[p + 1]].copy() for p in range(parts)]
    for _ in range(rounds):
        for (p, e), (n, sums) in _totals(rows, shape, books).items():
            books[p][e] = [s // n for s in sums]
    return shape, books


def encode(df: DataFrame, shape: Shape, books: Books, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = None) -> DataFrame:
    """id, code (two hex digits for each part), error (squared distance over all parts) and, where named, label, of each kept row."""
    rows = _rows(df, id_column, vector_column, label_column)
    edges, sent = shape.edges, rows.sparkSession.sparkContext.broadcast([Search(b) for b in books])
    others = [c for c in rows.columns if c != "vector"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, x = _whole(b.column("vector"), shape)
            codes, error = _assigned(sent.value, edges, x)
            kept = {c: b.column(c).take(pa.array(at)) for c in others}
            yield pa.record_batch(kept | {"code": pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], type=pa.string()), "error": pa.array(error)})

    return rows.mapInArrow(run, "id long, " + ("label string, " if label_column else "") + "code string, error long")


def decode(codes: list[str], shape: Shape, books: Books) -> np.ndarray:
    """The vectors that codes stand for."""
    edges, out = shape.edges, np.empty((len(codes), shape.size))
    for i, c in enumerate(codes):
        step = len(c) // shape.parts
        for p in range(shape.parts):
            out[i, edges[p] : edges[p + 1]] = books[p][int(c[p * step : (p + 1) * step], 16)] / SCALE
    return out


def books_digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()


def compress(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error (error summed over all rows of the label, nulls together) and codebooks_sha256 of each kept row."""
    spark = df.sparkSession
    shape, books = train_codebooks(df, id_column=id_column, vector_column=vector_column, parts=parts, entries=entries, rounds=rounds)
    if not books:
        return spark.createDataFrame([], "id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = Scratch(spark, "vector-codes").save(encode(df, shape, books, id_column=id_column, vector_column=vector_column, label_column=label_column))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    salted = coded.select("*", F.pmod(F.col("_metadata.row_index"), F.lit(SALTS)).cast("int").alias("salt"))
    both = salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return both.select("id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
