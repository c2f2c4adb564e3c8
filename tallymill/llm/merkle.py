"""Merkle manifest of a table: a digest of each row, a tree over each group's rows, a tree over the groups, and a proof for each row.

A tree is built bottom-up by events. A node's digest is an event at its parent: partial parents collect their children's digests by
index, as the combiners of a combineByKey do, until as many are there as the sizes of the tree ask for (a run's last parent has
fewer); then the parent is complete, its digest is the next event, and so on as far up as the rows at hand allow. Tasks do that over
their own rows first, which lie side by side in the order of the leaves, so only the edges of each range are left: a frontier of a few
nodes a level. Frontiers are shuffled to aligned blocks of the tree, where partial parents of different ranges meet; blocks get
wider by a fixed factor each round, so that no task sees more than some hundred frontiers, until every group has its root.

Proofs go the other way, along reverse links: who is told the siblings above a node tells them to the children, each with its own
siblings before. Blocks tell the ranges below, ranges their rows. Every row's digest is then folded up its proof again.

H is the lowercase hex SHA-256 of its inputs, one after the other, digests as hex text. A field is `-` if null, else its size in UTF-8
bytes, `:` and its value; integers are decimal.

Order and special cases: groups ascend bytewise, null first; rows of a group ascend by id, null first, rows of one id by their leaf's
digest, and equal rows have equal proofs up to their place; a group of one row is its leaf; a table of one group has its subroot as root;
an empty table gives no rows; texts of any length count whole; columns beyond the named ones are not read, whatever their names.
A null id is never tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.llm.runtime import Scratch, quoted

ARITY = 2
#: Leaves that one range holds.
RANGE_ROWS = 100_000
#: A round's blocks are so many times as wide as what they unite.
WIDEN = 512
HEX = 64


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def run_size(n: int, index: int, arity: int) -> int:
    """How many of a level's n nodes share the parent of this one."""
    return min(arity, n - index // arity * arity)


class Combiner:
    """Partial parents of one group; a node is (level, index)."""

    def __init__(self, total: int, arity: int, keep: bool = False) -> None:
        self.arity, self.keep = arity, keep
        self.sizes = [total]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // arity))
        #: Children so far of the parents that are not complete: by slot.
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        #: Children of the complete ones, for reverse links.
        self.links: dict[tuple[int, int], list[str]] = {}
        self.top: str | None = None

    def put(self, level: int, index: int, digest: str) -> None:
        """A node's digest is known; so may be its ancestors'."""
        while self.sizes[level] > 1:
            parent, slot = (level + 1, index // self.arity), index % self.arity
            children = self.open.setdefault(parent, {})
            children[slot] = digest
            if len(children) < run_size(self.sizes[level], index, self.arity):
                return
            del self.open[parent]
            run = [children[i] for i in sorted(children)]
            if self.keep:
                self.links[parent] = run
            (level, index), digest = parent, digest_of(*run)
        self.top = digest

    def frontier(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, digest) of the nodes whose parent is not complete, or of the root."""
        if self.top is not None:
            yield len(self.sizes) - 1, 0, self.top
        for (level, index), children in self.open.items():
            for slot, digest in children.items():
                yield level - 1, index * self.arity + slot, digest

    def above(self, level: int, index: int, told: dict[tuple[int, int], str], memo: dict[tuple[int, int], str]) -> str:
        """The siblings from a node to the root: told at some ancestor, found by links below it. High nodes are remembered."""
        climb, path = [], None
        while path is None:
            path = told.get((level, index), memo.get((level, index)))
            if path is None:
                parent, slot = (level + 1, index // self.arity), index % self.arity
                run = self.links[parent]
                climb.append((level, index, "".join(run[:slot] + run[slot + 1 :])))
                level, index = parent
        for level, index, own in reversed(climb):
            path = own + path
            if level >= 6:
                memo[level, index] = path
        return path


def fold(digest: str, index: int, total: int, proof: str, at: int = 0, arity: int = ARITY) -> tuple[str, int]:
    """The root that a node's digest and its proof from place `at` lead to, and where the rest of the proof begins."""
    while total > 1:
        more, slot = HEX * (run_size(total, index, arity) - 1), index % arity * HEX
        own = proof[at : at + more]
        digest, at = digest_of(own[:slot], digest, own[slot:]), at + more
        index, total = index // arity, -(-total // arity)
    return digest, at


NODES = "group string, total long, level int, index long, digest binary, src long"


def _nodes(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])


def _columns(t: pa.Table | pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(t.column(n).to_pylist() for n in names), strict=True)


def _combined(t: pa.Table, src: int, arity: int) -> pa.Table:
    """One block of one group: what its nodes make, and what stays open."""
    group, total = t.column("group")[0].as_py(), t.column("total")[0].as_py()
    c = Combiner(total, arity)
    for level, index, digest in _columns(t, "level", "index", "digest"):
        c.put(level, index, digest.hex())
    return _nodes([(group, total, level, index, bytes.fromhex(digest), src) for level, index, digest in c.frontier()])


class Forest:
    """Trees over the digests of each group of rows, in the order of `order`.

    rows: group (string, not null), digest (binary, the leaf) and other columns, which leaves() keeps.
    """

    def __init__(self, rows: DataFrame, order: list[str], scratch: Scratch, arity: int = ARITY, range_rows: int = RANGE_ROWS, widen: int = WIDEN) -> None:
        self.scratch, self.arity = scratch, arity
        stored = scratch.save(rows)
        ranges = max(1, -(-stored.count() // range_rows))
        keys = ["group", *order]
        dealt = scratch.save(stored.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys))
        # A file is a range; a row's place in it and the rows of the group in earlier files give its index.
        placed = dealt.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("place"))
        cells = placed.groupBy("group", "file").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        w = Window.partitionBy("group")
        before = F.sum("n").over(w.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        self.cells = scratch.save(cells.select("group", "file", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total")))
        self.leaves = placed.join(self.cells, ["group", "file"]).withColumn("index", F.col("place") + F.col("shift")).drop("place", "shift")
        self.most = self.cells.agg(F.max("total")).first()[0] or 0
        self.spans = self._spans(range_rows, widen)
        self.rounds: list[DataFrame] = []

    def _spans(self, range_rows: int, widen: int) -> list[int]:
        """Leaves under the blocks of each round: powers of the arity, the last over every group's whole tree."""
        out, span = [], 1
        while not out or out[-1] < self.most:
            least = (out[-1] if out else range_rows) * widen
            while span < least:
                span *= self.arity
            out.append(span)
        return out

    def _block(self, span: int) -> Column:
        start = F.col("index") * F.pow(F.lit(float(self.arity)), F.col("level")).cast("long")
        return F.floor(start / F.lit(span)).cast("long") if span < 1 << 50 else F.lit(0).cast("long")

    def roots(self) -> DataFrame:
        """(group, total, digest) of each group's root."""
        arity = self.arity

        def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[str, int], Combiner] = {}
            for b in it:
                for group, file, total, index, digest in _columns(b, "group", "file", "total", "index", "digest"):
                    c = found.get((group, file))
                    if c is None:
                        c = found[group, file] = Combiner(total, arity)
                    c.put(0, index, digest.hex())
            rows = [(g, c.sizes[0], level, index, bytes.fromhex(d), f) for (g, f), c in found.items() for level, index, d in c.frontier()]
            yield from _nodes(rows).to_batches()

        nodes = self.leaves.select("group", "file", "total", "index", "digest").mapInArrow(ranges, NODES)
        for span in self.spans:
            self.rounds.append(self.scratch.save(nodes).withColumn("block", self._block(span)))
            nodes = self.rounds[-1].groupBy("group", "block").applyInArrow(lambda key, t: _combined(t, key[1].as_py(), arity), NODES)
        return self.scratch.save(nodes).select("group", "total", "digest")

    def down(self, tops: DataFrame, finish: Callable[[pa.Table, list[str], dict], pa.Table], fields: str) -> DataFrame:
        """finish(a range's leaves, each one's siblings up to the root of all, the columns of its group's row in tops) for every range.

        tops: group, path (the siblings above the group's root) and columns that every leaf of the group is told.
        """
        told = [c for c in tops.columns if c not in ("group", "path")]
        kinds = ", ".join(f"{c} {tops.schema[c].dataType.simpleString()}" for c in told)
        given = f"group string, level int, index long, src long, path string, {kinds}"
        arity = self.arity

        def pass_on(key, nodes: pa.Table, paths: pa.Table) -> pa.Table:
            c, above = _resolved(nodes, paths, arity)
            memo: dict = {}
            path = [c.above(level, index, above, memo) for level, index in _columns(nodes, "level", "index")]
            out = {n: nodes.column(n) for n in ("group", "level", "index", "src")}
            return pa.table(out | {"path": pa.array(path, type=pa.string())} | {n: pa.array([paths.column(n)[0].as_py()] * len(path), type=paths.schema.field(n).type) for n in told})

        def last(key, leaves: pa.Table, paths: pa.Table) -> pa.Table:
            c, above = _resolved(leaves, paths, arity)
            memo: dict = {}
            path = (c.above(0, index, above, memo) for (index,) in _columns(leaves, "index"))
            return finish(leaves, path, {n: paths.column(n)[0].as_py() for n in told})

        heights = F.lit(-1)  # the root of a group, whatever its height
        paths = tops.select("group", heights.alias("level"), F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("src"), "path", *told)
        for nodes in reversed(self.rounds):
            paths = self.scratch.save(nodes.groupBy("group", "block").cogroup(paths.groupBy("group", "src")).applyInArrow(pass_on, given))
        return self.leaves.groupBy("group", "file").cogroup(paths.groupBy("group", "src")).applyInArrow(last, fields)


def _resolved(nodes: pa.Table, paths: pa.Table, arity: int) -> tuple[Combiner, dict[tuple[int, int], str]]:
    """The links among nodes (leaves, if they have no level), and the siblings told above them."""
    c = Combiner(nodes.column("total")[0].as_py(), arity, keep=True)
    level = nodes.column("level").to_pylist() if "level" in nodes.column_names else [0] * nodes.num_rows
    for n, (index, digest) in zip(level, _columns(nodes, "index", "digest"), strict=True):
        c.put(n, index, digest.hex())
    above = {(len(c.sizes) - 1 if n < 0 else n, i): p for n, i, p in _columns(paths, "level", "index", "path")}
    return c, above


def leaf_digest(*columns: Column) -> Column:
    """H of a row's fields, on the JVM."""
    fields = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROVED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(leaves: pa.Table, paths: Iterator[str], told: dict) -> pa.Table:
    """Each row's proof, and the root that its present digest folds to."""
    total, proofs, folded = leaves.column("total")[0].as_py(), [], []
    for path, (index, present) in zip(paths, _columns(leaves, "index", "present"), strict=True):
        subroot, at = fold(present.hex(), index, total, path)
        folded.append(fold(subroot, told["place"], told["groups"], path, at)[0])
        proofs.append(digest_of(path))
    n = leaves.num_rows
    return pa.table(
        {
            "id": leaves.column("id"),
            "leaf": pa.array([d.hex() for d in leaves.column("digest").to_pylist()], type=pa.string()),
            "subroot": pa.array([told["subroot"]] * n, type=pa.string()),
            "root": pa.array([told["root"]] * n, type=pa.string()),
            "proof_sha256": pa.array(proofs, type=pa.string()),
            "folded_root": pa.array(folded, type=pa.string()),
            "verified": pa.array([f == told["root"] for f in folded], type=pa.bool_()),
        }
    )


def _above_groups(subroots: pa.Table, paths: Iterator[str], told: dict) -> pa.Table:
    """What every group is told: the siblings above its root, its place among the groups and the root of all."""
    n = subroots.num_rows
    return pa.table(
        {
            "group": subroots.column("name"),
            "path": pa.array(list(paths), type=pa.string()),
            "subroot": pa.array([d.hex() for d in subroots.column("digest").to_pylist()], type=pa.string()),
            "root": pa.array([told["root"]] * n, type=pa.string()),
            "place": subroots.column("index"),
            "groups": subroots.column("total"),
        }
    )


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", group_column: str = "lang", present: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS, widen: int = WIDEN) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    fields: the columns that a leaf is of, in order. present: columns whose values differ from the recorded ones by the time rows
    are verified, as expressions over docs; without it rows are verified as they are.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    recorded = {c: F.col(quoted(c)) for c in fields}
    name = F.when(F.col(quoted(group_column)).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(quoted(group_column)).cast("string")))
    rows = docs.select(
        name.alias("group"),
        F.col(quoted(id_column)).cast("long").alias("id"),
        leaf_digest(*recorded.values()).alias("digest"),
        leaf_digest(*(recorded | (present or {})).values()).alias("present"),
    )
    forest = Forest(rows, ["id", "digest"], scratch, range_rows=range_rows, widen=widen)
    subroots = forest.roots().select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    over = Forest(subroots, ["name"], scratch, range_rows=range_rows, widen=widen)
    root = over.roots().select("group", F.lit("").alias("path"), F.lower(F.hex("digest")).alias("root"))
    tops = scratch.save(over.down(root, _above_groups, "group string, path string, subroot string, root string, place long, groups long"))
    return forest.down(tops, _proved, PROVED)


def tampered(id_column: str = "doc_id", size_column: str = "n_chars") -> dict[str, Column]:
    """A size that is one more where 7 divides the CRC-32 of the decimal id."""
    key, size = F.col(quoted(id_column)), F.col(quoted(size_column))
    hit = F.coalesce(F.crc32(key.cast("long").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return {size_column: F.when(hit, size + 1).otherwise(size)}
