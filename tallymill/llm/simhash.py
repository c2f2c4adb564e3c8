"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are routed by the pigeonhole rule: of radius + 2 bit blocks, two fingerprints within the radius agree on two at
least, so each fingerprint goes to one bucket for every pair of blocks. In a bucket the fingerprints are sorted by Gray
rank; runs of neighbours become nodes that hold the bits all of them share, upper nodes take the shared bits of lower ones,
and a search adds up differences from the root down and drops a whole node when they pass the radius. Nodes whose members are
already linked to the searching fingerprint are dropped too, so a large group of copies costs a spanning set of links, not
all its pairs.

Equal fingerprints are one node of the graph; the fingerprint of a text without words is zero and linked like any other.
Null ids: such rows get a fingerprint and the component of their fingerprint, never name a component, and have a null one if
no row of the component has an id. Rows that repeat an id or a text get their own results; texts of any length count whole, as all their
shingles are added up; an empty table gives no rows. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import cut, partitions, text_bytes
from tallymill.llm.xxh64 import xxh64_slices
from tallymill.operators.components import connected_components

U = np.uint64
#: Children of a node.
FAN = 8
#: Searching fingerprints in one step.
STEP = 4096
#: A bucket over this many fingerprints is dealt again by the blocks of its other bits.
BUCKET_ROWS = 1_000_000


def fingerprints(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """64 bits for each text: a bit is set if it is in over half the hashes of its shingles."""
    out = np.zeros(len(texts), dtype=U)
    clean = [b" ".join(t.lower().split()) for t in texts]
    for lo, hi in K.batches([len(t) for t in clean]):
        w = K.Words(clean[lo:hi])
        n = np.diff(w.bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        shingles = np.maximum(n[some] - words + 1, 1)
        first = K.spread(w.bounds[some], shingles)
        last = np.minimum(first + words, np.repeat(w.bounds[some + 1], shingles)) - 1
        h = xxh64_slices(w.data, w.starts[first], w.ends[last], seed)
        ones = _ones(h, np.concatenate(([0], np.cumsum(shingles)[:-1])))
        out[lo + some] = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(U)[:, 0]
    return out


def _ones(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit. Bytes are added up 128 at a time before they are widened."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    size = np.diff(np.append(starts, len(h)))
    pieces = -(-size // 128)
    at = K.spread(np.zeros(len(starts), dtype=np.int64), pieces) * 128 + np.repeat(starts, pieces)
    part = np.add.reduceat(bits, at, axis=0, dtype=np.uint8)
    return np.add.reduceat(part, np.concatenate(([0], np.cumsum(pieces)[:-1])), axis=0, dtype=np.int64)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    x = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(k)
    return x


class GrayIndex:
    """Many buckets at once: codes sorted by bucket, then by Gray rank; level 0 are runs of codes, the last level the buckets."""

    def __init__(self, buckets: np.ndarray, codes: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(codes), buckets))
        self.codes, own = codes[self.order], buckets[self.order]
        starts = K.group_starts(own)
        sizes = np.diff(np.append(starts, len(codes)))
        #: For each level: first child, children, shared mask, shared pattern.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        every, some = self.codes, self.codes
        while True:
            nodes = -(-sizes // FAN)
            first = K.spread(np.zeros(len(starts), dtype=np.int64), nodes) * FAN + np.repeat(starts, nodes)
            count = np.diff(np.append(first, len(every)))
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            mask = ~(every ^ some)
            self.levels.append((first, count, mask, every & mask))
            starts, sizes = np.concatenate(([0], np.cumsum(nodes)[:-1])), nodes
            if (nodes <= 1).all():
                break
        self.root = np.repeat(np.arange(len(nodes)), np.diff(np.append(K.group_starts(own), len(own))))
        #: Bits that a node shares but the node above does not: only these are compared there.
        for k in range(len(self.levels) - 2, -1, -1):
            first, count, mask, pattern = self.levels[k]
            up = self.levels[k + 1]
            self.levels[k] = (first, count, mask, pattern, mask & ~np.repeat(up[2], up[1]))
        self.levels[-1] = (*self.levels[-1], self.levels[-1][2])

    def links(self, radius: int) -> np.ndarray:
        """A label for each code in sorted order: the first position of all that links reach inside the buckets."""
        n = len(self.codes)
        label = np.arange(n)
        for lo in range(0, n, STEP):
            q = np.arange(lo, min(n, lo + STEP))
            whole = self._whole(label)
            node = self.root[q]
            spent = np.zeros(len(q), dtype=np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                first, count, _, pattern, own = self.levels[k]
                spent = spent + np.bitwise_count((self.codes[q] ^ pattern[node]) & own[node])
                go = (spent <= radius) & (whole[k][node] != label[q])
                q, node, spent = q[go], node[go], spent[go]
                kids = count[node]
                q, spent, node = np.repeat(q, kids), np.repeat(spent, kids), K.spread(first[node], kids)
            near = (node != q) & (label[node] != label[q])
            q, node = q[near], node[near]
            near = np.bitwise_count(self.codes[q] ^ self.codes[node]) <= radius
            label = _join(label, q[near], node[near])
        return label

    def _whole(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all its codes have, or -1."""
        out, low, high = [], label, label
        for first, *_ in self.levels:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append(np.where(low == high, low, -1))
        return out


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a - b: smallest label of each component, by hooking and pointer jumping."""
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of near-equal bit blocks."""
    edge = [round(i * bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _block_value(code: F.Column, shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def near_links(codes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between rows of (rep long, code long), one row per code, that connect all codes within the radius."""
    blocks = _blocks(64, radius + 2)
    routes = []
    for i, ((s1, w1), (s2, w2)) in enumerate(combinations(blocks, 2)):
        value = F.shiftleft(_block_value(F.col("code"), s1, w1), w2).bitwiseOR(_block_value(F.col("code"), s2, w2))
        rest = [b for b in blocks if b not in ((s1, w1), (s2, w2))]
        routes.append(F.struct(F.xxhash64(F.lit(i), value).alias("route"), F.array(*[F.xxhash64(F.lit(j), _block_value(F.col("code"), s, w)) for j, (s, w) in enumerate(_split(rest, radius + 1))]).alias("finer")))
    dealt = codes.select("rep", "code", F.explode(F.array(*routes)).alias("r")).select("rep", "code", F.col("r.route").alias("route"), F.col("r.finer").alias("finer"))
    # Buckets beyond the bound are dealt again: the rest of the bits has radius + 1 blocks, so a link keeps one whole.
    heavy = codes.select(F.explode(F.array(*[r["route"] for r in routes])).alias("route")).groupBy("route").count().where(F.col("count") > BUCKET_ROWS).select("route", F.lit(True).alias("heavy"))
    dealt = dealt.join(heavy, "route", "left")
    bucket = F.explode(F.when(F.col("heavy"), F.transform("finer", lambda x: F.xxhash64("route", x))).otherwise(F.array("route")))
    dealt = dealt.select("rep", "code", bucket.alias("bucket"))
    return dealt.repartition(partitions(codes.sparkSession), "bucket").mapInArrow(lambda it: _search(it, radius), "a long, b long").distinct()


def _split(rest: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """The bit blocks, the widest cut in two until there are so many."""
    rest = list(rest)
    while len(rest) < parts:
        s, w = max(rest, key=lambda b: b[1])
        rest.remove((s, w))
        rest += [(s, w // 2), (s + w // 2, w - w // 2)]
    return rest


def _search(it, radius: int):
    parts = [b for b in it if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    rep, code, bucket = (t.column(c).to_numpy() for c in ("rep", "code", "bucket"))
    # Buckets of one code cannot link.
    order = np.argsort(bucket, kind="stable")
    first = K.group_starts(bucket[order])
    size = np.diff(np.append(first, len(order)))
    order = order[np.repeat(size > 1, size)]
    if not len(order):
        return
    index = GrayIndex(bucket[order], code[order].view(U))
    label = index.links(radius)
    who = rep[order][index.order]
    linked = label != np.arange(len(label))
    yield from pa.table({"a": who[linked], "b": who[label[linked]]}).to_batches()


def _fingerprint_batches(it, words: int):
    for batch in it:
        f = fingerprints(batch.column("text").to_pylist(), words)
        yield pa.record_batch([batch.column("id"), pa.array(f.view(np.int64))], names=["id", "code"])


def near_groups(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, code, component) for each row: its fingerprint and the smallest id that links within the radius reach."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(F.col(text_column)).alias("text"))
    rows = cut(rows.mapInArrow(lambda it: _fingerprint_batches(it, words), "id long, code long"))
    # A fingerprint is its own node, so those of rows without an id link too; ids name the components afterwards.
    codes = cut(rows.groupBy("code").agg(F.min("id").alias("low")))
    links = near_links(codes.select(F.col("code").alias("rep"), "code"), radius)
    found = connected_components(links, "a", "b").select(F.col("node").alias("code"), F.col("component").alias("root"))
    placed = codes.join(found, "code", "left").select("code", "low", F.coalesce("root", "code").alias("root"))
    named = placed.groupBy("root").agg(F.min("low").alias("component"))
    mapped = placed.join(named, "root").select("code", "component")
    return rows.join(mapped, "code").select("id", "code", "component")


def fingerprint_hex(code: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
