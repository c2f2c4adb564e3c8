"""Interpolated modified Kneser-Ney language model of order three.

Counting. Every training text is a run of tokens, its words and one end, after two start marks. Tasks count their trigrams and
send them packed to shards by the last two words (salted by the last, so that a very common word does not fill one shard);
a shard then sees all trigrams that end in its bigrams, hence counts, continuation counts and the counts of counts. What a
word or a context needs from several shards travels as partial sums in a second exchange.

The model is a set of sorted hash arrays, one file for each table and shard in the shared folder, which workers map into
memory and search in sorted order:
  words     every training word: count, number of words before it, and its totals as a context
  bigrams   those seen twice or more: continuation count, count, and the discounted mass kept after them
  trigrams  those seen twice or more: count
  single_bigrams, single_trigrams  those seen once, as keys only
All counts cover every training text and grow with the input. What follows a context once needs no sum of its own: it is the
context's count without what follows it twice or more. With least=2 the single ones are counted but not stored, and their
whole mass goes to the lower order, as if their discount were 1.

Shards are counted in PASSES turns over the texts, so that the trigrams under way at once are a part of all; their partial
sums wait in scratch tables for the second exchange.

Identity: a word is 63 bits of its hash, the first word of a bigram or trigram 48 bits within the rest. Of a bigram's or
trigram's hash a shard keeps 40 bits beyond those that find its bucket of some 16.

The shared folder must be a file system that workers can map (file:); others raise an error.

Results in special cases: a null text is empty and has one token, its end; a null id counts as the empty id text; rows
that repeat are trained on as often as they occur; texts of any length count whole; without training texts, as in an empty
table, every token has probability one; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import Scratch, new_path, pack, partitions, text_bytes, unpack

U = np.uint64
START, END = U(1), U(2)
FIRST_BITS, LOW_BITS = U((1 << 48) - 1), U((1 << 32) - 1)
#: Turns in which shards are counted.
PASSES = 2
#: Tokens that a task counts together before it sends.
FLUSH = 2_500_000
WORDS, CONTEXTS, STATS = 0, 1, 2
SENT_SQL = "to int, kind int, load binary"


def pair_key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return K.mix((first & FIRST_BITS) * U(0x9E3779B97F4A7C15) + last * U(0xD6E8FEB86659FD93))


def triple_key(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    return K.mix(pair ^ ((first & FIRST_BITS) * U(0xC2B2AE3D27D4EB4F)))


@dataclass(frozen=True)
class Layout:
    path: str
    shards: int

    @property
    def salt(self) -> np.uint64:
        """A context word's bigrams lie in so many shards; a power of two."""
        return U((1 << max(0, (self.shards // 8).bit_length())) - 1)

    def pair_shard(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (K.mix((first & FIRST_BITS) + (last & self.salt) * U(0xA0761D6478BD642F)) >> U(32)).astype(np.int64) % self.shards

    def word_shard(self, word: np.ndarray) -> np.ndarray:
        return (K.mix(word) >> U(32)).astype(np.int64) % self.shards

    def file(self, table: str, shard: int) -> str:
        return f"{self.path}/{table}-{shard}"


def local_path(uri: str) -> str:
    found = re.match(r"(?:file:(?://)?)?(/.*)$", uri)
    if not found:
        raise ValueError(f"the model is mapped into memory by workers, which needs a mounted shared folder, not {uri}")
    return found[1]


def _save(path: str, *arrays: np.ndarray) -> None:
    """Whole or not at all; a repeated task writes the same."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(pack(*arrays))
    os.replace(part, path)


_CODES = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each value's number among them, in one or two bytes where they suffice."""
    distinct, code = np.unique(values, return_inverse=True)
    return distinct.astype(np.int64), code.astype(next(k for k in _CODES.values() if len(distinct) <= 1 << 8 * np.dtype(k).itemsize))


def _save_table(path: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    _save(path, keys, *_columns(columns))


def _columns(columns: list[np.ndarray]) -> list[np.ndarray]:
    coded = [_coded(c) for c in columns]
    return [*[d for d, _ in coded], np.array([c.dtype.itemsize for _, c in coded], dtype=np.int64), *[c.view(np.uint8) for _, c in coded]]


def _save_ngrams(path: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """Sorted keys in buckets by their first bits, 40 bits of the rest."""
    bits = max(1, (len(keys) // 16).bit_length())
    starts = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)).astype(np.uint32)
    rest = keys << U(bits) >> U(24)
    _save(path, starts, (rest & LOW_BITS).astype(np.uint32), (rest >> U(32)).astype(np.uint8), *_columns(columns))


class Table:
    """Sorted keys with coded columns in a mapped file."""

    def __init__(self, path: str, columns: int) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        arrays = unpack(raw, U, *[np.int64] * columns, np.int64, *[np.uint8] * columns)
        self.keys, self.values = arrays[0], arrays[1 : columns + 1]
        self._decode(arrays[columns + 1 :])

    def _decode(self, arrays: list[np.ndarray]) -> None:
        self.codes = [c.view(_CODES[int(size)]) for c, size in zip(arrays[1:], arrays[0], strict=True)]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, row) for keys, which are sorted."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def column(self, i: int, rows: np.ndarray) -> np.ndarray:
        return self.values[i][self.codes[i][rows]]


class Ngrams(Table):
    """A table whose keys are hashes in every bit, in short form."""

    def __init__(self, path: str, columns: int) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        arrays = unpack(raw, np.uint32, np.uint32, np.uint8, *[np.int64] * columns, np.int64, *[np.uint8] * columns)
        self.starts, self.low, self.high, self.values = *arrays[:3], arrays[3 : columns + 3]
        self.bits = U((len(self.starts) - 1).bit_length() - 1)
        self._decode(arrays[columns + 3 :])

    def __len__(self) -> int:
        return len(self.low)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self) or not len(keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        bucket, rest = (keys >> U(64) - self.bits).astype(np.int64), keys << self.bits >> U(24)
        lo, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        hi, last = end, len(self) - 1
        for _ in range(int((end - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self._rest(np.minimum(mid, last)) < rest)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.maximum(mid, lo))
        at = np.minimum(lo, last)
        return (lo < end) & (self._rest(at) == rest), at

    def _rest(self, rows: np.ndarray) -> np.ndarray:
        return self.low[rows].astype(U) | self.high[rows].astype(U) << U(32)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each with its end, and where each text's begin."""
    w = K.Words(texts)
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.empty(int(bounds[-1]), dtype=U)
    ends = np.zeros(len(out), dtype=bool)
    ends[bounds[1:] - 1] = True
    out[~ends] = w.hashes(fold=True) | U(4)
    out[ends] = END
    return out, bounds


def _before(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each, start marks at a text's beginning."""
    one = np.concatenate(([START], token[:-1]))
    one[bounds[:-1]] = START
    two = np.concatenate(([START, START], token[:-2]))[: len(token)]
    two[bounds[:-1]] = START
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = START
    return two, one


def _grouped(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct key tuples in order, and the sums of values. The first key orders first."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & LOW_BITS).astype(np.uint32), (x >> U(32)).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U) | high.astype(U) << U(32)


_TRIPLE = (U, np.uint32, U, np.uint32, np.uint32, np.uint16, np.uint32)


def _send_trigrams(parts: list[tuple[np.ndarray, ...]]):
    shard, a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    (shard, b, c, a), (n,) = _grouped([shard, b, c, a & FIRST_BITS], [np.ones(len(a), dtype=np.int64)])
    rows = []
    for lo, hi in K.runs(shard):
        # Runs: contexts, their last words, the words before with their counts.
        x, y = b[lo:hi], c[lo:hi]
        new_x = np.concatenate(([True], x[1:] != x[:-1]))
        new_y = new_x | np.concatenate(([True], y[1:] != y[:-1]))
        pair = np.flatnonzero(new_y)
        first = np.flatnonzero(new_x[pair])
        load = pack(x[pair[first]], np.diff(np.append(first, len(pair))).astype(np.uint32), y[pair], np.diff(np.append(pair, hi - lo)).astype(np.uint32), *_halves(a[lo:hi]), n[lo:hi].astype(np.uint32))
        rows.append((int(shard[lo]), 0, load))
    yield _batch(rows)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"to": pa.array([r[0] for r in rows], type=pa.int32()), "kind": pa.array([r[1] for r in rows], type=pa.int32()), "load": pa.array([r[2] for r in rows], type=pa.binary())})


def _count(it, layout: Layout, turn: int):
    """The trigrams of the shards whose turn it is."""
    held, size = [], 0
    for batch in it:
        texts = batch.column("text").to_pylist()
        for lo, hi in K.batches([len(t) for t in texts]):
            t, bounds = tokens(texts[lo:hi])
            two, one = _before(t, bounds)
            shard = layout.pair_shard(one, t).astype(np.int32)
            now = shard % PASSES == turn
            held.append(tuple(x[now] for x in (shard, two, one, t)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from _send_trigrams(held)
                held, size = [], 0
    if size:
        yield from _send_trigrams(held)


def _of_counts(n: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4; and at least 3."""
    c = np.bincount(np.minimum(n, 5), minlength=6)
    return np.array([c[1], c[2], c[3], c[4], c[3] + c[4] + c[5]], dtype=np.int64)


def _shard(layout: Layout, shard: int, t: pa.Table, least: int) -> pa.Table:
    """Writes a shard's trigrams and bigrams; sends on the sums that words and contexts need."""
    parts = []
    for load in t.column("load"):
        x, xn, y, yn, low, high, n = unpack(load.as_buffer(), *_TRIPLE)
        pair_of = np.repeat(np.arange(len(yn)), yn)
        parts.append((np.repeat(x, xn)[pair_of], y[pair_of], _whole(low, high), n.astype(np.int64)))
    b, c, a, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    (pair, a, b, c), (n,) = _grouped([pair_key(b, c), a, b, c], [n])
    three = _of_counts(n)
    first = K.group_starts(pair)
    types = np.diff(np.append(first, len(pair)))
    raw, pb, pc, pk = np.add.reduceat(n, first), b[first], c[first], pair[first]
    # After a start mark there is one word before at most: the count itself is used.
    follow = np.where(pb == START, raw, types)
    two = _of_counts(follow)
    stored = raw >= 2
    _save_ngrams(layout.file("bigrams", shard), pk[stored], [follow[stored], raw[stored]])
    kept = n >= 2
    tk = triple_key(pair[kept], a[kept])
    order = np.argsort(tk)
    _save_ngrams(layout.file("trigrams", shard), tk[order], [n[kept][order]])
    if least == 1:
        _save_ngrams(layout.file("single_bigrams", shard), pk[~stored], [])
        _save_ngrams(layout.file("single_trigrams", shard), np.sort(triple_key(pair[~kept], a[~kept])), [])

    rows = [(shard, STATS, pack(np.concatenate((three, two, [raw.sum(), len(pk)]))))]
    zero = np.zeros(len(pk), dtype=np.int64)
    big = follow >= 2
    words, sums = _grouped(
        [np.concatenate((pb, pc))],
        [
            np.concatenate((x, y))
            for x, y in ((follow, zero), (np.where(big, follow, 0), zero), ((follow == 2).astype(np.int64), zero), ((follow >= 3).astype(np.int64), zero), (zero, zero + 1), (zero, raw))
        ],
    )
    to = layout.word_shard(words[0])
    rows += _dealt(to, WORDS, [words[0]], sums)
    m = n[kept]
    ctx_first, ctx_last = a[kept], b[kept]
    (to, key), sums = _grouped([layout.pair_shard(ctx_first, ctx_last), pair_key(ctx_first, ctx_last)], [m, (m == 2).astype(np.int64), (m >= 3).astype(np.int64)])
    rows += _dealt(to, CONTEXTS, [key], sums)
    return pa.Table.from_batches([_batch(rows)])


def _dealt(to: np.ndarray, kind: int, keys: list[np.ndarray], sums: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    order = np.argsort(to, kind="stable")
    to = to[order]
    columns = [k[order] for k in keys] + [s[order] for s in sums]
    return [(int(to[lo]), kind, pack(columns[0][lo:hi], *[_coded_sums(c[lo:hi]) for c in columns[1:]])) for lo, hi in K.runs(to)]


def _coded_sums(x: np.ndarray) -> np.ndarray:
    """Sums as bytes of the narrowest width that holds them, the width first."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if not len(x) or x.max() <= np.iinfo(k).max)
    return np.concatenate((np.array([np.dtype(kind).itemsize], dtype=np.uint8), x.astype(kind).view(np.uint8)))


def _sums(x: np.ndarray) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[int(x[0])]
    return np.frombuffer(x[1:].tobytes(), dtype=kind).astype(np.int64)


def _merge(layout: Layout, shard: int, t: pa.Table) -> pa.Table:
    """Writes a shard's words, and the kept mass beside its bigrams; returns the shard's statistics."""
    words, contexts, stats = [], [], np.zeros(12, dtype=np.int64)
    for kind, load in zip(t.column("kind").to_pylist(), t.column("load"), strict=True):
        if kind == STATS:
            stats += unpack(load.as_buffer(), np.int64)[0]
        else:
            width = 6 if kind == WORDS else 3
            key, *sums = unpack(load.as_buffer(), U, *[np.uint8] * width)
            (words if kind == WORDS else contexts).append((key, *map(_sums, sums)))
    one, distinct = np.zeros(5, dtype=np.int64), 0
    keys, sums = np.empty(0, dtype=U), [np.empty(0, dtype=np.int64)] * 6
    if words:
        key, *values = (np.concatenate(x) for x in zip(*words, strict=True))
        (keys,), sums = _grouped([key], values)
        one, distinct = _of_counts(sums[4][sums[5] > 0]), int((sums[5] > 0).sum())
    _save_table(layout.file("words", shard), keys, sums)
    if os.path.exists(layout.file("bigrams", shard)):
        pairs = Ngrams(layout.file("bigrams", shard), 2)
        mass = [np.zeros(len(pairs), dtype=np.int64) for _ in range(3)]
        if contexts and len(pairs):
            key, *values = (np.concatenate(x) for x in zip(*contexts, strict=True))
            (key,), values = _grouped([key], values)
            same, at = pairs.find(key)
            for m, v in zip(mass, values, strict=True):
                m[at[same]] = v[same]
        _save_table(layout.file("contexts", shard), np.empty(0, dtype=U), mass)
    return pa.table({"shard": pa.array([shard], type=pa.int32()), "stats": pa.array([[*stats.tolist(), *one.tolist(), distinct]], type=pa.list_(pa.int64()))})


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n[:4]
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), float(k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


@dataclass(frozen=True)
class Model:
    layout: Layout
    #: Shards that have files.
    bigram_shards: frozenset[int]
    word_shards: frozenset[int]
    three: tuple[float, float, float]
    two: tuple[float, float, float]
    one: tuple[float, float, float]
    tokens: int
    vocabulary: int
    pairs: int
    #: Mass that the unigram discounts free.
    freed: float
    #: Bigrams and trigrams seen less often are not stored.
    least: int


def train(docs: DataFrame, *, text_column: str = "text", least: int = 1) -> Model:
    """Counts all rows of docs; least is 1 for all bigrams and trigrams, 2 to leave out those seen once."""
    spark = docs.sparkSession
    layout = Layout(local_path(new_path(spark, "kneser-ney")), partitions(spark))
    os.makedirs(layout.path)
    body = docs.select(text_bytes(F.col(text_column)).alias("text"))
    scratch = Scratch(spark, "kneser-ney-sums")

    def counted(turn: int) -> DataFrame:
        sent = body.mapInArrow(lambda it: _count(it, layout, turn), SENT_SQL)
        return scratch.save(sent.groupBy("to").applyInArrow(lambda key, t: _shard(layout, key[0].as_py(), t, least), SENT_SQL))

    sums = reduce(DataFrame.union, [counted(turn) for turn in range(PASSES)])
    # A row of 18 numbers for each shard.
    rows = sums.groupBy("to").applyInArrow(lambda key, t: _merge(layout, key[0].as_py(), t), "shard int, stats array<long>").collect()
    scratch.clear()
    total = np.sum([r.stats for r in rows], axis=0).tolist() if rows else [0] * 18
    three, two, (n, pairs), one, distinct = total[:5], total[5:10], total[10:12], total[12:17], total[17]
    d = discounts(one)
    freed = d[0] * one[0] + d[1] * one[1] + d[2] * one[4]
    files = os.listdir(layout.path)
    having = lambda name: frozenset(int(f.rpartition("-")[2]) for f in files if re.fullmatch(rf"{name}-\d+", f))
    of = lambda counts: discounts(counts) if least == 1 else (1.0, *discounts(counts)[1:])
    return Model(layout, having("bigrams"), having("words"), of(three), of(two), d, n, distinct, pairs, freed, least)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.m, self.open = model, {}

    def _table(self, name: str, shard: int, columns: int, kind: type[Table] = Table) -> Table:
        if (name, shard) not in self.open:
            self.open[name, shard] = kind(self.m.layout.file(name, shard), columns)
        return self.open[name, shard]

    def _single(self, name: str, shard: int, keys: np.ndarray, found: np.ndarray) -> np.ndarray:
        """1 for keys that were not found and are stored as seen once, else 0."""
        out = np.zeros(len(keys), dtype=np.int64)
        if self.m.least == 1:
            out[~found] = self._table(name, shard, 0, Ngrams).find(keys[~found])[0]
        return out

    def _lookup(self, shard: np.ndarray, key: np.ndarray, take, columns: int) -> list[np.ndarray]:
        """Columns for each key, 0 where it has none; take(shard, sorted keys) -> (found, columns)."""
        order = np.lexsort((key, shard))
        s, k = shard[order], key[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))[: len(k)]
        at = np.flatnonzero(new)
        us, uk = s[at], k[at]
        got = [np.zeros(len(at), dtype=np.int64) for _ in range(columns)]
        for lo, hi in K.runs(us):
            for g, v in zip(got, take(int(us[lo]), uk[lo:hi]), strict=True):
                g[lo:hi] = v
        spot = np.empty(len(k), dtype=np.int64)
        spot[order] = np.cumsum(new) - 1
        return [g[spot] for g in got]

    def _words(self, shard: int, keys: np.ndarray):
        if shard not in self.m.word_shards:
            return [0] * 6
        t = self._table("words", shard, 6)
        found, row = t.find(keys)
        return [np.where(found, t.column(i, row), 0) if len(t.keys) else 0 for i in range(6)]

    def _pairs(self, shard: int, keys: np.ndarray):
        if shard not in self.m.bigram_shards:
            return [0] * 5
        t, mass = self._table("bigrams", shard, 2, Ngrams), self._table("contexts", shard, 3)
        found, row = t.find(keys)
        once = self._single("single_bigrams", shard, keys, found)
        return [np.where(found, x.column(i, row), other) if len(t) else other for x, n, other in ((t, 2, once), (mass, 3, 0)) for i in range(n)]

    def _triples(self, shard: int, keys: np.ndarray):
        if shard not in self.m.bigram_shards:
            return [0]
        t = self._table("trigrams", shard, 1, Ngrams)
        found, row = t.find(keys)
        once = self._single("single_trigrams", shard, keys, found)
        return [np.where(found, t.column(0, row), once) if len(t) else once]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, tokens seen in training, base score and model score, both log10."""
        m, lay = self.m, self.m.layout
        t, bounds = tokens(texts)
        two, one = _before(t, bounds)
        count, types, *ctx = (lambda v: (v[5], v[4], *v[:4]))(self._lookup(lay.word_shard(t), t, self._words, 6))
        base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
        known = count > 0
        d = np.array((0.0, *m.one))
        p1 = (np.maximum(types - d[np.minimum(types, 3)], 0) / m.pairs if m.pairs else 0.0) + (m.freed / m.pairs if m.pairs else 1.0) / (m.vocabulary + 1)

        # The context is the token before, whose totals were just looked up; a start mark's are looked up once.
        mark = [x[0] for x in self._lookup(lay.word_shard(np.array([START])), np.array([START]), self._words, 6)]
        at_start = np.zeros(len(t), dtype=bool)
        at_start[bounds[:-1]] = True
        total, kept, n2, n3 = (np.where(at_start, mark[i], np.concatenate(([0], ctx[i][:-1]))) for i in range(4))
        shard, pair = lay.pair_shard(one, t), pair_key(one, t)
        follow, raw, mass, m2, m3 = self._lookup(shard, pair, self._pairs, 5)
        d = np.array((0.0, *m.two))
        safe = np.maximum(total, 1)
        top = follow - d[np.minimum(follow, 3)]
        left = np.where(total > 0, (m.two[0] * (total - kept) + m.two[1] * n2 + m.two[2] * n3) / safe, 1.0)
        p2 = np.where(total > 0, top / safe, 0.0) + left * p1

        (n,) = self._lookup(shard, triple_key(pair, two), self._triples, 1)
        # The context pair is the pair before; that of a first token is two start marks, of a second token the first's pair.
        (sf, sr, sm, s2, s3) = (x[0] for x in self._lookup(lay.pair_shard(np.array([START]), np.array([START])), pair_key(np.array([START]), np.array([START])), self._pairs, 5))
        before = lambda x, s: np.where(at_start, s, np.concatenate(([0], x[:-1])))
        raw, mass, m2, m3 = before(raw, sr), before(mass, sm), before(m2, s2), before(m3, s3)
        d = np.array((0.0, *m.three))
        safe = np.maximum(raw, 1)
        top = np.where(raw > 0, (n - d[np.minimum(n, 3)]) / safe, 0.0)
        left = np.where(raw > 0, (m.three[0] * (raw - mass) + m.three[1] * m2 + m.three[2] * m3) / safe, 1.0)
        p3 = top + left * p2
        start = bounds[:-1]
        return np.diff(bounds), np.add.reduceat(known.astype(np.int64), start), np.add.reduceat(base, start), np.add.reduceat(np.log10(p3), start)


def _score(it, model: Model):
    scorer = Scorer(model)
    for batch in it:
        texts = batch.column("text").to_pylist()
        parts = [scorer.score(texts[lo:hi]) for lo, hi in K.batches([len(t) for t in texts])]
        n, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0)] * 4
        yield pa.record_batch([batch.column("id"), batch.column("held_out"), pa.array(n, type=pa.int64()), pa.array(known, type=pa.int64()), pa.array(base, type=pa.float64()), pa.array(score, type=pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 7, held_fold: int = 2, least: int = 1) -> DataFrame:
    """Every row's scores by a model of the rows whose crc32 of the id modulo folds is not held_fold; least as in train."""
    held = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    rows = docs.select(F.col(id_column).cast("long").alias("id"), held.alias("held_out"), F.col(text_column).alias("text"))
    model = train(rows.where(~F.col("held_out")), text_column="text", least=least)
    out = rows.select("id", "held_out", text_bytes(F.col("text")).alias("text")).mapInArrow(lambda it: _score(it, model), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
