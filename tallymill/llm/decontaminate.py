"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item becomes windows of `window` consecutive words (a shorter item is one window). A window's set are its word
shingles; a text contains the window only if it has every shingle, so one necessary prefix token is enough: the shingle that
is rarest over all documents. The document frequencies are counted in a first pass over every document. In the second pass a
document's shingles meet the prefix tokens; length and position bounds drop candidates that would start before the text or
end after it, and the window's words are compared one by one.

The benchmark side travels to the tasks in blocks of bounded size (`BLOCK_BYTES` of item text). A larger benchmark is run block by block
over all documents; one block at a time is on the driver, its hits are written to the shared folder once for each text that has some, and
are united at the end, so neither a broadcast nor the driver's memory grows with it.

Results in special cases: null or empty texts have no words and no hits; items without words are skipped; an item with a null
id hits words but is not among the items; repeated items and ids count once; repeated documents each get their own row; a very long
text is one row like any other; without items no word is hit, and without documents there are no rows; other columns may have any name
and type.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import Scratch, in_rest, loosened, text_bytes, texts_of, whole_row, with_rest

BLOCK_BYTES = 4 << 20
#: Rows of one text meet its hits in this many places.
SALTS = 64
#: Words of a shingle; an item shorter than that is its own shingle.
SHINGLE = 3
U = np.uint64
_KEEP = bytes(i if not K.PUNCTUATION[i] else 32 for i in range(256)).translate(K.FOLD)


@dataclass
class Block:
    """Benchmark windows as runs of word numbers, by length."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: For each window its words' numbers, and the items that have it.
    windows: dict[tuple[int, ...], list] = field(default_factory=dict)

    def add(self, item, text: bytes) -> None:
        words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.translate(_KEEP).split()]
        size = min(self.window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            who = self.windows.setdefault(tuple(words[i : i + size]), [])
            if item is not None and item not in who:
                who.append(item)

    def shingles(self) -> dict[tuple[int, ...], int]:
        """Every shingle of every window, numbered."""
        out: dict[tuple[int, ...], int] = {}
        for w in self.windows:
            k = min(SHINGLE, len(w))
            for i in range(len(w) - k + 1):
                out.setdefault(w[i : i + k], len(out))
        return out


class Matcher:
    """Finds word shingles in batches of documents: word numbers, then exact keys in base vocabulary + 1."""

    def __init__(self, block: Block, shingles: list[tuple[int, ...]]) -> None:
        self.base = len(block.vocabulary) + 1
        assert self.base**SHINGLE < 1 << 63, "a block has too many words"
        known, self.seed = K.Words([b" ".join(block.vocabulary)]), 0
        # No two words of a block share a hash: the seed rises until all differ.
        while len(np.unique(h := known.hashes(seed=self.seed))) < len(h):
            self.seed += 1
        order = np.argsort(h)
        #: Sorted hashes of the vocabulary, to number a document's words as arrays; equality is then checked on the bytes.
        self.hashes, self.number, self.spelling = h[order], order, list(block.vocabulary)
        self.tables = []
        for k in sorted({len(s) for s in shingles}):
            ids = np.array([i for i, s in enumerate(shingles) if len(s) == k])
            keys = np.array([self._key(s) for s in shingles if len(s) == k], dtype=np.int64)
            by = np.argsort(keys)
            self.tables.append((k, keys[by], ids[by]))

    def _key(self, s: tuple[int, ...]) -> int:
        out = 0
        for w in s:
            out = out * self.base + w
        return out

    def numbers(self, w: K.Words) -> np.ndarray:
        """Each word's number in the vocabulary, or -1."""
        h = w.hashes(fold=True, seed=self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], -1)

    def found(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, first word) of each occurrence."""
        hit_s, hit_at = [], []
        for k, keys, ids in self.tables:
            m = len(numbers) - k + 1
            if m <= 0:
                continue
            ok = K.same_doc(bounds, k, len(numbers))
            for j in range(k):
                ok &= numbers[j : j + m] >= 0
            at = np.flatnonzero(ok)
            key = np.zeros(len(at), dtype=np.int64)
            for j in range(k):
                key = key * self.base + numbers[at + j]
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[where] == key
            hit_s.append(ids[where[same]])
            hit_at.append(at[same])
        if not hit_s:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(hit_s), np.concatenate(hit_at)


def _count(it, block: Block):
    """(shingle, documents that have it) for each task."""
    shingles = list(block.shingles())
    match, total = Matcher(block, shingles), np.zeros(len(shingles), dtype=np.int64)
    for batch in it:
        texts = batch.column("text").to_pylist()
        for lo, hi in K.batches([len(t) for t in texts]):
            w = K.Words(texts[lo:hi], K.PUNCTUATION)
            s, at = match.found(match.numbers(w), w.bounds)
            doc = np.searchsorted(w.bounds, at, side="right") - 1
            both = np.unique(doc * len(shingles) + s)
            total += np.bincount(both % len(shingles), minlength=len(shingles))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["shingle", "docs"])


@dataclass
class Prefixes:
    """For each window its rarest shingle, where in the window that is, and the window's words."""

    shingles: list[tuple[int, ...]]
    #: Candidates of a shingle: first[s] to first[s + 1].
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    words: np.ndarray
    width: np.ndarray


def _prefixes(block: Block, docs: dict[int, int]) -> Prefixes:
    ids = block.shingles()
    chosen: dict[int, list[tuple[int, int]]] = defaultdict(list)
    wide = max(len(w) for w in block.windows)
    words = np.full((len(block.windows), wide), -2, dtype=np.int64)
    for n, w in enumerate(block.windows):
        k = min(SHINGLE, len(w))
        words[n, : len(w)] = w
        _, s, o = min((docs.get(ids[w[i : i + k]], 0), ids[w[i : i + k]], i) for i in range(len(w) - k + 1))
        chosen[s].append((n, o))
    used = sorted(chosen)
    every = list(ids)
    flat = [x for s in used for x in chosen[s]]
    return Prefixes(
        [every[s] for s in used],
        np.concatenate(([0], np.cumsum([len(chosen[s]) for s in used]))),
        np.array([n for n, _ in flat]),
        np.array([o for _, o in flat]),
        words,
        np.array([len(w) for w in block.windows]),
    )


def _occurrences(p: Prefixes, match: Matcher, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a batch."""
    numbers = match.numbers(w)
    s, at = match.found(numbers, w.bounds)
    many = p.first[s + 1] - p.first[s]
    cand = K.spread(p.first[s], many)
    win, begin = p.window[cand], np.repeat(at, many) - p.offset[cand]
    doc = np.searchsorted(w.bounds, np.repeat(at, many), side="right") - 1
    # Position and length bounds: the window lies in the document.
    ok = (begin >= w.bounds[doc]) & (begin + p.width[win] <= w.bounds[doc + 1])
    win, begin = win[ok], begin[ok]
    for j in range(p.words.shape[1]):
        ok = (j >= p.width[win]) | (numbers[np.minimum(begin + j, len(numbers) - 1)] == p.words[win, j])
        win, begin = win[ok], begin[ok]
    if len(win):  # the numbers came by hash: the words themselves, once for each window and spelling
        same = np.array([all(w.data[w.starts[b + j] : w.ends[b + j]].lower() == match.spelling[p.words[n, j]] for j in range(p.width[n])) for n, b in zip(win.tolist(), begin.tolist(), strict=True)])
        win, begin = win[same], begin[same]
    return win, begin




def _scan(it, block: Block, docs: dict[int, int], carry: list[str], text_column: str):
    p = _prefixes(block, docs) if block.windows else None
    match = Matcher(block, p.shingles) if p else None
    names, owners = [], []
    if p:
        owners = list(block.windows.values())
        names = sorted({str(i) for o in owners for i in o})
    number = {n: i for i, n in enumerate(names)}
    owned = [[number[str(i)] for i in o] for o in owners]
    for batch in it:
        texts = texts_of(batch, text_column)
        n_words, n_hit, items = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), [[] for _ in texts]
        spans: list[list] = [[] for _ in texts]
        for lo, hi in K.batches([len(t) for t in texts]):
            w = K.Words(texts[lo:hi], K.PUNCTUATION)
            n_words[lo:hi] = np.diff(w.bounds)
            if not p:
                continue
            win, begin = _occurrences(p, match, w)
            if not len(win):
                continue
            total = np.concatenate(([0], np.cumsum(K.hit_words(len(w), begin, p.width[win]))))
            n_hit[lo:hi] = total[w.bounds[1:]] - total[w.bounds[:-1]]
            doc = np.searchsorted(w.bounds, begin, side="right") - 1
            for d in np.unique(doc):
                mine = doc == d
                items[lo + d] = [names[i] for i in sorted({i for n in np.unique(win[mine]) for i in owned[n]})]
                spans[lo + d] = [{"first": int(a), "size": int(b)} for a, b in sorted(set(zip((begin[mine] - w.bounds[d]).tolist(), p.width[win[mine]].tolist(), strict=True)))]
        got = {c: batch.column(c) for c in carry if c != "rest"}
        got |= {"n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "items": pa.array(items, type=pa.list_(pa.string())), "spans": pa.array(spans, type=pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())])))}
        yield pa.record_batch(got | ({"rest": loosened(batch.column("rest"))} if "rest" in carry else {}))


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, window: int):
    """The benchmark in blocks of bounded size, read one partition at a time."""
    block, size = Block(window), 0
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), text_bytes(F.col(text_column)).alias("text")).distinct()
    for r in rows.toLocalIterator():
        if size and size + len(r.text) > BLOCK_BYTES:
            yield block
            block, size = Block(window), 0
        block.add(r.item, bytes(r.text))
        size += len(r.text)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = 13, keep_columns: bool = False) -> DataFrame:
    """For each document: id, n_words, n_hit (words inside an occurrence of a benchmark window), items (sorted ids as strings)
    and spans (first word and size of each occurrence). keep_columns: also `rest`, a struct of the input's columns."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(F.col(text_column)).alias("text"), *([whole_row(docs)] if keep_columns else []))
    carry = ["id", *(["rest"] if keep_columns else [])]
    slim = rows.drop("text") if keep_columns and in_rest(docs, text_column) else rows
    fields = "id long, n_words long, n_hit long, items array<string>, spans array<struct<first:bigint,size:bigint>>"
    blocks = _blocks(benchmark, item_column, item_text, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        seen = _frequencies(rows, first)
        return slim.mapInArrow(lambda it: _scan(it, first, seen, carry, text_column), with_rest(fields, docs) if keep_columns else fields)
    # Several blocks: one at a time is on the driver, and what is kept of it are the texts that it hits, once each.
    scratch = Scratch(docs.sparkSession, "contamination")
    texts = rows.select(F.sha2("text", 256).alias("digest"), "text")
    found = None
    for block in chain((first, second), blocks):
        if block.windows:
            seen = _frequencies(texts, block)
            hits = texts.mapInArrow(lambda it, b=block, seen=seen: _scan(it, b, seen, ["digest"], "text"), fields.replace("id long", "digest string"))
            some = scratch.save(hits.where("n_hit > 0").select("digest", "items", "spans").dropDuplicates(["digest"]))
            found = some if found is None else found.unionByName(some)
    none = Block(window)
    counted = rows.withColumn("digest", F.sha2("text", 256)).drop("text") if slim is not rows else rows.withColumn("digest", F.sha2("text", 256))
    wide = "digest string, " + fields
    counted = counted.mapInArrow(lambda it: _scan(it, none, {}, ["digest", *carry], text_column), with_rest(wide, docs) if keep_columns else wide)
    if found is None:
        return counted.drop("digest")
    return _united(counted, found, carry)


def _frequencies(rows: DataFrame, block: Block) -> dict[int, int]:
    """In how many documents each shingle of the block is: as many counts as the block has shingles, whatever the number of documents."""
    if not block.windows:
        return {}
    counts = rows.select("text").mapInArrow(lambda it: _count(it, block), "shingle long, docs long")
    return {r.shingle: r.docs for r in counts.groupBy("shingle").agg(F.sum("docs").alias("docs")).collect()}


def _united(counted: DataFrame, found: DataFrame, carry: list[str]) -> DataFrame:
    """Each row with the hits of all blocks on its text; words that several cover count once. The rows of a frequent text meet its hits
    in SALTS places."""
    merged = found.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    reach = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["first"] + s["size"] - F.greatest(a["end"], s["first"]))).alias("n"), F.greatest(a["end"], s["first"] + s["size"]).alias("end")),
        lambda a: a["n"],
    )
    hits = merged.select(F.col("digest").alias("of"), reach.alias("hit"), F.col("items").alias("all_items"), F.col("spans").alias("all_spans"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    both = salted.join(hits, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("at")), "left")
    return both.select(*carry, "n_words", F.coalesce("hit", "n_hit").alias("n_hit"), F.coalesce("all_items", "items").alias("items"), F.coalesce("all_spans", "spans").alias("spans"))
