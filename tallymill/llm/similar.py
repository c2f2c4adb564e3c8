"""Near-duplicates by fingerprint and by verified similarity of shingle sets, complete over all pairs of different texts.

A fingerprint within a few bits finds copies with an odd word changed; texts of similarity 0.8 on five-word shingles are often
ten bits apart. So the links of the SimHash index are joined by an exact set join, and components are those of all links.

A form is what texts of equal words have in common: a fingerprint and a set of shingles. Forms, not ids, are the nodes, so rows
that repeat an id with another text are judged by their text.
  prefix   the rarest hashes of a set, so many that two sets alike by `least` share one, in one order for all sets: how often
           hashes with the same last bits occur, then the hash
  stars    in each shared prefix hash, every form with a few others there
  pairs    after those links, all forms of different components that share a prefix hash
Sizes, and the places of the shared hash in both prefixes, bound the overlap; what passes is verified on the whole sets. The
last search misses no pair, and families of near copies are one component by then. Its work grows with the square of a family
only where many texts of one size share their rarest hashes and stars have not linked them.

Results in special cases: a null text is empty; texts without words have fingerprint zero and are linked to each other; a text
of fewer words than a shingle is its own shingle; rows without an id are copies of nothing and all stay; of rows equal in id
and text one stays, the one whose columns hash lowest; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import Scratch, text_bytes, whole_row
from tallymill.llm.simhash import fingerprints, near_links
from tallymill.operators.components import connected_components

U = np.uint64
#: Counters of the order of hashes; a power of two.
COUNTERS = 1 << 20


def _shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes."""
    out = []
    for lo, hi in K.batches([len(t) for t in texts]):
        w = K.Words(texts[lo:hi])
        h = w.hashes(fold=True)
        win = K.window_hashes(h, words)
        first, end = w.bounds[:-1], w.bounds[1:]
        brief = np.flatnonzero((end > first) & (end - first < words))
        whole = dict(zip(brief.tolist(), K.sequence_hashes(h, first[brief], end[brief]), strict=True))
        for i, (a, b) in enumerate(zip(first, end, strict=True)):
            out.append(np.unique(win[a : b - words + 1]) if b - a >= words else np.array([whole[i]] if i in whole else [], dtype=U))
    return out


def _loads(it, words: int):
    """How often a task's shingle hashes have the same last bits."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in it:
        texts = batch.column("text").to_pylist()
        for lo, hi in K.batches([len(t) for t in texts]):
            w = K.Words(texts[lo:hi])
            win = K.window_hashes(w.hashes(fold=True), words)[K.same_doc(w.bounds, words, len(w))]
            total += np.bincount((win & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    cuts = total.astype(np.uint32).reshape(16, -1)
    yield pa.record_batch([pa.array(range(16), type=pa.int32()), pa.array([c.tobytes() for c in cuts], type=pa.binary())], names=["place", "load"])


def _added(key, t):
    total = sum(np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(np.int64) for x in t.column("load"))
    return pa.table({"place": pa.array([key[0].as_py()], type=pa.int32()), "load": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], type=pa.binary())})


def shingle_loads(texts: DataFrame, words: int) -> np.ndarray:
    """The counters over all texts: a row of them for each task, added up in 16 cuts of fixed size."""
    rows = texts.select("text").mapInArrow(lambda it: _loads(it, words), "place int, load binary").groupBy("place").applyInArrow(_added, "place int, load binary")
    return np.frombuffer(b"".join(bytes(r.load) for r in sorted(rows.collect())) or bytes(4 * COUNTERS), dtype=np.uint32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    edge = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(values, type=pa.int64()))


def _forms(it, words: int, least: float, often: np.ndarray):
    for batch in it:
        texts = batch.column("text").to_pylist()
        sizes, same, heads = [], [], []
        for own in _shingles(texts, words):
            take = len(own) - math.ceil(least * len(own) - 1e-9) + 1 if len(own) else 0
            order = np.lexsort((own, often[(own & U(COUNTERS - 1)).astype(np.int64)]))
            sizes.append(len(own))
            same.append(xxhash.xxh3_128_digest(own.tobytes()))
            heads.append(own[order[:take]])
        codes = pa.array(fingerprints(texts).view(np.int64))
        yield pa.record_batch([batch.column("id"), batch.column("digest"), codes, pa.array(same, type=pa.binary()), pa.array(sizes, type=pa.int64()), _lists(heads)], names=["id", "digest", "code", "same", "size", "head"])


def _sets(it, words: int):
    for batch in it:
        yield pa.record_batch([batch.column("node"), _lists(_shingles(batch.column("text").to_pylist(), words))], names=["node", "shingles"])


def _star(forms: DataFrame, key: str) -> DataFrame:
    """(a, b): each form and the first of those with the same key."""
    low = forms.groupBy(key).agg(F.min("node").alias("b"))
    return forms.select("node", key).join(low, key).where("node != b").select(F.col("node").alias("a"), "b")


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b)."""
    ends = links.join(placed.toDF("a", "x"), "a").join(placed.toDF("b", "y"), "b").where("x != y").select("x", "y").distinct()
    found = connected_components(ends, "x", "y").toDF("component", "into")
    return placed.join(found, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def _may_be_alike(least: float, size_a: str, pos_a: str, size_b: str, pos_b: str) -> F.Column:
    """Bounds by the sizes, and by what can follow a hash that is at these places of both sets."""
    a, b = F.col(size_a), F.col(size_b)
    return (F.least(a, b) >= least * F.greatest(a, b) - 1e-9) & (F.least(a - F.col(pos_a), b - F.col(pos_b)) >= least / (1 + least) * (a + b) - 1e-6)


def star_pairs(meeting: DataFrame, least: float) -> DataFrame:
    """(a, b): in each hash that forms of several components share, each form with four others, where those are of another
    component: the first and the last of all, and two that chance picks for that hash, so that a form meets many."""
    who = F.struct("component", "node", "size", "pos")
    drawn = F.struct(F.xxhash64("token", "node").alias("turn"), who.alias("who"))
    ends = meeting.groupBy("token").agg(F.min(who).alias("low"), F.max(who).alias("high"), F.min(drawn).alias("one"), F.max(drawn).alias("other")).where("low.component != high.component")
    both = meeting.join(ends, "token").select("node", "component", "size", "pos", F.explode(F.array("low", "high", "one.who", "other.who")).alias("end"))
    good = both.where(F.col("component") != F.col("end.component")).where(_may_be_alike(least, "size", "pos", "end.size", "end.pos"))
    return good.select(F.greatest("node", "end.node").alias("a"), F.least("node", "end.node").alias("b")).distinct()


def all_pairs(meeting: DataFrame, least: float) -> DataFrame:
    """(a, b): forms of different components that share a hash and may be alike. Sizes fall into classes so wide that a form's
    partners are in its own or the next."""
    several = meeting.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    met = meeting.join(several, "token", "left_semi").withColumn("class", F.floor(F.log("size") / -math.log(least) + 1e-9))
    small = met.select("token", F.explode(F.array("class", F.col("class") + 1)).alias("class"), *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "size", "pos")])
    large = met.select("token", "class", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "size", "pos")])
    order = F.expr("component_a != component_b and (size_a < size_b or size_a = size_b and node_a < node_b)")
    found = small.join(large, ["token", "class"]).where(order & _may_be_alike(least, "size_a", "pos_a", "size_b", "pos_b"))
    return found.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def verified(pairs: DataFrame, forms: DataFrame, texts: DataFrame, words: int, least: float, scratch: Scratch) -> DataFrame:
    """The pairs of forms whose whole shingle sets are that alike; texts: (id, digest, text)."""
    pairs = scratch.save(pairs)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(forms.select("node", "id", "digest"), "node")
    own = texts.join(needed, ["id", "digest"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.save(own.mapInArrow(lambda it: _sets(it, words), "node long, shingles array<long>"))
    j = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return scratch.save(j.where(both >= least * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))


def near_forms(texts: DataFrame, scratch: Scratch, *, near: int = 3, words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, digest, component) of one row for each form of texts (id, digest, text): its smallest id, and digest for that id."""
    often = shingle_loads(texts, words)
    rows = texts.mapInArrow(lambda it: _forms(it, words, least, often), "id long, digest long, code long, same binary, size long, head array<long>")
    once = rows.groupBy("code", "same").agg(F.min(F.struct("id", "digest")).alias("low"), F.first("size").alias("size"), F.first("head").alias("head"))
    forms = scratch.save(once.select(F.monotonically_increasing_id().alias("node"), "low.*", "code", "same", "size", "head"))

    coded = forms.groupBy("code").agg(F.min("node").alias("rep"))
    links = near_links(coded.select("rep", "code"), near).union(_star(forms, "code")).union(_star(forms, "same"))
    found = connected_components(scratch.save(links), "a", "b").toDF("node", "component")
    placed = scratch.save(forms.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    entries = forms.select("node", "size", F.posexplode("head").alias("pos", "token"))
    shared = entries.groupBy("token").count().where("count > 1").select("token")
    meeting = scratch.save(entries.join(shared, "token", "left_semi"))
    for search in (star_pairs, all_pairs):
        links = verified(search(meeting.join(placed, "node"), least), forms, texts, words, least, scratch)
        placed = scratch.save(_merged(placed, links))
    return forms.select("node", "id", "digest").join(placed, "node").select("id", "digest", "component")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", near: int = 3, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay: one of each group linked by fingerprints within `near` bits or by similarity of `least`, the
    one with the smallest id, then text hash; and all rows without an id."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    body = text_bytes(F.col(text_column))
    keyed = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.xxhash64(body).alias("digest"), body.alias("text"), whole_row(docs))
    texts = keyed.select("id", "digest", "text")
    forms = near_forms(texts, scratch, near=near, words=words, least=least)
    kept = scratch.save(forms.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("low")).select("low.*"))
    scratch.clear(but=kept)
    # Equal ids and texts: ordered by the whole row as text, so that no column is left out.
    out = keyed.select("id", "digest", "rest").join(kept, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min_by("rest", F.sha2(F.to_json("rest"), 256)).alias("rest"))
    return out.select("rest.*").unionByName(docs.where(F.col(id_column).isNull()))
