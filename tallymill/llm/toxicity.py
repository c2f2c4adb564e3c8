"""Toxicity by a classifier chain of linear models.

The categories are label columns in a given order. Each category's model is a logistic regression over hashed features of the
text, and over the log odds that the models before it give; those are out-of-fold predictions while it is trained, and the
whole-sample models' predictions when it scores.

Features: each distinct word of a text (A-Z lower-cased) and its leading bytes of several lengths, hashed. A text's margin is the sum over its distinct words, so batches are scored as arrays, whole texts always.

The models are fitted on a bounded sample: of the labelled rows the `sample` with the smallest hash of id, whatever their
number (with fewer, all). Everything else, above all scoring, covers every row.

Results in special cases: a null label leaves a row out of that category's training only; a label with one class gives its share (smoothed) as
probability; rows with a null id are scored but never trained on; a null text is empty and gets the intercept; a repeated
label row trains as often as it occurs; ties in the sample's order go by labels, then features; texts of any length count
whole, in training as in scoring; empty tables give a model that says one half, and no rows; other columns pass through.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import kernels as K
from tallymill.llm.runtime import in_rest, loosened, text_bytes, texts_of, whole_row, with_rest
from tallymill.llm.xxh64 import xxh64_slices

U = np.uint64
BITS = 18
#: Byte lengths of word beginnings.
HEADS = (4, 5, 6, 8)
#: A feature that fewer sampled texts have gets no weight.
LEAST_TEXTS = 3
SAMPLE = 10_000
FOLDS = 3
#: Share of held-out texts without the last category that may be rejected, and the range of the probability that sets.
FALSE_ALARMS, LEAST_REJECT, MOST_REJECT = 0.002, 0.05, 0.5


def word_features(w: K.Words, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature): features of the words at these positions, whose hashes are whole; word numbers count through `at`."""
    folded, s, e = w.data.translate(K.FOLD), w.starts[at], w.ends[at]
    word, feature = [np.arange(len(at))], [(K.mix(whole) >> U(64 - BITS)).astype(np.int64)]
    for n in HEADS:
        has = np.flatnonzero(e - s >= n)
        h = xxh64_slices(folded, s[has], s[has] + n, n)
        word.append(has)
        feature.append((h >> U(64 - BITS)).astype(np.int64))
    return np.concatenate(word), np.concatenate(feature)


def distinct_words(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the batch's distinct words; (text, number) of each text's distinct words."""
    h, first, number = np.unique(w.hashes(fold=True), return_index=True, return_inverse=True)
    pair = np.unique(w.doc_of() * max(1, len(first)) + number)
    return first, h, pair // max(1, len(first)), pair % max(1, len(first))


def _features(it):
    """Each text's features with counts, packed."""
    for batch in it:
        texts, blobs = batch.column("text").to_pylist(), []
        for lo, hi in K.batches([len(t) for t in texts]):
            w = K.Words(texts[lo:hi])
            at, whole, text, number = distinct_words(w)
            who, feature = word_features(w, at, whole)
            order = np.argsort(who, kind="stable")
            feature, count = feature[order], np.bincount(who, minlength=len(at))
            first = np.concatenate(([0], np.cumsum(count)))[:-1]
            doc = np.repeat(text, count[number])
            own = feature[K.spread(first[number], count[number])]
            key, n = np.unique(doc << BITS | own, return_counts=True)
            # A count is a byte; a larger one goes on in further entries of the same feature.
            more = -(-n // 255)
            key, n = np.repeat(key, more), np.minimum(255, np.repeat(n, more) - 255 * K.spread(np.zeros(len(n), dtype=np.int64), more))
            edge = np.searchsorted(key, np.arange(hi - lo + 1) << BITS)
            for a, b in zip(edge, edge[1:], strict=False):
                blobs.append((key[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes() + n[a:b].astype(np.uint8).tobytes())
        yield pa.record_batch([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(blobs, type=pa.binary())], names=[*(c for c in batch.schema.names if c != "text"), "features"])


@dataclass
class Rows:
    """Sparse rows: feature and value of row i at start[i] to start[i + 1]."""

    start: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.start)[rows]
        at = K.spread(self.start[rows], n)
        return Rows(np.concatenate(([0], np.cumsum(n))), self.feature[at], self.value[at])

    def margins(self, weights: np.ndarray, step: int = 1024) -> np.ndarray:
        out = np.zeros(len(self.start) - 1)
        for lo in range(0, len(out), step):
            edge = self.start[lo : lo + step + 1]
            part = slice(edge[0], edge[-1])
            run = np.concatenate(([0.0], np.cumsum(weights[self.feature[part]] * self.value[part])))
            out[lo : lo + step] = run[edge[1:] - edge[0]] - run[edge[:-1] - edge[0]]
        return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    """Weights of the features under the numbers that the rows have."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def odds(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return self.bias + rows.margins(self.weights) + np.clip(earlier, -6, 6) @ self.earlier


def numbered(rows: Rows) -> tuple[Rows, np.ndarray]:
    """The rows with only the features that LEAST_TEXTS of them have, numbered from 0, and those features."""
    used = np.flatnonzero(np.bincount(rows.feature, minlength=1 << BITS) >= LEAST_TEXTS)
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    own = number[rows.feature]
    rows.feature = own  # the hashed numbers are not needed again
    live = own >= 0
    return Rows(np.concatenate(([0], np.cumsum(live, dtype=np.int32)))[rows.start].astype(np.int64), own[live], rows.value[live]), used


def fit_linear(rows: Rows, width: int, earlier: np.ndarray, y: np.ndarray, members: np.ndarray, *, rounds: int = 2, steps: int = 50, rate: float = 0.05, l2: float = 1e-4, batch: int = 64, seed: int = 7) -> Linear:
    """Logistic regression on the members among the rows, by AdaGrad over shuffled batches: `rounds` over all members, of `steps`
    batches together at least. The same input gives the same model."""
    y = y.astype(float)
    share = (y[members].sum() + 0.5) / (len(members) + 1)
    model = Linear(np.zeros(width), np.zeros(earlier.shape[1]), float(logit(np.array([share]))[0]))
    if not len(members) or y[members].min() == y[members].max():
        return model
    w = model.weights
    seen, seen_e, seen_b = np.full(width, 1e-3), np.full(earlier.shape[1], 1e-3), 1e-3
    scale = np.clip(earlier, -6, 6)
    rng = np.random.default_rng(seed)
    for _ in range(max(rounds, -(-steps * batch // len(members)))):
        order = rng.permutation(members)
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            x, e = rows.take(part), scale[part]
            gap = (sigmoid(model.bias + x.margins(w) + e @ model.earlier) - y[part]) / len(part)
            g = np.bincount(x.feature, weights=np.repeat(gap, np.diff(x.start)) * x.value, minlength=width)
            g += l2 * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
            ge, gb = e.T @ gap, gap.sum()
            seen_e += ge * ge
            seen_b += gb * gb
            model.earlier -= rate * ge / np.sqrt(seen_e)
            model.bias -= rate * gb / np.sqrt(seen_b)
    return model


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    #: From this probability of the last category on a text is rejected.
    reject: float = MOST_REJECT

    def probabilities(self, margins: list[np.ndarray]) -> list[np.ndarray]:
        """From each model's text margins, in order of the chain."""
        odds: list[np.ndarray] = []
        for m, own in zip(self.models, margins, strict=True):
            z = m.bias + own + sum((w * np.clip(o, -6, 6) for w, o in zip(m.earlier, odds, strict=True)), np.zeros(len(own)))
            odds.append(z)
        return [sigmoid(z) for z in odds]


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability that rejects no more than FALSE_ALARMS of the out-of-fold rows without the category."""
    other = np.sort(p[y == 0])[::-1]
    if not len(other) or not (y == 1).any():
        return MOST_REJECT
    return float(np.clip(np.nextafter(other[int(FALSE_ALARMS * len(other))], 1), LEAST_REJECT, MOST_REJECT))


def fit_chain(rows: Rows, labels: list[np.ndarray], categories: tuple[str, ...], folds: np.ndarray) -> Chain:
    """labels: 0, 1 or -1 for unknown, for each category in order of the chain."""
    rows, used = numbered(rows)
    n, width, models = len(rows.start) - 1, len(used), []
    earlier = np.zeros((n, 0))
    for y in labels:
        known = np.flatnonzero(y >= 0)
        models.append(fit_linear(rows, width, earlier, y, known))
        out = np.zeros(n)
        for f in range(FOLDS):
            held = folds == f
            out[held] = fit_linear(rows, width, earlier, y, known[folds[known] != f]).odds(rows, earlier)[held]
        earlier = np.column_stack((earlier, out))
    reject = threshold(sigmoid(earlier[:, -1]), labels[-1]) if labels else MOST_REJECT
    for m in models:
        every = np.zeros(1 << BITS)
        every[used] = m.weights
        m.weights = every
    return Chain(categories, models, reject)


def _unpacked(packed: pa.ChunkedArray) -> Rows:
    """Rows from _features' blobs, without a copy of them between."""
    edges = [np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1] for c in packed.chunks]
    size = np.concatenate([np.diff(e) // 5 for e in edges] or [np.empty(0, dtype=np.int32)]).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    rows, i = Rows(start, np.empty(start[-1], dtype=np.int32), np.empty(start[-1], dtype=np.uint8)), 0
    for chunk, edge in zip(packed.chunks, edges, strict=True):
        data = np.frombuffer(chunk.buffers()[2] or b"", dtype=np.uint8)
        for a in edge[:-1]:
            n, at = size[i], start[i]
            rows.feature[at : at + n] = data[a : a + 4 * n].view("<u4")
            rows.value[at : at + n] = data[a + 4 * n : a + 5 * n]
            i += 1
    return rows


def train(docs: DataFrame, labels: DataFrame, *, categories: dict[str, F.Column], id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Chain:
    """categories: for each name, in order of the chain, the 0/1 label as a column of labels."""
    names = [f"y{i}" for i in range(len(categories))]
    marks = labels.select(F.col(id_column).cast("long").alias("id"), *[c.cast("int").alias(n) for n, c in zip(names, categories.values(), strict=True)]).where("id is not null")
    marks = marks.orderBy(F.xxhash64("id"), "id", *names).limit(sample)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(F.col(text_column)).alias("text"))
    kinds = ", ".join(f"{n} int" for n in names)
    # The sample's ids, at most `sample` short rows, go to where the texts are. Repeated document ids can add rows, so the
    # bound is set again on the features.
    found = texts.join(F.broadcast(marks), "id").select("id", *names, "text")
    rows = found.mapInArrow(_features, f"id long, {kinds}, features binary").orderBy(F.xxhash64("id"), "id", *names, "features").limit(sample)
    # One task fits the bounded sample; only the chain comes back.
    order = tuple(categories)
    fitted = rows.mapInArrow(lambda it: _fit(it, names, order), "chain binary").collect()
    return pickle.loads(fitted[0].chain) if fitted else _fitted(pa.table({}), [], order)


def _fitted(got: pa.Table, names: list[str], categories: tuple[str, ...]) -> Chain:
    if not got.num_rows:
        return fit_chain(Rows(np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.uint8)), [np.empty(0, dtype=np.int64) for _ in categories], categories, np.empty(0, dtype=np.int64))
    rows = _unpacked(got.column("features"))
    ids = got.column("id").to_numpy()
    folds = (K.mix(ids.astype(np.int64).view(U)) % U(FOLDS)).astype(np.int64)
    marked = [got.column(n).fill_null(-1).to_numpy().astype(np.int64) for n in names]
    del got  # the packed copy
    return fit_chain(rows, marked, categories, folds)


def _fit(it, names: list[str], categories: tuple[str, ...]):
    parts = list(it)
    if parts:
        yield pa.record_batch([pa.array([pickle.dumps(_fitted(pa.Table.from_batches(parts), names, categories))], type=pa.binary())], names=["chain"])


def _margins(chain: Chain, texts: list[bytes]) -> list[np.ndarray]:
    out = [np.zeros(len(texts)) for _ in chain.models]
    for lo, hi in K.batches([len(t) for t in texts]):
        w = K.Words(texts[lo:hi])
        if not len(w):
            continue
        at, whole, text, number = distinct_words(w)
        who, feature = word_features(w, at, whole)
        for m, o in zip(chain.models, out, strict=True):
            score = np.bincount(who, weights=m.weights[feature], minlength=len(at))
            o[lo:hi] = np.bincount(text, weights=score[number], minlength=hi - lo)
    return out


def score(docs: DataFrame, chain: Chain, *, id_column: str = "doc_id", text_column: str = "text", keep_columns: bool = False) -> DataFrame:
    """(id, one probability for each category in order); keep_columns: also `rest`, a struct of the input's columns."""
    names = [f"p{i}" for i in range(len(chain.models))]
    rest = [whole_row(docs)] if keep_columns else []
    text = [] if keep_columns and in_rest(docs, text_column) else [text_bytes(F.col(text_column)).alias("text")]
    rows = docs.select(F.col(id_column).cast("long").alias("id"), *text, *rest)
    carry = ["id", *(["rest"] if keep_columns else [])]
    fields = "id long, " + ", ".join(f"{n} double" for n in names)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # 2 MB for each category, fixed by BITS

    def run(it):
        for b in it:
            p = sent.value.probabilities(_margins(sent.value, texts_of(b, text_column)))
            kept = [loosened(b.column("rest"))] if keep_columns else []
            yield pa.record_batch([b.column("id"), *(pa.array(x, type=pa.float64()) for x in p), *kept], names=["id", *names, *carry[1:]])

    out = rows.mapInArrow(run, with_rest(fields, docs) if keep_columns else fields)
    return out.select(*carry, *[F.col(n).alias(f"p_{c}") for n, c in zip(names, chain.categories, strict=True)])
