"""URL filtering by a cascade of Bloom filters.

Rules are keys of host and path. Every url has candidate keys: each of the host's domain suffixes with each path prefix of a
length that some rule has. The first filter of the cascade encodes the rules; the second the candidates of the whole corpus
that pass the first but are no rule; the third the rules that pass the second, and so on until none is left. Over the key
universe it was built for, the cascade answers membership exactly, without the rule list and without a join. A second
cascade, over the rules, tells the blocking ones.

Sizes: the first filter's false-positive rate is set from the number of rules and of distinct candidates, so that the false
positives that reach the driver are about as many as the rules; twice as many as that bound start a tighter build.

A url that no rule fits is not listed: the verdict is allow. A null url, or one without ://, has empty host and path. Rows that repeat are
judged one by one, whatever their id; of two rules that fit, the longer decides, and two of equal length cannot both fit one url
unless they are the same. A url of any length is judged whole: only its suffixes and prefixes of lengths that rules have are keys. An
empty table gives no rows. Only the id and url columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bloom:
    def __init__(self, keys: Iterable[str], rate: float, level: int) -> None:
        keys = list(keys)
        self.level = level
        self.bits = max(8, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(-math.log2(rate)))
        self.set = np.zeros(self.bits, dtype=bool)
        for k in keys:
            self.set[self._at(k)] = True

    def _at(self, key: str) -> list[int]:
        a, b = xxhash.xxh64_intdigest(key, seed=2 * self.level), xxhash.xxh64_intdigest(key, seed=2 * self.level + 1) | 1
        return [(a + i * b) % (1 << 64) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.set[i] for i in self._at(key))


class Cascade:
    """Exact membership in `listed` over listed and `others`."""

    def __init__(self, listed: Iterable[str], others: Iterable[str], first: Bloom | None = None, rate: float = 0.5) -> None:
        yes, no = set(listed), set(others) - set(listed)
        self.levels = [first or Bloom(yes, rate, 0)]
        while no := {k for k in no if k in self.levels[-1]}:
            self.levels.append(Bloom(no, 0.5, len(self.levels)))
            yes, no = no, yes

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of the rules that could fit, longest first; of equal lengths the longer host first. lengths: of rules' paths."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return sorted((h + path[:n] for h in hosts for n in lengths if n <= len(path)), key=len, reverse=True)


def _passing(it, first: Bloom, listed: set[str], lengths: list[int]):
    for batch in it:
        found = {k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True) for k in candidates(h, p, lengths) if k in first and k not in listed}
        yield pa.record_batch({"key": pa.array(sorted(found), type=pa.string())})


def _keys(it, lengths: list[int]):
    for batch in it:
        found = {k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True) for k in candidates(h, p, lengths)}
        yield pa.record_batch({"key": pa.array(sorted(found), type=pa.string())})


def build(urls: DataFrame, rules: dict[str, str]) -> tuple[Cascade, Cascade, list[int]]:
    """Cascades of the rules over all candidate keys of urls (host, path), and of the blocking among the rules."""
    lengths = sorted({len(k) - len(k.split("/")[0]) for k in rules})
    pairs = urls.select("host", "path").distinct()
    universe = pairs.mapInArrow(lambda it: _keys(it, lengths), "key string").agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(len(rules), 16) / (math.sqrt(2) * max(universe, 1)))
    while True:
        first = Bloom(rules, rate, 0)
        found = pairs.mapInArrow(lambda it, first=first: _passing(it, first, set(rules), lengths), "key string").distinct()
        most = 4 * max(len(rules), 16)
        false = [r.key for r in found.limit(most + 1).collect()]
        if len(false) <= most:
            return Cascade(rules, false, first), Cascade([k for k, v in rules.items() if v == "block"], rules), lengths
        rate /= 16


def judge_urls(pages: DataFrame, rules: dict[str, str], *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row; rules: verdict (allow or block) by host and path, such as example.org/a."""
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    listed, blocking, lengths = build(rows, rules)

    def run(it):
        for b in it:
            fit, verdict = [], []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                rule = next((k for k in candidates(h, p, lengths) if k in listed), None)
                fit.append(rule)
                verdict.append("block" if rule is not None and rule in blocking else "allow")
            yield pa.record_batch({"id": b.column("id"), "host": b.column("host"), "path": b.column("path"), "rule": pa.array(fit, type=pa.string()), "verdict": pa.array(verdict, type=pa.string())})

    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string")
