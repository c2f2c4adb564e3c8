"""A stored index of 64-bit codes for searches by Hamming distance: any small radius, many queries at once.

The bits in which the stored codes differ are dealt to bands by how evenly each is set, so that every band tells about as many codes apart;
bits that are all alike would make a band whose values nearly every code shares. Of two codes within radius r, bands differ in fewer than
r + 1 bits in all: if each band may differ in so many bits that these numbers, each with one added, make r + 1, some band does not exceed its
own. A query probes, in each band, its own value and those within that many bits. Postings hold each distinct code once, by band and value; the
rows of a code are a table of their own, so a code that very many rows share is one posting, and queries of one code are one search. A pair
that several bands find is kept at the first that does.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import text as T

BITS = 64
#: Most values that one band of one query probes.
PROBES = 4096
#: Most bands that are made unasked, and the bits by which a value of one may tell fewer codes apart than there are: 2 ** 7 codes share one.
MOST_BANDS, SHARED_BITS = 4, 7


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def dealt(shares: list[float], codes: int, bands: int | None = None) -> list[int]:
    """A mask of bits for each band, from the share of codes that have each bit set. Without a number of bands, there are as many, up to
    MOST_BANDS and two at least, as leave a value 2 ** SHARED_BITS codes."""
    worth = [-sum(x * math.log2(x) for x in (p, 1 - p) if x > 0) for p in shares]
    bands = bands or max(2, min(MOST_BANDS, int(sum(worth) / max(1.0, math.log2(max(1, codes)) - SHARED_BITS))))
    masks, held = [0] * bands, [0.0] * bands
    for i in sorted((i for i in range(BITS) if worth[i] > 0), key=lambda i: (-worth[i], i)):
        b = min(range(bands), key=lambda b: (held[b], b))
        masks[b] |= 1 << i
        held[b] += worth[i]
    return masks


class RadiusIndex:
    """Under a folder: `rows` (code, id), `codes` (each code once), `bands` (band, mask) and `postings` (band, value, code), in a folder for
    each band and in ranges of the value."""

    def __init__(self, spark: SparkSession, path: str, bands: int | None = None) -> None:
        self.spark, self.path, self.bands = spark, path.rstrip("/"), bands

    def build(self, df: DataFrame, id: str, code: str) -> RadiusIndex:
        """Stores the codes of df; null codes are not found. Refuses a folder that is there."""
        rows = df.where(F.col(code).isNotNull()).select(F.col(code).cast("long").alias("code"), F.col(id).alias("id"))
        rows.repartitionByRange("code").sortWithinPartitions("code").write.mode("errorifexists").parquet(f"{self.path}/rows")
        self.rows().select("code").distinct().write.parquet(f"{self.path}/codes")
        once = self.spark.read.parquet(f"{self.path}/codes")
        n, *ones = once.agg(F.count("*"), *[F.sum(F.shiftrightunsigned("code", i).bitwiseAND(F.lit(1))) for i in range(BITS)]).first()
        masks = dealt([(k or 0) / max(1, n) for k in ones], n, self.bands)
        self.spark.createDataFrame([(b, _signed(m)) for b, m in enumerate(masks)], "band int, mask long").coalesce(1).write.parquet(f"{self.path}/bands")
        bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("value")) for b, m in enumerate(masks)])
        placed = once.select("code", F.inline(bands))
        placed.repartitionByRange("band", "value").sortWithinPartitions("value").write.partitionBy("band").parquet(f"{self.path}/postings")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("value long, code long, band int").parquet(f"{self.path}/postings")

    def masks(self) -> list[int]:
        """The bits of each band, as numbers from 0 to 2 ** 64 - 1; a row for each band, 64 at most."""
        return [r.mask % (1 << BITS) for r in self.spark.read.parquet(f"{self.path}/bands").orderBy("band").collect()]

    def _probes(self, radius: int) -> list[tuple[int, int, list[int]]]:
        """(mask, bits that may differ, their combinations) of each band that is probed."""
        masks, out = self.masks(), []
        for b, mask in enumerate(masks):
            flips = (radius + 1) // len(masks) + (b < (radius + 1) % len(masks)) - 1
            bits = [i for i in range(BITS) if mask >> i & 1]
            if flips < 0:
                break
            if (n := sum(math.comb(len(bits), k) for k in range(flips + 1))) > PROBES:
                raise ValueError(f"radius {radius} takes {n} probes of a band; build the index with more bands")
            out.append((mask, flips, [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(bits, k)]))
        return out

    def _met(self, codes: DataFrame, probes: list[tuple[int, int, list[int]]]) -> DataFrame:
        """(query_code, band, code) of each query_code in codes."""
        own = lambda mask: F.col("query_code").bitwiseAND(F.lit(_signed(mask)))
        bands = F.array(*[F.struct(F.lit(b).alias("band"), own(mask).alias("own"), F.array(*[F.lit(_signed(m)) for m in near]).cast("array<bigint>").alias("near")) for b, (mask, _, near) in enumerate(probes)])
        each = codes.select("query_code", F.inline(bands)).select("query_code", "band", "own", F.explode("near").alias("flip"))
        return each.select("query_code", "band", F.col("own").bitwiseXOR(F.col("flip")).alias("value")).join(self.postings(), ["band", "value"]).select("query_code", "band", "code")

    def candidates(self, queries: DataFrame, id: str, code: str, radius: int) -> DataFrame:
        """(query, query_code, band, code): what the probes meet, before any distance is taken."""
        q = _queries(queries, id, code)
        return q.join(self._met(q.select("query_code").distinct(), self._probes(radius)), "query_code").select("query", "query_code", "band", "code")

    def matches(self, queries: DataFrame, id: str, code: str, radius: int) -> DataFrame:
        """(query, id, distance) of every row within the radius of a query's code."""
        probes, q = self._probes(radius), _queries(queries, id, code)
        differ = F.col("code").bitwiseXOR(F.col("query_code"))
        earlier = F.lit(False)
        for b, (mask, flips, _) in enumerate(probes[:-1]):
            earlier = earlier | ((F.col("band") > b) & (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= flips))
        met = self._met(q.select("query_code").distinct(), probes)
        near = met.where((T.hamming(F.col("code"), F.col("query_code")) <= radius) & ~earlier).select("query_code", "code", T.hamming(F.col("code"), F.col("query_code")).alias("distance"))
        return q.join(near, "query_code").join(self.rows(), "code").select("query", "id", "distance")


def _queries(queries: DataFrame, id: str, code: str) -> DataFrame:
    return queries.where(F.col(code).isNotNull()).select(F.col(id).alias("query"), F.col(code).cast("long").alias("query_code"))
