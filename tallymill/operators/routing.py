"""Nearest-agency routing and the reasons that send a record to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import vectors as V
from tallymill.operators.components import checkpoint_dir


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose test holds, in order."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]), lambda x: x.isNotNull())


def review_reasons(label: Column, confidence: Column, least: float, catch_all: str, spread: Column | None = None, most_spread: float | None = None) -> Column:
    tests = [(confidence < least, "low_confidence"), (label == catch_all, "catch_all_class")]
    if most_spread is not None and spread is not None:
        tests.append((spread > most_spread, "high_epistemic_uncertainty"))
    return reasons(*tests)


#: Sites of a box, or of a category, that are all compared; bits of each axis by which boxes are cut further.
LEAF, STEP, DEEPEST = 256, 4, 24
#: What rounding can hide between squared chords of the unit sphere: sites of nearly the least distance are all measured by the formula.
SLACK = 1e-12
_AT = ["category", "latitude", "longitude"]


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """x, y and z: a fourth of the squared chord is the number under the root of the haversine formula."""
    p, q = (F.when(F.abs(c) <= 720, F.radians(c)).otherwise(float("nan")) for c in (lat, lon))  # others are no place that a box is bounded for
    return [(F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z")]


def _boxed(sites: DataFrame) -> tuple[DataFrame, list[int]]:
    """Sites with the number of their cell on either axis, and the bits of each level of boxes, from wide to narrow.

    Boxes of a level have 4 ** STEP in each box of the level before at most; the narrowest hold LEAF sites at most, unless they are DEEPEST.
    No levels: no category has more than LEAF sites.
    """
    span = sites.agg(*[f(F.when(F.abs(c) < 1e9, F.col(c))).alias(f"{n}_{c}") for c in ("alat", "alon") for n, f in (("low", F.min), ("high", F.max))])
    cell = lambda c: F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.abs(c) < 1e9, (F.col(c) - F.col(f"low_{c}")) / F.nullif(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(0.0))))) * ((1 << DEEPEST) - 1)), F.lit(0)).cast("long")
    placed = sites.crossJoin(F.broadcast(span)).withColumns({"row": cell("alat"), "column": cell("alon")}).select(*sites.columns, "row", "column")  # span: one row
    most = lambda bits: (placed.groupBy("category", _cell(bits).alias("cell")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    levels, bits = [], 0
    while most(bits) > LEAF and bits < DEEPEST:
        bits += STEP
        levels.append(bits)
    return placed, levels


def _cell(bits: int) -> Column:
    """The box of so many bits of each axis, as one number."""
    return F.shiftleft(F.shiftright("row", DEEPEST - bits), DEEPEST).bitwiseOR(F.shiftright("column", DEEPEST - bits)) if bits else F.lit(0).cast("long")


def _pairs(places: DataFrame, sites: DataFrame) -> DataFrame:
    """Places (category, latitude, longitude) with those sites (category, alat, alon, agency_id) that can be their nearest.

    Where a category has many sites, boxes of them are visited from wide to narrow. A box stays if the least distance to it does not exceed
    the distance to a site that is known, so a place visits boxes near its nearest site. What has no distance bounds nothing and stays.
    """
    sites, levels = _boxed(sites)
    left = places.select(*_AT, F.lit(0).cast("long").alias("cell"))
    if levels:
        checkpoint_dir(places.sparkSession)
        sites = sites.select("*", *_on_sphere(F.col("alat"), F.col("alon"))).checkpoint(eager=True)
        left = left.select("*", *_on_sphere(F.col("latitude"), F.col("longitude")), F.lit(4.5).alias("known")).checkpoint(eager=True)
    for before, bits in zip([0, *levels], levels, strict=False):
        some = F.min(F.struct("agency_id", *[F.col(c).alias(f"some_{c}") for c in "xyz"])).alias("some")
        boxes = sites.groupBy("category", _cell(before).alias("cell"), _cell(bits).alias("inner")).agg(some, *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
        boxes = boxes.select("*", "some.*").drop("some", "agency_id")
        apart = lambda c: F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"))
        least = F.nanvl(sum((apart(c) * apart(c) for c in "xyz"), F.lit(0.0)), F.lit(0.0))
        reach = sum(((F.col(c) - F.col(f"some_{c}")) * (F.col(c) - F.col(f"some_{c}")) for c in "xyz"), F.lit(0.0))
        met = left.join(boxes, ["category", "cell"]).select(*_AT, "x", "y", "z", "inner", least.alias("least"), F.least("known", reach).alias("reach"))
        known = met.groupBy(*_AT).agg(F.min("reach").alias("known"))
        left = met.join(known, _AT).where(F.col("least") <= F.col("known") + SLACK).select(*_AT, F.col("inner").alias("cell"), "x", "y", "z", "known").checkpoint(eager=True)
    inner = sites.select("category", _cell(levels[-1] if levels else 0).alias("cell"), "agency_id", "alat", "alon")
    return left.select(*_AT, "cell").join(inner, ["category", "cell"]).drop("cell")


def _best(records: DataFrame, agencies: DataFrame, key: str, catch_all: str) -> DataFrame:
    """(key, best), a struct of the distance and agency_id, of the records that have any.

    Sites at one point are as far from anything, and the smallest id stands for them; records at one point have one nearest site.
    """
    able = records.where((F.col("category") != catch_all) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    placed = agencies.where("active and latitude is not null and longitude is not null")
    sites = placed.select("category", F.col("latitude").alias("alat"), F.col("longitude").alias("alon"), "agency_id")
    sites = sites.groupBy("category", "alat", "alon").agg(F.min("agency_id").alias("agency_id"))
    far = V.haversine_m(F.col("latitude"), F.col("longitude"), F.col("alat"), F.col("alon"))
    best = _pairs(able.select(*_AT).distinct(), sites).groupBy(*_AT).agg(F.min(F.struct(far.alias("d"), "agency_id")).alias("best"))
    return able.select(key, *_AT).join(best, _AT).groupBy(key).agg(F.min("best").alias("best"))


def _found() -> list[Column]:
    return [F.col("best.agency_id").alias("agency_id"), F.round("best.d", 2).alias("distance_m")]


def nearest(records: DataFrame, agencies: DataFrame, key: str, catch_all: str) -> DataFrame:
    """(key, agency_id, distance_m): the closest active agency of the record's category; the smallest id of equal distances.

    Found once for each place of a category. Records of the catch-all category or without a place have none, and agencies without a place
    are nobody's.
    """
    return records.select(key).join(_best(records, agencies, key, catch_all), key, "left").select(key, *_found())


def registry_reasons(records: DataFrame, agencies: DataFrame, key: str, catch_all: str, status: str = "verified") -> DataFrame:
    """(key, routing_reasons) of the registry: one reason at most."""
    return _with_registry_reasons(records, agencies, catch_all, status).select(key, "routing_reasons")


def _with_registry_reasons(records: DataFrame, agencies: DataFrame, catch_all: str, status: str = "verified") -> DataFrame:
    gaps = agencies.where("active").select("category").distinct().withColumn("covered", F.lit(True))
    no_place = F.col("latitude").isNull() | F.col("longitude").isNull()
    state = F.lit({"verified": None, "incomplete": "routing_registry_incomplete"}.get(status, "agency_registry_untrusted"))
    one = F.when(F.col("category") == catch_all, "catch_all_class").when(state.isNotNull(), state).when(no_place, "routing_location_missing").when(F.col("covered").isNull(), "routing_registry_gap")
    return records.join(gaps, "category", "left").withColumn("routing_reasons", F.filter(F.array(one), lambda x: x.isNotNull()))


def routed(records: DataFrame, agencies: DataFrame, key: str, catch_all: str, least: float) -> DataFrame:
    """(key, reasons, agency_id, distance_m): an agency only where no reason asks for review."""
    own = review_reasons(F.col("category"), F.col("confidence"), least, catch_all)
    every = _with_registry_reasons(records, agencies, catch_all).select(key, F.array_distinct(F.concat(own, "routing_reasons")).alias("reasons"))
    agency, metres = _found()
    free = F.size("reasons") == 0
    j = every.join(_best(records, agencies, key, catch_all), key, "left")
    return j.select(key, "reasons", F.when(free, agency).alias("agency_id"), F.when(free, metres).alias("distance_m"))


def coverage_gaps(classes: DataFrame, agencies: DataFrame) -> DataFrame:
    return classes.join(agencies.where("active").select("category").distinct(), "category", "left_anti")


def registry_status(agencies: int, gaps: int, trusted: bool = True) -> str:
    if agencies == 0:
        return "unavailable"
    if not trusted:
        return "untrusted_fallback"
    return "incomplete" if gaps else "verified"
