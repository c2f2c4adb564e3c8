"""Nearest agencies against a comparison with every site."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallymill.functions import vectors as V
from tallymill.operators import routing as R

RECORDS = "id long, category string, latitude double, longitude double, confidence double"
AGENCIES = "agency_id long, category string, latitude double, longitude double, active boolean"


def world(r, n):
    """Sites and places all over the globe, in one town, and at the poles and the date line."""
    for i in range(n):
        yield i, r.choice("ab"), *r.choice([
            (r.uniform(-90, 90), r.uniform(-180, 180)),
            (round(r.gauss(-6.2, 0.01), 3), round(r.gauss(106.8, 0.01), 3)),
            (r.choice([-90.0, 90.0, 89.999]), r.uniform(-180, 180)),
            (r.uniform(-1, 1), r.choice([-180.0, 180.0, 179.9999])),
        ])


def every_pair(records, agencies):
    sites = agencies.where("active and latitude is not null").select("agency_id", "category", F.col("latitude").alias("alat"), F.col("longitude").alias("alon"))
    far = V.haversine_m(F.col("latitude"), F.col("longitude"), F.col("alat"), F.col("alon"))
    return {x.id: (x.b.agency_id, x.b.d) for x in records.where("category != 'z' and latitude is not null").join(sites, "category").groupBy("id").agg(F.min(F.struct(far.alias("d"), "agency_id")).alias("b")).collect()}


@pytest.mark.parametrize("leaf,step", [(8, 2), (64, 4), (256, 4)])
def test_nearest_against_every_pair(spark, monkeypatch, leaf, step):
    monkeypatch.setattr(R, "LEAF", leaf)
    monkeypatch.setattr(R, "STEP", step)
    r = random.Random(leaf)
    sites = [(*x, i % 9 != 0) for i, x in enumerate(world(r, 700))] + [(900, "a", None, 1.0, True), (901, "a", math.nan, 1.0, True), (902, "c", math.nan, 0.0, True), (903, "a", 1e6, 1e6, True)]
    places = [(*x, 0.9) for x in world(r, 400)] + [(900, "a", None, 1.0, 0.9), (901, "a", math.nan, 1.0, 0.9), (902, "c", 5.0, 5.0, 0.9), (903, "z", 1.0, 1.0, 0.9), (904, "d", 1.0, 1.0, 0.9)]
    records, agencies = spark.createDataFrame(places, RECORDS), spark.createDataFrame(sites, AGENCIES)
    want = every_pair(records, agencies)
    got = {x.id: (x.agency_id, x.distance_m) for x in R.nearest(records, agencies, "id", "z").collect()}
    assert len(got) == len(places) and {k for k, v in got.items() if v[0] is not None} == set(want)
    for k, (agency, d) in want.items():
        assert got[k][0] == agency and (math.isnan(d) and math.isnan(got[k][1]) or abs(got[k][1] - d) <= 0.0051)


def test_pairs_do_not_grow_with_the_sites(spark):
    """3,000 sites and as many places, all apart: a place is compared with the sites near it."""
    r = random.Random(1)
    at = [(i, "a", r.uniform(-7, -6), r.uniform(106, 107)) for i in range(6000)]
    places = spark.createDataFrame(at[:3000], "id long, category string, latitude double, longitude double")
    sites = spark.createDataFrame(at[3000:], "agency_id long, category string, alat double, alon double")
    assert R._pairs(places, sites).count() < 3000 * 300


def test_sites_and_records_at_one_point_are_one(spark):
    places = spark.createDataFrame([(i, "a", float(i % 5), 1.0, 0.9) for i in range(500)] + [(None, "a", 1.0, 1.0, 0.9), (7, "a", 4.0, 1.0, 0.9)], RECORDS)
    sites = spark.createDataFrame([(i, "a", float(i % 3), 1.0, True) for i in range(900)], AGENCIES)
    got = R.nearest(places, sites, "id", "z").collect()
    assert len(got) == 502 and all(x.agency_id == (min(x.id % 5, 2) if x.id is not None else None) for x in got)
    routed = R.routed(places, sites, "id", "z", 0.5).collect()
    assert len(routed) == 502 and sorted((x.id, x.agency_id) for x in routed if x.id is not None) == sorted((x.id, x.agency_id) for x in got if x.id is not None)
