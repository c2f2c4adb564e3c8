"""Connected components of a graph given as an edge table, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only a local session without one (tests, a laptop) gets one under /tmp."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
    at = at or "/tmp/checkpoints/tallymill"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Edges that one task takes: a small graph costs few tasks, whatever the session's shuffle width.
TASK_EDGES = 200_000


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node on an edge between two different nodes; component is the smallest node reachable.

    Each round is two aggregations and two joins over the edges that are left; a node with very many neighbours costs its
    aggregate, not a list. Edges with a null end are no edges. The rounds grow with the logarithm of a component's size.
    """
    checkpoint_dir(edges.sparkSession)
    e = (
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct()
        .checkpoint(eager=True)
    )
    before = _state(e)
    while before[0]:
        tasks = -(-before[0] // TASK_EDGES)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = small.union(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks).checkpoint(eager=True)
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
