"""The registered queries, by family."""

from tallymill.plans import arrays, manifests, metrics, records, scans, store, streams
from tallymill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "arrays", "manifests", "metrics", "records", "scans", "store", "streams"]
