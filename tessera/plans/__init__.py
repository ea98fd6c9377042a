"""Named queries. Importing this package registers them all."""

from tessera.plans import classify, confidence, consensus, enrich, evaluation, gates, geometry, lookup, medications, metadata, more_texts, names, prescriptions, records, reports, resources, retrieval, review, seam_queries, stores, streams, structuring, temporal, texts, transfer, validation  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
