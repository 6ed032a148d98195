"""Named queries over a data directory, with the SQL that checks them."""

from helixmart.plans import (  # noqa: F401  (they register themselves)
    check_views,
    jobs_documents,
    jobs_events,
    jobs_features,
    jobs_ml,
    jobs_scoring,
    jobs_similarity,
    jobs_stats,
)
from helixmart.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
