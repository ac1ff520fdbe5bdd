"""All registered queries. Importing this module fills the registry."""

from fablens.plans import (  # noqa: F401
    scoring_queries, sequence_queries, source_queries, stream_queries, table_queries,
)
from fablens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
