"""All registered queries; importing the modules registers them."""

from ledgerloom.plans import check_queries, figure_queries, filing_queries, label_queries, other_queries, retrieval_queries, table_queries
from ledgerloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "check_queries", "figure_queries", "filing_queries", "label_queries", "other_queries", "retrieval_queries", "table_queries"]
