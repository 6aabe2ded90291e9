"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import network_queries, page_queries, rule_queries, text_queries  # noqa: F401  (their queries register themselves)
from .text_queries import ORACLE_SQL, QUERIES

FLAGSHIP = "term_topk_network"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
