"""The registered queries: each one composes an operator with the views, next to the SQL that gives the same rows."""

from .registry import CHECKS, oracle_texts, query_callables

__all__ = ["CHECKS", "oracle_texts", "query_callables"]
