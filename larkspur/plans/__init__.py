"""Registered queries: views over the given tables, operators applied to them, and the same in SQL."""

from larkspur.plans import changes_plan, checks_plan, claims_plan, games_plan, items_plan, matching_plan, more_plan, pages_plan, streams_plan
from larkspur.plans.items_plan import best_opportunities

_PARTS = (items_plan, changes_plan, pages_plan, more_plan, streams_plan, games_plan, matching_plan, claims_plan, checks_plan)

ALL_QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ALL_SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}

__all__ = ["ALL_QUERIES", "ALL_SQL", "best_opportunities"]
