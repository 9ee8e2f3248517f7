"""Review-aware predicates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schema import RETIRED

_REVIEWED = ["reviewed", "canonical"]


def active() -> Column:
    return F.coalesce(F.col("assertion_status") == "active", F.lit(False))


def _review_in(values: list[str]) -> Column:
    return F.coalesce(F.col("review").isin(values), F.lit(False))


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


VIEWS = {
    "all": lambda: active() & ~_is("review", "rejected"),
    "reviewed": lambda: active() & _review_in(_REVIEWED),
    "canonical": lambda: active() & _is("review", "canonical"),
    "trusted": lambda: active() & _review_in(_REVIEWED) & (~_is("asserted_by", "llm") | _is("review", "canonical")),
    "proposed": lambda: _is("assertion_type", "proposed") & _is("review", "unreviewed"),
    "rejected": lambda: _is("review", "rejected"),
}
POLICIES = ["all", "reviewed", "canonical", "trusted"]


def policy(name: str) -> Column:
    if name not in VIEWS:
        raise ValueError(f"unknown policy {name!r}; there are {', '.join(VIEWS)}")
    return VIEWS[name]()


def visible(policy_name: str | None = None, review: str | None = None) -> Column:
    """The default view is active and not rejected; asking for a review status lifts the second half."""
    seen = policy(policy_name) if policy_name else active() if review else policy("all")
    return seen & _is("review", review) if review else seen


def retired(column: str = "status") -> Column:
    return F.coalesce(F.col(column).isin(RETIRED), F.lit(False))
