"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

from chronolith.plans import bars, base, evaluate, features, instruments, lanes, more, policy, smc  # noqa: F401
from chronolith.plans.flagship import flagship  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
