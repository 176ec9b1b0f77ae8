"""Property tests of the staging rules against a direct statement of them."""

from __future__ import annotations

from datetime import timedelta

from ledger_rows import AS_OF, move
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caudal import schema as S
from caudal.operators.staging import stage


def spec(days_late: int | None, residual_cents: int):
    """Right-closed buckets at 0/30/60/90; risk by days late; overdue needs a residual."""
    if days_late is None:
        return None, S.RISK_NO_DUE_DATE, False
    d = max(days_late, 0)
    bucket = next(label for limit, label in zip((0, 30, 60, 90, 10**9), S.AGING_LABELS) if d <= limit)
    risk = (S.RISK_CURRENT if d == 0 else S.RISK_LOW if d <= 30 else
            S.RISK_MEDIUM if d <= 60 else S.RISK_CRITICAL)
    return bucket, risk, days_late > 0 and residual_cents > 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-400, 400)), st.integers(0, 10**6)),
                min_size=1, max_size=60))
def test_buckets_risk_and_overdue_follow_the_rules(make_moves, cases):
    rows = [move(i, total=f"{c / 100 + 1:.2f}", residual=f"{c / 100:.2f}",
                 due=None if d is None else AS_OF - timedelta(days=d))
            for i, (d, c) in enumerate(cases, start=1)]
    got = {r.id: (r.tramo_aging, r.nivel_riesgo, r.is_overdue) for r in stage(make_moves(rows), AS_OF).collect()}
    assert got == {i: spec(d, c) for i, (d, c) in enumerate(cases, start=1)}
