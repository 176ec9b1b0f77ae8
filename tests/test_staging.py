from __future__ import annotations

from datetime import date, timedelta

from ledger_rows import AS_OF, move

from caudal import schema as S
from caudal.operators.staging import date_range, stage, stage_v


def rows_by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_due_today_is_not_overdue(make_moves):
    r = rows_by_id(stage(make_moves([move(1, residual="50.00", due=AS_OF)]), AS_OF))[1]
    assert r.days_overdue == 0
    assert r.is_overdue is False
    assert r.tramo_aging == "Por vencer"
    assert r.nivel_riesgo == "Al corriente"


def test_bucket_edges_are_right_closed(make_moves):
    lates = [1, 30, 31, 60, 61, 90, 91]
    rows = [move(d, residual="10.00", due=AS_OF - timedelta(days=d)) for d in lates]
    got = rows_by_id(stage(make_moves(rows), AS_OF))
    a = S.AGING_LABELS
    expected = {1: a[1], 30: a[1], 31: a[2], 60: a[2], 61: a[3], 90: a[3], 91: a[4]}
    assert {k: got[k].tramo_aging for k in lates} == expected
    risk = {1: S.RISK_LOW, 30: S.RISK_LOW, 31: S.RISK_MEDIUM, 60: S.RISK_MEDIUM,
            61: S.RISK_CRITICAL, 90: S.RISK_CRITICAL, 91: S.RISK_CRITICAL}
    assert {k: got[k].nivel_riesgo for k in lates} == risk
    assert all(got[k].is_overdue for k in lates)


def test_paid_late_is_critical_but_not_overdue(make_moves):
    r = rows_by_id(stage(make_moves([move(1, residual="0.00", due=AS_OF - timedelta(days=70))]), AS_OF))[1]
    assert r.is_overdue is False
    assert r.is_collected is True
    assert r.days_overdue == 70
    assert r.nivel_riesgo == S.RISK_CRITICAL


def test_missing_due_date(make_moves):
    r = rows_by_id(stage(make_moves([move(1, residual="10.00", due=None)]), AS_OF))[1]
    assert r.days_overdue is None
    assert r.nivel_riesgo == S.RISK_NO_DUE_DATE
    assert r.tramo_aging is None
    assert r.is_overdue is False


def test_partial_payment_counts_nothing_collected(make_moves):
    r = rows_by_id(stage(make_moves([move(1, total="100.00", residual="40.00")]), AS_OF))[1]
    assert float(r.collected_amt) == 0.0
    assert float(r.pending_amt) == 100.0


def test_date_dimensions(make_moves):
    rows = [move(1, invoice=date(2026, 12, 2)), move(2, invoice=date(2027, 1, 1))]
    got = rows_by_id(stage(make_moves(rows), AS_OF))
    assert (got[1].month, got[1].quarter, got[1].year) == ("2026-12", "2026Q4", 2026)
    assert got[2].week_num == 53  # ISO week of 2027-01-01
    v = rows_by_id(stage_v(make_moves(rows), AS_OF))
    assert v[1].week == "2026-11-30/2026-12-06"


def test_null_invoice_date_dropped_and_counted(make_moves):
    from pyspark.sql import Observation
    obs = Observation("ingest")
    staged = stage(make_moves([move(1, invoice=None), move(2), move(3)]), AS_OF, obs)
    assert staged.count() == 2
    assert obs.get == {"rows_in": 3, "null_invoice_date": 1}


def test_date_range_closed_and_skipped_without_both_ends(make_moves):
    rows = [move(i, invoice=date(2001, 7, d)) for i, d in enumerate([1, 10, 20, 31], start=1)]
    st = stage(make_moves(rows), AS_OF)
    assert date_range(st, date(2001, 7, 10), date(2001, 7, 20)).count() == 2
    assert date_range(st, None, date(2001, 7, 20)).count() == 4
