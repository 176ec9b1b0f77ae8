"""Hot keys: one partner / one due day holding a third of all rows.

Results are compared with a brute-force computation in plain Python over the
same fixture, and the plans must pre-aggregate before their shuffle.
"""

from __future__ import annotations

import contextlib
import io
from collections import defaultdict
from datetime import timedelta
from decimal import Decimal

from ledger_rows import AS_OF, move

from caudal.operators import projection as P
from caudal.operators import reports as R
from caudal.operators.staging import stage
from caudal.sources.ledger import journals_source


def _fixture():
    rows = []
    hot_due = AS_OF + timedelta(days=7)
    for i in range(1, 601):
        hot = i % 3 == 0  # a third of all rows
        partner = "Hot" if hot else f"P{i % 40:02d}"
        due = hot_due if hot else AS_OF + timedelta(days=i % 90)
        cents = (i * 7919) % 100000
        rows.append(move(i, total=f"{cents / 100 + 100:.2f}", residual=f"{cents / 100:.2f}",
                         due=due, partner=partner))
    return rows


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_hot_partner_concentration(make_moves):
    rows = _fixture()
    st = stage(make_moves(rows), AS_OF)
    got = R.client_concentration(st, top_n=8)
    per: dict[str, Decimal] = defaultdict(Decimal)
    for r in rows:
        if r[7] > 0:
            per[r[8]] += r[7]
    ranked = sorted(per.items(), key=lambda kv: (-kv[1], kv[0]))
    total = sum(per.values())
    expect = [(k, float(v)) for k, v in ranked[:8]] + [("Otros", float(total - sum(v for _, v in ranked[:8])))]
    assert [(r.cliente, r.monto) for r in got.collect()] == expect
    plan = _plan(got)
    assert "partial_sum" in plan  # map-side combine before the partner shuffle


def test_hot_due_day_projection(spark, make_moves, journals):
    rows = _fixture()
    st = stage(make_moves(rows), AS_OF)
    jr = journals_source(journals)
    proj = P.cashflow_projection(spark, st, jr, AS_OF).collect()
    inflow: dict = defaultdict(Decimal)
    for r in rows:
        if r[7] > 0 and AS_OF <= r[5] <= AS_OF + timedelta(days=90):
            inflow[r[5]] += r[7]
    saldo = Decimal("1500.00")
    for r in proj:
        saldo += inflow.get(r.fecha, Decimal(0))
        assert r.ingreso == float(inflow.get(r.fecha, 0))
        assert r.saldo == float(saldo)
    assert "partial_sum" in _plan(P.cashflow_projection(spark, st, jr, AS_OF))
