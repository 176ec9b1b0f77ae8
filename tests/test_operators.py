from __future__ import annotations

from datetime import date, timedelta

import pytest
from ledger_rows import AS_OF, move

from caudal import schema as S
from caudal.operators import alerts as A
from caudal.operators import kpis as K
from caudal.operators import projection as P
from caudal.operators import reports as R
from caudal.operators.staging import stage, stage_v
from caudal.sources.ledger import journals_source


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_vendor_bill_overdue_counts_in_receivable_totals(make_moves):
    rows = [move(1, "in_invoice", total="300.00", residual="300.00", due=AS_OF - timedelta(days=70)),
            move(2, "out_invoice", total="100.00", residual="100.00", due=AS_OF + timedelta(days=5))]
    r = one(K.exposure_totals(stage(make_moves(rows), AS_OF)))
    assert r.total_cxc == 100.0
    assert r.cxc_vencida == 300.0
    assert r.n_criticas == 1


def test_empty_moves(spark, make_moves, journals):
    st = stage(make_moves([]), AS_OF)
    jr = journals_source(journals)
    b = one(K.kpi_bundle(st, jr, AS_OF))
    assert (b.dso, b.burn_rate, b.liquidity_ratio, b.collection_rate) == (0.0, 0.0, 0.0, 0.0)
    assert b.cash_runway == float("inf") and b.color_runway == S.SUCCESS
    assert b.saldo_liquido == 1500.0
    for rep in (R.aging_report(st), R.monthly_comparison(st), R.client_concentration(st),
                R.collections_velocity(st), R.critical_invoices(st, AS_OF),
                P.cashflow_projection(spark, st, jr, AS_OF)):
        assert rep.count() == 0
        assert len(rep.schema.fields) > 0
    w = P.whatif_runway(spark, st, jr, AS_OF).collect()
    assert all(r.runway_str == S.NOT_AVAILABLE and r.nivel == S.MUTED for r in w)
    assert R.monthly_net_cashflow(st).collect() == []  # no months, no Total either


def test_no_overdue_payables_sentinels(make_moves, journals):
    rows = [move(1, "in_invoice", residual="50.00", due=AS_OF + timedelta(days=3))]
    m = make_moves(rows)
    assert one(K.liquidity_ratio(stage(m, AS_OF), journals_source(journals), AS_OF)).liquidity_ratio == 99.0
    assert one(K.liquidity_ratio_v(m, journals, AS_OF)).liquidity_ratio == 99.99


def test_liquidity_uses_bank_and_cash_only_in_main(make_moves, journals):
    rows = [move(1, "in_invoice", residual="750.00", due=AS_OF - timedelta(days=3))]
    m = make_moves(rows)
    assert one(K.liquidity_ratio(stage(m, AS_OF), journals, AS_OF)).liquidity_ratio == 2.0
    assert one(K.liquidity_ratio_v(m, journals, AS_OF)).liquidity_ratio == round(11499 / 750, 2)
    assert one(K.total_cash_v(journals)).total_cash == 11499.0


def test_top_n_ties_ordered_by_name_then_id(make_moves):
    due = AS_OF - timedelta(days=10)
    rows = [move(3, residual="500.00", due=due, name="B"), move(2, residual="500.00", due=due, name="A"),
            move(1, residual="500.00", due=due, name="A"), move(4, residual="900.00", due=due, name="Z")]
    got = R.critical_invoices(stage(make_moves(rows), AS_OF), AS_OF, top_n=3).collect()
    assert [r.name for r in got] == ["Z", "A", "A"]
    assert got[1].invoice_date == "01/07/2001" and got[1].date_maturity == "22/07/2001"


def test_concentration_exactly_n_partners_has_no_others(make_moves):
    rows = [move(i, residual=f"{10 * i}.00", partner=f"P{i}") for i in range(1, 9)]
    st = stage(make_moves(rows), AS_OF)
    got = R.client_concentration(st, top_n=8).collect()
    assert len(got) == 8 and "Otros" not in {r.cliente for r in got}
    got9 = R.client_concentration(st, top_n=5).collect()
    assert [r.cliente for r in got9] == ["P8", "P7", "P6", "P5", "P4", "Otros"]
    assert got9[-1].monto == 60.0
    assert sum(r.monto for r in got9) == 360.0  # identity: concentration total = unpaid total


def test_month_with_only_bills_gives_zero_income(make_moves):
    rows = [move(1, "in_invoice", total="70.00", invoice=date(2001, 6, 5)),
            move(2, "out_invoice", total="100.00", invoice=date(2001, 7, 5))]
    got = {r.month: r for r in R.monthly_net_cashflow(stage(make_moves(rows), AS_OF)).collect()}
    assert got["2001-06"].ingresos == 0.0 and got["2001-06"].neto == -70.0
    t = got["Total"]
    assert (t.ingresos, t.egresos, t.neto, t.tipo) == (100.0, 70.0, 30.0, "total")
    assert t.month_dt == date(2001, 8, 1)


def test_velocity_drops_small_months_and_averages_rounded_rows(make_moves):
    rows = []
    i = 0
    for month, n, terms in [(3, 3, 30), (4, 2, 10), (5, 3, 45), (6, 4, 60)]:
        for _ in range(n):
            i += 1
            inv = date(2001, month, 1)
            rows.append(move(i, invoice=inv, due=inv + timedelta(days=terms)))
    got = R.collections_velocity(stage(make_moves(rows), AS_OF)).collect()
    assert [r.month for r in got] == ["2001-03", "2001-05", "2001-06"]
    assert [r.dso_ma3 for r in got] == [30.0, 37.5, 45.0]


def test_aging_identity_and_order(make_moves):
    rows = [move(i, residual="10.00", due=AS_OF - timedelta(days=d)) for i, d in
            enumerate([-5, 0, 10, 45, 75, 120, 200], start=1)]
    rows.append(move(99, residual="10.00", due=None))
    st = stage(make_moves(rows), AS_OF)
    got = R.aging_report(st).collect()
    assert [r.tramo for r in got] == list(S.AGING_LABELS)
    assert [r.facturas for r in got] == [2, 1, 1, 1, 2]
    assert sum(r.monto for r in got) == 70.0  # the undated invoice has no bucket
    assert sum(r.porcentaje for r in got) == pytest.approx(100.0, abs=0.2)


def test_projection_identities(spark, make_moves, journals):
    rows = [move(1, residual="100.00", due=AS_OF),
            move(2, residual="200.00", due=AS_OF + timedelta(days=10)),
            move(3, "in_invoice", residual="50.00", due=AS_OF + timedelta(days=10)),
            move(4, residual="999.00", due=AS_OF + timedelta(days=90)),   # day N: filtered in, not shown
            move(5, residual="777.00", due=AS_OF - timedelta(days=1))]    # overdue: never projected
    st = stage(make_moves(rows), AS_OF)
    jr = journals_source(journals)
    proj = P.cashflow_projection(spark, st, jr, AS_OF, cobrabilidad_pct=80).collect()
    assert len(proj) == 90 and proj[0].fecha == AS_OF and proj[-1].fecha == AS_OF + timedelta(days=89)
    assert proj[0].ingreso == 80.0 and proj[10].egreso == 50.0
    last = proj[-1]
    assert last.saldo == pytest.approx(1500 + 0.8 * 300 - 50)
    assert all(r.saldo_pes <= r.saldo <= r.saldo_opt for r in proj)
    assert last.saldo_opt == pytest.approx(1500 + 0.92 * 300 - 50)
    assert last.saldo_pes == pytest.approx(1500 + 0.68 * 300 - 50)
    grid = P.scenario_grid(spark, st, jr, AS_OF).filter("pct = 100").drop("pct").collect()
    default = P.cashflow_projection(spark, st, jr, AS_OF).collect()
    assert grid == default
    wr = {r.pct: r for r in P.whatif_runway(spark, st, jr, AS_OF).collect()}
    assert wr[80].saldo_final == pytest.approx(last.saldo)


def test_projection_variant_uses_posted_and_all_journals(spark, make_moves, journals):
    rows = [move(1, residual="100.00", due=AS_OF + timedelta(days=1)),
            move(2, residual="100.00", due=AS_OF + timedelta(days=1), state="draft")]
    st = stage_v(make_moves(rows), AS_OF)
    got = P.cashflow_projection_v(spark, st, journals, AS_OF, impayment_pct=25).collect()
    assert got[1].inflow == 75.0
    assert got[-1].balance == 11499 + 75.0


def test_alerts_and_badge(spark, make_moves, journals):
    rows = [move(i, residual="10.00", due=AS_OF - timedelta(days=61 + i)) for i in range(12)]
    rows.append(move(100, "in_invoice", total="20000.00", invoice=AS_OF - timedelta(days=5)))
    st = stage(make_moves(rows), AS_OF)
    bundle = K.kpi_bundle(st, journals_source(journals), AS_OF)
    got = {r.code: r for r in A.alerts(bundle).collect()}
    assert got["cash_runway"].severity == S.DANGER
    assert got["cash_runway"].message.startswith("ALERTA CRÍTICA — Cash Runway de 0.1 meses.")
    assert got["overdue_invoices"].severity == S.DANGER
    assert got["overdue_invoices"].message == "12 facturas con más de 60 días vencidas detectadas."
    badge = one(A.critical_badge(R.critical_invoices(st, AS_OF)))
    assert (badge.n, badge.texto, badge.color) == (12, "12 facturas", S.DANGER)
    none = one(A.critical_badge(R.critical_invoices(stage(make_moves([move(1)]), AS_OF), AS_OF)))
    assert (none.n, none.texto, none.color) == (0, "Sin alertas", S.SUCCESS)


def test_kpi_display_text(spark, make_moves, journals):
    st = stage(make_moves([move(1, residual="0.00")]), AS_OF)
    d = one(A.kpi_display(K.kpi_bundle(st, journals_source(journals), AS_OF)))
    assert d.saldo_liquido_txt == "$1,500"
    assert d.cash_runway_txt == "∞"
    assert d.liquidity_ratio_txt == ">90×"
    assert d.collection_rate_txt == "100.0%"


def test_one_decimal_text_matches_python_str(spark):
    from pyspark.sql import functions as F

    from caudal.functions.columns import one_decimal_text
    vals = [47.5, 5.0, 12345678.9, 0.1, -3.2]
    df = spark.createDataFrame([(v,) for v in vals] + [(float("inf"),)], "x double")
    got = [r[0] for r in df.select(one_decimal_text(F.col("x"))).collect()]
    assert got == [str(v) for v in vals] + [None]


def test_cash_runway_override_and_zero_burn(make_moves, journals):
    st = stage(make_moves([move(1)]), AS_OF)
    jr = journals_source(journals)
    assert one(K.cash_runway(st, jr, AS_OF, burn=600.0)).cash_runway == 2.5
    assert one(K.cash_runway(st, jr, AS_OF, burn=0.0)).cash_runway == float("inf")
    assert one(K.cash_runway(st, jr, AS_OF)).cash_runway == float("inf")  # no bills: burn 0
