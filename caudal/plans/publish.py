"""Publish job: every table of one as-of date's refresh, published together.

The reference returns all tables of a refresh as one payload. Here they are
written under one version and appear by one manifest (see
:mod:`caudal.sources.sinks`). The moves are scanned as few times as possible:

1. the staged moves, payments and journals of the window, which are payload
   themselves;
2. the ledger facts (:mod:`caudal.operators.facts`), in one pass: day facts in
   place of the moves give every report but two, partner facts the
   concentration; the critical invoices come from the staged table just written;
3. everything that follows from a finished report, from its written rows.

Run as (the package shipped with ``--py-files``)::

    zip -r caudal.zip caudal
    spark-submit --py-files caudal.zip caudal/plans/publish.py \
        --ledger <ledger folder> --format parquet --out <reports folder> --as-of 2001-08-01
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal import schema as S
from caudal.functions.columns import lit_date
from caudal.operators import alerts as A
from caudal.operators import facts as X
from caudal.operators import kpis as K
from caudal.operators import projection as P
from caudal.operators import reports as R
from caudal.operators.staging import stage, stage_v
from caudal.plans import catalog
from caudal.session import build_session
from caudal.sources import ledger as L
from caudal.sources.ledger import Ledger, load_ledger, undated_documents
from caudal.sources.rejects import Sifted, sift_ledger
from caudal.sources.sinks import Refresh

# Tables as large as the window and its facts, the reports over those, and what follows from the reports.
TABLES = ("staging", "payments", "journals", "facts")
BASE = ("monthly_facts", "kpi_bundle", "aging_report", "journal_breakdown", "client_concentration",
        "critical_invoices", "scenario_grid", "undated_documents", "undated_payments", "break_even_rate",
        "kpi_bundle_v", "monthly_comparison_v", "overdue_aging_v", "scenario_grid_v")
DERIVED = ("kpi_display", "alerts", "critical_badge", "critical_invoices_display", "monthly_comparison",
           "monthly_net_cashflow", "waterfall_labels", "collections_velocity", "report_targets", "velocity_targets",
           "grand_totals", "cashflow_projection", "projection_mirrored", "whatif_runway", "kpi_levels_v")
REPORTS = TABLES + BASE + DERIVED


def window_and_undated(moves: DataFrame, as_of: date, lookback_days: int) -> DataFrame:
    """The moves whose facts the reports of a date need: the look-back window, and the undated ones for their count."""
    cutoff = as_of - timedelta(days=lookback_days)
    rows = F.col("invoice_date").isNull() | (F.col("invoice_date") >= lit_date(cutoff))
    if S.INVOICE_PERIOD in moves.columns:
        period = F.col(S.INVOICE_PERIOD)
        rows = rows & (period.isNull() | (period >= cutoff.strftime(S.PERIOD_STRFTIME)))
    return moves.filter(rows)


def base_reports(spark: SparkSession, day_facts: DataFrame, partner_facts: DataFrame, critical: DataFrame,
                 payments: DataFrame, journals: DataFrame, p: S.Params) -> dict[str, DataFrame]:
    """The reports over the moves, from their facts; ``critical`` has the overdue
    invoices among which the most critical are. The variant's keep drafts."""
    days = X.day_facts(day_facts)
    main, with_drafts = X.window_facts(days, p.as_of, p.lookback_days)
    ctx = catalog.Ctx(spark, None, p, raw=Ledger(None, None, journals))
    ctx.main = Ledger(main, None, L.journals_source(journals))
    ctx.staged, ctx.moves_v, ctx.staged_v = stage(main, p.as_of), with_drafts, stage_v(with_drafts, p.as_of)
    special = {"monthly_facts": R.monthly_facts(ctx.staged),  # exact, the monthly reports go on from there
               "client_concentration": R.client_concentration(X.open_by_customer(partner_facts, p.as_of, p.lookback_days), p.top_clients),
               "critical_invoices": R.critical_invoices(critical, p.as_of, p.top_critical),
               "undated_documents": undated_documents(days), "undated_payments": L.undated_payments(payments)}
    return {**{name: catalog.build(name, ctx) for name in BASE if name not in special}, **special}


def derived_reports(done: dict[str, DataFrame], p: S.Params) -> dict[str, DataFrame]:
    """What follows from the written base reports and the written monthly facts."""
    facts, bundle, critical, grid = (done[k] for k in ("monthly_facts", "kpi_bundle", "critical_invoices", "scenario_grid"))
    monthly = catalog.to_output(R.comparison_of(facts, p.history_months))
    velocity = R.velocity_of(facts, p.history_months, p.min_velocity_sample)
    projection = grid.filter("pct = 100").drop("pct").orderBy("fecha")
    return {
        "kpi_display": A.kpi_display(bundle),
        "alerts": A.alerts(bundle),
        "critical_badge": A.critical_badge(critical),
        "critical_invoices_display": R.critical_invoices_display(critical),
        "monthly_comparison": monthly,
        "monthly_net_cashflow": R.net_of(facts, p.net_months),
        "waterfall_labels": R.waterfall_labels(R.net_of(facts, 10)),
        "collections_velocity": velocity,
        "report_targets": R.collection_target(monthly),
        "velocity_targets": R.velocity_target(velocity),
        "grand_totals": R.grand_totals_of(done["aging_report"], done["journal_breakdown"]),
        "cashflow_projection": projection,
        "projection_mirrored": P.mirrored_outflow(projection),
        "whatif_runway": P.whatif_of(grid, bundle),
        "kpi_levels_v": K.kpi_levels_v(done["kpi_bundle_v"]),
    }


def finish(tables: Refresh, day_facts: DataFrame, partner_facts: DataFrame, critical: DataFrame, payments: DataFrame,
           journals: DataFrame, p: S.Params) -> None:
    """Write the reports of a refresh whose window tables are written, and publish all."""
    tables.write_all(base_reports(tables.spark, day_facts, partner_facts, critical, payments, journals, p))
    tables.write_all(derived_reports({name: tables.read(name) for name in BASE}, p))
    tables.commit()


def publish(spark: SparkSession, raw: Ledger, out: str, p: S.Params, sifted: Sifted | None = None,
            max_rejects: int = 0) -> None:
    """All tables of one as-of date. With ``sifted`` (of which ``raw`` is the
    ledger) the rejected rows are published too, unless they are more than
    ``max_rejects``: then nothing is."""
    ctx, tables = catalog.Ctx(spark, None, p, raw=raw), Refresh(spark, out, p.as_of)
    tables.write("staging", ctx.staged, one_file=False, partitions=("move_type",))
    tables.write("payments", ctx.main.payments, one_file=False)
    tables.write("journals", ctx.main.journals)
    if sifted:
        sifted.check(max_rejects)  # counted by the three tables just written
        tables.write("rejects", sifted.rejects, one_file=False)
    tables.write("facts", X.ledger_facts(window_and_undated(raw.moves, p.as_of, p.lookback_days)), one_file=False)
    finish(tables, tables.read("facts"), tables.read("facts"), tables.read("staging"), raw.payments, raw.journals, p)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--ledger", required=True, help="folder with moves/, payments/, journals/")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--out", required=True)
    ap.add_argument("--as-of", required=True, type=date.fromisoformat)
    ap.add_argument("--lookback-days", type=int, default=365)
    ap.add_argument("--max-rejects", type=int, help="set unreadable rows of a text export aside, up to so many "
                                                    "(default: the first one fails the job)")
    args = ap.parse_args(argv)
    spark = build_session(app="caudal-publish")
    p = replace(S.Params(as_of=args.as_of), lookback_days=args.lookback_days)
    if args.max_rejects is None:
        publish(spark, load_ledger(spark, args.ledger, args.format), args.out, p)
    else:
        sifted = sift_ledger(spark, args.ledger, args.format)
        publish(spark, sifted.ledger, args.out, p, sifted, args.max_rejects)


if __name__ == "__main__":
    main()
