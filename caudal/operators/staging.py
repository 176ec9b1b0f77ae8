"""Staging: the flat table every report reads.

One narrow ``withColumns`` projection over the moves: no shuffle, fused into
the scan's whole-stage codegen. Reports select only what they need, so
Catalyst prunes the unused derived columns away again.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from caudal.functions import columns as C


def _dated(moves: DataFrame, observation: Observation | None) -> DataFrame:
    """Drop documents without an invoice date (they have no month); with an
    ``Observation``, count them on the way, in the same pass as the query."""
    if observation is not None:
        moves = moves.observe(observation,
                              F.count(F.lit(1)).alias("rows_in"),
                              F.count_if(F.col("invoice_date").isNull()).alias("null_invoice_date"))
    return moves.filter(F.col("invoice_date").isNotNull())


def stage(moves: DataFrame, as_of: date, observation: Observation | None = None) -> DataFrame:
    """Main staging: date dimensions, flags, risk level and aging bucket.

    * ``is_overdue`` needs a due date before ``as_of`` and an open residual.
    * ``days_overdue`` ignores payment (a paid late invoice is still
      ``Riesgo crítico``) and stays null without a due date.
    * ``collected_amt`` is all-or-nothing: a partial payment counts 0.
    * Documents without an invoice date are dropped (counted when an
      ``observation`` is given).
    """
    inv, mat = F.col("invoice_date"), F.col("date_maturity")
    total, residual = F.col("amount_total"), F.col("amount_residual")
    days = C.days_overdue(mat, as_of)
    collected = F.when(residual == 0, total).otherwise(C.zero_money())
    return (_dated(moves, observation)
            .withColumns({
                "year": F.year(inv),
                "month": C.month_label(inv),
                "quarter": C.quarter_label(inv),
                "week_num": F.weekofyear(inv),
                "is_collected": residual == 0,
                "is_overdue": F.coalesce(C.overdue(as_of), F.lit(False)),
                "days_overdue": days,
                "collected_amt": collected,
                "pending_amt": C.money(total - collected),
                "nivel_riesgo": C.risk_level(days),
                "tramo_aging": C.aging_bucket(days),
                "tramo_orden": C.aging_order(days),
            }))


def stage_v(moves: DataFrame, as_of: date, observation: Observation | None = None) -> DataFrame:
    """Variant staging: week label and payment date; no quarter, pending or risk."""
    inv, mat = F.col("invoice_date"), F.col("date_maturity")
    total, residual = F.col("amount_total"), F.col("amount_residual")
    return (_dated(moves, observation)
            .withColumns({
                "year": F.year(inv),
                "month": C.month_label(inv),
                "week": C.week_label(inv),
                "is_collected": residual == 0,
                "is_overdue": F.coalesce(C.overdue(as_of), F.lit(False)),
                "days_overdue": C.days_overdue(mat, as_of),
                "collected_amt": F.when(residual == 0, total).otherwise(C.zero_money()),
            }))


def date_range(staged: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """User period filter on ``invoice_date``, both ends closed.

    Skipped unless both ends are given, like the reference's date picker.
    """
    if start is None or end is None:
        return staged
    return staged.filter(F.col("invoice_date").between(C.lit_date(start), C.lit_date(end)))
