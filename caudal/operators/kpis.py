"""Scalar KPIs as one-row DataFrames.

A KPI on its own filters the moves to what it needs (type, date, residual:
all pushed into the scan) and aggregates that. The bundles take every KPI from
one conditional aggregate (:func:`moves_stats`) instead: a single scan, partial
aggregation in each task, one row after the final merge. The burn rate (mean
of monthly sums) is total / number of months present; the months are a
distinct aggregate over at most a handful of values.

Values from the journals table enter as scalar subqueries
(``DataFrame.scalar()``): a global aggregate is exactly one value, so no join
is needed to put it next to the moves aggregate.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal import schema as S
from caudal.functions import columns as C

INF = float("inf")


def _tot() -> Column:
    return F.col("amount_total")


def _sum_if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), C.zero_money())


def _burn_cut(as_of: date, months: int) -> Column:
    return F.col("invoice_date") >= C.lit_date(as_of - timedelta(days=30 * months))


def _mean_of_months(total: Column, n_months: Column) -> Column:
    """Mean of per-month sums = window total / months present, 2 decimals."""
    return F.bround(F.try_divide(total.cast("double"), n_months), 2)


def moves_stats(staged: DataFrame, as_of: date | None = None, months: int = 3) -> DataFrame:
    """All single-pass aggregates over the staged moves (one row)."""
    collected_out = C.customer_invoice() & F.col("is_collected")
    aggs = [
        C.count_docs(staged).alias("n_moves"),
        C.mean_docs(staged, collected_out, C.days_to_collect(F.col("invoice_date"), F.col("date_maturity")))
         .alias("dso_raw"),
        _sum_if(C.customer_invoice(), _tot()).alias("billed_out"),
        _sum_if(C.customer_invoice(), F.col("collected_amt")).alias("collected_out"),
        _sum_if(C.customer_invoice(), C.residual()).alias("residual_out"),
        _sum_if(C.vendor_bill() & F.col("is_overdue"), C.residual()).alias("overdue_in"),
        _sum_if(F.col("is_overdue"), C.residual()).alias("overdue_all"),
        C.count_docs(staged, F.col("is_overdue") & (F.col("days_overdue") > 60)).alias("n_critical"),
    ]
    if as_of is not None:
        opex = C.vendor_bill() & _burn_cut(as_of, months)
        aggs += [F.sum(F.when(opex, _tot())).alias("burn_total"),
                 F.count_distinct(F.when(opex, F.col("month"))).alias("burn_months")]
    return staged.agg(*aggs)


def _burn_col() -> Column:
    return F.coalesce(_mean_of_months(F.col("burn_total"), F.col("burn_months")), F.lit(0.0))


# -- main pipeline -----------------------------------------------------------

def _dso_raw(staged: DataFrame) -> DataFrame:
    return (staged.filter(C.customer_invoice() & (C.residual() == 0))
            .agg(F.avg(C.days_to_collect(F.col("invoice_date"), F.col("date_maturity"))).alias("dso_raw")))


def dso(staged: DataFrame) -> DataFrame:
    """Mean of max(due - issue, 0) days over collected customer invoices, 1 decimal."""
    return _dso_raw(staged).select(F.coalesce(F.bround("dso_raw", 1), F.lit(0.0)).alias("dso"))


def _burn_window(bills: DataFrame, as_of: date, months: int) -> DataFrame:
    """Total and number of months of the vendor bills of the last 30*N days (one row)."""
    return (bills.filter(C.vendor_bill() & _burn_cut(as_of, months))
            .agg(F.sum("amount_total").alias("burn_total"),
                 F.count_distinct(C.month_label(F.col("invoice_date"))).alias("burn_months")))


def burn_rate(staged: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """Mean monthly vendor-bill total over bills issued in the last 30*N days.

    Months are the calendar months present, partial ones included.
    """
    return _burn_window(staged, as_of, months).select(_burn_col().alias("burn_rate"))


def liquid_balance(journals: DataFrame) -> DataFrame:
    """Sum of bank and cash balances (as a decimal, column ``saldo``)."""
    return (journals.filter(F.col("type").isin(*S.LIQUID_JOURNAL_TYPES))
            .agg(F.coalesce(F.sum("current_balance"), C.zero_money()).alias("saldo")))


def liquid_balance_value(journals: DataFrame) -> Column:
    """The liquid balance as a scalar subquery column."""
    return liquid_balance(journals).scalar()


def _runway(balance: Column, burn: Column) -> Column:
    return F.when(burn <= 0, F.lit(INF)).otherwise(F.bround(balance.cast("double") / burn, 1))


def cash_runway(staged: DataFrame, journals: DataFrame, as_of: date,
                burn: float | None = None, months: int = 3) -> DataFrame:
    """Liquid balance / burn rate in months, 1 decimal; +inf when burn <= 0.

    ``burn`` overrides the computed burn rate (what-if use).
    """
    if burn is not None:
        return liquid_balance(journals).select(_runway(F.col("saldo"), F.lit(float(burn))).alias("cash_runway"))
    return _burn_window(staged, as_of, months).select(
        _runway(liquid_balance_value(journals), _burn_col()).alias("cash_runway"))


def _liquidity(n_moves: Column, balance: Column, overdue_in: Column, sentinel: float) -> Column:
    return (F.when(n_moves == 0, F.lit(0.0))
            .when(overdue_in == 0, F.lit(sentinel))
            .otherwise(F.bround(balance.cast("double") / overdue_in.cast("double"), 2)))


def _any_rows(moves: DataFrame) -> Column:
    """Whether ``moves`` has a row: a scalar subquery that stops at the first."""
    return moves.select(F.lit(1).alias("one")).limit(1).scalar().isNotNull()


def liquidity_ratio(staged: DataFrame, journals: DataFrame, as_of: date) -> DataFrame:
    """Liquid balance / overdue vendor-bill residual, 2 decimals; 99.0 with none."""
    due = (staged.filter(C.vendor_bill() & C.overdue(as_of))
           .agg(F.coalesce(F.sum(C.residual()), C.zero_money()).alias("overdue_in")))
    return due.select(
        _liquidity(F.when(_any_rows(staged), 1).otherwise(0), liquid_balance_value(journals), F.col("overdue_in"),
                   S.LIQUIDITY_SENTINEL).alias("liquidity_ratio"))


def _rate(collected: Column, billed: Column) -> Column:
    return F.coalesce(F.bround(C.ratio(collected, billed) * 100, 1), F.lit(0.0))


def _billed(staged: DataFrame) -> DataFrame:
    return staged.filter(C.customer_invoice()).agg(
        F.coalesce(F.sum("amount_total"), C.zero_money()).alias("billed_out"),
        F.coalesce(F.sum("collected_amt"), C.zero_money()).alias("collected_out"),
        F.coalesce(F.sum(C.residual()), C.zero_money()).alias("residual_out"))


def collection_rate(staged: DataFrame) -> DataFrame:
    """Collected / billed over customer invoices, percent, 1 decimal."""
    return _billed(staged).select(
        _rate(F.col("collected_out"), F.col("billed_out")).alias("collection_rate"))


def exposure_totals(staged: DataFrame) -> DataFrame:
    """Open receivables; overdue residual and >60-day count over *all* moves.

    ``cxc_vencida`` and ``n_criticas`` include vendor bills, as in the
    reference (trap T7).
    """
    return moves_stats(staged).select(
        C.money_out(F.col("residual_out")).alias("total_cxc"),
        C.money_out(F.col("overdue_all")).alias("cxc_vencida"),
        F.col("n_critical").cast("bigint").alias("n_criticas"))


def kpi_bundle(staged: DataFrame, journals: DataFrame, as_of: date,
               months: int = 3, th: S.Thresholds = S.Thresholds()) -> DataFrame:
    """All main KPIs and their traffic-light levels in one row.

    One scan of the moves (every KPI including the burn rate) plus one
    scalar subquery over the journals.
    """
    saldo = liquid_balance_value(journals)
    burn = _burn_col()
    out = moves_stats(staged, as_of, months).select(
        F.coalesce(F.bround("dso_raw", 1), F.lit(0.0)).alias("dso"),
        burn.alias("burn_rate"),
        _runway(saldo, burn).alias("cash_runway"),
        C.money_out(saldo).alias("saldo_liquido"),
        _liquidity(F.col("n_moves"), saldo, F.col("overdue_in"), S.LIQUIDITY_SENTINEL).alias("liquidity_ratio"),
        _rate(F.col("collected_out"), F.col("billed_out")).alias("collection_rate"),
        C.money_out(F.col("residual_out")).alias("total_cxc"),
        C.money_out(F.col("overdue_all")).alias("cxc_vencida"),
        F.col("n_critical").cast("bigint").alias("n_criticas"),
    )
    return out.withColumns({
        "color_dso": C.level_high_bad(F.col("dso"), th.dso_warn, th.dso_crit),
        "color_runway": C.level_low_bad(F.col("cash_runway"), th.runway_warn, th.runway_crit),
        "color_liq": C.level_low_bad(F.col("liquidity_ratio"), th.liq_warn, th.liq_crit),
        "color_tasa": F.when(F.col("collection_rate") > th.rate_success, S.SUCCESS)
                       .when(F.col("collection_rate") > th.rate_warn, S.WARNING)
                       .otherwise(S.DANGER),
    })


# -- variant pipeline (drafts in the input, filtered here) ---------------------

def moves_stats_v(moves: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """Single-pass aggregates of the variant pipeline over the window moves."""
    opex = C.vendor_bill() & C.posted() & _burn_cut(as_of, months)
    overdue_in = C.vendor_bill() & C.posted() & C.overdue(as_of)
    is_overdue = C.overdue(as_of)
    out = C.customer_invoice() & C.posted()
    if C.DOCS in moves.columns:  # facts have the days summed
        mean_days = F.try_divide(F.sum(F.when(out, F.col("paid_days"))).cast("double"), F.sum(F.when(out, F.col("n_paid"))))
    else:
        mean_days = F.avg(F.when(out & F.col("payment_date").isNotNull(), F.datediff("payment_date", "invoice_date")))
    return moves.agg(
        mean_days.alias("dso_raw"),
        F.sum(F.when(opex, _tot())).alias("burn_total"),
        F.count_distinct(F.when(opex, C.month_label(F.col("invoice_date")))).alias("burn_months"),
        _sum_if(overdue_in, C.residual()).alias("pasivos"),
        _sum_if(C.customer_invoice(), C.residual()).alias("total_ar"),
        _sum_if(is_overdue, C.residual()).alias("overdue_ar"),
    )


def _all_cash(journals_all: DataFrame) -> Column:
    return journals_all.agg(F.coalesce(F.sum("current_balance"), C.zero_money())).scalar()


def _burn_v() -> Column:
    return _mean_of_months(F.col("burn_total"), F.col("burn_months"))


def _liquidity_v(cash: Column) -> Column:
    return (F.when(F.col("pasivos") == 0, F.lit(S.LIQUIDITY_SENTINEL_V))
            .otherwise(F.bround(cash.cast("double") / F.col("pasivos").cast("double"), 2)))


def dso_v(moves: DataFrame) -> DataFrame:
    """Mean payment - issue days over posted paid customer invoices; null if none."""
    return (moves.filter(C.customer_invoice() & C.posted() & F.col("payment_date").isNotNull())
            .agg(F.bround(F.avg(F.datediff("payment_date", "invoice_date")), 1).alias("dso")))


def burn_rate_v(moves: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """Variant burn: posted bills only; null (not 0) when there are none."""
    return _burn_window(moves.filter(C.posted()), as_of, months).select(_burn_v().alias("burn_rate"))


def total_cash_v(journals_all: DataFrame) -> DataFrame:
    """Sum over every journal, bank/cash or not (trap T13)."""
    return journals_all.agg(C.money_out(F.coalesce(F.sum("current_balance"), C.zero_money()))
                            .alias("total_cash"))


def cash_runway_v(moves: DataFrame, journals_all: DataFrame, as_of: date,
                  months: int = 3) -> DataFrame:
    """Bank+cash balance / variant burn; +inf when burn <= 0, null when undefined."""
    return _burn_window(moves.filter(C.posted()), as_of, months).select(
        _runway(liquid_balance_value(journals_all), _burn_v()).alias("cash_runway"))


def liquidity_ratio_v(moves: DataFrame, journals_all: DataFrame, as_of: date) -> DataFrame:
    """All journals / posted overdue vendor bills, 2 decimals; 99.99 with none."""
    due = (moves.filter(C.vendor_bill() & C.posted() & C.overdue(as_of))
           .agg(F.coalesce(F.sum(C.residual()), C.zero_money()).alias("pasivos")))
    return due.select(_liquidity_v(_all_cash(journals_all)).alias("liquidity_ratio"))


def exposure_totals_v(moves: DataFrame, as_of: date) -> DataFrame:
    """Receivables and overdue residual, drafts included, 2 decimals."""
    return moves_stats_v(moves, as_of).select(
        C.money_out(F.col("total_ar")).alias("total_ar"),
        C.money_out(F.col("overdue_ar")).alias("overdue_ar"))


def kpi_bundle_v(moves: DataFrame, journals_all: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """The variant's seven KPIs: one scan of the moves, two journal scalars."""
    cash = _all_cash(journals_all)
    burn = _burn_v()
    return moves_stats_v(moves, as_of, months).select(
        F.bround("dso_raw", 1).alias("dso"),
        burn.alias("burn_rate"),
        _runway(liquid_balance_value(journals_all), burn).alias("cash_runway"),
        _liquidity_v(cash).alias("liquidity_ratio"),
        C.money_out(cash).alias("total_cash"),
        C.money_out(F.col("total_ar")).alias("total_ar"),
        C.money_out(F.col("overdue_ar")).alias("overdue_ar"))


def kpi_levels_v(bundle_v: DataFrame, th: S.ThresholdsV = S.ThresholdsV()) -> DataFrame:
    """Variant traffic lights: greater-is-better for runway and liquidity."""
    def good_high(x: Column, good: float, warn: float) -> Column:
        return F.when(x > good, S.SUCCESS).when(x > warn, S.WARNING).otherwise(S.DANGER)

    return bundle_v.select(
        good_high(F.col("cash_runway"), th.runway_good, th.runway_warn).alias("color_runway"),
        F.when(F.col("dso") < th.dso_good, S.SUCCESS).when(F.col("dso") < th.dso_warn, S.WARNING)
         .otherwise(S.DANGER).alias("color_dso"),
        good_high(F.col("liquidity_ratio"), th.liq_good, th.liq_warn).alias("color_liq"))


# -- formulas published in the documentation only ------------------------------

def dso_doc(staged: DataFrame, lookback_days: int = 365) -> DataFrame:
    """Open receivables / annualised billing * 365, 1 decimal.

    Billing of the loaded window is annualised by 365 / look-back days.
    """
    annual = F.col("billed_out").cast("double") * (365.0 / lookback_days)
    return _billed(staged).select(F.coalesce(
        F.bround(F.try_divide(F.col("residual_out").cast("double"), annual) * 365, 1),
        F.lit(0.0)).alias("dso"))


def burn_rate_doc(payments: DataFrame, as_of: date, months: int = 3) -> DataFrame:
    """Mean monthly outbound payments over the last 30*N days, 2 decimals."""
    cutoff = as_of - timedelta(days=30 * months)
    out = payments.filter((F.col("payment_type") == S.OUTBOUND) & (F.col("date") >= C.lit_date(cutoff)))
    return out.agg(F.coalesce(_mean_of_months(
        F.sum("amount"), F.count_distinct(C.month_label(F.col("date")))), F.lit(0.0)).alias("burn_rate"))


def liquidity_ratio_doc(staged: DataFrame, journals: DataFrame, as_of: date,
                        months: int = 3) -> DataFrame:
    """Liquid balance / monthly burn, 2 decimals; null when burn <= 0."""
    burn = _burn_col()
    return _burn_window(staged, as_of, months).select(
        F.when(burn > 0, F.bround(liquid_balance_value(journals).cast("double") / burn, 2))
        .alias("liquidity_ratio"))


def collection_rate_doc(staged: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Collection rate over customer invoices issued in the last ``days`` days."""
    recent = staged.filter(F.col("invoice_date") >= C.lit_date(as_of - timedelta(days=days)))
    return collection_rate(recent)
