"""Column expressions shared by all operators.

Everything here is a built-in ``pyspark.sql.functions`` expression, so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal import schema as S


def lit_date(d: date) -> Column:
    return F.lit(d).cast("date")


def zero_money() -> Column:
    return F.lit(0).cast(S.MONEY)


def money(c: Column) -> Column:
    """Back to decimal(18,2) after decimal arithmetic."""
    return c.cast(S.MONEY)


def money_out(c: Column, scale: int = 2) -> Column:
    """Decimal leaves the engine as a double rounded at its own scale.

    The cast is exact up to one ulp; rounding at the natural scale makes the
    double the nearest one to the exact decimal in every engine.
    """
    return F.bround(c.cast("double"), scale)


def ratio(num: Column, den: Column) -> Column:
    """num / den in double, null when den is 0 (ANSI-safe, trap T23)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# -- rows that stand for several documents (see caudal.operators.facts) -----

DOCS = "n_docs"


def count_docs(rows: DataFrame, cond: Column | None = None) -> Column:
    """How many documents of ``rows`` meet ``cond``: the rows themselves, or what they stand for."""
    if DOCS not in rows.columns:
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return F.coalesce(F.sum(F.col(DOCS) if cond is None else F.when(cond, F.col(DOCS))), F.lit(0))


def mean_docs(rows: DataFrame, cond: Column, value: Column) -> Column:
    """Mean of an integer ``value`` over the documents of ``rows`` that meet ``cond`` and have one."""
    value = F.when(cond, value)
    if DOCS not in rows.columns:
        return F.avg(value)
    return F.try_divide(F.sum(value * F.col(DOCS)).cast("double"), F.sum(F.when(value.isNotNull(), F.col(DOCS))))


# -- document predicates ---------------------------------------------------

def customer_invoice() -> Column:
    return F.col("move_type") == S.OUT_INVOICE


def vendor_bill() -> Column:
    return F.col("move_type") == S.IN_INVOICE


def residual() -> Column:
    return F.col("amount_residual")


def posted() -> Column:
    return F.col("state") == S.POSTED


def overdue(as_of: date) -> Column:
    """Due before ``as_of`` and still open: a bare predicate, null (as a filter:
    no) without a due date, so that both halves reach the scan."""
    return (F.col("date_maturity") < lit_date(as_of)) & (residual() > 0)


# -- date dimensions -------------------------------------------------------

def month_label(d: Column) -> Column:
    """``yyyy-MM`` like a pandas monthly Period."""
    return F.date_format(d, "yyyy-MM")


def quarter_label(d: Column) -> Column:
    """``2026Q4`` like a pandas quarterly Period."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def week_label(d: Column) -> Column:
    """``Monday/Sunday`` of the week, like a pandas weekly Period."""
    monday = F.date_trunc("week", d).cast("date")
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def month_start(month: Column) -> Column:
    """``yyyy-MM`` text to the first day of that month."""
    return F.to_date(F.concat(month, F.lit("-01")))


def day_month_year(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def short_month(d: Column) -> Column:
    """``Aug 01`` axis label."""
    return F.date_format(d, "MMM yy")


# -- overdue arithmetic ----------------------------------------------------

def days_overdue(maturity: Column, as_of: date) -> Column:
    """max(as_of - maturity, 0); a missing due date stays null (trap T6)."""
    return F.when(maturity.isNotNull(),
                  F.greatest(F.datediff(lit_date(as_of), maturity), F.lit(0)))


def days_to_collect(invoice_date: Column, maturity: Column) -> Column:
    """max(maturity - invoice_date, 0), null when either date is missing."""
    return F.when(maturity.isNotNull() & invoice_date.isNotNull(),
                  F.greatest(F.datediff(maturity, invoice_date), F.lit(0)))


def risk_level(days: Column) -> Column:
    return (F.when(days == 0, S.RISK_CURRENT)
            .when(days <= 30, S.RISK_LOW)
            .when(days <= 60, S.RISK_MEDIUM)
            .when(days > 60, S.RISK_CRITICAL)
            .otherwise(S.RISK_NO_DUE_DATE))


def aging_bucket(days: Column) -> Column:
    a = S.AGING_LABELS
    return (F.when(days <= 0, a[0]).when(days <= 30, a[1]).when(days <= 60, a[2])
            .when(days <= 90, a[3]).when(days > 90, a[4]))


def aging_order(days: Column) -> Column:
    return (F.when(days <= 0, 0).when(days <= 30, 1).when(days <= 60, 2)
            .when(days <= 90, 3).when(days > 90, 4))


def overdue_bucket(days: Column) -> Column:
    o = S.OVERDUE_LABELS
    return (F.when(days <= 0, None).when(days <= 30, o[0]).when(days <= 60, o[1])
            .when(days <= 90, o[2]).when(days > 90, o[3]))


# -- text ------------------------------------------------------------------

def one_decimal_text(x: Column) -> Column:
    """A 1-decimal figure as Python prints it (``47.5``, ``5.0``,
    ``12345678.9``): through a decimal, so large values never turn into
    ``1.23E7``. Infinity is not representable and becomes null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x.cast("decimal(38,1)").cast("string"))


def money_text(x: Column) -> Column:
    """``$1,234,568`` (no decimals)."""
    return F.concat(F.lit("$"), F.format_number(x.cast("double"), 0))


def level_high_bad(x: Column, warn: float, crit: float) -> Column:
    """danger above ``crit``, warning above ``warn``, else success."""
    return F.when(x > crit, S.DANGER).when(x > warn, S.WARNING).otherwise(S.SUCCESS)


def level_low_bad(x: Column, warn: float, crit: float) -> Column:
    """danger below ``crit``, warning below ``warn``, else success."""
    return F.when(x < crit, S.DANGER).when(x < warn, S.WARNING).otherwise(S.SUCCESS)
