"""Alert banner rows, the critical-table badge and KPI display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal import schema as S
from caudal.functions import columns as C

def _num() -> Column:
    return F.col("cash_runway")



def _fmt(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a fixed message with column text."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        parts += [F.lit(head), values[key]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def alerts(bundle: DataFrame) -> DataFrame:
    """severity, code, message rows from the KPI bundle (zero to two rows).

    Runway below 3 months is critical, below 6 a warning; invoices more than
    60 days overdue raise a warning, or danger from 10 of them. Built as one
    pass over the one-row bundle: an array of candidate rows, filtered and
    exploded.
    """
    n = F.col("n_criticas")
    candidates = F.array(
        F.struct(F.when(_num() < 3, F.lit(S.DANGER)).when(_num() < 6, F.lit(S.WARNING)).alias("severity"),
                 F.lit("cash_runway").alias("code"),
                 F.when(_num() < 3, _fmt(S.ALERT_RUNWAY_CRITICAL, runway=C.one_decimal_text(_num())))
                  .otherwise(_fmt(S.ALERT_RUNWAY_WARNING, runway=C.one_decimal_text(_num()))).alias("message")),
        F.struct(F.when(n > 0, F.when(n < 10, F.lit(S.WARNING)).otherwise(F.lit(S.DANGER))).alias("severity"),
                 F.lit("overdue_invoices").alias("code"),
                 _fmt(S.ALERT_OVERDUE_INVOICES, n=n.cast("string")).alias("message")),
    )
    return (bundle.select(F.inline(F.filter(candidates, lambda r: r["severity"].isNotNull())))
            .select("severity", "code", "message"))


def critical_badge(critical: DataFrame) -> DataFrame:
    """Badge over the critical table: danger above 5 rows, warning 1-5, success at 0."""
    n = F.col("n")
    return critical.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        "n",
        F.when(n > 0, _fmt(S.BADGE_INVOICES, n=n.cast("string"))).otherwise(F.lit(S.BADGE_NONE)).alias("texto"),
        F.when(n > 5, S.DANGER).when(n > 0, S.WARNING).otherwise(S.SUCCESS).alias("color"))


def kpi_display(bundle: DataFrame) -> DataFrame:
    """Card text of the KPI bundle: money with thousands separators, ``∞``
    for an infinite runway, ``>90×`` for a ratio from 90 up."""
    runway, liq = F.col("cash_runway"), F.col("liquidity_ratio")
    return bundle.select(
        C.money_text(F.col("saldo_liquido")).alias("saldo_liquido_txt"),
        _fmt(S.KPI_DAYS, x=C.one_decimal_text(F.col("dso"))).alias("dso_txt"),
        _fmt(S.KPI_PER_MONTH, x=C.money_text(F.col("burn_rate"))).alias("burn_rate_txt"),
        F.when(runway == float("inf"), F.lit(S.KPI_INFINITE))
         .otherwise(_fmt(S.KPI_MONTHS, x=C.one_decimal_text(runway))).alias("cash_runway_txt"),
        F.when(runway < 3, F.lit(S.RUNWAY_CRITICAL)).otherwise(F.lit(S.RUNWAY_OK)).alias("runway_badge"),
        F.when(liq < 90, _fmt(S.KPI_TIMES, x=F.format_number(liq, 2)))
         .otherwise(F.lit(S.KPI_LIQUIDITY_CAP)).alias("liquidity_ratio_txt"),
        C.money_text(F.col("total_cxc")).alias("total_cxc_txt"),
        C.money_text(F.col("cxc_vencida")).alias("cxc_vencida_txt"),
        _fmt(S.KPI_PERCENT, x=C.one_decimal_text(F.col("collection_rate"))).alias("collection_rate_txt"),
    )
