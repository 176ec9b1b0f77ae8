"""Report tables: aging, monthly series, concentration, critical invoices.

Shape of every report plan: filter + narrow projection over the staged scan,
one hash aggregate on a small key (bucket, month; partner is the only large
key space), then work on the already-grouped rows. Windows without a
partition only ever see those grouped rows (at most 5 buckets or 12 months),
never the moves. Top-N uses ``orderBy(...).limit(n)``, which Spark plans as
a per-task top-N merged on one task (``TakeOrderedAndProject``): bounded by
N, not by the data.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from caudal import schema as S
from caudal.functions import columns as C
from caudal.operators.staging import date_range


def _all() -> WindowSpec:
    return Window.partitionBy()


def _share(part: Column, total: Column) -> Column:
    return F.bround(C.ratio(part, total) * 100, 1)


def _last_months(grouped: DataFrame, n: int) -> DataFrame:
    """The last ``n`` months present, oldest first (pandas ``tail`` after sort)."""
    return grouped.orderBy(F.col("month").desc()).limit(n).orderBy("month")


def aging_report(staged: DataFrame, position: bool = False) -> DataFrame:
    """Unpaid customer invoices per aging bucket: monto, facturas, porcentaje.

    Only non-empty buckets, in bucket order (``position`` keeps the bucket's
    number as ``posicion``); invoices without a due date have no bucket and
    are left out of the totals too.
    """
    grouped = (staged.filter(C.customer_invoice() & (C.residual() > 0) & F.col("date_maturity").isNotNull())
               .groupBy("tramo_orden", "tramo_aging")
               .agg(F.sum(C.residual()).alias("monto_d"), C.count_docs(staged).alias("facturas")))
    total = F.sum("monto_d").over(_all())
    return (grouped
            .select("tramo_orden",
                    F.col("tramo_aging").alias("tramo"),
                    C.money_out(F.col("monto_d")).alias("monto"),
                    F.col("facturas").cast("bigint").alias("facturas"),
                    F.when(total > 0, _share(F.col("monto_d"), total)).otherwise(F.lit(0.0))
                     .alias("porcentaje"))
            .orderBy("tramo_orden")
            .select(*([F.col("tramo_orden").alias("posicion")] if position else []),
                    "tramo", "monto", "facturas", "porcentaje"))


def overdue_aging_v(staged_v: DataFrame, as_of: date, start: date | None = None,
                    end: date | None = None) -> DataFrame:
    """Variant: overdue customer invoices in a period, residual per 4 buckets."""
    rows = date_range(staged_v, start, end).filter(C.customer_invoice() & C.overdue(as_of))
    bucket = C.overdue_bucket(F.col("days_overdue"))
    order = F.least(F.greatest(F.ceil(F.col("days_overdue") / 30), F.lit(1)), F.lit(4))
    return (rows.withColumns({"tramo": bucket, "_o": order})
            .filter(F.col("tramo").isNotNull())
            .groupBy("_o", "tramo").agg(F.sum(C.residual()).alias("_r"))
            .orderBy("_o")
            .select("tramo", C.money_out(F.col("_r")).alias("amount_residual")))


def monthly_facts(staged: DataFrame) -> DataFrame:
    """Per month and type, what the monthly reports are made of: one row per
    month and document type, so small enough to be written and read by all."""
    days = C.days_to_collect(F.col("invoice_date"), F.col("date_maturity"))
    closed = C.residual() == 0
    return (staged.filter(C.customer_invoice() | C.vendor_bill()).groupBy("month", "move_type")
            .agg(F.sum("amount_total").alias("total"), F.sum("collected_amt").alias("collected"),
                 C.count_docs(staged).alias("n"), C.count_docs(staged, closed).alias("n_closed"),
                 C.mean_docs(staged, closed, days).alias("mean_days")))


def monthly_comparison(staged: DataFrame, months: int = 12) -> DataFrame:
    """Customer invoices per month: billed, collected, count, rate; last N months."""
    return comparison_of(monthly_facts(staged.filter(C.customer_invoice())), months)


def comparison_of(facts: DataFrame, months: int = 12) -> DataFrame:
    """:func:`monthly_comparison` of :func:`monthly_facts` rows."""
    return (_last_months(facts.filter(C.customer_invoice()), months)
            .select("month",
                    C.money_out(F.col("total")).alias("facturado"),
                    C.money_out(F.col("collected")).alias("cobrado"),
                    F.col("n").cast("bigint").alias("n_facturas"),
                    F.coalesce(_share(F.col("collected"), F.col("total")), F.lit(0.0)).alias("tasa_cobro"),
                    C.month_start(F.col("month")).alias("month_dt")))


def monthly_comparison_v(staged_v: DataFrame, months: int = 12) -> DataFrame:
    """Variant: drafts included, English names, no null fill of the rate."""
    grouped = (staged_v.filter(C.customer_invoice()).groupBy("month")
               .agg(F.sum("amount_total").alias("f"), F.sum("collected_amt").alias("c"),
                    C.count_docs(staged_v).alias("n")))
    return (_last_months(grouped, months)
            .select("month",
                    C.money_out(F.col("f")).alias("invoiced"),
                    C.money_out(F.col("c")).alias("collected"),
                    F.col("n").cast("bigint").alias("count"),
                    _share(F.col("c"), F.col("f")).alias("collection_rate"),
                    C.month_start(F.col("month")).alias("month_dt")))


def monthly_net_cashflow(staged: DataFrame, months: int = 12) -> DataFrame:
    """Collected customer invoices minus vendor bills per month, plus a Total row.

    A month missing on one side gives 0 there. The Total row sums the months
    shown and is dated one month after the last; without any month there is
    no row at all.
    """
    return net_of(monthly_facts(staged), months)


def net_of(facts: DataFrame, months: int = 12) -> DataFrame:
    """:func:`monthly_net_cashflow` of :func:`monthly_facts` rows: conditional
    sums in place of the reference's outer join of two monthly series."""
    grouped = (facts.groupBy("month")
               .agg(F.coalesce(F.sum(F.when(C.customer_invoice(), F.col("collected"))), C.zero_money()).alias("i"),
                    F.coalesce(F.sum(F.when(C.vendor_bill(), F.col("total"))), C.zero_money()).alias("e")))
    shown = _last_months(grouped, months).select(
        "month", "i", "e", (F.col("i") - F.col("e")).alias("n"),
        C.month_start(F.col("month")).alias("month_dt"),
        F.lit(S.WATERFALL_RELATIVE).alias("tipo"))
    total = shown.agg(
        F.lit(S.TOTAL_LABEL).alias("month"), F.sum("i").alias("i"), F.sum("e").alias("e"), F.sum("n").alias("n"),
        F.add_months(F.max("month_dt"), 1).alias("month_dt"),
        F.lit(S.WATERFALL_TOTAL).alias("tipo")).filter(F.col("month_dt").isNotNull())
    return (shown.unionByName(total)
            .select("month",
                    C.money_out(F.col("i")).alias("ingresos"),
                    C.money_out(F.col("e")).alias("egresos"),
                    C.money_out(F.col("n")).alias("neto"),
                    "month_dt", "tipo"))


def waterfall_labels(net: DataFrame) -> DataFrame:
    """Axis label per waterfall bar: ``Aug 01`` for months, ``Total`` last."""
    return net.withColumn(
        "etiqueta",
        F.when(F.col("tipo") == S.WATERFALL_RELATIVE, C.short_month(F.col("month_dt")))
         .otherwise(F.lit(S.TOTAL_LABEL)))


def client_concentration(staged: DataFrame, top_n: int = 8) -> DataFrame:
    """Open receivables per customer: top N, the rest summed as ``Otros``.

    The per-partner aggregate is the only large-key shuffle of the reports; a
    hot partner is pre-reduced by partial aggregation in every task. The top
    N is a bounded ``TakeOrderedAndProject``; the grand total and the top
    sum are scalar subqueries over that same aggregate (its exchange is
    reused), and ``Otros`` is their difference. Ties on the amount are
    ordered by name.
    """
    per = (staged.filter(C.customer_invoice() & (C.residual() > 0)).groupBy("partner_name")
           .agg(F.sum(C.residual()).alias("m")))
    top = per.orderBy(F.col("m").desc(), F.col("partner_name")).limit(top_n)
    totals = per.agg(F.sum("m").alias("total"))
    total = totals.scalar()
    top_sum = top.agg(F.coalesce(F.sum("m"), C.zero_money())).scalar()
    others = (totals.select(F.lit(S.OTHERS_LABEL).alias("partner_name"),
                            (F.col("total") - top_sum).alias("m"), F.lit(1).alias("_g"))
              .filter(F.col("m") > 0))
    return (top.withColumn("_g", F.lit(0)).unionByName(others)
            .orderBy("_g", F.col("m").desc(), "partner_name")
            .select(F.col("partner_name").alias("cliente"),
                    C.money_out(F.col("m")).alias("monto"),
                    _share(F.col("m"), total).alias("porcentaje")))


def collections_velocity(staged: DataFrame, months: int = 12, min_invoices: int = 3) -> DataFrame:
    """Mean days-to-collect per month over collected invoices, with a 3-row average.

    Months need at least ``min_invoices`` invoices. Order of the reference
    kept (trap T12): round each month, keep the last N, then average by row.
    """
    return velocity_of(monthly_facts(staged.filter(C.customer_invoice() & (C.residual() == 0))), months, min_invoices)


def velocity_of(facts: DataFrame, months: int = 12, min_invoices: int = 3) -> DataFrame:
    """:func:`collections_velocity` of :func:`monthly_facts` rows."""
    last = _last_months(facts.filter(C.customer_invoice() & (F.col("n_closed") >= min_invoices)), months).select(
        "month", F.bround("mean_days", 1).alias("dso_mes"), F.col("n_closed").cast("bigint").alias("n_fact"),
        C.month_start(F.col("month")).alias("month_dt"))
    w = Window.orderBy("month_dt").rowsBetween(-2, 0)
    return last.withColumn("dso_ma3", F.bround(F.avg("dso_mes").over(w), 1)).orderBy("month_dt")


def _with_text(totals: DataFrame) -> DataFrame:
    return totals.select(
        C.money_out(F.col("p")).alias("total_pendiente"),
        C.money_out(F.col("s")).alias("saldo_diarios"),
        C.money_text(F.col("p")).alias("total_pendiente_txt"),
        C.money_text(F.col("s")).alias("saldo_diarios_txt"))


def grand_totals(staged: DataFrame, journals: DataFrame) -> DataFrame:
    """Totals printed in the middle of the two donuts: the unpaid receivables
    of the aging report and the sum of the bank and cash balances."""
    liquid = (journals.filter(F.col("type").isin(*S.LIQUID_JOURNAL_TYPES))
              .agg(F.coalesce(F.sum("current_balance"), C.zero_money())).scalar())
    aged = staged.filter(C.customer_invoice() & (C.residual() > 0) & F.col("date_maturity").isNotNull())
    return _with_text(aged.agg(F.coalesce(F.sum(C.residual()), C.zero_money()).alias("p")).select("p", liquid.alias("s")))


def grand_totals_of(aging: DataFrame, journals: DataFrame) -> DataFrame:
    """:func:`grand_totals` of a finished aging report and journal breakdown."""
    def total(df: DataFrame, c: str) -> Column:
        return df.agg(F.coalesce(F.sum(F.bround(c, 2).cast(S.MONEY)), C.zero_money())).scalar()
    return _with_text(aging.sparkSession.range(1).select(total(aging, "monto").alias("p"),
                                                         total(journals, "current_balance").alias("s")))


def journal_breakdown(journals: DataFrame) -> DataFrame:
    """Bank and cash accounts with their balances."""
    return (journals.filter(F.col("type").isin(*S.LIQUID_JOURNAL_TYPES))
            .select("name", "type", C.money_out(F.col("current_balance")).alias("current_balance")))


def critical_invoices(staged: DataFrame, as_of: date, top_n: int = 15) -> DataFrame:
    """Top N overdue customer invoices by open residual (ties: name, id)."""
    top = (staged.filter(C.customer_invoice() & C.overdue(as_of))
           .orderBy(C.residual().desc(), F.col("name"), F.col("id")).limit(top_n))
    return top.select(
        "name", "partner_name",
        C.day_month_year(F.col("invoice_date")).alias("invoice_date"),
        C.day_month_year(F.col("date_maturity")).alias("date_maturity"),
        C.money_out(F.col("amount_total")).alias("amount_total"),
        C.money_out(C.residual()).alias("amount_residual"),
        "days_overdue", "nivel_riesgo")


def critical_invoices_display(critical: DataFrame) -> DataFrame:
    """Table headers of the alert table, money as ``$1,234``."""
    renamed = critical.withColumns({
        "amount_total": C.money_text(F.col("amount_total")),
        "amount_residual": C.money_text(F.col("amount_residual")),
    })
    return renamed.withColumnsRenamed(
        {k: v for k, v in S.CRITICAL_TABLE_HEADERS.items() if k in critical.columns})


def collection_target(monthly: DataFrame, pct: float = S.COLLECTION_TARGET_PCT) -> DataFrame:
    """The monthly comparison with the collection rate aimed at, its target line."""
    return monthly.withColumn("meta_cobro", F.lit(pct))


def velocity_target(velocity: DataFrame, days: float = S.DSO_TARGET_DAYS) -> DataFrame:
    """The collections velocity with the days aimed at, its target line."""
    return velocity.withColumn("umbral_dso", F.lit(days))
