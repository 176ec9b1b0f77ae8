"""Ledger facts: the moves as additive sums, from which the reports follow.

Two grouping sets, taken in one pass:

* *day facts*, one row per type, state, issue day, due day and sign of the
  residual. They are themselves moves that stand for several documents each
  (``n_docs``): staging, KPIs, aging, monthly and projection operators take them
  in place of the moves, at any as-of date. Their number is bounded by the days
  and not by the ledger.
* *partner facts*, one row per customer and issue day: the open residual of the
  posted invoices, for the concentration.

All measures are exact sums, so facts can be added and, from a ledger that
changed, subtracted (:func:`signed`, :func:`summed`).
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import schema as S
from caudal.functions import columns as C

DAY, PARTNER = "day", "partner"
DAY_KEYS = ("move_type", "state", "invoice_date", "date_maturity", "sign")
PARTNER_KEYS = ("customer", "customer_day")
KEYS = ("kind", *DAY_KEYS, *PARTNER_KEYS)
MEASURES = (C.DOCS, "amount_total", "amount_residual", "n_paid", "paid_days")
SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("move_type", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("invoice_date", T.DateType()), T.StructField("date_maturity", T.DateType()), T.StructField("sign", T.IntegerType()),
    T.StructField("customer", T.StringType()), T.StructField("customer_day", T.DateType()),
    T.StructField(C.DOCS, T.LongType()), T.StructField("amount_total", S.MONEY), T.StructField("amount_residual", S.MONEY),
    T.StructField("n_paid", T.LongType()), T.StructField("paid_days", T.LongType())])


def _sum(c: Column, kind: str | T.DataType = "bigint") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(kind)


def ledger_facts(moves: DataFrame) -> DataFrame:
    """Both kinds of facts of ``moves``, in one scan. A sum beyond decimal(18,2) fails the job."""
    residual = F.col("amount_residual")
    open_invoice = C.customer_invoice() & C.posted() & (residual > 0) & F.col("invoice_date").isNotNull()
    rows = moves.select(
        "move_type", "state", "invoice_date", "date_maturity", F.signum(residual).cast("int").alias("sign"),
        F.when(open_invoice, F.col("partner_name")).alias("customer"),
        F.when(open_invoice, F.col("invoice_date")).alias("customer_day"),
        "amount_total", "amount_residual", "payment_date",
        F.col("invoice_date").alias("issued"))  # a grouping column is null inside the other set
    sets = [[F.col(c) for c in DAY_KEYS], [F.col(c) for c in PARTNER_KEYS]]
    return (rows.groupingSets(sets, *DAY_KEYS, *PARTNER_KEYS)
            .agg(F.grouping("move_type").alias("g"),
                 F.count(F.lit(1)).alias(C.DOCS), _sum(F.col("amount_total"), S.MONEY).alias("amount_total"),
                 _sum(residual, S.MONEY).alias("amount_residual"), F.count("payment_date").alias("n_paid"),
                 _sum(F.datediff("payment_date", "issued")).alias("paid_days"))
            .filter("g = 0 OR customer IS NOT NULL")
            .select(F.when(F.col("g") == 0, DAY).otherwise(PARTNER).alias("kind"), *DAY_KEYS, *PARTNER_KEYS, *MEASURES))


def signed(facts: DataFrame, sign: int) -> DataFrame:
    return facts.select(*KEYS, *((F.col(m) * sign).cast(SCHEMA[m].dataType).alias(m) for m in MEASURES))


def summed(*facts: DataFrame) -> DataFrame:
    """The facts added up; what adds up to nothing is gone."""
    rows = reduce(DataFrame.unionByName, facts)
    some = reduce(Column.__or__, (F.col(m) != 0 for m in MEASURES))  # a change may leave the documents' number as it was
    return (rows.groupBy(*KEYS).agg(*(_sum(F.col(m), SCHEMA[m].dataType).alias(m) for m in MEASURES))
            .filter(some).select(*SCHEMA.fieldNames()))


def day_facts(facts: DataFrame) -> DataFrame:
    """The day facts as rows of moves that stand for ``n_docs`` documents each."""
    return facts.filter(F.col("kind") == DAY).select(*DAY_KEYS, *MEASURES)


def window_facts(days: DataFrame, as_of: date, lookback_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Day facts of the look-back window: what the main pipeline extracts, and the variant's with drafts."""
    recent = days.filter(F.col("invoice_date") >= C.lit_date(as_of - timedelta(days=lookback_days)))
    return recent.filter(F.col("move_type").isin(S.OUT_INVOICE, S.IN_INVOICE) & C.posted()), recent


def open_by_customer(facts: DataFrame, as_of: date, lookback_days: int = 365) -> DataFrame:
    """The window's partner facts as open customer invoices, for the concentration."""
    return (facts.filter((F.col("kind") == PARTNER) & (F.col("customer_day") >= C.lit_date(as_of - timedelta(days=lookback_days))))
            .select(F.lit(S.OUT_INVOICE).alias("move_type"), F.col("customer").alias("partner_name"), "amount_residual"))
