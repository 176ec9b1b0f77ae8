"""Ledger bundle and the three extraction sources (moves, payments, journals).

The sources apply the extraction filters as plain DataFrame predicates, so
Catalyst pushes them into the Parquet scan (``PushedFilters``) and prunes
columns to the ones the reports read.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import schema as S
from caudal.functions.columns import count_docs, lit_date
from caudal.sources import decode


@dataclass(frozen=True)
class Ledger:
    moves: DataFrame
    payments: DataFrame
    journals: DataFrame


MOVE_COLUMNS = ("id", "name", "move_type", "state", "invoice_date", "date_maturity",
                "amount_total", "amount_residual", "partner_name")


def _since(moves: DataFrame, cutoff: date) -> DataFrame:
    """``invoice_date >= cutoff``, plus the same bound on the period partition
    column when the ledger is partitioned, so whole folders are pruned."""
    df = moves.filter(F.col("invoice_date") >= lit_date(cutoff))
    if S.INVOICE_PERIOD in moves.columns:
        df = df.filter(F.col(S.INVOICE_PERIOD) >= cutoff.strftime(S.PERIOD_STRFTIME))
    return df


def moves_source(moves: DataFrame, as_of: date, lookback_days: int = 365) -> DataFrame:
    """Posted customer invoices and vendor bills issued in the look-back window."""
    cutoff = as_of - timedelta(days=lookback_days)
    return (_since(moves, cutoff)
            .filter(F.col("move_type").isin(S.OUT_INVOICE, S.IN_INVOICE)
                    & (F.col("state") == S.POSTED))
            .select(*MOVE_COLUMNS))


def undated_documents(moves: DataFrame) -> DataFrame:
    """How many documents no report can show, for want of an invoice date, by type.

    Counted on the ledger itself, before any window: the window drops these
    rows. The null test reaches the scan, so only their partition (or row
    groups) is read.
    """
    return (moves.filter(F.col("invoice_date").isNull()).groupBy("move_type")
            .agg(count_docs(moves).alias("n_undated")))


def undated_payments(payments: DataFrame) -> DataFrame:
    """How many payments no window can hold, for want of a date, by type; counted before any window."""
    return (payments.filter(F.col("date").isNull()).groupBy("payment_type")
            .agg(F.count(F.lit(1)).alias("n_undated")))


def payments_source(payments: DataFrame, as_of: date, lookback_days: int = 365) -> DataFrame:
    cutoff = as_of - timedelta(days=lookback_days)
    if "journal_tipo" in payments.columns:
        journal = F.coalesce(F.col("journal_tipo"), F.lit(S.UNKNOWN_JOURNAL))
    elif "journal_id" in payments.columns:
        journal = decode.many2one_name(F.col("journal_id"), S.UNKNOWN_JOURNAL)
    else:
        journal = F.lit(S.UNKNOWN_JOURNAL)
    partner = F.col("partner_name") if "partner_name" in payments.columns else F.lit(None).cast("string")
    if S.PAYMENT_PERIOD in payments.columns:  # written ledger: prune period folders
        payments = payments.filter(F.col(S.PAYMENT_PERIOD) >= cutoff.strftime(S.PERIOD_STRFTIME))
    return (payments
            .filter((F.col("state") == S.POSTED)
                    & (F.col("date") >= lit_date(cutoff))
                    & F.col("payment_type").isin(S.INBOUND, S.OUTBOUND))
            .select("id", "date", "amount", "payment_type", "state",
                    partner.alias("partner_name"), journal.alias("journal_tipo")))


def journals_source(journals: DataFrame) -> DataFrame:
    """Bank and cash journals; an unreadable balance counts as 0."""
    return (journals
            .filter(F.col("type").isin(*S.LIQUID_JOURNAL_TYPES))
            .select("id", "name", "type",
                    F.coalesce(F.col("current_balance").cast(S.MONEY),
                               F.lit(0).cast(S.MONEY)).alias("current_balance")))


def main_ledger(raw: Ledger, as_of: date, lookback_days: int = 365) -> Ledger:
    """What the main pipeline's extraction returns."""
    return Ledger(moves_source(raw.moves, as_of, lookback_days),
                  payments_source(raw.payments, as_of, lookback_days),
                  journals_source(raw.journals))


def variant_moves(raw_moves: DataFrame, as_of: date, lookback_days: int = 365) -> DataFrame:
    """The variant pipeline keeps drafts and the payment date (trap T4)."""
    cutoff = as_of - timedelta(days=lookback_days)
    return _since(raw_moves, cutoff).select(*S.MOVES_SCHEMA.fieldNames())


def attach_partner_names(moves: DataFrame, partners: DataFrame,
                         key: str = "partner_id") -> DataFrame:
    """Partner lookup for sources that deliver ids only.

    ``partners`` has one row per ``key`` with a ``partner_name``. A plain
    left equi-join: Catalyst broadcasts the partner side when its statistics
    say it is small and shuffles both sides otherwise; with one row per key
    on that side, a hot partner only skews the moves side, which AQE's skew
    join splits. A missing partner becomes ``Sin partner``.
    """
    named = partners.select(F.col(key), F.col("partner_name").alias("_pname"))
    out = moves.drop("partner_name").join(named, key, "left")
    return out.withColumn("partner_name", F.coalesce(F.col("_pname"), F.lit(S.NO_PARTNER))).drop("_pname")


def normalize_journals(journals: DataFrame) -> DataFrame:
    """The second pipeline names the balance column ``balance``."""
    if "balance" in journals.columns and "current_balance" not in journals.columns:
        return journals.withColumnRenamed("balance", "current_balance")
    return journals


PERIODS = (S.INVOICE_PERIOD, S.PAYMENT_PERIOD)


def conform(df: DataFrame, schema: T.StructType, check_nulls: bool = False) -> DataFrame:
    """Validate ``df`` against ``schema`` once, on ingest.

    A missing nullable column is added as a typed null (the reference skips a
    report or a column when an optional field is absent); a missing required
    column is an error. Every column is cast to its schema type, in schema
    order; a period column the files are partitioned by is kept behind them,
    so the look-back window still prunes folders. With ``check_nulls`` a null
    in a required column fails the job (text formats; a Parquet column keeps
    its plain form, which filters can be pushed through).
    """
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have and not f.nullable]
    if missing:
        raise ValueError(f"missing required columns: {missing}")

    def column(f: T.StructField) -> Column:
        value = (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
        if check_nulls and not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"missing value in required column {f.name}")).cast(f.dataType))
        return value.alias(f.name)

    return df.select(*map(column, schema.fields), *[F.col(c).cast("string").alias(c) for c in PERIODS if c in have])


def load_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> Ledger:
    """Read ``moves``, ``payments``, ``journals`` under ``path`` with fixed schemas.

    ``fmt`` is any Spark batch format (parquet, json, csv, orc). JSON exports
    of the ERP (text fields, ``[id, "name"]`` many-to-one values) are decoded
    with :mod:`caudal.sources.decode` when ``fmt == "erp-json"``. Text formats
    are read with ``FAILFAST``: a malformed row fails the load.
    """
    strict = {"mode": "FAILFAST"}
    if fmt == "erp-json":
        def raw(name: str, schema: T.StructType) -> DataFrame:
            return spark.read.options(**strict).schema(schema).json(f"{path}/{name}")
        return Ledger(decode.decode_moves(raw("moves", S.RAW_MOVES_SCHEMA)),
                      decode.decode_payments(raw("payments", S.RAW_PAYMENTS_SCHEMA)),
                      decode.decode_journals(raw("journals", S.RAW_JOURNALS_SCHEMA)))
    text = fmt in ("csv", "json")
    opts = {**(strict if text else {}), **({"header": "true"} if fmt == "csv" else {})}

    def read(name: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format(fmt).options(**opts)
        if not text:
            return conform(reader.load(f"{path}/{name}"), schema)
        # No inference pass; the columns a file lacks come from its header (csv) or are null (json).
        names = reader.load(f"{path}/{name}").columns if fmt == "csv" else schema.fieldNames()
        kinds = T.StructType([T.StructField(n, schema[n].dataType if n in schema.fieldNames() else T.StringType())
                              for n in names])
        return conform(reader.schema(kinds).load(f"{path}/{name}"), schema, check_nulls=True)

    def read_journals() -> DataFrame:
        reader = spark.read.format(fmt).options(**opts)
        if fmt == "json":
            fields = [*S.JOURNALS_SCHEMA.fields, T.StructField("balance", S.MONEY)]
            df = reader.schema(T.StructType(fields)).load(f"{path}/journals")
            df = df.withColumn("current_balance", F.coalesce("current_balance", "balance")).drop("balance")
        else:
            df = normalize_journals(reader.load(f"{path}/journals"))
        return conform(df, S.JOURNALS_SCHEMA, check_nulls=text)

    return Ledger(read("moves", S.MOVES_SCHEMA), read("payments", S.PAYMENTS_SCHEMA), read_journals())
