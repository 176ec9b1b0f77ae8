"""Registered queries: one per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the ledger mapped from
the given tables at the fixed parameters below. Nothing is collected: the
caller runs the action.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import schema as S
from caudal.operators import alerts as A
from caudal.operators import kpis as K
from caudal.operators import projection as P
from caudal.operators import reports as R
from caudal.operators.staging import date_range, stage, stage_v
from caudal.session import shared_dir
from caudal.sources import decode
from caudal.sources import ledger as L
from caudal.sources.ledger import Ledger, main_ledger, variant_moves
from caudal.sources.pages import FORMAT, load_pages, register_pages
from caudal.sources.rejects import Sifted, sift_ledger
from caudal.sources.tables import ledger_signature, mapped_ledger, materialise_ledger, table

# The registered queries' run: its date, and the dates of the "_at" and "_empty" ones.
PARAMS = S.Params(as_of=date(2001, 8, 1))
EARLIER = replace(PARAMS, as_of=date(2001, 5, 1))
NO_MOVES = replace(PARAMS, as_of=date(2030, 1, 1))
# Period of the date-range operator: the last quarter before the as-of date.
RANGE_START = date(2001, 5, 1)
RANGE_END = date(2001, 7, 31)


class Ctx:
    """Inputs of one query, built on first use (plan building is not free)."""

    def __init__(self, spark: SparkSession, sf_dir: str | None, p: S.Params, raw: Ledger | None = None):
        self.spark, self.sf_dir, self.p = spark, sf_dir, p
        self.loads: dict[str, object] = {}  # copies of the ledger in other formats
        if raw is not None:
            self.raw = raw  # overrides the mapped ledger (any source, see publish)

    @cached_property
    def raw(self) -> Ledger:
        return mapped_ledger(self.spark, self.sf_dir, self.p.as_of)

    @cached_property
    def main(self) -> Ledger:
        return main_ledger(self.raw, self.p.as_of, self.p.lookback_days)

    @cached_property
    def staged(self) -> DataFrame:
        return stage(self.main.moves, self.p.as_of)

    @cached_property
    def moves_v(self) -> DataFrame:
        return variant_moves(self.raw.moves, self.p.as_of, self.p.lookback_days)

    @cached_property
    def staged_v(self) -> DataFrame:
        return stage_v(self.moves_v, self.p.as_of)


_CONTEXTS: dict[tuple[str, str, S.Params], Ctx] = {}


def context(spark: SparkSession, sf_dir: str, p: S.Params = PARAMS) -> Ctx:
    """One context per application, state of the input files and parameters: the
    staged frames are plans only, so every query of a session shares them."""
    key = (spark.sparkContext.applicationId, ledger_signature(spark, sf_dir), p)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Ctx(spark, sf_dir, p)
    return _CONTEXTS[key]


def materialise(spark: SparkSession, sf_dir: str, *params: S.Params) -> None:
    """Write the mapped ledger of ``sf_dir`` for the queries of this session and
    later ones to read (default: with the balances of all registered dates)."""
    params = params or tuple(dict.fromkeys(p for _, p in _REGISTRY.values()))
    materialise_ledger(spark, sf_dir, *dict.fromkeys(p.as_of for p in params))
    signature = ledger_signature(spark, sf_dir)
    for key in [k for k in _CONTEXTS if k[1] == signature]:
        del _CONTEXTS[key]  # plans over the mapping


def to_output(df: DataFrame) -> DataFrame:
    """Decimals leave as doubles rounded at their scale (see ``money_out``)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.bround(F.col(f.name).cast("double"), f.dataType.scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# -- raw ERP text derived from the mapped ledger (input of the decoders) -------------

def erp_moves_text(raw_moves: DataFrame) -> DataFrame:
    """The moves as the ERP exports them, with its irregularities spread over the
    ids: text fields, ``false`` for an empty date, dates with a time of day or
    without leading zeros, unreadable dates, ``[id, "name"]`` partners, one-item
    lists and ``false`` for a missing partner."""
    i, day = F.col("id"), F.col("invoice_date")
    issued = (F.when(i % 4 == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
              .when(i % 4 == 2, F.concat(day.cast("string"), F.lit("T10:00:00")))
              .when(i % 4 == 3, F.date_format(day, "yyyy-M-d")).otherwise(day.cast("string")))
    partner = (F.when(i % 7 == 0, F.concat(F.lit("["), i.cast("string"), F.lit("]")))
               .when(i % 13 == 0, F.lit("false"))
               .otherwise(F.concat(F.lit("["), i.cast("string"), F.lit(', "'), F.col("partner_name"), F.lit('"]'))))
    return raw_moves.select(
        i.cast("string").alias("id"), "name", "move_type", "state",
        F.coalesce(issued, F.lit("false")).alias("invoice_date"),
        F.when(i % 11 == 0, F.lit("n/a")).otherwise(F.coalesce(F.col("date_maturity").cast("string"), F.lit("false")))
         .alias("invoice_date_due"),
        F.col("amount_total").cast("string").alias("amount_total"),
        F.col("amount_residual").cast("string").alias("amount_residual"),
        partner.alias("partner_id"),
        F.coalesce(F.col("payment_date").cast("string"), F.lit("false")).alias("payment_date"))


def erp_payments_text(raw_payments: DataFrame) -> DataFrame:
    """Payments as exported; every fourth has no journal, every ninth a one-item list, every tenth an unreadable date."""
    i = F.col("id")
    journal = (F.when(i % 4 == 0, F.lit("false")).when(i % 9 == 0, F.lit("[3]"))
               .otherwise(F.concat(F.lit("[3, \"Banco "), (i % 3).cast("string"), F.lit('"]'))))
    return raw_payments.select(
        i.cast("string").alias("id"),
        F.when(i % 10 == 3, F.lit("n/a")).otherwise(F.col("date").cast("string")).alias("date"),
        F.col("amount").cast("string").alias("amount"), "payment_type", "state",
        F.concat(F.lit('[9, "'), F.col("partner_name"), F.lit('"]')).alias("partner_id"), journal.alias("journal_id"))


def erp_journals_text(raw_journals: DataFrame) -> DataFrame:
    """Journals as exported; every second balance cannot be read."""
    return raw_journals.select(
        F.col("id").cast("string").alias("id"), "name", "type",
        F.when(F.col("id") % 2 == 0, F.lit("abc")).otherwise(F.col("current_balance").cast("string"))
         .alias("current_balance"))


# Copies in text formats: compressed, in files that one task reads back.
TEXT_FILES = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}


def _reloaded(c: Ctx, fmt: str) -> Ledger:
    """The ledger written to the shared folder in ``fmt`` and loaded from there, once per context.

    The csv copy has no payment date (an optional column) and names the
    balance ``balance``; the Parquet copy is partitioned by period.
    """
    if fmt in c.loads:
        return c.loads[fmt]
    path = f"{shared_dir(c.spark)}/caudal/loads/{uuid.uuid4().hex}"
    moves, payments, journals = c.raw.moves, c.raw.payments, c.raw.journals
    if fmt == "erp-json":
        frames = erp_moves_text(moves), erp_payments_text(payments), erp_journals_text(journals)
    else:
        moves = moves.select(*S.MOVES_SCHEMA.fieldNames(), *([S.INVOICE_PERIOD] if fmt == "parquet" else []))
        payments = payments.select("id", "date", "amount", "payment_type", "state", "partner_name")
        frames = moves.drop("payment_date") if fmt == "csv" else moves, payments, (
            journals.withColumnRenamed("current_balance", "balance") if fmt == "csv" else journals)
    for name, df in zip(("moves", "payments", "journals"), frames):
        writer = df.write.option("header", "true")
        if fmt != "parquet":
            writer = writer.options(**TEXT_FILES)
        if S.INVOICE_PERIOD in df.columns:
            writer = writer.partitionBy(*S.LEDGER_PARTITIONS)
        writer.format("json" if fmt == "erp-json" else fmt).save(f"{path}/{name}")
    c.loads[fmt] = L.load_ledger(c.spark, path, fmt)
    return c.loads[fmt]


def faulty_export(raw: Ledger) -> dict[str, DataFrame]:
    """The ERP export as lines of JSON, some of them bad: lines cut off in the
    middle, ids missing, amounts and ids that are no numbers, spread over the ids."""
    def lines(df: DataFrame, cut: Column | None = None) -> DataFrame:
        line = F.to_json(F.struct(*df.columns))
        if cut is not None:
            line = F.when(cut, F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))).otherwise(line)
        return df.select(line.alias("value"))

    i = F.col("id").cast("bigint")
    moves = erp_moves_text(raw.moves).withColumns({
        "amount_total": F.when(i % 19 == 4, F.lit("n/d")).otherwise(F.col("amount_total")), "_i": i})
    moves = moves.withColumn("id", F.when(i % 23 != 5, F.col("id")))
    payments = erp_payments_text(raw.payments).withColumns({
        "amount": F.when(i % 31 == 7, F.lit("12,50 MXN")).otherwise(F.col("amount")),
        "id": F.when(i % 37 == 8, F.concat(F.lit("P-"), F.col("id"))).otherwise(F.col("id"))})
    journals = erp_journals_text(raw.journals).withColumn("id", F.when(i == 4, F.lit("four")).otherwise(F.col("id")))
    return {"moves": lines(moves, F.col("_i") % 29 == 6), "payments": lines(payments), "journals": lines(journals)}


def _sifted(c: Ctx) -> Sifted:
    """The faulty export, written to the shared folder once per context and sifted from there."""
    if "faulty" not in c.loads:
        path = f"{shared_dir(c.spark)}/caudal/loads/{uuid.uuid4().hex}"
        for name, df in faulty_export(c.raw).items():
            df.write.options(**TEXT_FILES).text(f"{path}/{name}")
        c.loads["faulty"] = path
    return sift_ledger(c.spark, c.loads["faulty"])


PAGE_RECORDS = 2000


def write_pages(df: DataFrame, path: str, page_records: int = PAGE_RECORDS) -> None:
    """Raw rows (text) as compressed page files of ``page_records`` records, as ``search_read`` returns them:
    many-to-one fields as pairs. Each task cuts its own rows into pages, so no record is shuffled or sorted."""
    pairs = [c for c in ("partner_id", "journal_id") if c in df.columns]
    plain = F.to_json(F.struct(*(c for c in df.columns if c not in pairs)))
    for c in pairs:
        df = df.filter(F.col(c).isNotNull())  # without its pair a row is no record
    record = F.concat(*(x for c in pairs for x in (F.lit(f'"{c}": '), F.col(c), F.lit(", "))), F.substring(plain, 2, 1 << 30))
    register_pages(df.sparkSession)
    (df.select(F.concat(F.lit("{"), record).alias("record"))
     .write.format(FORMAT).option("page_records", page_records).mode("append").save(path))


def _paged(c: Ctx) -> str:
    """The export as page files in the shared folder, written once per context."""
    if "pages" not in c.loads:
        path = f"{shared_dir(c.spark)}/caudal/loads/{uuid.uuid4().hex}"
        for name, df in (("moves", erp_moves_text(c.raw.moves)), ("payments", erp_payments_text(c.raw.payments)),
                         ("journals", erp_journals_text(c.raw.journals))):
            write_pages(df, f"{path}/{name}")
        c.loads["pages"] = path
    return c.loads["pages"]


def _partner_lookup(c: Ctx) -> DataFrame:
    """Orders that deliver a customer id only, named by the lookup."""
    ids = table(c.spark, c.sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("partner_id"))
    names = table(c.spark, c.sf_dir, "customer").select(F.col("c_custkey").alias("partner_id"), F.col("c_name").alias("partner_name"))
    return L.attach_partner_names(ids, names).select("id", "partner_name")


# -- the registry -------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Callable[[Ctx], DataFrame], S.Params]] = {}


def _q(name: str, p: S.Params = PARAMS):
    def deco(fn: Callable[[Ctx], DataFrame]):
        _REGISTRY[name] = fn, p
        return fn
    return deco


# sources and decoders
_q("moves_source")(lambda c: c.main.moves)
_q("payments_source")(lambda c: c.main.payments)
_q("journals_source")(lambda c: c.main.journals)
_q("many2one_partner")(lambda c: erp_moves_text(c.raw.moves).select(
    F.col("id").cast("bigint").alias("id"),
    decode.many2one_name(F.col("partner_id"), S.NO_PARTNER).alias("partner_name")))
_q("lenient_dates")(lambda c: erp_moves_text(c.raw.moves).select(
    F.col("id").cast("bigint").alias("id"),
    decode.lenient_date(F.col("invoice_date")).alias("invoice_date"),
    decode.lenient_date(F.col("invoice_date_due")).alias("date_maturity"),
    decode.lenient_date(F.col("payment_date")).alias("payment_date")))
_q("lenient_balances")(lambda c: decode.decode_journals(erp_journals_text(c.raw.journals)))
_q("journal_decode")(lambda c: L.payments_source(
    decode.decode_payments(erp_payments_text(c.raw.payments)), c.p.as_of, c.p.lookback_days))
_q("load_csv")(lambda c: _reloaded(c, "csv").moves)
_q("load_json")(lambda c: _reloaded(c, "json").moves)
_q("load_parquet")(lambda c: L.moves_source(_reloaded(c, "parquet").moves, c.p.as_of, c.p.lookback_days))
_q("load_erp")(lambda c: _reloaded(c, "erp-json").moves)
for _key, _fmt in (("csv", "csv"), ("json", "json"), ("parquet", "parquet"), ("erp", "erp-json")):
    _q(f"load_payments_{_key}")(lambda c, _f=_fmt: _reloaded(c, _f).payments.select(*S.PAYMENTS_SCHEMA.fieldNames()))
    _q(f"load_journals_{_key}")(lambda c, _f=_fmt: _reloaded(c, _f).journals)
_q("load_rejects")(lambda c: _sifted(c).rejects.select("table_name", "reason", "id"))
_q("load_accepted")(lambda c: _sifted(c).ledger.moves)
_q("load_accepted_payments")(lambda c: _sifted(c).ledger.payments)
_q("load_pages")(lambda c: load_pages(c.spark, _paged(c)).moves)
_q("load_pages_since")(lambda c: L.moves_source(load_pages(
    c.spark, _paged(c), (c.p.as_of - timedelta(days=c.p.lookback_days)).isoformat()).moves, c.p.as_of, c.p.lookback_days))
_q("partner_lookup")(_partner_lookup)
_q("undated_documents")(lambda c: L.undated_documents(c.raw.moves))
_q("undated_payments")(lambda c: L.undated_payments(c.raw.payments))
_q("undated_payments_erp")(lambda c: L.undated_payments(decode.decode_payments(erp_payments_text(c.raw.payments))))

# staging
_q("staging")(lambda c: c.staged)
_q("staging_v")(lambda c: c.staged_v)
_q("risk_levels")(lambda c: c.staged.select("id", "move_type", "days_overdue", "nivel_riesgo"))
_q("date_range")(lambda c: date_range(c.staged, RANGE_START, RANGE_END))

# KPIs
_q("dso")(lambda c: K.dso(c.staged))
_q("dso_v")(lambda c: K.dso_v(c.moves_v))
_q("dso_doc")(lambda c: K.dso_doc(c.staged, c.p.lookback_days))
_q("burn_rate")(lambda c: K.burn_rate(c.staged, c.p.as_of, c.p.burn_months))
_q("burn_rate_v")(lambda c: K.burn_rate_v(c.moves_v, c.p.as_of, c.p.burn_months))
_q("burn_rate_doc")(lambda c: K.burn_rate_doc(c.main.payments, c.p.as_of, c.p.burn_months))
_q("liquid_balance")(lambda c: K.liquid_balance(c.main.journals))
_q("total_cash_v")(lambda c: K.total_cash_v(c.raw.journals))
_q("cash_runway")(lambda c: K.cash_runway(c.staged, c.main.journals, c.p.as_of, months=c.p.burn_months))
_q("cash_runway_v")(lambda c: K.cash_runway_v(c.moves_v, c.raw.journals, c.p.as_of, c.p.burn_months))
_q("liquidity_ratio")(lambda c: K.liquidity_ratio(c.staged, c.main.journals, c.p.as_of))
_q("liquidity_ratio_v")(lambda c: K.liquidity_ratio_v(c.moves_v, c.raw.journals, c.p.as_of))
_q("liquidity_ratio_doc")(lambda c: K.liquidity_ratio_doc(c.staged, c.main.journals, c.p.as_of, c.p.burn_months))
_q("collection_rate")(lambda c: K.collection_rate(c.staged))
_q("collection_rate_doc")(lambda c: K.collection_rate_doc(c.staged, c.p.as_of))
_q("exposure_totals")(lambda c: K.exposure_totals(c.staged))
_q("exposure_totals_v")(lambda c: K.exposure_totals_v(c.moves_v, c.p.as_of))
_q("kpi_bundle")(lambda c: K.kpi_bundle(c.staged, c.main.journals, c.p.as_of, c.p.burn_months))
_q("kpi_bundle_at", EARLIER)(lambda c: K.kpi_bundle(c.staged, c.main.journals, c.p.as_of, c.p.burn_months))
_q("kpi_bundle_v")(lambda c: K.kpi_bundle_v(c.moves_v, c.raw.journals, c.p.as_of, c.p.burn_months))
_q("kpi_levels_v")(lambda c: K.kpi_levels_v(K.kpi_bundle_v(c.moves_v, c.raw.journals, c.p.as_of, c.p.burn_months)))

# reports
_q("aging_report")(lambda c: R.aging_report(c.staged))
_q("aging_positions")(lambda c: R.aging_report(c.staged, position=True))
_q("overdue_aging_v")(lambda c: R.overdue_aging_v(c.staged_v, c.p.as_of))
_q("overdue_aging_v_period")(lambda c: R.overdue_aging_v(c.staged_v, c.p.as_of, RANGE_START, RANGE_END))
_q("monthly_facts")(lambda c: R.monthly_facts(c.staged))
_q("monthly_comparison")(lambda c: R.monthly_comparison(c.staged, c.p.history_months))
_q("monthly_comparison_v")(lambda c: R.monthly_comparison_v(c.staged_v, c.p.history_months))
_q("monthly_net_cashflow")(lambda c: R.monthly_net_cashflow(c.staged, c.p.net_months))
_q("net_cashflow_empty", NO_MOVES)(lambda c: R.monthly_net_cashflow(c.staged, c.p.net_months))
_q("waterfall_labels")(lambda c: R.waterfall_labels(R.monthly_net_cashflow(c.staged, 10)))
_q("client_concentration")(lambda c: R.client_concentration(c.staged, c.p.top_clients))
_q("collections_velocity")(lambda c: R.collections_velocity(
    c.staged, c.p.history_months, c.p.min_velocity_sample))
_q("journal_breakdown")(lambda c: R.journal_breakdown(c.main.journals))
_q("grand_totals")(lambda c: R.grand_totals(c.staged, c.main.journals))
_q("critical_invoices")(lambda c: R.critical_invoices(c.staged, c.p.as_of, c.p.top_critical))
_q("critical_invoices_display")(lambda c: R.critical_invoices_display(
    R.critical_invoices(c.staged, c.p.as_of, c.p.top_critical)))
_q("report_targets")(lambda c: R.collection_target(R.monthly_comparison(c.staged, c.p.history_months)))
_q("velocity_targets")(lambda c: R.velocity_target(R.collections_velocity(
    c.staged, c.p.history_months, c.p.min_velocity_sample)))

# projection and what-if
_q("cashflow_projection")(lambda c: P.cashflow_projection(c.spark, c.staged, c.main.journals, c.p.as_of,
                                                          days=c.p.horizon_days))
_q("cashflow_projection_v")(lambda c: P.cashflow_projection_v(c.spark, c.staged_v, c.raw.journals, c.p.as_of,
                                                              days=c.p.horizon_days))
_q("projection_mirrored")(lambda c: P.mirrored_outflow(build("cashflow_projection", c)))
_q("projection_mirrored_v")(lambda c: P.mirrored_outflow(build("cashflow_projection_v", c), "outflow"))
_q("scenario_grid")(lambda c: P.scenario_grid(c.spark, c.staged, c.main.journals, c.p.as_of, days=c.p.horizon_days))
_q("scenario_grid_at", EARLIER)(lambda c: P.scenario_grid(c.spark, c.staged, c.main.journals, c.p.as_of,
                                                          days=c.p.horizon_days))
_q("scenario_grid_v")(lambda c: P.scenario_grid_v(c.spark, c.staged_v, c.raw.journals, c.p.as_of,
                                                  days=c.p.horizon_days))
_q("whatif_runway")(lambda c: P.whatif_runway(c.spark, c.staged, c.main.journals, c.p.as_of,
                                              days=c.p.horizon_days, months=c.p.burn_months))
_q("min_collection_rate")(lambda c: P.min_collection_rate(c.spark, c.staged, c.main.journals, c.p.as_of,
                                                          days=c.p.horizon_days))
_q("break_even_rate")(lambda c: P.break_even_rate(c.spark, c.staged, c.main.journals, c.p.as_of, days=c.p.horizon_days))
_q("break_even_rate_at", EARLIER)(lambda c: P.break_even_rate(c.spark, c.staged, c.main.journals, c.p.as_of,
                                                              days=c.p.horizon_days))
_q("projected_cash_doc")(lambda c: P.projected_cash_doc(c.spark, c.staged, c.main.journals, c.p.as_of,
                                                        days=c.p.horizon_days, months=c.p.burn_months))

# alerts and display
_q("alerts")(lambda c: A.alerts(build("kpi_bundle", c)))
_q("critical_badge")(lambda c: A.critical_badge(build("critical_invoices", c)))
_q("kpi_display")(lambda c: A.kpi_display(build("kpi_bundle", c)))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(name, context(spark, sf_dir, _REGISTRY[name][1]))


def build(name: str, ctx: Ctx) -> DataFrame:
    """A registered operator over an arbitrary context (e.g. a loaded ledger), at the context's parameters."""
    return to_output(_REGISTRY[name][0](ctx))


def names() -> list[str]:
    return sorted(_REGISTRY)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: (lambda s, d, _n=name: run(_n, s, d)) for name in _REGISTRY}
    from caudal.streaming.refresh import STREAM_REPORTS, refresh_stream_query
    for key, report in STREAM_REPORTS.items():
        out[key] = lambda s, d, _r=report: refresh_stream_query(s, d, _r)
    return out
