"""Daily cash projection, the what-if scenario grid and derived figures.

Plan: the open residuals due inside the horizon are reduced to one row per
due day (a hash aggregate with at most ``days + 1`` groups, so its size is
bounded by the horizon, not by the data). That daily table is broadcast into
an equi-join with the scenario x day grid (``len(scenarios) * days`` rows
generated by one ``spark.range``), and the running balance is a window
partitioned by scenario. The opening balance and the burn rate are scalar
subqueries (one value each). Every slider position comes from one job.

Money stays decimal through the running sum, so the balance is exact; it
becomes a double only on output. Collection factors are decimals too
(``pct / 100``, the +/-15% band), so ``c = 0.85`` means exactly 0.85.
"""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caudal import schema as S
from caudal.functions import columns as C
from caudal.operators.kpis import burn_rate, liquid_balance_value

FACTOR = "decimal(6,4)"
RATE_SCALE = 6  # money (2) x factor (4)
MONTHS_FACTOR = "decimal(10,6)"


def _daily_due(staged: DataFrame, as_of: date, days: int, posted_only: bool = False) -> DataFrame:
    """Open residual per due day in [as_of, as_of + days], inflow and outflow."""
    cond = ((C.residual() > 0) & (C.customer_invoice() | C.vendor_bill())
            & F.col("date_maturity").between(C.lit_date(as_of), C.lit_date(as_of + timedelta(days=days))))
    if posted_only:
        cond = cond & (F.col("state") == S.POSTED)
    return (staged.filter(cond).groupBy(F.col("date_maturity").alias("fecha"))
            .agg(F.sum(F.when(C.customer_invoice(), C.residual())).alias("base_in"),
                 F.sum(F.when(C.vendor_bill(), C.residual())).alias("base_out")))


def _has_rows(staged: DataFrame) -> Column:
    """True when ``staged`` has any row: a scalar subquery over ``limit(1)``."""
    return staged.select(F.lit(True).alias("_any")).limit(1).scalar().isNotNull()


def _factors(pct: Column) -> dict[str, Column]:
    """c = pct/100, optimist min(1.15c, 1), pessimist max(0.85c, 0), as exact decimals."""
    c = (pct.cast("decimal(5,0)") / F.lit(100)).cast(FACTOR)
    return {
        "c": c,
        "c_opt": F.least(c * F.lit(1.15).cast("decimal(3,2)"), F.lit(1).cast(FACTOR)).cast(FACTOR),
        "c_pes": F.greatest(c * F.lit(0.85).cast("decimal(3,2)"), F.lit(0).cast(FACTOR)).cast(FACTOR),
    }


def collection_scenarios(spark: SparkSession, pcts: range) -> DataFrame:
    """Slider positions as rows: pct and its three collection factors."""
    pct = F.col("id").cast("int")
    return spark.range(pcts.start, pcts.stop, pcts.step).select(
        pct.alias("pct"), *[v.alias(k) for k, v in _factors(pct).items()])


def scenario_days(spark: SparkSession, as_of: date, days: int, pcts: range,
                  name: str = "pct") -> DataFrame:
    """The scenario x day grid straight from ``spark.range``: row i is scenario
    ``i div days`` on day ``i mod days`` (``len(pcts) * days`` rows, no join)."""
    i = F.col("id")
    return spark.range(len(pcts) * days).select(
        (F.lit(pcts.start) + F.expr(f"id div {days}") * F.lit(pcts.step)).cast("int").alias(name),
        F.date_add(C.lit_date(as_of), (i % days).cast("int")).alias("fecha"))


def _project(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
             days: int, pcts: range, probe: DataFrame | None = None) -> DataFrame:
    """``probe`` has a row exactly when ``staged`` has one (default: ``staged`` itself)."""
    daily = _daily_due(staged, as_of, days)
    grid = (scenario_days(spark, as_of, days, pcts)
            .filter(_has_rows(staged if probe is None else probe))
            .join(F.broadcast(daily), "fecha", "left")
            .withColumns(_factors(F.col("pct"))))
    opening = liquid_balance_value(journals)
    base_in = F.coalesce(F.col("base_in"), C.zero_money())
    out = F.coalesce(F.col("base_out"), C.zero_money())
    run = Window.partitionBy("pct").orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)

    def balance(factor: str) -> Column:
        return opening + F.sum(base_in * F.col(factor) - out).over(run)

    return grid.select(
        "pct", "fecha",
        (base_in * F.col("c")).alias("ingreso"),
        out.alias("egreso"),
        balance("c").alias("saldo"),
        balance("c_opt").alias("saldo_opt"),
        balance("c_pes").alias("saldo_pes"))


def _present(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in ("pct",) if c in df.columns], "fecha",
        C.money_out(F.col("ingreso"), RATE_SCALE).alias("ingreso"),
        C.money_out(F.col("egreso")).alias("egreso"),
        *[C.money_out(F.col(k), RATE_SCALE).alias(k) for k in ("saldo", "saldo_opt", "saldo_pes")])


def cashflow_projection(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
                        cobrabilidad_pct: int = 100, days: int = 90) -> DataFrame:
    """N daily rows: fecha, ingreso, egreso, saldo, saldo_opt, saldo_pes.

    Inflow = open customer residual due that day x collectability; outflow =
    open vendor residual due that day at 100%. Overdue residuals never enter
    (trap T9). Opening balance = bank + cash.
    """
    proj = _project(spark, staged, journals, as_of, days, range(cobrabilidad_pct, cobrabilidad_pct + 1))
    return _present(proj).drop("pct").orderBy("fecha")


def scenario_grid(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
                  pcts: range = range(0, 101, 5), days: int = 90, probe: DataFrame | None = None) -> DataFrame:
    """The projection for every slider position (0..100 step 5) in one job."""
    return _present(_project(spark, staged, journals, as_of, days, pcts, probe)).orderBy("pct", "fecha")


def whatif_runway(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
                  pcts: range = range(0, 101, 5), days: int = 90, months: int = 3) -> DataFrame:
    """Projected runway per slider position: max(last balance, 0) / burn.

    ``N/D`` (null runway) when there is no projection or burn <= 0; levels
    danger below 3 months, warning below 6. The last balance is the opening
    balance plus the horizon's net flow, so no window is needed here.
    """
    shown = _daily_due(staged, as_of, days).filter(
        F.col("fecha") < C.lit_date(as_of + timedelta(days=days)))
    net = shown.agg(F.struct(F.coalesce(F.sum("base_in"), C.zero_money()).alias("tin"),
                             F.coalesce(F.sum("base_out"), C.zero_money()).alias("tout"))).scalar()
    rows = collection_scenarios(spark, pcts).withColumns({
        "tin": net.getField("tin"), "tout": net.getField("tout"),
        "saldo": liquid_balance_value(journals),
        "burn_rate": burn_rate(staged, as_of, months).scalar(),
        "_any": _has_rows(staged)})
    last = F.col("saldo") + F.col("tin") * F.col("c") - F.col("tout")
    final = F.greatest(last, F.lit(0).cast(S.MONEY))
    return _runway_rows(rows.select("pct", final.cast("double").alias("final"), "burn_rate", "_any"),
                        F.col("_any") & (F.col("burn_rate") > 0))


def _runway_rows(rows: DataFrame, ok: Column) -> DataFrame:
    """Runway, text and level of rows (pct, final, burn_rate)."""
    runway = F.when(ok, F.bround(F.col("final") / F.col("burn_rate"), 1))
    return rows.select(
        "pct",
        F.bround("final", RATE_SCALE).alias("saldo_final"),
        runway.alias("runway_proy"),
        F.when(ok, F.concat(C.one_decimal_text(runway), F.lit(" m"))).otherwise(F.lit(S.NOT_AVAILABLE))
         .alias("runway_str"),
        F.when(~ok, F.lit(S.MUTED)).when(runway < 3, S.DANGER).when(runway < 6, S.WARNING)
         .otherwise(S.SUCCESS).alias("nivel"),
    ).orderBy("pct")


def mirrored_outflow(projection: DataFrame, outflow: str = "egreso") -> DataFrame:
    """The projection with its outflow below the axis, as the chart draws it."""
    negative = -F.col(outflow)
    return projection.withColumn(f"{outflow}_neg", F.when(negative == 0, F.lit(0.0)).otherwise(negative))


def whatif_of(grid: DataFrame, bundle: DataFrame, pcts: range = range(0, 101, 5)) -> DataFrame:
    """:func:`whatif_runway` of a finished scenario grid and KPI bundle: the
    last day's balance of each slider position over the burn rate."""
    last = grid.groupBy("pct").agg(F.max_by("saldo", "fecha").alias("last"))
    one = bundle.select(F.struct("burn_rate", "saldo_liquido")).scalar()
    rows = (grid.sparkSession.range(pcts.start, pcts.stop, pcts.step).select(F.col("id").cast("int").alias("pct"))
            .join(last, "pct", "left")  # both sides have a row per slider position
            .withColumns({"burn_rate": one.getField("burn_rate"), "opening": one.getField("saldo_liquido")}))
    final = F.greatest(F.coalesce("last", "opening"), F.lit(0.0))
    return _runway_rows(rows.select("pct", "burn_rate", "last", final.alias("final")),
                        F.col("last").isNotNull() & (F.col("burn_rate") > 0)).orderBy("pct")


def min_collection_rate(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
                        pcts: range = range(0, 101, 5), days: int = 90,
                        base_pct: int = 85, drop_pts: int = 10) -> DataFrame:
    """Lowest slider position whose balance stays positive on every day, and the
    money lost at the end of the horizon by collecting ``drop_pts`` points less
    than ``base_pct``."""
    proj = _project(spark, staged, journals, as_of, days, pcts)
    per = proj.groupBy("pct").agg(F.min("saldo").alias("low"),
                                  F.max_by("saldo", "fecha").alias("last"))
    return per.agg(
        F.min(F.when(F.col("low") > 0, F.col("pct"))).alias("min_cobrabilidad_pct"),
        C.money_out(F.max(F.when(F.col("pct") == base_pct, F.col("last")))
                    - F.max(F.when(F.col("pct") == base_pct - drop_pts, F.col("last"))), RATE_SCALE)
         .alias("impacto_caida"))


def break_even_rate(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
                    days: int = 90, step: int = 5) -> DataFrame:
    """The collection rate above which the balance stays positive on every day, and the slider's answer to it.

    Each day's balance is opening + rate x inflow so far - outflow so far, so the
    rate is the largest over the days of (outflow - opening) / inflow, from
    prefix sums alone, without a grid. Integer arithmetic in cents, rounded up
    at the sixth decimal of the percentage; 0 where no collection is needed.
    ``min_cobrabilidad_pct`` is the first slider position above the rate, which
    is :func:`min_collection_rate`'s. A day that is not positive before anything
    came in cannot be mended: both are null, as they are without any document.
    """
    whole = "decimal(38,0)"
    start = spark.range(1).select(C.lit_date(as_of).alias("fecha"), C.zero_money().alias("base_in"), C.zero_money().alias("base_out"))
    due = _daily_due(staged, as_of, days).filter(F.col("fecha") < C.lit_date(as_of + timedelta(days=days)))
    daily = due.unionByName(start).groupBy("fecha").agg(F.sum("base_in").alias("base_in"), F.sum("base_out").alias("base_out"))
    run = Window.orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)  # at most one row per day

    def cents(c: Column) -> Column:
        return (c * 100).cast(whole)

    sums = daily.select(
        cents(F.coalesce(F.sum(F.coalesce("base_in", C.zero_money())).over(run), C.zero_money())).alias("den"),
        cents(F.coalesce(F.sum(F.coalesce("base_out", C.zero_money())).over(run), C.zero_money())
              - liquid_balance_value(journals)).alias("num"))
    num, den = F.col("num"), F.nullif(F.col("den"), F.lit(0).cast(whole))

    def quotient(a: Column) -> tuple[Column, Column]:
        rest = a % den
        return ((a - rest) / den).cast(whole), rest

    parts, rest = quotient(num * F.lit(10 ** 8).cast(whole))  # millionths of a percent
    rate = F.when(num <= 0, F.lit(0).cast(whole)).otherwise((parts + F.when(rest > 0, 1).otherwise(0)).cast(whole))
    steps, _ = quotient(num * F.lit(100 // step).cast(whole))
    position = F.when(num < 0, F.lit(0).cast(whole)).otherwise(((steps + 1) * step).cast(whole))
    out = sums.withColumns({"rate": rate, "position": position}).agg(
        F.max("rate").alias("rate"), F.max("position").alias("position"),
        F.count_if(F.col("rate").isNull() | F.col("position").isNull()).alias("stuck"))
    ok = (F.col("stuck") == 0) & _has_rows(staged)
    return out.select(
        F.when(ok, F.bround((F.col("rate") / 1000000).cast("double"), 6)).alias("break_even_pct"),
        F.when(ok & (F.col("position") <= 100), F.col("position").cast("int")).alias("min_cobrabilidad_pct"))


def projected_cash_doc(spark: SparkSession, staged: DataFrame, journals: DataFrame, as_of: date,
                       pcts: range = range(0, 101, 5), days: int = 90, months: int = 3) -> DataFrame:
    """Closed form: balance + receivables x c - monthly burn x (days / 30), per slider position.

    Exact decimal arithmetic (``days / 30`` as a 6-decimal factor, the burn
    rate at its 2 published decimals), so the result has no rounding step.
    """
    recv = staged.filter(C.customer_invoice()).agg(F.coalesce(F.sum(C.residual()), C.zero_money())).scalar()
    rows = collection_scenarios(spark, pcts).withColumns({
        "cxc": recv, "saldo": liquid_balance_value(journals),
        "burn_rate": burn_rate(staged, as_of, months).scalar()})
    span = F.lit(Decimal(days) / Decimal(30)).cast(MONTHS_FACTOR)
    cash = F.col("saldo") + F.col("cxc") * F.col("c") - F.col("burn_rate").cast(S.MONEY) * span
    return rows.select("pct", C.money_out(cash, RATE_SCALE).alias("caja_proyectada")).orderBy("pct")


# -- variant ---------------------------------------------------------------------

def _project_v(spark: SparkSession, staged_v: DataFrame, journals_all: DataFrame, as_of: date,
               days: int, pcts: range) -> DataFrame:
    daily = _daily_due(staged_v, as_of, days, posted_only=True)
    opening = journals_all.agg(F.coalesce(F.sum("current_balance"), C.zero_money())).scalar()
    keep = (F.lit(1).cast(FACTOR) - (F.col("impayment_pct").cast("decimal(5,0)") / F.lit(100))).cast(FACTOR)
    grid = (scenario_days(spark, as_of, days, pcts, "impayment_pct")
            .join(F.broadcast(daily), "fecha", "left")
            .withColumns({"keep": keep, "opening": opening})
            .withColumnRenamed("fecha", "date"))
    inflow = F.coalesce(F.col("base_in"), C.zero_money()) * F.col("keep")
    outflow = F.coalesce(F.col("base_out"), C.zero_money())
    run = Window.partitionBy("impayment_pct").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select(
        "impayment_pct", "date",
        C.money_out(inflow, RATE_SCALE).alias("inflow"),
        C.money_out(outflow).alias("outflow"),
        C.money_out(F.col("opening") + F.sum(inflow - outflow).over(run), RATE_SCALE).alias("balance"))


def cashflow_projection_v(spark: SparkSession, staged_v: DataFrame, journals_all: DataFrame,
                          as_of: date, impayment_pct: int = 0, days: int = 90) -> DataFrame:
    """Variant: posted residuals only, inflow x (1 - impayment), opening = all journals."""
    pcts = range(impayment_pct, impayment_pct + 1)
    return _project_v(spark, staged_v, journals_all, as_of, days, pcts).drop("impayment_pct").orderBy("date")


def scenario_grid_v(spark: SparkSession, staged_v: DataFrame, journals_all: DataFrame, as_of: date,
                    pcts: range = range(0, 51, 5), days: int = 90) -> DataFrame:
    return _project_v(spark, staged_v, journals_all, as_of, days, pcts).orderBy("impayment_pct", "date")
