"""Fixed schemas, labels and thresholds of the ledger model.

Money is ``decimal(18,2)`` everywhere inside the engine; it only becomes a
double when a report leaves the engine (see ``caudal.functions.columns``).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_SQL = "decimal(18,2)"

MOVES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("move_type", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("invoice_date", T.DateType(), True),
    T.StructField("date_maturity", T.DateType(), True),
    T.StructField("amount_total", MONEY, False),
    T.StructField("amount_residual", MONEY, False),
    T.StructField("partner_name", T.StringType(), False),
    T.StructField("payment_date", T.DateType(), True),
])

# Partition columns of a written ledger: document type, then the period of
# the invoice (payment) date. The period is a year: coarse folders, few files;
# inside a folder the files are sorted by date, so row-group statistics narrow
# a look-back window further. Spark pattern and strftime format of a period:
PERIOD_PATTERN, PERIOD_STRFTIME = "yyyy", "%Y"
INVOICE_PERIOD = "invoice_period"
LEDGER_PARTITIONS = ("move_type", INVOICE_PERIOD)
PAYMENT_PERIOD = "payment_period"
PAYMENT_PARTITIONS = ("payment_type", PAYMENT_PERIOD)

PAYMENTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("amount", MONEY, False),
    T.StructField("payment_type", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("partner_name", T.StringType(), True),
    T.StructField("journal_tipo", T.StringType(), True),
])

JOURNALS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("current_balance", MONEY, False),
])

# Raw ERP export: every field arrives as text; many-to-one fields are
# ``[id, "name"]`` or the literal ``false``, empty dates are ``false``.
RAW_MOVES_SCHEMA = T.StructType([
    T.StructField(f, T.StringType(), True) for f in (
        "id", "name", "move_type", "state", "invoice_date", "invoice_date_due",
        "amount_total", "amount_residual", "partner_id", "payment_date")
])
RAW_PAYMENTS_SCHEMA = T.StructType([
    T.StructField(f, T.StringType(), True) for f in (
        "id", "date", "amount", "payment_type", "state", "partner_id", "journal_id")
])
RAW_JOURNALS_SCHEMA = T.StructType([
    T.StructField(f, T.StringType(), True) for f in ("id", "name", "type", "current_balance")
])

# ---------------------------------------------------------------------------
# These labels, defaults and messages must equal the
# reference's output text exactly.
# ---------------------------------------------------------------------------
OUT_INVOICE = "out_invoice"
IN_INVOICE = "in_invoice"
POSTED = "posted"
INBOUND = "inbound"
OUTBOUND = "outbound"
LIQUID_JOURNAL_TYPES = ("bank", "cash")

NO_PARTNER = "Sin partner"
UNKNOWN_JOURNAL = "desconocido"

RISK_CURRENT = "Al corriente"
RISK_LOW = "Riesgo bajo"
RISK_MEDIUM = "Riesgo medio"
RISK_CRITICAL = "Riesgo crítico"
RISK_NO_DUE_DATE = "Sin vencimiento"

# Aging buckets, right-closed at 0 / 30 / 60 / 90 days (main pipeline).
AGING_LABELS = ("Por vencer", "1–30 días", "31–60 días", "61–90 días", "+90 días")
# Overdue buckets of the variant UI, right-closed at 30 / 60 / 90, zero excluded.
OVERDUE_LABELS = ("1 – 30 días", "31 – 60 días", "61 – 90 días", "+90 días")

OTHERS_LABEL = "Otros"
TOTAL_LABEL = "Total"
WATERFALL_RELATIVE = "relative"
WATERFALL_TOTAL = "total"

SUCCESS = "success"
WARNING = "warning"
DANGER = "danger"
MUTED = "muted"
NOT_AVAILABLE = "N/D"

ALERT_RUNWAY_CRITICAL = ("ALERTA CRÍTICA — Cash Runway de {runway} meses. "
                         "Liquidez insuficiente para 90 días de operación.")
ALERT_RUNWAY_WARNING = "ADVERTENCIA — Cash Runway de {runway} meses. Revisar plan de cobranza."
ALERT_OVERDUE_INVOICES = "{n} facturas con más de 60 días vencidas detectadas."
BADGE_INVOICES = "{n} facturas"
BADGE_NONE = "Sin alertas"

CRITICAL_TABLE_HEADERS = {
    "name": "Folio",
    "partner_name": "Cliente",
    "invoice_date": "Emisión",
    "date_maturity": "Vencimiento",
    "amount_total": "Total",
    "amount_residual": "Pendiente",
    "days_overdue": "Días vencida",
    "nivel_riesgo": "Riesgo",
}

KPI_DAYS = "{x} días"
KPI_PER_MONTH = "{x}/m"
KPI_MONTHS = "{x} m"
KPI_TIMES = "{x}×"
KPI_PERCENT = "{x}%"
KPI_INFINITE = "∞"
KPI_LIQUIDITY_CAP = ">90×"
RUNWAY_CRITICAL = "CRÍTICO"
RUNWAY_OK = "OK"

# Targets drawn with two reports: the first with the monthly one, the second with the velocity.
COLLECTION_TARGET_PCT = 80.0
DSO_TARGET_DAYS = 45.0

# Sentinels for "no overdue liabilities".
LIQUIDITY_SENTINEL = 99.0
LIQUIDITY_SENTINEL_V = 99.99


# Fixed values (continued): the traffic-light thresholds of both UIs, as the
# reference states them; they are dataclass defaults so a caller can tune them.
@dataclass(frozen=True)
class Thresholds:
    """Traffic-light thresholds of the main KPI cards."""

    dso_warn: float = 45
    dso_crit: float = 60
    runway_warn: float = 6
    runway_crit: float = 3
    liq_warn: float = 1.5
    liq_crit: float = 1.0
    rate_success: float = 80
    rate_warn: float = 60


@dataclass(frozen=True)
class ThresholdsV:
    """Thresholds of the variant UI (inverse comparisons)."""

    dso_good: float = 30
    dso_warn: float = 45
    runway_good: float = 6
    runway_warn: float = 3
    liq_good: float = 1.5
    liq_warn: float = 1.0


@dataclass(frozen=True)
class Params:
    """Run parameters; ``as_of`` replaces the reference's frozen clock and is always given."""

    as_of: date
    lookback_days: int = 365
    horizon_days: int = 90
    burn_months: int = 3
    top_clients: int = 8
    top_critical: int = 15
    net_months: int = 12
    history_months: int = 12
    min_velocity_sample: int = 3
