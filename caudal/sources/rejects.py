"""Loading text exports row by row: what cannot be read is set aside, with its reason.

``load_ledger`` fails on the first unreadable row. Here every row is read as
text, judged by the same rules, and either becomes a typed row of the ledger or
goes to ``rejects`` with the first rule it breaks: ``malformed`` (the line is no
record of its format), ``missing <field>`` or ``unreadable <field>``. Rows are
counted by reason in the pass that reads the ledger (``observe``), so a job can
refuse to publish beyond a threshold without reading anything twice.

Fields that the loader reads leniently (dates and balances of the ERP export)
are no reason. Every row of the input is either accepted or rejected, once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import schema as S
from caudal.sources import decode
from caudal.sources.ledger import Ledger, conform

MALFORMED, MISSING, UNREADABLE = "malformed", "missing", "unreadable"
_CORRUPT, _REASON = "_corrupt", "_reason"
TABLES = ("moves", "payments", "journals")


class TooManyRejects(RuntimeError):
    pass


@dataclass(frozen=True)
class Sifted:
    """An accepted ledger, the rows that are not in it (table_name, reason, id, record), and their counts."""
    ledger: Ledger
    rejects: DataFrame
    observations: dict[str, Observation]

    def counts(self) -> dict[str, dict[str, int]]:
        """Rejected rows by table and reason. Each table must have been read by an action before."""
        return {table: {reason: n for reason, n in o.get.items() if n} for table, o in self.observations.items()}

    def check(self, at_most: int) -> int:
        """How many rows were rejected; more than ``at_most`` is an error."""
        counts = self.counts()
        total = sum(n for reasons in counts.values() for n in reasons.values())
        if total > at_most:
            raise TooManyRejects(f"{total} rows rejected, {at_most} allowed: {counts}")
        return total


def _required(name: str, kind: T.DataType) -> tuple[str, T.DataType, bool]:
    return name, kind, True


# Per table of the ERP export: fields that must be read, with their types.
_ERP_RULES = {
    "moves": [_required("id", T.LongType()), _required("amount_total", S.MONEY), _required("amount_residual", S.MONEY)],
    "payments": [_required("id", T.LongType()), _required("amount", S.MONEY)],
    "journals": [_required("id", T.LongType())],
}
_RAW = {"moves": S.RAW_MOVES_SCHEMA, "payments": S.RAW_PAYMENTS_SCHEMA, "journals": S.RAW_JOURNALS_SCHEMA}
_TYPED = {"moves": S.MOVES_SCHEMA, "payments": S.PAYMENTS_SCHEMA, "journals": S.JOURNALS_SCHEMA}


def _rules(table: str, fmt: str, have: list[str]) -> list[tuple[str, T.DataType, bool]]:
    if fmt == "erp-json":
        return _ERP_RULES[table]
    return [(f.name, f.dataType, not f.nullable) for f in _TYPED[table].fields if f.name in have or not f.nullable]


def _reasons(rules: list[tuple[str, T.DataType, bool]]) -> list[tuple[str, Column]]:
    out = [(MALFORMED, F.col(_CORRUPT).isNotNull())]
    for name, kind, required in rules:
        if required:
            out.append((f"{MISSING} {name}", F.col(name).isNull()))
        if not isinstance(kind, T.StringType):
            out.append((f"{UNREADABLE} {name}", F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()))
    return out


def _texts(spark: SparkSession, path: str, table: str, fmt: str) -> DataFrame:
    """Every field as text, and the line itself where it is no record."""
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    if fmt == "csv":
        names = spark.read.option("header", "true").csv(f"{path}/{table}").columns
        reader = reader.options(header="true", columnPruning="false", enforceSchema="true")
    else:
        names = (_RAW if fmt == "erp-json" else _TYPED)[table].fieldNames()
        names = [*names, *(["balance"] if table == "journals" and fmt == "json" else [])]
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    df = reader.schema(fields).format("csv" if fmt == "csv" else "json").load(f"{path}/{table}")
    if table == "journals" and "balance" in df.columns:  # the other pipeline's name of it
        had = F.col("current_balance") if "current_balance" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("current_balance", F.coalesce(had, F.col("balance"))).drop("balance")
    return df


def _typed(df: DataFrame, table: str, fmt: str) -> DataFrame:
    if fmt == "erp-json":
        return decode.DECODERS[table](df, decode.lenient)
    kinds = {f.name: f.dataType for f in _TYPED[table].fields}
    return conform(df.select(*(F.col(c).try_cast(kinds[c]).alias(c) for c in df.columns if c in kinds)), _TYPED[table])


def sift_ledger(spark: SparkSession, path: str, fmt: str = "erp-json") -> Sifted:
    """The ledger under ``path`` (csv, json or erp-json) with its unreadable rows set aside."""
    if fmt not in ("csv", "json", "erp-json"):
        raise ValueError(f"{fmt} has no unreadable rows to set aside")
    tables, rejects, observations = {}, [], {}
    for table in TABLES:
        df = _texts(spark, path, table, fmt)
        reasons = _reasons(_rules(table, fmt, df.columns))
        judged = df.withColumn(_REASON, F.coalesce(*(F.when(c, F.lit(r)) for r, c in reasons)))
        observations[table] = Observation(f"rejects-{table}-{uuid.uuid4().hex[:8]}")
        counted = judged.observe(observations[table], *(F.count_if(F.col(_REASON) == r).alias(r) for r, _ in reasons))
        tables[table] = _typed(counted.filter(F.col(_REASON).isNull()).drop(_REASON, _CORRUPT), table, fmt)
        fields = [c for c in df.columns if c != _CORRUPT]
        whole = F.col(_CORRUPT).isNull()
        rejects.append(judged.filter(F.col(_REASON).isNotNull()).select(
            F.lit(table).alias("table_name"), F.col(_REASON).alias("reason"), F.when(whole, F.col("id")).alias("id"),
            F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*fields))).alias("record")))
    return Sifted(Ledger(*(tables[t] for t in TABLES)), reduce(DataFrame.unionByName, rejects), observations)
