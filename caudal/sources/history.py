"""Column names over time.

Extracts of different weeks may name, add or lack columns. The history says
from which date on a table's column was delivered under another name; each
extract's columns are resolved by it at plan time, from the extract's own
schema and date, so that old and new extracts give the same table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.sources.ledger import conform


@dataclass(frozen=True)
class Renamed:
    """From the extract of ``since`` on, ``column`` of ``table`` comes as ``name``."""
    table: str
    column: str
    name: str
    since: date = date.min


# The names that the sources are known to use besides the ledger's own.
HISTORY = (
    Renamed("moves", "date_maturity", "invoice_date_due"),
    Renamed("journals", "current_balance", "balance"),
)


def source_column(table: str, column: str, have: set[str], day: date, history: tuple[Renamed, ...] = HISTORY) -> str | None:
    """The delivered column that is ``column`` in an extract of ``day``: the newest
    name in force that it has, the ledger's own name after those; None if it has neither."""
    names = [(r.since, r.name) for r in history if (r.table, r.column) == (table, column) and r.since <= day]
    for _, name in sorted(names, key=lambda x: x[0], reverse=True):
        if name in have:
            return name
    return column if column in have else None


def resolve(df: DataFrame, table: str, schema: T.StructType, day: date, history: tuple[Renamed, ...] = HISTORY) -> DataFrame:
    """``df``, delivered on ``day``, in the columns of ``schema``: renamed ones found, missing optional ones null;
    a missing required one is an error that names it."""
    have = set(df.columns)
    found = {f.name: source_column(table, f.name, have, day, history) for f in schema.fields}
    return conform(df.select(*(F.col(source).alias(name) for name, source in found.items() if source)), schema)
