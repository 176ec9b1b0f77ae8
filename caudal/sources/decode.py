"""Decoders for the raw ERP export (all fields arrive as text).

Dates are lenient and journal balances are lenient, as in the source: what
cannot be read becomes null, or 0 for a balance. The amounts and ids of moves
and payments are not: a document whose money cannot be read fails the load,
with its id in the message, instead of passing as a paid one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import schema as S


def many2one_name(raw: Column, default: str) -> Column:
    """``[7, "Acme"]`` to ``Acme``; ``false``, a one-item list or unreadable
    text to ``default``.

    ``get_json_object`` walks the JSON text to the second element only (no
    array is materialised), unescapes strings, and is null for ``false``,
    for non-arrays and for lists shorter than two.
    """
    return F.coalesce(F.get_json_object(raw, "$[1]"), F.lit(default))


def lenient_date(raw: Column) -> Column:
    """A date in any form a cast reads (``2001-07-31``, ``2001-7-1``, with a
    time of day or without); bad, empty or ``false`` text becomes null."""
    return raw.try_cast("date")


def lenient_money(raw: Column) -> Column:
    """Unreadable balance becomes 0."""
    return F.coalesce(raw.try_cast(S.MONEY), F.lit(0).cast(S.MONEY))


def strict(table: str, field: str, kind: T.DataType | str) -> Column:
    """``field`` read as ``kind``; unreadable, missing or too large fails the job and names the row."""
    raw = F.col(field)
    said = F.concat(F.lit(f"{table}: unreadable {field} "), F.coalesce(raw.cast("string"), F.lit("(none)")),
                    F.lit(" in id "), F.coalesce(F.col("id").cast("string"), F.lit("(none)")))
    return F.coalesce(raw.try_cast(kind), F.raise_error(said).cast(kind))


def lenient(table: str, field: str, kind: T.DataType | str) -> Column:
    """``field`` read as ``kind``, null where it cannot be: for rows that were judged before."""
    return F.col(field).try_cast(kind)


Reader = Callable[[str, str, "T.DataType | str"], Column]


def decode_moves(raw: DataFrame, read: Reader = strict) -> DataFrame:
    """Raw ERP moves (text) to the typed ``moves`` schema."""
    return raw.select(
        read("moves", "id", "bigint").alias("id"),
        F.col("name"),
        F.col("move_type"),
        F.col("state"),
        lenient_date(F.col("invoice_date")).alias("invoice_date"),
        lenient_date(F.col("invoice_date_due")).alias("date_maturity"),
        read("moves", "amount_total", S.MONEY).alias("amount_total"),
        read("moves", "amount_residual", S.MONEY).alias("amount_residual"),
        many2one_name(F.col("partner_id"), S.NO_PARTNER).alias("partner_name"),
        lenient_date(F.col("payment_date")).alias("payment_date"),
    )


def decode_payments(raw: DataFrame, read: Reader = strict) -> DataFrame:
    """Raw ERP payments (text) to the typed ``payments`` schema; the journal's name is its type."""
    return raw.select(
        read("payments", "id", "bigint").alias("id"),
        lenient_date(F.col("date")).alias("date"),
        read("payments", "amount", S.MONEY).alias("amount"),
        F.col("payment_type"),
        F.col("state"),
        many2one_name(F.col("partner_id"), S.NO_PARTNER).alias("partner_name"),
        many2one_name(F.col("journal_id"), S.UNKNOWN_JOURNAL).alias("journal_tipo"),
    )


def decode_journals(raw: DataFrame, read: Reader = strict) -> DataFrame:
    return raw.select(
        read("journals", "id", "bigint").alias("id"),
        F.col("name"),
        F.col("type"),
        lenient_money(F.col("current_balance")).alias("current_balance"),
    )


DECODERS = {"moves": decode_moves, "payments": decode_payments, "journals": decode_journals}
