"""Joins whose small side is broadcast only after its rows were counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 250_000


def counted_join(big: DataFrame, side: DataFrame, on: Column | list[str], how: str,
                 rows: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` joined with ``side``, by broadcast when ``side`` has at most ``rows`` rows.

    ``side`` must be cheap to read again (a checkpoint) and have narrow rows;
    beyond the bound both sides are shuffled and AQE splits hot keys.
    """
    return big.join(F.broadcast(side) if side.count() <= rows else side, on, how)
