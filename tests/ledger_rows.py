"""Dates, paths and hand-made ledger rows that the tests share."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

AS_OF = date(2001, 8, 1)
SF_SMALL = "/root/testdata/sf0.001"


def move(id, move_type="out_invoice", total="100.00", residual="0.00", invoice=date(2001, 7, 1),
         due=date(2001, 7, 31), partner="Acme", state="posted", paid=None, name=None):
    return (id, name or f"DOC/{id:05d}", move_type, state, invoice, due, Decimal(total), Decimal(residual),
            partner, paid)
