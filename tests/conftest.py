from __future__ import annotations

import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from caudal import schema as S  # noqa: E402
from caudal.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="caudal-tests", shuffle_partitions=4,
                      extra={"spark.sql.maxMetadataStringLength": "4000"})  # plans are read by the tests
    s.sparkContext.setLogLevel("ERROR")
    # Tests set their own shared folder only where the session has none.
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caudal-test-ckpt-"))
    yield s


@pytest.fixture()
def make_moves(spark):
    def _make(rows):
        return spark.createDataFrame(rows, S.MOVES_SCHEMA)
    return _make


@pytest.fixture()
def journals(spark):
    rows = [(1, "Banco", "bank", Decimal("1000.00")), (2, "Caja", "cash", Decimal("500.00")),
            (3, "Ventas", "sale", Decimal("9999.00"))]
    return spark.createDataFrame(rows, S.JOURNALS_SCHEMA)
