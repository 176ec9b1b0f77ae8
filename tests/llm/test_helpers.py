"""Counted joins, packed columns, running hashes and written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from caudal.llm.joins import counted_join
from caudal.llm.packed import pack, plain, squeezed, unpack
from caudal.llm.rolling import BASES, Rolling, grams
from caudal.llm.tables import written


@pytest.mark.parametrize("rows,broadcast", [(10, True), (2, False)])
def test_counted_join(spark, rows, broadcast):
    big, side = spark.range(20), spark.createDataFrame([(i,) for i in range(3, 8)], "id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = counted_join(big, side, ["id"], "left_anti", rows)
        assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()) == broadcast
        assert sorted(r.id for r in df.collect()) == [i for i in range(20) if not 3 <= i < 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    parts = [(rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(-9, 9, n // 2), rng.integers(0, 255, n * 3, dtype=np.uint8))
             for n in (0, 1, 700)]
    got = unpack([pack(*p) for p in parts] + [None], "QqB")
    for k in range(3):
        assert np.array_equal(got[k], np.concatenate([p[k] for p in parts]))
    assert [len(x) for x in unpack([None], "QqB")] == [0, 0, 0]


def test_squeezed_texts():
    texts = ["", "é" * 5000, "a\x00b", None]
    assert plain(squeezed(pa.array(texts))) == ["", "é" * 5000, "a\x00b", ""]


def test_rolling_hash_depends_on_the_slice_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 3000, dtype=np.uint8)
    roll = Rolling(data, BASES[0])
    every = roll.every(7)
    for i in range(0, 2900, 97):
        alone = Rolling(data[i:i + 7], BASES[0])(np.array([0]), np.array([7]))[0]
        assert every[i] == alone == roll(np.array([i]), np.array([i + 7]))[0]
    assert len(np.unique(every)) == len({data[i:i + 7].tobytes() for i in range(len(every))})
    assert len(grams(every, 5)) == len(every) - 4 and len(grams(every[:3], 5)) == 0


def test_written_table_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, b"x")], "a long, b string, c binary")
    out = written(df)
    assert out.schema == df.schema and sorted(out.collect()) == sorted(df.collect())
    assert written(df.limit(0)).collect() == []
