"""Written sequences: an exact round trip, and best fit against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_packing import check, plain, texts  # noqa: F401

from caudal.llm import token_output as O


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_matches_plain_search(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 100) for _ in range(400)])
    want, free = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            at = max(k for k, f in enumerate(free) if f == min(fits))
            free[at] -= lengths[i]
        else:
            free.append(100 - lengths[i])
    want = sorted(free)
    got = O.best_fit_decreasing(lengths, 100)
    assert sorted(i for b in got for i in b) == list(range(400))
    assert sorted(100 - lengths[b].sum() for b in got) == want


def test_room_tree():
    rng, tree, have = random.Random(1), O.RoomTree(77), []
    for _ in range(2000):
        if have and rng.random() < 0.45:
            f = have.pop(rng.randrange(len(have)))
            tree.add(f, -1)
        else:
            have.append(rng.randint(0, 77))
            tree.add(have[-1], 1)
        need = rng.randint(0, 77)
        assert tree.least_at_least(need) == min((f for f in have if f >= need), default=-1)


@pytest.mark.parametrize("capacity,shard_bytes", [(4096, O.SHARD_BYTES), (128, 5000)])
def test_round_trip(spark, frame, plain, tmp_path, capacity, shard_bytes):  # noqa: F811
    docs = list(enumerate(texts(60))) + [(5, "again"), (5, "again"), (None, "no id")]
    df = frame(docs).withColumns({"shard": F.lit("x"), "ids": F.lit(1), "piece": F.lit(2)})
    path = str(tmp_path / "out")
    O.write_sequences(df, path, capacity=capacity, shard_bytes=shard_bytes)
    check(O.read_segments(spark, path, capacity).collect(), docs, plain, capacity)
    pieces = {}
    for r in spark.read.parquet(path).collect():
        ids = np.frombuffer(bytes(r.input_ids), "<u2")
        assert len(ids) == capacity and not ids[r.n_tokens:].any() and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1]
        for lo, hi, d, p, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, r.starts):
            pieces.setdefault((d, p, s), []).append(ids[lo:hi].tolist())
    for i, t in docs:
        if i is not None and i != 5:
            whole = [x for k in sorted(k for k in pieces if k[0] == i) for x in pieces[k][0]]
            assert whole == plain(t)


def test_empty(spark, frame, tmp_path):
    path = str(tmp_path / "none")
    O.write_sequences(frame([(1, "x")]).filter("doc_id > 1"), path)
    assert O.read_segments(spark, path).collect() == []
