"""Repeat removal against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm import suffix_dedup as S

W = S.WINDOW


def brute(rows):
    """Expected rows for (doc_id, text), every window compared with every earlier one."""
    data = [(i, (t or "").encode()) for i, t in rows]
    data.sort(key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha1(x[1]).digest()))
    seen, out = set(), []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - W + 1):
            w = b[s:s + W]
            if w in seen:
                gone[s:s + W] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def sample(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 6))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choices(words, k=k))
    passages = [prose(k) for k in (8, 13, 18, 22, 30, 60, 200)] + ["x" * 101, "ab" * 90]
    rows = [(0, None), (1, ""), (2, "y" * 99), (3, "y" * 99), (4, "y" * 100), (5, "y" * 100), (6, "y" * 3000)]
    for i in range(7, n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                cut = rng.randrange(len(p))
                p = p[:cut] + "#" + p[cut + 1:]
            parts += [p, prose(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", ""]).join(parts)))
    full = rows[20][1] + passages[-3]
    rows += [(500, full), (501, full), (3, full), (501, full), (None, full), (None, passages[6]), (20, passages[6] + "z"),
             (20, prose(50))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot_runs,group_bytes", [(1, S.HOT_RUNS, S.GROUP_BYTES), (2, 1, 2000), (3, 0, 500)])
def test_matches_brute_force(frame, seed, hot_runs, group_bytes):
    rows = sample(seed)
    assert rows_of(S.remove_repeats(frame(rows), hot_runs=hot_runs, group_bytes=group_bytes)) == brute(rows)


def test_long_texts_cross_segments(frame):
    rows = sample(4, 60)
    assert rows_of(S.remove_repeats(frame(rows), segment=700, flush_bytes=2000)) == brute(rows)


def test_empty_and_extra_columns(frame):
    docs = frame([(1, "q" * 250), (2, "r")]).withColumn("sha", F.lit(1)).withColumn("_id", F.lit(2))
    assert rows_of(S.remove_repeats(docs)) == brute([(1, "q" * 250), (2, "r")])
    assert S.remove_repeats(docs.filter("doc_id > 9")).collect() == []


def test_anchor_runs_cover_every_window_once():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 105, 5000, dtype=np.uint8)
    ends = np.repeat([1234, 1300, 5000], [1234, 66, 3700])
    lo, hi, _, _ = S.anchor_runs(data, ends, W)
    got = sorted(p for a, b in zip(lo, hi) for p in range(a, b + 1))
    assert got == [p for p in range(5000 - W + 1) if p + W <= ends[p]]
