"""Stupid-backoff scores against a direct count."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caudal.llm import lm


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(rows):
    docs = [words(t) for _, t in rows]
    one, two = Counter(), Counter()
    for w in docs:
        one.update(w)
        two.update(zip(w, w[1:]))
    total, out = sum(one.values()), []
    for (i, _), w in zip(rows, docs):
        o1, o2, s, back = Counter(w), Counter(zip(w, w[1:])), 0.0, 0
        for k, x in enumerate(w):
            n = two[w[k - 1], x] - o2[w[k - 1], x] if k else 0
            if n > 0:
                s += math.log(n / (one[w[k - 1]] - o1[w[k - 1]]))
                continue
            back += 1
            s += (math.log(lm.BACKOFF) if k else 0) + math.log(max(one[x] - o1[x], lm.UNSEEN) / max(total - len(w), 1))
        out.append((str(i), len(w), back, s))
    return sorted(out)


def sample():
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, weights, k=rng.randint(0, 80)))) for i in range(200)]
    return rows + [(300, None), (301, ""), (302, "?!"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]),
                   (303, " ".join(rng.choices(vocab, weights, k=9000))), (304, "zzz unseen words only")]


@pytest.mark.parametrize("group_bytes,range_bytes", [(lm.GROUP_BYTES, lm.RANGE_BYTES), (900, 2500)])
def test_matches_direct_count(frame, group_bytes, range_bytes):
    df = frame(sample()).withColumns({"g": F.lit("x"), "z": F.lit(1)})
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, r.log_score) for r in lm.score(df, group_bytes=group_bytes, range_bytes=range_bytes).collect())
    want = brute(sample())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-9)


def test_empty_and_single(frame):
    assert lm.score(frame([(1, "x")]).filter("doc_id > 1")).collect() == []
    (r,) = lm.score(frame([(1, "only one here")])).collect()
    assert (r.n_words, r.n_backoff) == (3, 3)
    assert {r.log_score for r in lm.score(frame([(1, None), (2, "")])).collect()} == {0.0}


def brute_order(rows, order):
    docs = [words(t) for _, t in rows]

    def counted(w):
        return Counter(tuple(w[k:k + m]) for m in range(1, order + 1) for k in range(len(w) - m + 1))

    every, out = sum(map(counted, docs), Counter()), []
    total = sum(map(len, docs))
    for (i, _), w in zip(rows, docs):
        own, s, back = counted(w), 0.0, 0
        for k in range(len(w)):
            for m in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - m + 1:k + 1])
                n = every[gram] - own[gram]
                if m == 1:
                    s += math.log(max(n, lm.UNSEEN) / max(total - len(w), 1))
                elif n > 0:
                    s += math.log(n / (every[gram[:-1]] - own[gram[:-1]]))
                    break
                else:
                    s += math.log(lm.BACKOFF)
            back += m < order
        out.append((str(i), len(w), back, s))
    return sorted(out)


@pytest.mark.parametrize("order,group_bytes,range_bytes", [(3, lm.GROUP_BYTES, lm.RANGE_BYTES), (3, 900, 2500), (4, 5000, 900), (1, 900, 2500)])
def test_orders_match_direct_count(frame, order, group_bytes, range_bytes):
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, r.log_score) for r in lm.score(
        frame(sample()), group_bytes=group_bytes, range_bytes=range_bytes, order=order).collect())
    want = brute_order(sample(), order)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-9)
    if order < 4:
        assert lm.score(frame([(1, "x")]).filter("doc_id > 1"), order=order).collect() == []


def test_splits_may_change_between_jobs(spark, frame, tmp_path):
    """The table is read twice; the cores that Spark has decide its splits, here a setting does, changed in between."""
    rows = sample() + [(400, "the same text again and again")] * 40
    frame(rows).repartition(6).write.parquet(f"{tmp_path}/docs")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    try:
        scores = lm.score(spark.read.parquet(f"{tmp_path}/docs"), group_bytes=900, range_bytes=2500)
        for n in names:
            spark.conf.set(n, "700")
        got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, 6)) for r in scores.collect())
    finally:
        for n in names:
            spark.conf.set(n, old[n])
    assert got == [(i, n, b, round(s, 6)) for i, n, b, s in brute(rows)]


def test_many_equal_rows(frame):
    rows = [(7, "some words and more words")] * 2300 + [(8, "other words")]
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, 6)) for r in lm.score(frame(rows)).collect())
    assert got == [(i, n, b, round(s, 6)) for i, n, b, s in brute(rows)]
