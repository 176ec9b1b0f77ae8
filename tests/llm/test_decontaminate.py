"""Decontamination against brute-force greedy string tiling."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from caudal.llm import decontaminate as D


def brute_tiles(p, t, m):
    """Wise's greedy string tiling: all pairs of places, longest unmarked match first."""
    mp, mt, out = set(), set(), []
    while True:
        best = (m - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and i + k not in mp and j + k not in mt:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < m:
            return out
        k, i, j = best
        mp |= set(range(i, i + k))
        mt |= set(range(j, j + k))
        out.append(best)


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


@pytest.mark.parametrize("lot", range(8))
def test_tiles_match_brute_force(lot):
    """Tile for tile, over 4,000 cases of few symbols (many overlaps and ties) and some of many."""
    for seed in range(500 * lot, 500 * lot + 500):
        rng = random.Random(seed)
        symbols = rng.choice([2, 3, 4, 4, 40])
        p = [rng.randint(1, symbols) for _ in range(rng.randint(3, 30))]
        t = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(p))
            t += p[a:a + rng.randint(2, 25)] + [rng.randint(1, symbols) for _ in range(rng.randint(0, 5))]
        m = rng.randint(2, 6)
        assert D.tile(p, t[:40], m) == brute_tiles(p, t[:40], m), seed


def test_what_a_longer_tile_leaves_waits_for_its_turn(monkeypatch):
    """Remainders count by their own length, above and below the length searched."""
    for first in (2, 5, 20):
        monkeypatch.setattr(D, "FIRST_LENGTH", first)
        for seed in range(300):
            rng = random.Random(10_000 + seed)
            p, t = ([rng.randint(1, 2) for _ in range(rng.randint(10, 40))] for _ in range(2))
            assert D.tile(p, t, 3) == brute_tiles(p, t, 3)


def test_a_phrase_of_all_items_joins_few_rows(spark, frame):
    rng = random.Random(3)

    def words(n):
        return ["w%d" % rng.randrange(10 ** 6) for _ in range(n)]
    phrase = "this phrase is in all".split()
    items = [(i, " ".join(words(10) + phrase + words(10))) for i in range(40)]
    docs = [(i, " ".join(words(20) + (phrase if i % 3 == 0 else []) + words(20))) for i in range(300)] + [(999, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tokens = D.item_tokens(bench)
    seeds = D.seed_table(tokens)
    bitmap, bits = D._bitmap(seeds)
    found = (frame(docs).select("doc_id", F.lit(0).cast("long").alias("hash"), "text")
             .mapInArrow(D._stretches(spark.sparkContext.broadcast(bitmap), bits), "doc_id long, hash long, tokens array<long>")
             .withColumn("row", F.monotonically_increasing_id()))
    assert found.count() > 90
    assert D.shared_seeds(found, tokens, seeds, D.MIN_COVERAGE).count() < len(docs) * len(items) / 100
    assert [(r.doc_id, r.item_id) for r in D.contaminated_pairs(frame(docs), bench).collect()] == [(999, 5)]


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choices(vocab, k=n))
    items = [(i, prose(rng.randint(12, 50))) for i in range(20)] + [(20, "too short item"), (21, None), (22, ""), (3, prose(30))]
    items.append((23, items[0][1]))
    docs = [(0, None), (1, ""), (2, items[4][1]), (3, items[5][1].upper().replace(" ", ", "))]
    for i in range(4, 120):
        w = items[rng.randrange(20)][1].split(" ")
        cut = rng.randint(1, len(w) - 1)
        kind = i % 5
        part = {0: w, 1: w[cut:] + ["zzz"] + w[:cut], 2: w[:len(w) // 3], 3: w[:max(4, int(len(w) * 0.55))], 4: []}[kind]
        docs.append((i, " ".join([prose(rng.randint(0, 60)), " ".join(part), prose(rng.randint(0, 60))])))
    docs += [(5, docs[5][1]), (None, items[6][1]), (500, prose(30000) + " " + items[7][1])]
    return docs, items


def test_matches_brute_force(spark, frame):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated_pairs(frame(docs), bench).collect()
    want = []
    for i, d in docs:
        t = words(d)
        for k, text in items:
            p = words(text)
            if len(p) >= D.MIN_MATCH and set(p) & set(t):
                keep = t if len(t) < 2000 else t[-200:]
                tiles = brute_tiles(p, keep, D.MIN_MATCH)
                n = sum(x for x, _, _ in tiles)
                if n >= D.MIN_COVERAGE * len(p):
                    want.append((str(i), k, len(p), n))
    assert sorted((str(r.doc_id), r.item_id, r.item_tokens, r.covered_tokens) for r in got) == sorted(want)
    assert len(want) > 50


def test_drop_keeps_columns_and_clean_rows(spark, frame):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(docs).withColumns({"_id": F.lit(1), "hash": F.lit(2), "row": F.lit(3)})
    bad = {(r.doc_id, r.hash) for r in D.contaminated_pairs(df, bench).collect()}
    out = D.drop_contaminated(df, bench)
    assert out.columns == df.columns
    left = df.withColumn("h", F.xxhash64("text")).collect()
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in left if (r.doc_id, r.h) not in bad)


def test_empty(spark, frame):
    docs, items = corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated_pairs(frame(docs), none).collect() == []
    assert D.drop_contaminated(frame(docs), none).count() == len(docs)
    assert D.contaminated_pairs(frame(docs).filter("doc_id < -1"), spark.createDataFrame(items, "item_id long, text string")).collect() == []
