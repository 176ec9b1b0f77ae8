"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caudal.llm import simhash
from caudal.llm.components import components


def fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, r=4):
    """Root (smallest index reachable) of each fingerprint, all pairs compared."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= r:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def sample_rows():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "a b c"), (6, "a b c d"), (7, "x" * 9000)]
    base = [" ".join(rng.choices(words, k=n)) for n in (30, 200, 900, 300)]
    for i in range(8, 300):
        ws = rng.choice(base).split(" ") if i % 3 else rng.choices(words, k=rng.randint(1, 60))
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(8, rows[8][1]), (None, rows[9][1]), (None, "nobody else has this text at all")]
    return rows


@pytest.mark.parametrize("leaf_rows", [16_384, 20])
def test_matches_brute_force(frame, leaf_rows):
    rows = sample_rows()
    got = simhash.near_duplicates(frame(rows), leaf_rows=leaf_rows).collect()
    fps = [fingerprint(t) for _, t in rows]
    root = groups(fps)
    low = {}
    for (i, _), r in zip(rows, root):
        low.setdefault(r, []).append(i)
    want = sorted((str(i), f"{fp:016x}", str(min((x for x in low[r] if x is not None), default=None)))
                  for (i, _), fp, r in zip(rows, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_vantage_tree_loses_no_link():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.concatenate([centre, *(centre ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64))
                                    ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(60))])
    fps = np.unique(fps)
    a, b = simhash.vantage_links(fps, np.arange(len(fps)), np.empty(0, np.int64))
    root = simhash.local_roots(len(fps), np.concatenate(a), np.concatenate(b))
    assert root.tolist() == groups([int(x) for x in fps])


def test_any_two_near_fingerprints_share_a_block(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        pairs.append([v - (1 << 64) if v >> 63 else v for v in (x, y)])
    df = spark.createDataFrame(pairs, "x long, y long")
    for blocks in (5, 6, 7, 8):
        keys = [simhash.block_keys(F.col(c), 4, blocks) for c in "xy"]
        assert df.filter(F.arrays_overlap(*keys)).count() == len(pairs)


def test_more_rows_more_key_bits():
    assert [simhash.blocks_for(10 ** n, 4) for n in (3, 6, 8, 10, 12)] == [5, 5, 6, 7, 8]


def test_links_do_not_depend_on_the_number_of_blocks(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in fps], "fp long")
    want = groups(fps)
    for shard_rows in (2048, 0):  # 0: as many blocks as there may be
        got = {r.node & ((1 << 64) - 1): r.root for r in components(simhash.links(df, shard_rows=shard_rows)).collect()}
        parts = {}
        for v, w in zip(fps, want):
            parts.setdefault(w, set()).add(v)
        found = {}
        for v in fps:
            found.setdefault(got.get(v, v - (1 << 64) if v >> 63 else v), set()).add(v)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, parts.values()))


def test_keep_one(spark, frame):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = frame([(5, text), (3, text), (3, text), (None, text), (9, "entirely other words in this one here"),
                  (None, "no id and no double at all in here"), (7, None), (6, "")]).withColumn("_id", F.lit(1))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([
        ("3", text), ("9", "entirely other words in this one here"), ("None", "no id and no double at all in here"),
        ("6", "")])


def test_empty(frame, spark):
    empty = frame([(1, "x")]).filter("doc_id > 1")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("levels", [12, 1])
def test_dense_cluster_goes_in_bounded_cells(spark, monkeypatch, levels):
    from itertools import combinations as pairs

    leaf, centre = 16, 0x0F0F_3C3C_55AA_7711
    fps = [centre] + [centre ^ (1 << i) for i in range(24)] + [centre ^ (1 << i) ^ (1 << j) for i, j in pairs(range(24), 2)]
    sent = []
    whole = simhash._cells
    monkeypatch.setattr(simhash, "_cells", lambda rows, n: sent.append((rows, whole(rows, n))) or sent[0][1])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = components(simhash.links(df, leaf_rows=leaf, levels=levels)).collect()
    assert len(roots) == len(fps) and len({r.root for r in roots}) == 1
    before, after = ({r.key: (r.h, r.q) for r in d.groupBy("key").agg(
        F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("q")).collect()} for d in sent[0])
    assert max(map(max, before.values())) > 4 * leaf >= max(map(max, after.values()))

    def compared(d):
        by = {}
        for r in d.collect():
            by.setdefault(r.key, ([], []))[0 if r.home else 1].append(r.fp)
        return {frozenset((x, y)) for h, q in by.values() for x in h for y in h + q if x != y}

    assert compared(sent[0][1]) == compared(sent[0][0])


def test_comparisons_on_the_registered_input(spark):
    """Trees and blocks leave out most pairs; with one block value for all rows the trees alone still leave some out."""
    table = simhash.fingerprint_table(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    fps = table.select("fp").distinct().checkpoint()
    n = fps.count()
    compared = simhash.links(fps).agg(F.sum("compared")).first()[0]
    assert 0 < compared < n * (n - 1) // 2 / 5
    x = np.array([r.fp for r in fps.collect()], np.int64).view(np.uint64)
    one = []
    simhash.vantage_links(x, np.arange(n), np.empty(0, np.int64), compared=one)
    assert sum(one) < 0.99 * n * (n - 1) // 2


def test_trees_prune_what_is_spread():
    """Rows at many distances: most branches are left out."""
    rng = np.random.default_rng(5)
    x = np.unique(np.array([(1 << int(k)) - 1 for k in rng.integers(0, 64, 4000)], np.uint64) ^
                  (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    compared = []
    a, b = simhash.vantage_links(x, np.arange(len(x)), np.empty(0, np.int64), compared=compared)
    assert sum(compared) < len(x) * (len(x) - 1) // 2 / 2
    root = simhash.local_roots(len(x), np.concatenate(a), np.concatenate(b))
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= simhash.MAX_BITS, 1))
    assert np.array_equal(root, simhash.local_roots(len(x), i, j))
