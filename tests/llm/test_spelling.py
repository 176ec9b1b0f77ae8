"""Words, near words, forms and roots against brute force over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caudal.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def counted(rows, slip=S.SLIP):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def expected(rows, slip=S.SLIP):
    words = counted(rows, slip)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, str(form[w]), root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.word, str(r.form), r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def rows(seed=5, n=150):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(4, 9))) for _ in range(40)]
    vocab = list(base)
    for w in base:  # chains of edits, of falling frequency
        for _ in range(6):
            k = rng.randrange(len(w)) if w else 0
            w = rng.choice([w[:k] + w[k + 1:] + "a" * (len(w) < 5), w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abx") + w[k + 1:]])
            vocab.append(w)
    weights = [1 / (1 + i % 11) for i in range(len(vocab))]
    out = [None, "", "Straße straße STRASSE", "É×÷é É×÷é É×÷é", "日本abcde abcde。ABCDE", "aaaaa aaaab aaabb " * 3, "zzzzz" * 90]
    for _ in range(n):
        out.append(rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocab, weights, k=rng.randint(5, 60))).title())
    return list(enumerate(out)) + [(3, "zzzzz" * 90), (None, "zzzzz" * 90), (3, "abcde abcdf")]


@pytest.mark.parametrize("options", [{}, {"cell_words": 8, "leaf_words": 2}, {"cell_words": 50, "leaf_words": 1, "block_letters": 60},
                                     {"slip": 3, "cell_words": 20}])
def test_against_all_pairs(frame, options):
    df = frame(rows()).withColumns({"word": F.lit("w"), "n": F.lit(1), "size": F.lit(2)})
    assert got(S.variants(df, **options)) == expected(rows(), options.get("slip", S.SLIP))


def test_fixture_has_chains():
    found = expected(rows())
    assert any(r[1] not in ("None", r[2]) for r in found) and any(r[1] == "None" and r[4] for r in found)
    assert any(sum(n == m for _, _, _, n, _, _ in found) > 1 for _, _, _, m, _, _ in found)


def test_empty_tables(frame):
    assert S.variants(frame(rows()).limit(0)).collect() == []
    assert S.variants(frame([(1, "one two three"), (2, None)])).collect() == []


def test_one_hot_word(frame):
    rng = random.Random(2)
    docs = [(i, "hello " * rng.randint(0, 200) + "help hella hellp help") for i in range(60)]
    assert got(S.variants(frame(docs))) == expected(docs)


letters = st.text("abc", min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(letters, letters)
def test_one_edit(a, b):
    if abs(len(a) - len(b)) <= 1:
        x, y = (S._matrix([w.encode()]) for w in (a, b))
        assert S.one_edit(x, y)[0] == one_edit(a, b)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abcd", min_size=4, max_size=4), min_size=1, max_size=60), st.sets(st.text("abcde", min_size=3, max_size=5), max_size=60),
       st.integers(1, 9))
def test_search_finds_all(home, queries, leaf):
    home, queries = sorted(home), sorted(queries)
    n = np.array([len(set(w)) for w in home])
    count, best = S.near_words([w.encode() for w in home], n, [w.encode() for w in queries], leaf)
    for q, c, b in zip(queries, count, best):
        others = [i for i, w in enumerate(home) if one_edit(q, w)]
        assert c == len(others)
        assert b == min(others, key=lambda i: (-n[i], home[i]), default=-1)


def test_boxes_prune():
    """Most leaves are left out for most words."""
    rng = np.random.default_rng(4)
    words = sorted({bytes(97 + rng.integers(0, 12, 8, dtype=np.uint8)) for _ in range(8000)})
    leaves = []
    v = S.vectors(words)
    tree = S.grown(v, 64, leaves)
    one = np.ones(len(words), np.int64)
    seen = sum(len(at) * len(leaves[leaf]) for leaf, at in S.visited(tree, v, one, one))
    assert seen < len(words) ** 2 / 4
    home = np.concatenate([at for _, at in S.visited(tree, v, 0 * one, 0 * one)])
    assert sorted(home) == list(range(len(words)))
