"""Block naming against plain comparison of normalised texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caudal.llm import exact_dedup as X


def rows():
    rng = random.Random(7)
    out = [None, "", " ", "\n\t ", "a", "a ", " a", "a  b", "a\nb", "a\x0b\x0c\rb", "a\xa0b", "é" * 40, "é" * 40 + "x",
           "ab" * 16, "ab" * 32, "ab" * 64, "ab" * 64 + "a", "x" * 5000, "x" * 5001, "ab" * 16 + " "]
    base = ["".join(rng.choices("ab ", k=rng.randint(0, 300))) for _ in range(25)]
    for _ in range(120):
        t = rng.choice(base)
        out.append(t if rng.random() < 0.6 else t.replace(" ", rng.choice(["  ", "\n", " "])) + rng.choice(["", "", "b", "a" * 32]))
    return list(enumerate(out)) + [(3, "a"), (3, "a"), (3, "ab" * 64), (None, "é" * 40), (None, "zz"), (None, "zz")]


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    size = Counter(t for _, t in norm)
    keep = {}
    for i, t in norm:
        keep[t] = min((x for x in (keep.get(t, i), i) if x is not None), default=None)
    return sorted((str(i), str(keep[t]), size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


@pytest.mark.parametrize("block_bytes", [16, 3, X.BLOCK_BYTES])
def test_groups(frame, block_bytes):
    df = frame(rows()).withColumns({"name": F.lit(1), "rid": F.lit(2), "kept": F.lit("x"), "level": F.lit(0)})
    got = X.deduplicate(df, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected(rows())
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(str(r.doc_id) == str(r.keep_id) for r in got if r.kept)


def test_empty_table(spark, frame):
    df = frame(rows()).limit(0)
    assert X.deduplicate(df).collect() == []
    assert X.deduplicate(df).dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"),
                                        ("kept", "boolean"), ("text_sha256", "string")]


def test_names_are_ordered_and_collision_free(spark, frame):
    got = X.named(frame([(i, t) for i, t in enumerate(["ab" * 40, "ab" * 40, "ab" * 41, "q", "q", "ab" * 41])]), block_bytes=8).collect()
    by = {}
    for r in got:
        by.setdefault((r.level, r.name), set()).add(r.sha)
    assert all(len(s) == 1 for s in by.values()) and len(by) == 3 and all(r.name is not None for r in got)
    assert {r.level for r in got} == {0, 4}


def test_no_python_in_the_plan(frame):
    plan = X.deduplicate(frame(rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
