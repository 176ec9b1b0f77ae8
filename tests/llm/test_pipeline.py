"""The pipeline against each stage's definition, on a small corpus with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute_tiles, words
from test_packing import check, plain  # noqa: F401
from test_quality import figures
from test_secrets import base
from test_simhash import fingerprint, groups

from caudal.llm import secrets


def corpus():
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(600)]

    def prose(n):
        return " ".join(rng.choices(vocab, k=n))
    items = [(i, prose(rng.randint(15, 40))) for i in range(10)]
    rows = [(i, prose(rng.randint(12, 300))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(110 + i, rows[i][1] + " " + rng.choice(vocab)) for i in range(10, 30)]
    rows += [(200 + i, prose(20) + " " + items[i % 10][1] + " " + prose(15)) for i in range(15)]
    rows += [(300 + i, prose(30) + f' token = "{rng.getrandbits(160):040x}" ' + prose(20)) for i in range(10)]
    rows += [(400, "!!! " * 40), (401, ""), (402, None), (403, "spam eggs ham " * 30), (404, prose(6000)), (None, prose(60))]
    rng.shuffle(rows)
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, frame, tmp_path_factory):
    rows, items = corpus()
    path = tmp_path_factory.mktemp("tables")
    frame(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def expected():
    rows, items = corpus()
    rows = [r for r in rows if figures(r[1])[-1]]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    root = groups([fingerprint(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]

    def leaked(text):
        for _, item in items:
            p, t = words(item), words(text)
            if len(t) < 400 and sum(k for k, _, _ in brute_tiles(p, t, 5)) >= 0.5 * len(p):
                return True
        return False
    rows = [r for r in rows if not leaked(r[1])]
    return [(i, secrets.redact_text(t)) for i, t in rows]


def test_pipeline(spark, folder, plain):  # noqa: F811
    want = expected()
    assert 60 < len(want) < 110 and not any(base(t) for _, t in want)
    n, bound = check(P.run(spark, folder).collect(), want, plain, 4096)
    assert n <= bound + 1


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
    masked = P.secret_scans(spark, docs, folder)
    assert masked.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert masked.count() == docs.count()


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
