"""Quality rules against a plain count of the same figures."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from caudal.llm import quality as Q


def figures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    n, chars = len(words), sum(map(len, words))
    symbols, dups = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    upper, lower = (sum(a <= c <= z for c in text) for a, z in ("AZ", "az"))
    kept = not (failed or 10 * symbols > n or 2 * text.count("!") > n or upper > lower or 2 * dups > len(lines)
                or chars > 15 * n or chars < 2 * n)
    return n, chars, symbols, dups, len(covered), failed, kept


def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 8))) for _ in range(200)]
    phrase = " ".join(rng.choices(vocab, k=7))
    out = [None, "", " \n\t", "x", "\n\n", "a b c d e", "a a a a a a", " ".join(["w"] * 30), phrase + " " + phrase, "AB CD " * 30]
    for _ in range(120):
        words = rng.choices(vocab, k=rng.randint(5, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at:at] = phrase.split(" ")
        mark = rng.choice(["", "", "", "%%", "!", "#"])
        text = "".join(w + mark + rng.choice([" ", " ", " ", "\n", "  ", "\x0b", " "]) for w in words)
        out.append(text if rng.random() < 0.8 else "\n".join([text, "same line", "same line ", "same line"]))
    return list(enumerate(out)) + [(3, "x"), (None, phrase * 3)]


def test_report(frame):
    df = frame(rows()).withColumns({"kept": F.lit(1), "words": F.lit("x")})
    got = Q.quality_report(df).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(i), *figures(t)) for i, t in rows())


def test_filter_keeps_columns_and_agrees(frame):
    df = frame(rows()).withColumns({"kept": F.lit(1), "h": F.lit("x")})
    out = Q.filter_quality(df)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(t) for _, t in rows() if figures(t)[-1])


def test_order_changes_no_verdict(frame):
    df = frame(rows())
    rules = list(Q.BASE_RULES + Q.EXTRA_RULES)
    for seed in range(3):
        random.Random(seed).shuffle(rules)
        got = df.filter(Q._with_words(F.col("text"), Q.cascade(rules))).count()
        assert got == sum(not figures(t)[-1] for _, t in rows())


def test_rules_are_ranked_by_rejection_per_cost(frame):
    df = frame([(i, "!!! " * 20) for i in range(50)])
    ranked = [r.name for r in Q.order_rules(df, Q.EXTRA_RULES)]
    assert set(ranked) == {r.name for r in Q.EXTRA_RULES}
    assert ranked.index("exclamations") < ranked.index("shouting")


@pytest.mark.parametrize("call", [Q.quality_report, Q.filter_quality])
def test_empty(frame, call):
    assert call(frame([(1, "x")]).filter("doc_id > 1")).collect() == []
