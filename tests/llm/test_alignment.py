"""Alignment against both tokenizers on whole texts, and the laws of the fragments."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caudal.llm import alignment as A

PATHS = A.default_vocabularies()
TOKENIZER = Tokenizer.from_file(PATHS[0])
TOKENIZER.encode_special_tokens = True


def tokens(v, text):
    """(id, end) of A and B over the whole text, or nothing."""
    if not text:
        return [], []
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    data = (" " + text).encode()
    if not b"".join(v.a_bytes[i] for i in a) == data == b"".join(v.b_bytes[i] for i in b):
        return [], []
    return v.ends(np.array(a), v.a_sizes, 0), v.ends(np.array(b), v.b_sizes, 0)


def expected(rows):
    v = A.vocabularies(PATHS)
    found, counts = [], Counter()
    for i, text in rows:
        a, b = tokens(v, text)
        both = {e: x for x, e in a}
        links = [(both[e], x) for x, e in b if e in both]
        counts.update(links)
        ends = sorted({e for _, e in a} & {e for _, e in b})
        groups = ";".join("|".join(",".join(str(x) for x, e in side if lo < e <= hi) for side in (a, b))
                          for lo, hi in zip([0, *ends], ends))
        found.append((i, len(a), len(b), len(ends), links, groups))
    top = {}
    for (a, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return sorted((str(i), a, b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                   hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, a, b, g, links, groups in found)


ODD = [None, "", " ", "\n", "  ", "\n\n", " \n ", "a", " a", "a ", "a\n", "\na", "a  b", "a \n b", "x\t\n y", "x\t y", "a\xa0\n b",
       "<|endoftext|> <s>x</s> <unk>", "<0x41>", "a▁b c d e f", "\x00a b", "a\x1c b ?\x1c !", "naïve café — ﬁn", "日本語 テキスト\n中文",
       "👩‍👩‍👧 ok", "don't 'll ''s it's", "1,234.5 67", "    four\n        eight", "tab\there", "é é", "x　y   z",
       "antidisestablishmentarianism " * 3, "q" * 300, "\u0085 a\u0085\n b", "word." * 40, "foo.com, 3.14,15 (x). a_.b é.,é ...x.y .a ,", "a²,b ½. 日.本，"]


def rows():
    rng = random.Random(11)
    words = ["the", "cat", "Sat", "on", "mats.", "unbelievable", "étage,", "größe", "x1y2", "foo\nbar", "", "\n", "it's", "日本"]
    out = [*ODD, "the cat", "the cat", *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)),
           " ".join(rng.choices(words, k=2500)), "long ▁ " + "bad " * 300, "y" * 700 + " end " + "z" * 50]
    return list(enumerate(out)) + [(3, "the cat"), (None, "the cat sat"), (None, None)]


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                  for r in A.digest(df).collect())


@pytest.mark.parametrize("chunk_bytes,fan", [(A.CHUNK_BYTES, 8), (64, 2), (7, 3)])
def test_against_whole_texts(frame, chunk_bytes, fan):
    df = frame(rows()).withColumns({"groups": F.lit(1), "k": F.lit(2), "rid": F.lit("x")})
    assert got(A.align(df, chunk_bytes=chunk_bytes, fan=fan)) == expected(rows())


def test_small_memo(frame, monkeypatch):
    v = A.vocabularies(PATHS)
    monkeypatch.setattr(A.Vocabularies, "full", property(lambda self: True))
    assert v.full
    assert got(A.align(frame(rows()), chunk_bytes=200)) == expected(rows())


def test_empty_table(frame):
    assert A.align(frame(rows()).limit(0)).collect() == []


def test_odd_texts_by_unit():
    v = A.vocabularies(PATHS)
    v.use(None, True)
    v.forget()
    rng = random.Random(3)
    texts = ["".join(rng.choices(" \n\tab.,'s1é\x1c\xa0 日▁)²_", k=rng.randint(1, 14))) for _ in range(3000)]
    for some in (texts[:1], texts[1:200], texts[200:]):
        v.learn({u for text in some for u in A.units_of(" " + text)})
        for text in some:
            a, b = tokens(v, text)
            units = A.units_of(" " + text)
            assert "".join(units) == " " + text
            at = v.numbers(units)
            assert v.table[at, 5].any() == (not a)
            if a:
                assert v.table[at, :2].sum(0).tolist() == [len(a), len(b)]
                assert A.of_groups(";".join(v.groups[i] for i in at)) == A.of_tokens(a, b)


def test_a_file_of_another_order_goes_through_its_library(tmp_path):
    said = json.loads(open(PATHS[0], encoding="utf-8").read())
    said["model"]["merges"][5:7] = said["model"]["merges"][6:4:-1]
    (tmp_path / "other.json").write_text(json.dumps(said), encoding="utf-8")
    encode, of = A._byte_level(str(tmp_path / "other.json"))
    text = " some <|endoftext|> text it's 123\n\n  there"
    assert b"".join(of[i] for i in encode(text)) == text.encode()
    assert encode(text) == Tokenizer.from_file(str(tmp_path / "other.json")).encode(text).ids or "<|" in text


ends = st.lists(st.integers(1, 40), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.lists(st.integers(0, 40), unique=True, max_size=6).map(sorted), st.randoms())
def test_fragments_compose_in_any_tree(a, b, cuts, rng):
    a, b = ([(10 * side + e, e) for e in [*x, 41]] for side, x in ((1, a), (2, b)))
    whole = A.of_tokens(a, b)
    edges = [0, *cuts, 41]
    parts = [A.of_tokens(*([t for t in x if lo < t[1] <= hi] for x in (a, b))) for lo, hi in zip(edges, edges[1:])]
    assert reduce(A.compose, parts, A.Fragment()) == whole
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i:i + 2] = [A.compose(*parts[i:i + 2])]
    assert parts[0] == whole and A.of_groups(A.groups_of(whole)) == whole


def test_pairs_are_bounded_by_the_vocabularies():
    v = A.vocabularies(PATHS)
    known = {x: len(x) for x in v.a_bytes}
    pairs = sum(x[k:] in known for x in v.b_bytes for k in range(len(x)))
    pieces = Counter(v.b_bytes)
    pairs += sum(pieces[x[k:]] for x in v.a_bytes for k in range(1, len(x)))
    assert pairs < 500_000
