"""Temporal list join against a day-by-day evaluation."""

from __future__ import annotations

import random
from datetime import date, timedelta
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from caudal.llm import url_lists as U

D0 = date(2000, 1, 1)
ENTRIES = "list string, pattern string, action string, dated date"
CAPTURES = "page_id long, url string, fetched date"


def patterns(url):
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return []
    host = (parts.hostname or "").rstrip(".")
    if not host or "://" not in url:
        return []
    labels, segs = host.split("."), [s for s in parts.path.split("/") if s]
    return ["d:" + ".".join(labels[i:]) for i in range(len(labels))] + [
        "p:" + host + "/" + "/".join(segs[:i + 1]) for i in range(len(segs))]


def active(entries, kind, pattern, day):
    events = {}
    for lst, pat, action, dated in entries:
        if (lst, pat) == (kind, pattern) and dated and action and dated <= day:
            events.setdefault(dated, set()).add(action)
    return bool(events) and "remove" not in events[max(events)]


def expected(captures, entries):
    out = []
    for i, url, day in captures:
        n = [sum(active(entries, kind, p, day) for p in patterns(url)) if day else 0 for kind in ("block", "allow")]
        out.append((str(i), str(day), *n, n[0] == 0 or n[1] > 0))
    return sorted(out)


def sample():
    rng = random.Random(8)
    hosts = ["a.com", "www.a.com", "x.y.a.com", "b.org", "m.b.org", "hot.net"]
    paths = ["", "/", "/en", "/en/1", "/en//2/", "/fr/x?q=/en", "/EN#z"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{h}{rng.choice(['', ':8080'])}{p}" for h in hosts for p in paths]
    urls += ["http://A.COM./en", "not a url", "", "ftp://", "http://[::1]:80/en", "//a.com/en"]
    captures = [(i, rng.choice(urls), D0 + timedelta(rng.randrange(400))) for i in range(300)]
    captures += [(300 + i, "http://hot.net/en", D0 + timedelta(i % 90)) for i in range(200)]
    captures += [captures[0], (None, "http://a.com/", D0), (901, None, D0), (902, "http://a.com/", None)]
    pats = ["d:a.com", "d:com", "d:b.org", "d:hot.net", "p:a.com/en", "p:hot.net/en", "p:b.org/en/1", "d:[::1]", "d:y.a.com"]
    entries = [(rng.choice(["block", "block", "allow"]), rng.choice(pats), rng.choice(["add", "remove"]),
                D0 + timedelta(rng.randrange(-50, 450))) for _ in range(120)]
    entries += [("block", "d:hot.net", a, D0 + timedelta(d)) for d in range(90) for a in (["add"] if d % 3 else ["add", "remove"])]
    entries += [entries[0], ("other", "d:com", "add", D0), (None, "d:com", "add", D0), ("block", None, "add", D0),
                ("block", "d:com", None, D0), ("block", "d:com", "add", None)]
    return captures, entries


@pytest.fixture(scope="module")
def frames(spark):
    captures, entries = sample()
    return spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)


def test_matches_day_by_day(frames):
    captures, entries = sample()
    got = sorted((str(r.page_id), str(r.fetched), r.n_block, r.n_allow, r.kept) for r in U.judge(*frames).collect())
    assert got == expected(captures, entries)


def test_filter_keeps_columns(frames):
    df = frames[0].withColumns({"_url": F.lit(1), "day": F.lit("d"), "pattern": F.lit(0)})
    kept = U.filter_captures(df, frames[1])
    assert kept.columns == df.columns
    want = [r for r in expected(*sample()) if r[4]]
    assert sorted((str(r.page_id), str(r.fetched)) for r in kept.collect()) == sorted(r[:2] for r in want)


def test_empty(frames):
    captures, entries = frames
    assert U.judge(captures.limit(0), entries).collect() == []
    assert all(r.kept for r in U.judge(captures, entries.limit(0)).collect())
    assert U.filter_captures(captures, entries.limit(0)).count() == captures.count()
