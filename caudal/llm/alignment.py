"""Alignment of two tokenizers over the same bytes, by an associative fragment monoid.

Each text, with a blank before it, is encoded by a byte-level BPE (A) and by a
sentence-piece model (B). The bytes at which a token of both ends cut the text
into groups. A range of bytes yields a *fragment* of the tokens that end in it:
an open prefix up to the first common end, closed groups, and an open suffix.
Fragments compose (suffix and next prefix make one group), the empty fragment
is neutral, and composition is associative, so any tree over the ranges of a
text gives its groups.

Texts of up to ``chunk_bytes`` are one range. Longer ones are cut into ranges of
``chunk_bytes``, wherever those fall; the ranges are spread over Spark's tasks
and their fragments composed ``fan`` at a time by grouped rounds. A range is
encoded from the last place before it to the first one behind it where no token
of either vocabulary can cross: before a blank or line end that follows
something visible, and before a stop or comma that follows a Latin letter or digit. A
piece between two such places is called a unit here; it is
a fragment with nothing open, and each worker remembers those it met lately. A
range end inside a unit longer than a range moves to the unit's end.

Two tokens that end together are a *link*. One of them is then a suffix of the
other, so the id pairs that can link number at most the bytes of both
vocabularies (some hundred thousand). The corpus-wide table of pair counts has
that bound whatever the corpus, and is broadcast to score the documents.

Defined results. A text that is null, empty, or not given back byte for byte by
both tokenizers has no tokens: zeros and an empty string, and no part in any
count. Repeated rows are aligned and counted row by row; ids may repeat or be
null. A stretch without any safe place is encoded whole, however long. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.tables import written
from caudal.llm.tokens import _byte_letters

CHUNK_BYTES = 32 << 10
FAN = 8
MEMO_UNITS = 300_000
MEMO_CHARS = 8 << 20
BATCH_CHARS = 1 << 20
BLANK = "▁"

_LETTER = "[A-Za-z0-9À-ÖØ-öø-ɏ]"
_UNIT = re.compile(rf"[ \n]*(?:[^ \n.,]+|[.,]+[^ \n.,]*)(?:(?<!{_LETTER})[.,]+[^ \n.,]*)*|[ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]")
_SAFE_PLACE = re.compile(rf"(?<=\S)(?=[ \n])|(?<={_LETTER})(?=[.,])")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- fragments -----------------------------------------------------------------------------


class Fragment(NamedTuple):
    """Tokens that end in one range of bytes; ids as decimal text, comma-joined.

    Without a common end (``cut`` is false) everything is in the head.
    """
    cut: bool = False
    head_a: str = ""
    head_b: str = ""
    closed: str = ""
    tail_a: str = ""
    tail_b: str = ""


def _glue(x: str, y: str, mark: str = ",") -> str:
    return f"{x}{mark}{y}" if x and y else x or y


def compose(x: Fragment, y: Fragment) -> Fragment:
    if not x.cut:
        return y._replace(head_a=_glue(x.head_a, y.head_a), head_b=_glue(x.head_b, y.head_b))
    a, b = _glue(x.tail_a, y.head_a), _glue(x.tail_b, y.head_b)
    if not y.cut:
        return x._replace(tail_a=a, tail_b=b)
    return Fragment(True, x.head_a, x.head_b, _glue(_glue(x.closed, f"{a}|{b}", ";"), y.closed, ";"), y.tail_a, y.tail_b)


def of_tokens(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Fragment:
    """The fragment of (id, end) tokens whose ends lie in one range."""
    ends = sorted({e for _, e in a} & {e for _, e in b})
    out, i, j = Fragment(), 0, 0
    for end in [*ends, None]:
        m, n = i, j
        while m < len(a) and (end is None or a[m][1] <= end):
            m += 1
        while n < len(b) and (end is None or b[n][1] <= end):
            n += 1
        ids = [",".join(str(x[0]) for x in part) for part in (a[i:m], b[j:n])]
        out = compose(out, Fragment(end is not None, *ids))
        i, j = m, n
    return out


def of_groups(groups: str) -> Fragment:
    """The fragment of a run of whole groups, as text."""
    if not groups:
        return Fragment()
    first, _, rest = groups.partition(";")
    return Fragment(True, *first.split("|"), rest)


def groups_of(whole: Fragment) -> str:
    """All groups of a whole text's fragment."""
    return _glue(f"{whole.head_a}|{whole.head_b}" if whole.cut else "", whole.closed, ";")


# -- units ---------------------------------------------------------------------------------


def units_of(text: str) -> list[str]:
    """``text`` cut at its safe places."""
    return _SAFE_PLACE.split(text) if _ODD_SPACE.search(text) else _UNIT.findall(text)


def _byte_level(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """A function that encodes by the byte-level BPE at ``path``, and the bytes of its ids.

    Where each merge makes the next id, as in this family of vocabularies, ids
    are ranks and the file's vocabulary runs on tiktoken's merging, several
    times as fast with the same ids. Other files go through their own library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab, merges = said["model"]["vocab"], said["model"]["merges"]
    letters = {c: b for b, c in _byte_letters().items()}
    of = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        of[i] = bytes(letters[c] for c in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    plain = said["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and said["normalizer"] is None and len(vocab) == len(merges) + 256 and all(
            vocab["".join(pair)] == 256 + i for i, pair in enumerate(pairs)):
        ranks = {token: i for i, token in enumerate(of)}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary, of
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids, of


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the aligned units met lately.

    ``table``: for each unit (numbered by ``number``) its counts of A tokens, B
    tokens, links, links that are the best of their B id, their summed counts,
    and 1 if a tokenizer does not give the unit back. ``links`` has the keys of
    unit i's links from ``link_at[i]`` on; ``groups`` the units' groups as text,
    where wanted.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.a_bytes = _byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or BLANK in p.lstrip(BLANK) or re.search(f"{_LETTER}[.,]", p) for p in pieces):
            raise ValueError("a piece crosses a place where texts are cut")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(BLANK, " ").encode()
                        for p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id(BLANK)
        self.counts, self.with_groups = None, True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.links = np.empty(0, np.int64)
        self.link_at = np.zeros(1, np.int64)
        self.table = np.zeros((0, 6), np.int64)
        self.chars = 0

    def use(self, counts: tuple[str, np.ndarray, np.ndarray, np.ndarray] | None, groups: bool) -> None:
        """Corpus-wide counts (name, sorted pair keys, their counts, whether best) for the scores; whether groups are wanted."""
        if ((counts and counts[0]), groups) != ((self.counts and self.counts[0]), self.with_groups):
            self.counts, self.with_groups = counts, groups
            self.forget()

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's ids, B's ids and how many of B's each unit has.

        Where a unit ends visibly and the next begins with a blank or line end,
        A can read on, so it takes such units as one text.
        """
        texts, run = [], []
        for unit in units:
            if run and (run[-1][-1].isspace() or unit[0] not in " \n"):
                texts.append("".join(run))
                run = []
            run.append(unit)
        a = list(chain.from_iterable(map(self.a, [*texts, "".join(run)])))
        b = self.b.encode([u[1:] if u[0] == " " else u if u[0] == "\n" else f"a{u}" for u in units], num_threads=1)
        for i, unit in enumerate(units):
            if unit == " ":
                b[i] = [self.blank]  # B adds its blank to nothing but a text
            elif unit[0] != " ":
                b[i] = b[i][1:]  # no blank stands before a line end, and "a" is a piece of its own before a stop
        return (np.array(a, np.int64), np.fromiter(chain.from_iterable(b), np.int64), np.fromiter(map(len, b), np.int64, len(b)))

    def ends(self, ids: np.ndarray, sizes: np.ndarray, start: int) -> list[tuple[int, int]]:
        return list(zip(ids.tolist(), (start + np.cumsum(sizes[ids])).tolist()))

    def learn(self, units: set[str]) -> None:
        """Aligns the units not yet known."""
        new = [u for u in units if u not in self.number]
        if not new:
            return
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        self.chars += sum(map(len, new))
        data = [u.encode() for u in new]
        unit_ends = np.cumsum([len(d) for d in data])
        a, b, per_b = self.tokens(new)
        a_ends = np.cumsum(self.a_sizes[a])
        last_a, last_b = np.searchsorted(a_ends, unit_ends, "right"), np.cumsum(per_b)
        if len(a_ends) != last_a[-1] or (a_ends[last_a - 1] != unit_ends).any():
            raise ValueError("A does not end a token at a safe place")

        # B's sizes are summed unit by unit, for a unit that it does not give back must not shift the next.
        b_sums = np.concatenate([[0], np.cumsum(self.b_sizes[b])])
        starts, first_b = np.concatenate([[0], unit_ends[:-1]]), np.concatenate([[0], last_b[:-1]])
        bad = b_sums[last_b] - b_sums[first_b] != unit_ends - starts
        for ids, of, lasts in ((a, self.a_bytes, last_a), (b, self.b_bytes, last_b)):
            if b"".join(map(of.__getitem__, ids.tolist())) != b"".join(data):
                lows = [0, *lasts[:-1].tolist()]
                bad |= [b"".join(map(of.__getitem__, ids[lo:hi].tolist())) != d for lo, hi, d in zip(lows, lasts.tolist(), data)]
        good = ~np.repeat(bad, per_b)
        b_places = np.flatnonzero(good)
        b_ends = (b_sums[1:] + np.repeat(starts - b_sums[first_b], per_b))[good]
        common, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        at_b = b_places[at_b]
        keys = a[at_a] << 32 | b[at_b]
        cuts = np.concatenate([[0], np.searchsorted(common, unit_ends, "right")])
        rows = np.zeros((len(new), 6), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 5] = np.diff(last_a, prepend=0), per_b, np.diff(cuts), bad
        if self.counts is not None:
            _, known, n, best = self.counts
            for column, values in ((3, best), (4, n)):
                rows[:, column] = np.diff(np.concatenate([[0], np.cumsum(_at(values, known, keys))])[cuts])
        if self.with_groups:
            self.groups += self._groups(a, b, at_a, at_b, cuts, last_a, first_b)
        self.table = np.concatenate([self.table, rows])
        self.link_at = np.concatenate([self.link_at, len(self.links) + cuts[1:]])
        self.links = np.concatenate([self.links, keys])

    @staticmethod
    def _groups(a, b, at_a, at_b, cuts, last_a, first_b) -> list[str]:
        """Groups of each unit as text: the tokens behind the common end before, up to the next."""
        a, b = [list(map(str, x.tolist())) for x in (a, b)]
        unit = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        opens = np.zeros(len(at_a), bool)
        opens[cuts[:-1][np.diff(cuts) > 0]] = True
        first_a = np.concatenate([[0], last_a[:-1]])
        from_a, from_b = (np.where(opens, first[unit], np.concatenate([[0], at[:-1] + 1]) if len(at) else at)
                          for first, at in ((first_a, at_a), (first_b, at_b)))
        out = [f"{a[p] if p + 1 == q else ','.join(a[p:q])}|{b[r] if r + 1 == s else ','.join(b[r:s])}"
               for p, q, r, s in zip(from_a.tolist(), (at_a + 1).tolist(), from_b.tolist(), (at_b + 1).tolist())]
        cuts = cuts.tolist()
        return [out[i] if i + 1 == j else ";".join(out[i:j]) for i, j in zip(cuts, cuts[1:])]

    def numbers(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))

    @property
    def full(self) -> bool:
        return len(self.number) > MEMO_UNITS or self.chars > MEMO_CHARS


def _at(values: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys; 0 for a key not counted (units of texts that have no tokens)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(paths: tuple[str, str]) -> Vocabularies:
    """One pair per worker process and files."""
    if paths not in _LOADED:
        _LOADED[paths] = Vocabularies(*paths)
    return _LOADED[paths]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, inverse = np.unique(keys, return_inverse=True)
    return values, np.bincount(inverse, n, len(values)).astype(np.int64)


# -- tasks ---------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, list[str]]]]:
    """(id, units) of the rows (doc_id, text), a stretch of about ``BATCH_CHARS`` at a time."""
    out, size = [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py() or ""
        out.append((doc_id, units_of(" " + text) if text else []))
        size += len(text)
        if size >= BATCH_CHARS:
            yield out
            out, size = [], 0
    yield out


def _counted(paths: tuple[str, str]):
    """Texts of one range each, to the counts of their linked pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(paths)
        v.use(None, False)
        done = np.empty(0, np.int64), np.empty(0, np.int64)
        uses = np.zeros(0, np.int64)

        def settled() -> tuple[np.ndarray, np.ndarray]:
            n = np.repeat(uses, np.diff(v.link_at[:len(uses) + 1]))
            return _summed(np.concatenate([done[0], v.links[n > 0]]), np.concatenate([done[1], n[n > 0]]))

        for batch in batches:
            for texts in _texts(batch):
                v.learn(set().union(*(units for _, units in texts)))
                uses = np.concatenate([uses, np.zeros(len(v.number) - len(uses), np.int64)])
                good = [at for at in (v.numbers(units) for _, units in texts) if not v.table[at, 5].any()]
                uses += np.bincount(np.concatenate([np.empty(0, np.int64), *good]), minlength=len(uses))
                if v.full:
                    done, uses = settled(), np.zeros(0, np.int64)
                    v.forget()
        keys, n = settled()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
    return run


_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _scored(paths: tuple[str, str], counts):
    """Texts of one range each, to their alignment and its scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(paths)
        v.use(counts.value, True)
        for batch in batches:
            for texts in _texts(batch):
                v.learn(set().union(*(units for _, units in texts)))
                rows = np.zeros((len(texts), 6), np.int64)
                groups = []
                for r, (_, units) in enumerate(texts):
                    at = v.numbers(units)
                    rows[r] = v.table[at].sum(axis=0)
                    groups.append("" if rows[r, 5] else ";".join(map(v.groups.__getitem__, at.tolist())))
                rows[rows[:, 5] > 0] = 0
                columns = [rows[:, c] for c in (0, 1, 2, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), *map(pa.array, columns),
                                                  pa.array(groups, pa.string())], names=[f.split(" ")[0] for f in _RESULT.split(", ")])
                if v.full:
                    v.forget()
    return run


_RANGE = "rid long, doc_id long, k long, skip long, stop long, text string"


def _cut(chunk_bytes: int):
    """Long texts (rid, doc_id, text) to their ranges: the units that overlap each, and where it lies in them."""
    names = [f.split(" ")[0] for f in _RANGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(c) for c in range(3))):
                units = units_of(" " + text.as_py())
                ends = np.cumsum([len(u.encode()) for u in units])
                starts = np.concatenate([[0], ends[:-1]])
                inner = np.arange(chunk_bytes, ends[-1], chunk_bytes)
                at = np.searchsorted(ends, inner)  # the unit that holds the byte before
                inner = inner[(ends[at] == inner) | (ends[at] - starts[at] <= chunk_bytes)]
                edges = [0, *inner.tolist(), int(ends[-1])]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi) + 1
                    row = [rid.as_py(), doc_id.as_py(), k, lo - int(starts[i]), hi - int(starts[i]), "".join(units[i:j])]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=pa.schema(
                        [(n, pa.string() if n == "text" else pa.int64()) for n in names]))
    return run


_FRAGMENT = ("rid long, doc_id long, k long, ok boolean, cut boolean, head_a string, head_b string, closed binary, "
             "tail_a string, tail_b string, n_a long, n_b long, n_links long, keys array<long>, ns array<long>")
_FRAGMENT_ARROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("ok", pa.bool_()),
                             ("cut", pa.bool_()), ("head_a", pa.string()), ("head_b", pa.string()), ("closed", pa.binary()),
                             ("tail_a", pa.string()), ("tail_b", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                             ("n_links", pa.int64()), ("keys", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])


def _squeeze(groups: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(groups.encode())


def _plain(blob: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(blob).decode()


def range_fragment(v: Vocabularies, text: str, skip: int, stop: int) -> tuple[bool, Fragment, int, int, np.ndarray]:
    """(given back, fragment, A tokens, B tokens, link keys) of the tokens of ``text`` that end in (skip, stop].

    All units but the first and the last lie wholly in the range.
    """
    units = units_of(text)
    v.learn(set(units))
    at = v.numbers(units)
    if v.table[at, 5].any():
        return False, Fragment(), 0, 0, np.empty(0, np.int64)
    ends = np.cumsum([len(u) for u in units] if text.isascii() else [len(u.encode()) for u in units])
    starts = np.concatenate([[0], ends[:-1]])
    inside = (starts >= skip) & (ends <= stop)
    mine = at[inside]
    sizes = v.link_at[mine + 1] - v.link_at[mine]
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    links = [v.links[np.repeat(v.link_at[mine], sizes) + place]]
    n_a, n_b = v.table[mine, :2].sum(axis=0).tolist()
    whole = of_groups(";".join(map(v.groups.__getitem__, mine.tolist())))
    parts = []
    for i in np.flatnonzero(~inside).tolist():
        a, b, _ = v.tokens([units[i]])
        a, b = ([t for t in v.ends(x, of, int(starts[i])) if skip < t[1] <= stop] for x, of in ((a, v.a_sizes), (b, v.b_sizes)))
        b_at = {end: x for x, end in b}
        links.append(np.array([x << 32 | b_at[end] for x, end in a if end in b_at], np.int64))
        n_a, n_b = n_a + len(a), n_b + len(b)
        parts.append((i, of_tokens(a, b)))
    before, after = ([f for i, f in parts if (ends[i] > stop) == late] for late in (False, True))
    return True, reduce(compose, [*before, whole, *after], Fragment()), n_a, n_b, np.concatenate(links)


def _fragments(paths: tuple[str, str]):
    """Ranges to their fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(paths)
        v.use(None, True)
        for batch in batches:
            for row in range(batch.num_rows):
                rid, doc_id, k, skip, stop, text = (batch.column(c)[row].as_py() for c in range(6))
                ok, f, n_a, n_b, links = range_fragment(v, text, skip, stop)
                keys, n = _summed(links, np.ones(len(links)))
                values = [rid, doc_id, k, ok, f.cut, f.head_a, f.head_b, _squeeze(f.closed), f.tail_a, f.tail_b, n_a, n_b,
                          len(links), keys, n]
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(values, _FRAGMENT_ARROW)],
                                                 schema=_FRAGMENT_ARROW)
                if v.full:
                    v.forget()
    return run


_SUMS = ("n_a", "n_b", "n_links", "n_best", "count_sum")
_PART = [*_FRAGMENT_ARROW][:10] + [pa.field(c, pa.int64()) for c in _SUMS]
_PART_SQL = ", ".join([*_FRAGMENT.split(", ")[:10], *(f"{c} long" for c in _SUMS)])


def _with_scores(counts):
    """Fragments with the scores of their links in place of the links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, keys, n, best = counts.value
        for batch in batches:
            sums = []
            for wanted, uses in zip(batch.column("keys"), batch.column("ns")):
                wanted, uses = (np.array(x.as_py(), np.int64) for x in (wanted, uses))
                sums.append([int((_at(x, keys, wanted) * uses).sum()) for x in (best, n)])
            columns = [batch.column(f.name) for f in _PART[:13]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([s[c] for s in sums], pa.int64()) for c in (0, 1))],
                                             schema=pa.schema(_PART))
    return run


def _composed(t: pa.Table) -> pa.Table:
    """Fragments of successive ranges of one text, to one."""
    rows = t.sort_by("k").to_pylist()
    f = reduce(compose, [Fragment(r["cut"], r["head_a"], r["head_b"], _plain(r["closed"]), r["tail_a"], r["tail_b"]) for r in rows])
    first = rows[0]
    out = {"rid": first["rid"], "doc_id": first["doc_id"], "k": first["up"], "ok": all(r["ok"] for r in rows),
           **f._asdict(), "closed": _squeeze(f.closed), **{c: sum(r[c] for r in rows) for c in _SUMS}}
    return pa.Table.from_pylist([out], schema=pa.schema(_PART))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts' fragments to result rows."""
    for batch in batches:
        for r in batch.to_pylist():
            f = Fragment(r["cut"], r["head_a"], r["head_b"], _plain(r["closed"]), r["tail_a"], r["tail_b"])
            n = [r[c] if r["ok"] else 0 for c in _SUMS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"]], pa.int64()), *(pa.array([x], pa.int64()) for x in (*n[:3], *n[2:])),
                 pa.array([groups_of(f) if r["ok"] else ""])], names=[c.split(" ")[0] for c in _RESULT.split(", ")])


# -- the operator --------------------------------------------------------------------------


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None,
          chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row.

    ``groups`` is the alignment: ``a1,a2|b1;a3|b2,b3``, ids of A and B group by
    group. ``n_best`` counts the links whose pair is the most frequent of its B
    id, ``count_sum`` sums the links' corpus-wide counts.
    """
    paths = paths or default_vocabularies()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= chunk_bytes, F.lit(False))  # a blank is added
    short, long = rows.filter(~is_long), rows.filter(is_long)

    ranges = (long.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
              .mapInArrow(_cut(chunk_bytes), _RANGE).repartition("rid", "k"))
    parts = written(ranges.mapInArrow(_fragments(paths), _FRAGMENT))
    good = parts.groupBy("rid").agg(F.bool_and("ok").alias("good")).filter("good").select("rid")
    linked = (parts.join(good, "rid", "left_semi").select(F.explode(F.arrays_zip("keys", "ns")).alias("x"))
              .select("x.keys", "x.ns").toDF("key", "n"))
    counts = (short.mapInArrow(_counted(paths), "key long, n long").unionByName(linked)
                     .groupBy("key").agg(F.sum("n").alias("n")))
    # At most as many rows as both vocabularies have bytes.
    same_b = Window.partitionBy(F.col("key").bitwiseAND((1 << 32) - 1))
    best = (F.col("n") == F.max("n").over(same_b)).cast("long").alias("best")
    table = counts.select("key", "n", best).toArrow().sort_by("key")
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *(table[c].to_numpy() for c in ("key", "n", "best"))))

    up = parts.mapInArrow(_with_scores(shared), _PART_SQL)
    left = (parts.agg(F.max("k").alias("k")).first()["k"] or 0) + 1
    while left > 1:
        up = (up.withColumn("up", F.floor(F.col("k") / fan)).groupBy("rid", "up").applyInArrow(_composed, _PART_SQL))
        left = -(-left // fan)
    return short.mapInArrow(_scored(paths, shared), _RESULT).unionByName(up.mapInArrow(_finished, _RESULT))


def digest(aligned: DataFrame) -> DataFrame:
    """The columns of :func:`align` with the groups' digest in place of the groups."""
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", sha).drop("groups")
