"""Secret scan: fixed patterns plus assignment-aware lexing.

Three base patterns find spans in every whole text. The lexer then reads the
assignment statements of whatever syntax the text holds (``name = "x"``,
``name: x``, ``"name": "x"``, ``name := x``, ``name => x``, ``export NAME=x``,
typed declarations, keyword arguments, ``name <- x``, ``#define NAME x``,
``--name x``, ``set("name", "x")``, ``<name>x</name>``, YAML blocks, and
``name=x`` pairs inside a quoted connection string), each as a target name and
an expression of literals and references. Constants propagate: a literal first
given to a harmless name is judged by every name it later flows into,
concatenations included. A literal is reported when the sensitivity of its
target name times its own strength reaches ``MIN_SCORE`` and no base span
holds it already. Blanks and text of one character class lower the strength,
but not under names of full weight, whose usual values are such. Triple-quoted
and backquoted literals run over lines, and so does one in double quotes that
closes at the end of a line of its paragraph. A PEM block is one literal with
its label as a target name, assigned to another or not. Each element of a list,
tuple, set or call, and each ``- item`` line below a ``name:``, is a literal of
the target by itself; a plural name weighs as its singular.

Statements are found from their operators and few other signs, so prose without
them is never lexed. A run of bare characters and a comment are read once, so
the work on a text is linear in its length.

Defined results. A null text is the empty text. Rows are scanned one by one,
so repeated rows and ids (null ids too) give a row each; an empty table gives
an empty result. Only the named columns are read by :func:`scan`;
:func:`redact` keeps every other column, whatever its name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
MIN_SCORE = 0.5
MARK = "[REDACTED]"
BLANK_CUT, CLASS_CUT = 0.7, 0.8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# How telling a target name is, by the words it is made of.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "jwt": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "masterkey": 1.0,
}
PLACEHOLDERS = ("example", "changeme", "change_me", "placeholder", "xxxx", "your_", "your-", "dummy", "redacted", "****")

_OP = re.compile(r":=|=>|->|<-|[=!<>]=+|::+|://|[:=]")
_ASSIGNING = {":=", "=>", "<-", ":", "="}
_BARE = re.compile(r"[\w+/.=@%~!^-]+")
_BARE_PART = re.compile(r"[\w+/.@%~!^-]+=*(?![\w+/.@%~!^-])|[\w+/.@%~!^-]+|=+")  # of a run, up to an operator in it
_PREFIX = re.compile(r"[rbfuRBFU]{1,2}(?=[\"'])")
_REFERENCE = re.compile(r"\$\{(\w+)\}|\$(\w+)|%\((\w+)\)s|\{\{\s*(\w+)\s*\}\}")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\Z")
_CONCAT = re.compile(r"[ \t]*(?:\+|\.\.|\.|&|\|\|)?[ \t]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9][A-Z0-9 ]*)-----")
_PEM_BODY = re.compile(r"(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*")
_LAST_IN_LINE = re.compile(r"[ \t]*[,;)\]}]*[ \t]*\r?(?:\n|\Z)")
_OPENER = re.compile(r"[ \t]*(?:(?:new[ \t]+)?[\w.]*(?:<\w+>)?\[\][\w.*]*[ \t]*(?=\{))?[(\[{]")
_KEY = re.compile(r"""(?:"[^"\n]*"|'[^'\n]*'|[\w.$-]+)(?:[ \t]*(?:=>|:=|:(?!:))|[ \t]+=[ \t]|=(?![=,)\]}\s]))""")
_GAP = re.compile(r"(?:\s|#[^\n]*|//[^\n]*)*")
_ITEM = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\r?\n[ \t]*(?:#[^\n]*)?)*\n[ \t]*-[ \t]+(?=\S)")
_REST = re.compile(r"[^\n,)\]}\"'`:=\w]*")
# Statements without an operator: a definition, an option and its value, a name and a value as arguments.
_DEFINE = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)[ \t]+(?=\S)", re.MULTILINE)
_OPTION = re.compile(r"(?<![\w-])--([A-Za-z][\w-]*)[ \t]+(?=[^\s-])")
_ARGUMENTS = re.compile(r"""[\w.]\([ \t]*(["'])([A-Za-z_][\w.-]*)\1[ \t]*,[ \t]*(?=["'`])""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:[ \t][^<>\n]*)?>\s*([^<>\s](?:[^<>]*[^<>\s])?)\s*</\1[ \t]*>")
# Pairs in a quoted connection string or query; a block of lines that YAML gives a name.
_PAIR = re.compile(r"""(?<=[;&?"'`])[ \t]*([A-Za-z_][\w-]*(?: [\w-]+)*)[ \t]*=[ \t]*([^;&"'`\s][^;&"'`\n]*)""")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?\r?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*?)[ \t\r]*(?:\n|\Z)")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Literal = tuple[int, int]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the three fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _CAMEL.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_WEIGHTS.get(p) or NAME_WEIGHTS.get(p.removesuffix("s"), 0.0) for p in parts + pairs), default=0.0)


def literal_strength(value: str, weight: float = 1.0) -> float:
    """0 to 1: length, variety of character classes and entropy, lowered for blanks and for one
    class only unless the name has full ``weight``; 0 for short text and placeholders."""
    if len(value) < 8 or any(p in value.lower() for p in PLACEHOLDERS):
        return 0.0
    classes = sum(any(f(c) for c in value) for f in (
        str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace()))
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    strength = min(1.0, 0.25 * max(classes - 1, 0) + entropy / 5 + min(n, 32) / 64)
    if weight < 1.0:
        strength *= (BLANK_CUT if any(c.isspace() for c in value) else 1.0) * (CLASS_CUT if classes < 2 else 1.0)
    return strength if classes else 0.0


def pem_blocks(text: str) -> dict[int, tuple[int, str]]:
    """Start of each PEM block that has a body: its end and label. One without an END line ends with its base64."""
    out, heads = {}, list(_PEM.finditer(text))
    for m, after in zip(heads, [*heads[1:], None]):
        tail = f"-----END {m[1]}-----"
        stop = text.find(tail, m.end(), after.start() if after else len(text))
        end = stop + len(tail) if stop >= 0 else _PEM_BODY.match(text, m.end()).end()
        if re.search(r"[A-Za-z0-9+/=]{16}", text[m.end():end if stop < 0 else stop]):
            out[m.start()] = end, m[1]
    return out


class _Lexer:
    def __init__(self, text: str):
        self.text = text
        self.reach: dict[str, tuple[int, int]] = {}
        self.pems = pem_blocks(text)
        self.read = 0
        self.bare_end = 0  # of the bare run read last
        self.block_end = 0  # of the YAML block read last

    def gap(self, at: int) -> int:
        """Where the blanks, line ends and comments from ``at`` on end."""
        while True:
            at = _GAP.match(self.text, at).end()
            if not self.text.startswith("/*", at):
                return at
            close = self._next("*/", at + 2)
            if close == len(self.text):
                return at
            at = close + 2

    def _next(self, what: str, at: int) -> int:
        """Where ``what`` is next from ``at`` on (the text's length if nowhere); remembered between two calls' places."""
        begin, end = self.reach.get(what, (0, -1))
        if not begin <= at <= end:
            end = self.text.find(what, at)
            end = len(self.text) if end < 0 else end
            self.reach[what] = at, end
        return end

    def _identifier_before(self, at: int, floor: int) -> tuple[str, int]:
        """The name that ends at ``at`` (blanks, quotes and brackets skipped) and where it begins."""
        t = self.text
        while at > floor and t[at - 1] in " \t\"'`]":
            at -= 1
        end = at
        while at > floor and (t[at - 1].isalnum() or t[at - 1] in "_$.-"):
            at -= 1
        return t[at:end], at

    def target(self, at: int, floor: int) -> str:
        """The assigned name left of the operator at ``at``; ``name: type =`` gives ``name``."""
        name, begin = self._identifier_before(at, floor)
        back = begin
        while back > floor and self.text[back - 1] in " \t":
            back -= 1
        if self.text[at] == "=" and back > floor and self.text[back - 1] == ":":
            return self._identifier_before(back - 1, floor)[0] or name
        return name

    def _closing(self, at: int, quote: str, end: int) -> int:
        """The next ``quote`` in ``at`` to ``end`` that no backslash escapes, or -1."""
        t, i = self.text, at
        while (i := self._next(quote, i)) < end:
            back = i
            while back > at and t[back - 1] == "\\":
                back -= 1
            if (i - back) % 2 == 0:
                return i
            i += 1
        return -1

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """Begin and end of the string literal whose quote is at ``at``, and where its closing quote ends; None if
        none closes it."""
        quote, size = self.text[at], 1
        if quote != "`" and self.text.startswith(quote * 3, at):
            quote, size = quote * 3, 3
        begin = at + size
        if size == 3 or quote == "`":
            end = self._closing(begin, quote, len(self.text))
        else:
            end = self._closing(begin, quote, self._next("\n", begin))
            if end < 0 and quote == '"':
                end = self._closing(begin, quote, self._next("\n\n", begin))
                end = end if end >= 0 and _LAST_IN_LINE.match(self.text, end + 1) else -1
        return None if end < 0 else (begin, end, end + size)

    def operands(self, at: int) -> tuple[list[Literal | str], int]:
        """Literals (spans) and references (names) of the expression at ``at``, and its end; inside a literal of a
        list that was read, a bare word ends it."""
        t, out = self.text, []
        while at < len(t):
            if t[at] in "\"'`":
                if not (literal := self.quoted(at)):
                    break
                ref = _REFERENCE.fullmatch(t, *literal[:2])
                out.append(next(g for g in ref.groups() if g) if ref else literal[:2])
                at = literal[2]
            elif at in self.pems:
                out.append((at, self.pems[at][0]))
                at = self.pems[at][0]
            elif m := _REFERENCE.match(t, at):
                out.append(next(g for g in m.groups() if g))
                at = m.end()
            elif (m := _PREFIX.match(t, at)) and not (at and (t[at - 1].isalnum() or t[at - 1] in "_$")):
                at = m.end()  # the prefix of a string literal
                continue
            elif m := (_BARE if at >= self.bare_end else _BARE_PART).match(t, at):
                # A run is one word; an operator inside a run that was read takes its part of it, so no run is read twice.
                self.bare_end = max(self.bare_end, m.end())
                word = m[0].rstrip(".=")
                out += [word, (at, at + len(word))] if _IDENT.match(word) else [(at, at + len(word))] if word else []
                at = m.end()
                if at < self.read:
                    break
            else:
                break
            joint = _CONCAT.match(t, at)
            if not joint[0].strip() and not (joint.end() < len(t) and t[joint.end()] in "\"'`$"):
                break
            at = joint.end()
        return out, at

    def block(self, op: int, at: int) -> Literal | None:
        """The lines of the YAML block that is the value at ``at`` of the name before ``op``: those indented deeper."""
        head = _BLOCK.match(self.text, at) if at >= self.block_end else None
        if not head:
            return None
        line = self.text.rfind("\n", 0, op) + 1
        depth = len(self.text[line:op]) - len(self.text[line:op].lstrip(" \t"))
        begin = end = at = head.end()
        while at < len(self.text):
            m = _LINE.match(self.text, at)
            if m[2] and len(m[1]) <= depth:
                break
            if m[2]:
                begin, end = (m.start(2) if begin == end else begin), m.end(2)
            at = m.end()
        self.block_end = end
        return (begin, end) if end > begin else None

    def called(self, parts: list[Literal | str], end: int) -> bool:
        """Whether ``parts`` end with the name of a call at ``end``; one of letters only is taken from them."""
        t = self.text
        if t[end:end + 1] != "(" or not t[end - 1].isalnum():
            return False
        if len(parts) > 1 and isinstance(parts[-2], str) and parts[-2].replace(".", "").isalpha():
            del parts[-2:]
        return True

    def listed(self, at: int) -> tuple[list[list[Literal | str]], int]:
        """The elements, nested ones included, of the list, tuple or call that opens at ``at``, and where reading
        ended: after its close, at a nested statement, or at text that no list has."""
        t, out, depth = self.text, [], 0
        while at < len(t):
            if t[at] in "([{":
                depth += 1
                at = self.gap(at + 1)
                continue
            if t[at] in ")]}":
                depth -= 1
                at += 1
                if not depth:
                    break
            elif t[at] == ",":
                at = self.gap(at + 1)
                continue
            elif _KEY.match(t, at):
                break
            else:
                parts, end = self.operands(at)
                call = end > at and self.called(parts, end)
                out += [parts] if parts else []
                at = end
                if call:
                    continue
            at = self.gap(at)
            if at < len(t) and t[at] not in ",)]}":
                at = _REST.match(t, at).end()  # an operator and what it takes, to the next element of the line
                if t[at:at + 1] not in (",", ")", "]", "}"):
                    break
        return out, at

    def items(self, at: int) -> tuple[list[list[Literal | str]], int]:
        """The ``- item`` lines that follow the one of ``at``, up to another kind of line or a nested statement."""
        out = []
        while (m := _ITEM.match(self.text, at)) and not _KEY.match(self.text, m.end()):
            parts, at = self.operands(m.end())
            out += [parts] if parts else []
            at = self._next("\n", max(at, m.end()))
        return out, at

    def elements(self, at: int, op: str) -> tuple[list[list[Literal | str]], int]:
        """The expressions right of the operator that ends at ``at``, and the end of the first.

        What a list holds is read once: an operator inside a list's literal gets no list of its own.
        """
        t = self.text
        while at < len(t) and t[at] in " \t":
            at += 1
        opener = _OPENER.match(t, at) if at >= self.read else None
        if not opener:
            while at < len(t) and t[at] in " \t([":
                at += 1
            first, end = self.operands(at)
            if at < self.read:
                return [first] if first else [], end
            if first:
                more, self.read = self.listed(end) if self.called(first, end) else ([], self.read)
                return [x for x in (first, *more) if x], end
            out, self.read = self.items(at) if op == ":" else ([], self.read)
            return out, at
        out, self.read = self.listed(opener.end() - 1)
        at = opener.end()
        while at < len(t) and t[at] in " \t([":
            at += 1
        return out, self.operands(at)[1]


def _groups(text: str, elements: list[list[Literal | str]], known: dict[str, list[tuple[Literal, ...]]]) -> list[tuple[Literal, ...]]:
    """The literals of each of ``elements`` as one group; those of a name that holds several groups come beside it."""
    out, seen = [], set()
    for parts in elements:
        literals: list[Literal] = []
        i = 0
        while i < len(parts):
            if isinstance(parts[i], str):
                bare = parts[i + 1] if i + 1 < len(parts) and isinstance(parts[i + 1], tuple) and \
                    text[parts[i + 1][0]:parts[i + 1][1]] == parts[i] else None
                held = known.get(parts[i], [(bare,)] if bare else [])
                if len(held) == 1:
                    literals += held[0]
                elif parts[i] not in seen:
                    seen.add(parts[i])
                    out += held
                i += 2 if bare else 1
            else:
                literals.append(parts[i])
                i += 1
        out += [tuple(dict.fromkeys(literals))] if literals else []
    return list(dict.fromkeys(out))


def _statements(text: str) -> Iterator[tuple[int, re.Match, str]]:
    """(place, match, what it is) of operators and of the statements without one, in order of place."""
    found = [((m.start(), m, m[0]) for m in _OP.finditer(text) if m[0] in _ASSIGNING)]
    for sign, pattern in (("define", _DEFINE), ("--", _OPTION), (",", _ARGUMENTS), ("</", _ELEMENT)):
        if sign in text:
            found.append([(m.start(), m, sign) for m in pattern.finditer(text)])
    return found[0] if len(found) == 1 else merge(*found, key=lambda x: x[0])


def literal_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that flow into sensitive names."""
    lex, scores, floor = _Lexer(text), {}, 0
    known: dict[str, list[tuple[Literal, ...]]] = {}
    judged: dict[int, tuple[list[tuple[Literal, ...]], float]] = {}

    def given(name: str, groups: list[tuple[Literal, ...]]) -> None:
        if not name or not groups:
            return
        known[name] = groups
        if (weight := name_weight(name)) > judged.get(id(groups), (None, 0.0))[1]:
            judged[id(groups)] = groups, weight
            for group in groups:
                strength = literal_strength("".join(text[s:e] for s, e in group), weight)
                for span in group if weight * strength >= min_score else ():
                    scores[span] = max(scores.get(span, 0.0), weight * strength)

    for place, m, what in _statements(text):
        if place < floor:
            continue
        if what == "</":
            given(m[1].rsplit(":", 1)[-1], [(m.span(2),)])
            continue
        if what in _ASSIGNING:
            name = lex.target(place, floor)
            if what == ":" and (lines := lex.block(place, m.end())):
                given(name, [(lines,)])
                continue
        else:
            name = m[2] if what == "," else m[1]
        elements, end = lex.elements(m.end(), what) if what in _ASSIGNING else ([x for x in lex.operands(m.end())[:1] if x], m.end())
        parts = elements[0] if len(elements) == 1 else []
        if parts and parts[0] in known and parts[1:] in ([], [(end - len(parts[0]), end)]):
            groups = known[parts[0]]  # one name for another: shared, not copied
        else:
            groups = _groups(text, elements, known)
        given(name, groups)
        if what in _ASSIGNING and elements and len(elements[0]) == 1 and isinstance(elements[0][0], tuple) and \
                text[elements[0][0][0] - 1] in "\"'`":
            floor = end  # operators inside a plain quoted literal are its text, but for pairs of a connection string
            for pair in _PAIR.finditer(text, elements[0][0][0] - 1, elements[0][0][1]):
                given(pair[1], [(pair.span(2),)])
    reach, i, held = 0, 0, sorted(scores)
    for s, (e, label) in lex.pems.items():
        while i < len(held) and held[i][0] <= s:
            reach = max(reach, held[i][1])
            i += 1
        if e > reach and (weight := name_weight(label)) >= min_score:
            scores[s, e] = weight
    return [(s, e, score) for (s, e), score in sorted(scores.items()) if e > s]


def all_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Base spans plus the method's literals that no base span holds."""
    base = base_spans(text)
    if not any(sign in text for sign in ("=", ":", "--", "<-", "</", "define", "(")):
        return base
    out, reach, i = [], -1, 0
    for s, e, _ in literal_spans(text):
        while i < len(base) and base[i][0] <= s:
            reach = max(reach, base[i][2])
            i += 1
        if e > reach:
            out.append((s, 3, e, s))
    return sorted(base + out)


def _join(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


_SCAN = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("n_literal", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts by kind, digest of the base spans, all spans."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *_SCAN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                spans = all_spans(value.as_py() or "")
                kinds = Counter(k for _, k, _, _ in spans)
                rows.append((*(kinds[k] for k in range(4)),
                             hashlib.sha256(_join([x for x in spans if x[1] < 3]).encode()).hexdigest(), _join(spans)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def redact_text(text: str) -> str:
    """``text`` with each secret's value (overlapping ones together) replaced by ``MARK``."""
    out, at = [], 0
    for begin, end in sorted((v, e) for _, _, e, v in all_spans(text)):
        if begin >= at:
            out += [text[at:begin], MARK]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``length`` (if it is a column) brought up to date.

    A row without a secret is unchanged, a null text included.
    """
    at = docs.columns.index(text)
    counted = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            old = batch.column(at).to_pylist()
            new = [x and redact_text(x) for x in old]
            cols = list(batch.columns)
            if new != old:
                cols[at] = pa.array(new, cols[at].type)
                if counted is not None:
                    cols[counted] = pa.array([n if a == b else len(b) for n, a, b in zip(
                        cols[counted].to_pylist(), old, new)], cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
