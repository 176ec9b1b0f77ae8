"""Token ids of whole texts by a public tokenizer, word by word with a bounded memo.

The tokenizer drops white space and never joins characters across a blank, so
the ids of a text are those of its blank-separated words in order. Each worker
process keeps the ids of the words it met lately (two generations of at most
``MEMO_WORDS`` words). Texts in Latin-1 are put in lower case first, as the
tokenizer would, and stops behind a word are set apart, so that fewer different
words remain. A word outside the memo that is Latin-1 letters with plain
punctuation behind goes straight to the tokenizer's BPE model, piece by piece;
any other word goes through the whole tokenizer. Where each merge of the
vocabulary makes the next id, ids are ranks, and the words of a-z that a call
needs are merged all at once by tiktoken's routine, with the same ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

MEMO_WORDS = 200_000
LONG_WORD = 64
END_ID = 1
# Neither letters nor digits, and no part of a contraction or of a special token's name.
_PLAIN_PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
# One stop between a letter and white space is a piece of its own.
_STOP = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?=[ \n]|\Z)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_ranks(path: str) -> tuple[Callable[[str], list[int]], np.ndarray] | None:
    """A function from words of a-z, their last letters in upper case and nothing between them, to all their ids; and
    the letters of each id. None if the vocabulary's ids are not in the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model.get("end_of_word_suffix")
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if not end or made != list(range(made[0], made[0] + len(made))) or len(vocab) != made[-1] + 1:
        return None
    ranks, sizes = {}, np.zeros(len(vocab), np.int64)
    for token, i in vocab.items():
        word = token.removesuffix(end)
        if re.fullmatch("[a-z]+", word):
            ranks[(word if word == token else word[:-1] + word[-1].upper()).encode()] = i
            sizes[i] = len(word)
    if any(bytes([c]) not in ranks for c in range(65, 123) if chr(c).isalpha()):
        return None
    return tiktoken.Encoding("words", pat_str="[a-z]*[A-Z]", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


class WordEncoder:
    """``encode(texts)`` gives the little-endian unsigned 32-bit ids of each text as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.by_ranks = _by_ranks(path)
        self.tails: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bpe(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.rstrip(_PLAIN_PUNCTUATION)
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
            ids = self._bpe(letters.lower())
            return ids if len(letters) == len(word) else ids + self._bpe(word[len(letters):])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _tail(self, tail: str) -> bytes:
        """Ids of the punctuation behind a word."""
        if tail not in self.tails:
            if len(self.tails) >= 10_000:
                self.tails = {}
            self.tails[tail] = self._bpe(tail)
        return self.tails[tail]

    def _learn(self, new: Iterable[str]) -> None:
        """Ids of words that are in no memo: words of a-z together, the others one by one."""
        memo, plain, letters = self.young, [], []
        for word in new:
            known = self.old.get(word)
            if known is not None:
                memo[word] = known
                continue
            body = word.rstrip(_PLAIN_PUNCTUATION)
            if self.by_ranks and body.isascii() and body.isalpha():
                plain.append(word)
                letters.append(body.lower())
            else:
                memo[word] = self._word(word)
        if not plain:
            return
        encode, sizes = self.by_ranks
        ids = np.array(encode("".join([x[:-1] + x[-1].upper() for x in letters])), "<u4")
        cuts = 4 * np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(x) for x in letters]), "right")
        raw, lo = ids.tobytes(), 0
        for word, body, hi in zip(plain, letters, cuts.tolist()):
            part = raw[lo:hi]
            memo[word] = part if len(body) == len(word) else part + self._tail(word[len(body):])
            lo = hi

    @staticmethod
    def _words(text: str) -> list[str]:
        if "<|" not in text:  # else a name in upper case could turn into a special token's
            try:
                text.encode("latin-1")
                text = _STOP.sub(r" \1", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        split = list(map(self._words, texts))
        memo = self.young
        new = set().union(*split).difference(memo)
        self._learn(new)
        long = [word for word in new if len(word) > LONG_WORD]
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        for word in long:
            del memo[word]
        if len(memo) > MEMO_WORDS:
            self.old, self.young = memo, {}
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_column(column, path: str, chunk_bytes: int = 2 << 20) -> Iterable[bytes]:
    """Ids of each text of an Arrow column (null: empty text), ``END_ID`` appended.

    Works through the column in chunks of about ``chunk_bytes`` characters.
    """
    end, enc = np.array([END_ID], "<u4").tobytes(), encoder(path)
    chunk, size = [], 0
    for value in column:
        text = value.as_py() or ""
        chunk.append(text)
        size += len(text)
        if size >= chunk_bytes:
            yield from (ids + end for ids in enc.encode(chunk))
            chunk, size = [], 0
    yield from (ids + end for ids in enc.encode(chunk))
