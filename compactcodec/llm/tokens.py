"""Token ids of whole texts by a public tokenizer file, with the ids of single words kept at hand.

A tokenizer that splits at spaces before it looks for pairs gives a text the ids of its words, one
after another.  The encoder therefore gives the library each new word once, many words in one text, and
joins the known ids.  Which rule holds is read from the tokenizer's own description; for any other
tokenizer the library gets each text as it is.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np

#: words kept in each of two generations
KEPT_WORDS = 450_000
#: longer words seldom come again
LONGEST_KEPT = 12
#: stands between new words where ids alone don't show where a word ends; words that hold it go alone
MARK = "\x01"
#: signs that end a word and are a token run of their own after a letter or digit
_STOPS = (".", ",")
#: before a stop only Latin letters and digits count as such; one of them becomes a letter and a mark in lower case
_BEYOND, _SPLITS = "\u0250", "\u0130"
#: white space next to white space, and white space other than the space and the line feed
_SPACES = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
_BEFORE_WORD = re.compile(r" (?=\S)")


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.mode = _mode(about)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.before = " " if self.mode == "space before" else ""
        self.odd = MARK if self.mode == "words" else " "
        self.stops = {x: self._ids(x).tobytes() for x in _STOPS}
        if self.mode == "words":
            (self.mark,) = self._ids(MARK).tolist()
            self.edge[[i for w, i in vocab.items() if w.endswith(about["model"]["end_of_word_suffix"])]] = True
        if self.mode == "space before":
            self.edge[[i for w, i in vocab.items() if w.startswith("\u0120")]] = True
            (self.feed,) = self._ids("\n").tolist()

    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _split(self, words: list[str]) -> list[bytes]:
        """The ids of each word; none holds a space or, in mode "words", the mark."""
        if self.mode == "words":
            return self._split_ended(words)
        ids = self._ids(" " + " ".join(words))
        return _slices(ids, np.flatnonzero(self.edge[ids]), len(ids), words)

    def _split_ended(self, words: list[str]) -> list[bytes]:
        """Ids that end a run of letters show where plain words end; others get a mark between."""
        plain = [w for w in words if w.isalpha()]
        ids = self._ids(" ".join(plain))
        ends = np.flatnonzero(self.edge[ids]) + 1
        made = dict(zip(plain, _slices(ids, np.append(0, ends[:-1]), len(ids), plain), strict=True)) if plain and len(ends) == len(plain) else {}
        if rest := [w for w in words if w not in made]:
            ids = self._ids(f" {MARK} ".join(rest))
            marks = np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            if len(marks) != len(rest) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            made.update((w, raw[4 * s : 4 * e]) for w, s, e in zip(rest, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)], strict=True))
        return [made[w] for w in words]

    def _known(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        if None in ids:
            known, older = self.known, self.older
            made: dict[str, bytes] = {}
            new: dict[str, None] = {}
            stopped: list[str] = []
            for w in dict.fromkeys([w for w, x in zip(words, ids, strict=True) if x is None]):
                x = older.get(w)
                if x is not None:
                    made[w] = x
                elif w[-1:] in self.stops and w[-2:-1].isalnum() and w[-2] < _BEYOND and w[-2] != _SPLITS:
                    stopped.append(w)
                    base = w[:-1]
                    x = known.get(base) or older.get(base)
                    if x is None:
                        new[base] = None
                    else:
                        made[base] = x
                else:
                    new[w] = None
            if new:
                joined = [w for w in new if self.odd not in w and w[:1] != "\n"] if self.mode != "words" or self.odd in "".join(new) else list(new)
                made.update(zip(joined, self._split(joined), strict=True) if joined else ())
                if len(joined) < len(new):
                    made.update(self._apart([w for w in new if w not in made]))
            if len(known) > self.kept:
                self.known, self.older = {}, known
            for w in stopped:
                made[w] = made[w[:-1]] + self.stops[w[-1]]
            self.known.update(made if max(map(len, made)) <= LONGEST_KEPT else {w: x for w, x in made.items() if len(w) <= LONGEST_KEPT})
            ids = [made[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return ids

    def _apart(self, words: list[str]) -> dict[str, bytes]:
        """The ids of odd words: those that follow a line feed, in one text, and those that hold what keeps others apart."""
        after = [w for w in words if w[:1] == "\n" and self.mode != "words" and self.odd not in w and "\n" not in w[1:]]
        made = {}
        if after:
            ids = self._ids("".join(after))
            made = dict(zip(after, _slices(ids, np.flatnonzero(ids == self.feed), len(ids), after), strict=True))
        return made | {w: self._ids(w if w[:1] == "\n" else self.before + w).tobytes() for w in words if w not in made}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.mode == "words":
            text = text.replace("\n", " ")
            if text.isascii():
                text = text.lower()
            elif is_normalized("NFC", text) and is_normalized("NFC", low := text.encode().lower().decode()):
                text = low  # A-Z only; the tokenizer lowers the rest
            return b"".join(self._known(text.split(" ")))
        if self.mode == "space before":
            if any(map(text.__contains__, _SPACES)) or text[0] == "\n" or text[-1] == "\n":
                first, *later = _BEFORE_WORD.split(text)
            else:  # a line feed and the word after it count as one word
                first, *later = text.replace("\n", " \n").split(" ")
            end = []
            if later and not later[-1]:  # a space that ends the text
                later.pop()
                end = [self._ids(" ").tobytes()]
            if not first or first[0].isspace() or " " in first:
                return b"".join(chain([self._ids(first).tobytes()], self._known(later), end))
            ids = self._known(["\n" + first, *later])  # the first word has the ids that it has after a line feed
            ids[0] = ids[0][4:]
            return b"".join(chain(ids, end))
        return self._ids(text).tobytes()


def _slices(ids: np.ndarray, starts: np.ndarray, end: int, words: list[str]) -> list[bytes]:
    if len(starts) != len(words):
        raise ValueError("the tokenizer does not keep words apart")
    raw, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * end]
    return [raw[s:e] for s, e in zip(at, at[1:])]  # noqa: B905


def _mode(about: dict) -> str:
    pre, norm = about.get("pre_tokenizer") or {}, about.get("normalizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "space before"
    steps, norms = pre.get("pretokenizers", []), {n["type"] for n in norm.get("normalizers", [])}
    first = steps[0] if steps else {}
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first.get("pattern", {}).get("Regex", "") and norms <= {"NFC", "Replace", "Lowercase"} and about["model"].get("end_of_word_suffix"):
        return "words"
    return "whole"


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, kept)
    return _ENCODERS[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
