"""Whole-text encoding through bounded caches of pieces and words.

A piece ends where a single space stands between two characters that are not white space. No pre-token of the supported
tokenizers crosses such a place, so the ids of a text are the ids of its pieces, one after the other. A piece of plain
Latin text is split into pre-tokens, and each new one is given to the BPE model of the tokenizers library; any other piece
(other scripts, combining marks, special tokens) goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re

from . import common

_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space for Python, ordinary characters for the tokenizers.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Characters that make one pre-token with each other, and none with the letters before them.
_CLOSING = ".,!?;:|*&%$#\"()"
#: How byte-level tokenizers split a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write a byte as a character: printable Latin-1 as itself, the others, in order, from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(b) if b in shown else chr(0x100 + sum(x not in shown for x in range(b))) for b in range(256)}


class _Bytes(dict):
    """Little-endian unsigned 32-bit bytes of an id, made once."""

    def __missing__(self, i: int) -> bytes:
        return self.setdefault(i, i.to_bytes(4, "little"))


_BYTES = _Bytes()


class Recent:
    """A cache of two generations: once it holds `size` entries, the newer becomes the older, and the older goes."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of whole texts, as bytes.

    keeps_spaces: a byte-level tokenizer, for which the space before a word belongs to the word. Otherwise the tokenizer
    lower-cases and drops white space, and every run of it ends a piece.
    """

    def __init__(self, path: str, keeps_spaces: bool, pieces: int = 500_000, words: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keeps_spaces = keeps_spaces
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]
        own = BYTE_LEVEL_PATTERN if keeps_spaces else next(x["pattern"]["Regex"] for x in split["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(own).findall
        self.alphabet = _byte_level_alphabet()
        self.pieces, self.words = Recent(pieces), Recent(words)

    def by_library(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _tokens(self, word: str) -> bytes:
        """Of one pre-token, by the model."""
        shown = "Ġ" + word[1:] if word[0] == " " and word.isascii() and word[1:].isalpha() else word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([_BYTES[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        """Of a pre-token that is no piece of letters."""
        cache = self.words
        ids = cache.new.get(word) or cache.old.get(word)
        if ids is None:
            ids = cache.new[word] = self._tokens(word)
        return ids

    def _letters(self, before: str, core: str) -> bytes:
        """Of letters, which are a piece of their own where they stand alone."""
        if not self.keeps_spaces:
            core = core.lower()
        cache = self.pieces
        ids = cache.new.get(core)
        if ids is None:
            ids = cache.new[core] = cache.old.get(core) or self._tokens(before + core)
        return ids

    def _piece(self, before: str, piece: str) -> bytes:
        """Of a piece, with the space before it if the tokenizer keeps it."""
        core = piece.rstrip(_CLOSING)
        if core.isalpha() and (core.isascii() or max(core) <= "\xff") and (before or not self.keeps_spaces):
            ids = self._letters(before, core)
            return ids if len(core) == len(piece) else ids + self._word(piece[len(core) :])
        if max(piece) > "\xff" or "<|" in piece:
            return self.by_library(before + piece)
        return b"".join(map(self._word, self.split(before + (piece if self.keeps_spaces else piece.lower()))))

    def _look_up(self, pieces: list[str], before: str) -> list[bytes] | None:
        """None if a piece isn't set off by single spaces."""
        self.words.turn()
        self.pieces.turn()
        new, old = self.pieces.new, self.pieces.old.get
        found = list(map(new.get, pieces))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            p = pieces[at]
            ids = new.get(p)
            if ids is None:
                ids = old(p)
                if ids is None:
                    if before and (not p or p[0].isspace() or p[-1].isspace()):
                        return None
                    ids = self._piece(before, p)
                new[p] = ids
            found[at] = ids
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.keeps_spaces:
            if any(c in text for c in _SEPARATORS):
                return self.by_library(text)
            return b"".join(self._look_up(text.split(), ""))
        head, *rest = text.split(" ")
        found = self._look_up(rest, " ")
        if found is None or not head or head[-1].isspace():
            head, *rest = _SPACE.split(text)
            found = [self._piece(" ", p) for p in rest]
        found.insert(0, self._piece("", head))
        return b"".join(found)


_encoders: dict[tuple, PieceEncoder] = common.kept_between_tasks({})


def encoder(path: str, keeps_spaces: bool) -> PieceEncoder:
    """One for each Python worker."""
    key = (path, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, keeps_spaces)
    return _encoders[key]
