"""Exact ids of a public tokenizer, at the speed of a dictionary.

The pre-tokenizers of the supported files never join text across white space, so a text's ids are the ids of its
white-space-delimited chunks put together. Each distinct chunk is encoded once by the tokenizers library and kept in a
bounded cache of two generations. Texts of single spaces and line ends are cut by str.split, others by a pattern; texts
that hold the string of an added token go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Fixed: the characters that the tokenizers' patterns call white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Chunks longer than this are encoded, but not kept.
KEPT_CHARS = 48
#: Chunks in each of the two generations that one Python worker keeps.
CACHE_CHUNKS = 450_000

_ENCODERS: dict[str, "ChunkEncoder"] = {}


class Generations:
    """A bounded cache: when the young half is full it becomes the old one; what is used again moves back."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        parts = list(map(self.young.get, keys))
        missing = [k for k, part in enumerate(parts) if part is None]
        if missing:
            found: dict[str, bytes] = {}
            known, old = found.get, self.old.get
            for k in missing:
                key = keys[k]
                part = known(key)
                if part is None:
                    part = old(key)
                    found[key] = part = make(key) if part is None else part
                parts[k] = part
            if len(self.young) > self.size:
                self.young, self.old = {}, self.young
            self.young.update(found if max(map(len, found)) <= KEPT_CHARS else {c: ids for c, ids in found.items() if len(c) <= KEPT_CHARS})
        return parts

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        return self.old.get(key) if found is None else found


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.drops_space = bool(getattr(self.model, "end_of_word_suffix", None))
        pattern = f"[^{SPACE}]+" if self.drops_space else f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        self.units = re.compile(pattern).findall
        self.odd_space = re.compile(f"[{SPACE.replace(' ', '').replace(chr(10), '')}\x1c-\x1f]").search
        # a word of letters; both pre-tokenizers set it apart from the stop or comma that ends its chunk
        letters = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
        self.plain = re.compile(f" ?{letters}\\Z").match
        self.ended = re.compile(f" ?{letters}[.,]\\Z").match
        # how byte-level models write the bytes of such words: letters of two bytes become two letters
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        shown |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte_letters = {c: "".join(shown[b] for b in chr(c).encode()) for c in (32, *range(65, 256))}
        self.space = self.byte_letters[32]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = {c: self._ids(c) for c in ".,"}
        self.line_end = self._ids("\n")
        self.by_piece, self.by_unit = Generations(CACHE_CHUNKS), Generations(CACHE_CHUNKS // 4)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Of letters alone, with or without a space before them: straight from the model."""
        shown = (word.lower() if self.drops_space else word).translate(self.byte_letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _plain_word(self, word: str) -> bytes:
        """Of ASCII letters alone, after a space: byte-level models write these letters as they are."""
        shown = word.lower() if self.drops_space else self.space + word
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        if self.plain(unit):
            return self._word(unit)
        if self.ended(unit):
            return self._word(unit[:-1]) + self.ends[unit[-1]]
        return self._ids(unit)

    def _piece(self, piece: str) -> bytes:
        """Of what stands between single spaces; one that starts with a line end has no space before its word."""
        if piece.isascii():  # most are words of plain letters, with or without a stop or comma
            if piece.isalpha():
                return self._plain_word(piece)
            if piece[-1] in ".," and piece[:-1].isalpha():
                word = self.by_piece.get(piece[:-1])
                return (self._plain_word(piece[:-1]) if word is None else word) + self.ends[piece[-1]]
        if self.drops_space:
            before, unit = b"", piece
        elif piece[0] == "\n":
            before, unit = self.line_end, piece[1:]
        else:
            before, unit = b"", " " + piece
        if self.ended(unit) and (word := self.by_piece.get(piece[:-1])) is not None:
            return word + self.ends[piece[-1]]
        return before + self._unit(unit)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text; null is the empty text."""
        if not text:
            return np.empty(0, "<u4")
        if any(a in text for a in self.added):
            return np.frombuffer(self._ids(text), "<u4")
        spaced = text.replace("\n", " \n")
        if spaced.replace("\n", "").isprintable() or not self.odd_space(text):  # no white space but these two is printable
            if self.drops_space:
                return np.frombuffer(b"".join(self.by_piece.look_up(text.split(), self._piece)), "<u4")
            # no empty pieces and no line end alone
            if "  " not in spaced and "\n " not in spaced and spaced[0] != " " and spaced[-1] not in " \n":
                pieces = spaced.split(" ")
                first = self._unit(pieces.pop(0))
                return np.frombuffer(first + b"".join(self.by_piece.look_up(pieces, self._piece)), "<u4")
        return np.frombuffer(b"".join(self.by_unit.look_up(self.units(text), self._unit)), "<u4")


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_path(name: str) -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
