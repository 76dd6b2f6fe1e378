"""Byte-level BPE ids from the tokenizers library, with a memo of word pieces.

A single space between two characters that aren't white space always starts a new pre-token, so a text
may be cut there and its parts encoded on their own. Parts made of letters, with ASCII punctuation after
them, go straight to the library's BPE model; any other part goes through the library's whole encoder.
Both give the ids of the whole text's encoding. A text that holds one of the vocabulary's added tokens (as
``<|endoftext|>``) goes through the whole encoder in one piece, since such tokens are found before pre-tokens are.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Pieces that a worker remembers; beyond it pieces are encoded anew each time.
MEMO_PIECES = 500_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than the space and the line feed.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others take 256 and up in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.letters = byte_letters()
        self.room = memo
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _model(self, part: str) -> bytes:
        # of letters and printable ASCII only the space has another letter
        mapped = part.replace(" ", self.letters[32]) if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, part: str) -> bytes:
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        """Ids of one part, with the space before it if it has one."""
        body = part[1:] if part[:1] == " " else part
        if body.isalpha():
            return self._model(part)
        word = body.rstrip(_MARKS)
        if word.isalpha():
            head = part[: len(part) - len(body) + len(word)]
            known = self.memo.get(word) if head[:1] == " " else None
            return (known or self._model(head)) + self._marks(body[len(word) :])
        return self._whole(part)

    def _marks(self, tail: str) -> bytes:
        found = self.tails.get(tail)
        if found is None:
            found = self._model(tail)
            if len(self.tails) < 4096:
                self.tails[tail] = found
        return found

    def spaced(self, word: str) -> bytes:
        """Ids of a word with a space before it, remembered while there is room."""
        out = self.part(" " + word)
        if len(word) < 32 and len(self.memo) < self.room:
            self.memo[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self._whole(text)
        loose = "  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE)
        parts = _CUT.split(text) if loose else text.split(" ")
        get, spaced = self.memo.get, self.spaced
        return self.part(parts[0]) + b"".join([get(p) or spaced(p) for p in parts[1:]])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file."""
    return PieceEncoder(path)


def encode_documents(path: str, texts: list[str | None], end_id: int | None) -> list[np.ndarray]:
    """Id arrays (``<u4``) of whole texts, each followed by ``end_id``."""
    enc = encoder(path)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    return [np.frombuffer(enc.encode(t) + end, "<u4") for t in texts]
