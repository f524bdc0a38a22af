"""Cutting texts into chunks that a byte-level tokenizer treats independently, and a bounded memory of chunks.

The splitting pattern of the vocabulary begins a new piece at every space that a non-white character follows, and no
piece runs across such a space. A text may therefore be cut there, and each distinct chunk be looked at once.
"""

from __future__ import annotations

import re

import regex

#: Fixed value: the splitting pattern of byte-level vocabularies.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: All that some library might take for white space, beside the space itself.
PLAIN_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
OTHER_WHITE = "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
CUT = re.compile(f"[ ](?![ {PLAIN_WHITE}{OTHER_WHITE}]|$)")
AFTER_SPACE = tuple(" " + c for c in " " + PLAIN_WHITE)
#: Words and other pieces remembered by one Python worker (about 200 bytes each).
WORDS_KEPT, OTHERS_KEPT = 600_000, 60_000
#: Marks that often end a chunk; each is a piece of its own behind a letter.
END_MARKS = frozenset(".,;:!?")
AFTER_SPACE = tuple(" " + c for c in " " + PLAIN_WHITE)


def chunks(text: str) -> list[str]:
    """The text in chunks; all but the first begin with a space, which is left out of them."""
    sure = text[-1:] != " " and not any(x in text for x in AFTER_SPACE)
    if sure and not text.isascii():
        sure = not any(x in text for x in OTHER_WHITE)
    return text.split(" ") if sure else CUT.split(text)


class Memory(dict):
    """Key to value. ``fill`` computes a missing value; a full memory starts anew."""

    def __init__(self, fill, most: int):
        super().__init__()
        self.fill, self.most = fill, most

    def __missing__(self, key):
        value = self.fill(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Words(Memory):
    """Values of chunks behind a space. Words are remembered; a chunk of several pieces is put together."""

    def __init__(self, of_piece, join):
        super().__init__(of_piece, WORDS_KEPT)
        self.join = join
        self.other = Memory(of_piece, OTHERS_KEPT)
        self.mixed = Memory(lambda chunk: self.pieces(" " + chunk), OTHERS_KEPT)

    def __missing__(self, chunk):
        if chunk.isalpha():
            value = self.fill(" " + chunk)
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
            return value
        mark = chunk[-1:]
        if mark in END_MARKS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.other[mark]
        return self.mixed[chunk]

    def pieces(self, text: str):
        found = PIECES.findall(text)
        return self.join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.other[p] for p in found])


class Chunked:
    """Values of texts as a sum over their pieces, whose values ``of_piece`` gives."""

    def __init__(self, of_piece, join):
        self.join = join
        self.words = Words(of_piece, join)

    def __call__(self, text: str):
        head, *rest = chunks(text)
        return self.words.pieces(head) + self.join(map(self.words.__getitem__, rest))


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
