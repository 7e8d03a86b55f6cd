"""Cutting texts into pieces that a byte-level tokenizer treats on their own, so that pieces can be cached.

The tokenizer's pre-token pattern never joins a non-space to a space before it, and a single space goes to
the non-space after it. A text may therefore be cut before each space, and around each line feed, that has
no other white space beside it. The plain cut assumes this holds everywhere; a piece that shows otherwise
(it is empty, or white space is at its end) sends the text to the careful cut.
"""

from __future__ import annotations

import re

_CAREFUL = re.compile(r"(?<=\S)(?= \S)")


def stand_ins() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    # fixed values: bytes that stand for themselves; the others come behind, in order
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Uneven(Exception):
    """A piece with white space at an end, which the plain cut must not make."""


def is_even(piece: bytes) -> bool:
    text = piece.decode("utf-8", "replace")
    return bool(text) and not text[0].isspace() and not text[-1].isspace()


def plain_cut(text: bytes) -> list[list[bytes]]:
    """Lines of pieces: the first of a line as it is, the others without the space before them."""
    return [line.split(b" ") for line in text.split(b"\n")]


def careful_cut(text: bytes) -> list[bytes]:
    """Pieces with the spaces before them; they join to the text whatever its white space."""
    return [x.encode() for x in _CAREFUL.split(text.decode("utf-8", "replace"))]
