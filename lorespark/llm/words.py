"""Words of whole texts as UTF-8 bytes, cut by C code in pieces of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: A longer text is cut into words piece by piece.
PIECE_BYTES = 8 << 20


def lowering(separators: bytes) -> bytes:
    """A table for ``bytes.translate``: separators become spaces, A-Z become a-z, all other bytes stay."""
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words are what whitespace separates.
SPACED = lowering(bytes([32, *range(9, 14)]))
#: Words are letters and all that is not ASCII.
LETTERS = lowering(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words are letters, digits and all that is not ASCII.
ALPHANUMERIC = lowering(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def pieces(text: bytes | None, table: bytes, most: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists; a null text has none."""
    if not text:
        return
    most = most or PIECE_BYTES
    if len(text) <= most:
        yield text.translate(table).split()
        return
    at = 0
    while at < len(text):
        end = at + most
        # a word is never cut: the piece runs on to the next separator
        while end < len(text) and table[text[end]] != 32:
            end += 1
        yield text[at:end].translate(table).split()
        at = end
