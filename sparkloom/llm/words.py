"""Words of a text as bytes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20  #: bytes of a text taken apart at once


def split_words(raw: bytes, table: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, a list for each piece of it. table translates each byte, and what stands between words to spaces."""
    at, size = 0, size or PIECE
    while at < len(raw):
        end = at + size
        piece = raw[at:end].translate(table)
        whole = len(piece) if end >= len(raw) else piece.rfind(b" ") + 1
        while not whole:  # one word longer than a piece
            piece += raw[end : end + size].translate(table)
            end += size
            whole = len(piece) if end >= len(raw) else piece.rfind(b" ") + 1
        at += whole
        yield piece[:whole].split()
