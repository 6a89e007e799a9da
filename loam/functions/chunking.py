"""Texts cut into chunks at paragraph and sentence ends, with their places in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

LIMIT, OVERLAP, LEAST = 150, 1, 300
# Where a sentence and a paragraph end.
SENTENCE_END = re.compile(r"(?<=[.!?\u3002\uff01\uff1f\n])\s+(?=[A-Z\u00c0-\u1ef8\u0110a-z\u00e0-\u1ef9\u01110-9])")
PARAGRAPH_END = re.compile(r"\n\n+")

Chunk = tuple[int, str, int, int, int]  # number, text, start, stop, words
Piece = tuple[str, int, int]  # text, start, stop


def _parts(text: str, start: int, end: re.Pattern) -> Iterator[Piece]:
    """The non-blank parts between ends, without outer white space; ``start`` is where the text begins."""
    at = 0
    for a, b in [*(m.span() for m in end.finditer(text)), (len(text), len(text))]:
        part = text[at:a]
        if own := part.strip():
            begin = start + at + part.index(own)
            yield own, begin, begin + len(own)
        at = b


def _tail(pieces: list[Piece], overlap: int) -> list[Piece]:
    """The last sentences of pieces joined by a space, as one piece."""
    joined = " ".join(p[0] for p in pieces)
    sentences = list(_parts(joined, 0, SENTENCE_END))
    if not overlap or not sentences:
        return []
    begin = sentences[-min(overlap, len(sentences))][1]
    at = 0
    for text, start, _ in pieces:
        if begin <= at + len(text):
            return [(joined[begin:], start + max(0, begin - at), pieces[-1][2])]
        at += len(text) + 1
    return []


def chunks_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[Chunk]:
    """Chunks of at most ``limit`` words, beside the sentences that each repeats from the one before.

    A text of fewer than ``least`` words is one chunk. Paragraphs are packed whole; one that is longer than a chunk is packed
    by sentences, from a new chunk on. A longer sentence stays whole.
    """
    words = len(text.split())
    if words < least:
        yield 0, text.strip(), 0, len(text), words
        return
    held: list[Piece] = []
    n = number = 0
    fresh = False  # does ``held`` have more than what is repeated?

    def flush() -> Iterator[Chunk]:
        nonlocal held, n, number, fresh
        if fresh:
            joined = " ".join(p[0] for p in held)
            yield number, joined, held[0][1], held[-1][2], len(joined.split())
            number, held, fresh = number + 1, _tail(held, overlap), False
            n = sum(len(p[0].split()) for p in held)

    for paragraph, start, stop in _parts(text, 0, PARAGRAPH_END):
        units = [(paragraph, start, stop)]
        if len(paragraph.split()) > limit:
            yield from flush()
            units = list(_parts(paragraph, start, SENTENCE_END))
        for unit in units:
            size = len(unit[0].split())
            if n + size > limit:
                yield from flush()
                n = 0  # what is repeated isn't counted against a chunk that it would fill
            held.append(unit)
            n, fresh = n + size, True
    yield from flush()
