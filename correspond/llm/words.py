"""Words of many texts at once: texts are joined, one regex pass finds all words, and offsets tell whose they are."""

import re
from collections.abc import Iterable, Iterator

import numpy as np

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Bytes of text that are joined; a longer text is cut between words.
JOINED = 4 << 20


def _pieces(texts: Iterable[bytes | None], most: int, overlap: int) -> Iterator[tuple[int, bytes, int]]:
    """(row, piece of its text in lower case, words at its beginning that the piece before has too)."""
    for row, text in enumerate(texts):
        text, at, again = (text or b"").lower(), 0, 0
        while len(text) - at > most:
            end, span = at + most, most
            while True:
                end = m.end() if _IN_WORD[text[end - 1]] and (m := _WORD.match(text, end)) else end
                last = [m.start() for m in _WORD.finditer(text, at, end)][-overlap:] if overlap else []
                if end == len(text) or not last or last[0] > at:
                    break
                end, span = min(len(text), end + span), 2 * span
            if end == len(text):
                break
            yield row, text[at:end], again
            at, again = (last[0] if last else end), len(last)
        yield row, text[at:], again


def word_blocks(texts: Iterable[bytes | None], most: int = JOINED, overlap: int = 0) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """UTF-8 texts -> blocks of (words, piece of each word, row of each piece, repeated words at the beginning of each piece).

    Words are the runs of ASCII letters (lower-cased), digits and characters beyond
    ASCII. A text of over `most` bytes comes in pieces, each of which begins with the
    last `overlap` words of the one before.
    """
    held, size = [], 0
    for piece in _pieces(texts, most, overlap):
        held.append(piece)
        size += len(piece[1]) + 1
        if size > most:
            yield _found(held)
            held, size = [], 0
    if held:
        yield _found(held)


def _found(held: list[tuple[int, bytes, int]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    joined = b"\0".join(p[1] for p in held)
    inside = _IN_WORD[np.frombuffer(joined, np.uint8)]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    begins = np.cumsum([0, *(len(p[1]) + 1 for p in held[:-1])])
    return _WORD.findall(joined), np.searchsorted(begins, starts, side="right") - 1, np.array([p[0] for p in held]), np.array([p[2] for p in held])
