"""Words of texts, as DataFrame expressions and as arrays of word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# The white space that separates words, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def column_words(text: Column) -> Column:
    """Words of a text as an array; none for a missing text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


# Odd multipliers for hashes modulo 2**64; any odd numbers with mixed bits will do.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_ROOT, _ROOT_INVERSE = _MIX[0], np.uint64(pow(int(_MIX[0]), -1, 2**64))
BLOCK = 1 << 19  # bytes or words whose hashes are made at once
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < size:
        for i, root in enumerate((_ROOT, _ROOT_INVERSE)):
            steps = np.full(size, root, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def chunks(texts, lower: bool, size: int = 1 << 18):
    """Runs of texts (a list or an Arrow array) of about ``size`` bytes, or one text if it is longer.

    Yields (first, word hashes, offsets): the words of text ``first + i`` are
    ``hashes[offsets[i]:offsets[i + 1]]``, a missing text has none. Equal words
    have equal hashes in every task and session.
    """
    first, held, parts = 0, 0, []
    for i, text in enumerate(one_by_one(texts)):
        part = (text or "").encode()
        if parts and held + len(part) > size:
            yield first, *_hashes(parts, lower)
            first, held, parts = i, 0, []
        parts.append(part)
        held += len(part) + 1
    if parts:
        yield first, *_hashes(parts, lower)


def one_by_one(texts):
    """The texts of a list or an Arrow array, of which few are Python's at a time."""
    return texts if isinstance(texts, list) else (t.as_py() for t in texts)


def _hashes(parts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all parts and where each part's begin.

    The bytes are taken in blocks, so that memory beside the texts and hashes does not grow with a text.
    A word that a block's end cuts is carried on: its sum so far, times no power, and the next block's
    times the power of the bytes before it.
    """
    joined = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    ends_of_texts = np.cumsum([len(p) + 1 for p in parts])
    up, down = _powers(min(len(raw), BLOCK) + 1)
    hashes, places = [], []
    begun, before = 0, None
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        space = np.ones(len(part) + 2, bool)
        space[1:-1] = _IS_SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=total[1:])
        sums = (total[ends] - total[starts]) * down[starts]
        starts, ends = starts + at, ends + at
        if before is not None:
            if space[1]:
                sums, starts, ends = (np.concatenate(x) for x in ((before, sums), ([begun], starts), ([at], ends)))
            else:
                sums[:1] = before + sums[:1] * np.uint64(pow(int(_ROOT), at - begun, 2**64))
                starts[0] = begun
            before = None
        if not space[-2]:  # never at the end of all bytes, which is white space
            begun, before = int(starts[-1]), sums[-1:]
            sums, starts, ends = sums[:-1], starts[:-1], ends[:-1]
        hashes.append(mix(sums + (ends - starts).astype(np.uint64)))
        places.append(starts)
    starts = np.concatenate(places)
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, in order; none if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    up, down = _powers(min(n, BLOCK) + size)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[at : at + BLOCK] = mix((total[size:] - total[:-size]) * down[: len(part) - size + 1])
    return out
