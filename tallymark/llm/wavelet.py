"""Token ids in files that hold one wavelet matrix each.

A wavelet matrix stores a sequence of numbers as bit planes, highest bit first;
after each plane the numbers are stably parted by that bit, zeros first. With
counts of ones up to each block of a plane, the id at a place, the number of
times an id occurs before a place, and the place of its k-th occurrence follow
from a few looks at each plane. Planes and counts are stored in blocks that are
compressed one by one, so a look reads one block and not the file.

File: magic, header length (4 bytes), header as JSON, documents table, blocks.
"""

from __future__ import annotations

import json
import zlib

import numpy as np

MAGIC = b"WAVM0001"
BLOCK_BITS = 1 << 19  # bits of a plane in one compressed block
RANK_BITS = 512  # a count of ones is kept for each so many bits

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def write(stream, ids: np.ndarray, documents: bytes) -> None:
    """``documents``: a table about the sequence, kept compressed and given back as it is."""
    size = len(ids)
    depth = max(1, int(ids.max()).bit_length() if size else 1)
    kind = np.uint16 if depth <= 16 else np.uint32
    values = ids.astype(kind)
    zeros, blocks = [], []
    for level in range(depth - 1, -1, -1):
        bit = ((values >> kind(level)) & kind(1)).astype(bool)
        zeros.append(int(size - np.count_nonzero(bit)))
        packed = np.packbits(bit, bitorder="little")
        ones = 0
        for at in range(0, max(size, 1), BLOCK_BITS):
            part = packed[at // 8 : (at + BLOCK_BITS) // 8]
            padded = np.zeros(-(-len(part) * 8 // RANK_BITS) * RANK_BITS // 8, np.uint8)
            padded[: len(part)] = part
            counts = _ONES[padded].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.zeros(0, "<u4")
            blocks.append((ones, zlib.compress(before.tobytes() + part.tobytes(), 1)))
            ones += int(counts.sum())
        # by places: taking by a mask is slow where its bits come at random
        values = np.concatenate([np.compress(~bit, values), np.compress(bit, values)])
    table = zlib.compress(documents, 1)
    header = json.dumps({
        "size": size, "depth": depth, "zeros": zeros, "documents": len(table), "ones": [b[0] for b in blocks],
        "blocks": [len(b[1]) for b in blocks],
    }).encode()
    stream.write(MAGIC + len(header).to_bytes(4, "little") + header + table)
    for _, block in blocks:
        stream.write(block)


class WaveletMatrix:
    """Reads a file; ``source`` is anything with read() and seek()."""

    def __init__(self, source, kept_blocks: int = 64):
        self.source = source
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        length = int.from_bytes(source.read(4), "little")
        header = json.loads(source.read(length))
        self.size, self.depth, self.zeros = header["size"], header["depth"], header["zeros"]
        self.ones = header["ones"]
        table = len(MAGIC) + 4 + length
        self.documents = zlib.decompress(source.read(header["documents"]))
        self.lengths = header["blocks"]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]) + table + header["documents"]
        self.per_plane = -(-max(self.size, 1) // BLOCK_BITS)
        self.kept, self.most = {}, kept_blocks

    def _block(self, number: int):
        """(ones before each rank block, bits) of a compressed block."""
        if number not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))
            self.source.seek(int(self.starts[number]))
            raw = zlib.decompress(self.source.read(self.lengths[number]))
            bits = min(BLOCK_BITS, self.size - number % self.per_plane * BLOCK_BITS)
            counts = -(-(-(-bits // 8)) * 8 // RANK_BITS)
            self.kept[number] = np.frombuffer(raw, "<u4", counts), np.frombuffer(raw, np.uint8, offset=4 * counts)
        return self.kept[number]

    def _bit(self, plane: int, place: int) -> int:
        _, bits = self._block(plane * self.per_plane + place // BLOCK_BITS)
        at = place % BLOCK_BITS
        return int(bits[at >> 3] >> (at & 7)) & 1

    def _ones_before(self, plane: int, place: int) -> int:
        if place >= self.size:
            return self.size - self.zeros[plane]
        number = plane * self.per_plane + place // BLOCK_BITS
        before, bits = self._block(number)
        at = place % BLOCK_BITS
        first = at // RANK_BITS * RANK_BITS
        whole = int(_ONES[bits[first >> 3 : at >> 3]].sum())
        part = bin(int(bits[at >> 3]) & ((1 << (at & 7)) - 1)).count("1") if at & 7 else 0
        return self.ones[number] + int(before[at // RANK_BITS]) + whole + part

    def access(self, place: int) -> int:
        """The id at ``place``."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for plane in range(self.depth):
            bit = self._bit(plane, place)
            ones = self._ones_before(plane, place)
            place = self.zeros[plane] + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, place: int) -> int:
        """How often ``value`` occurs before ``place``."""
        low, high = self._range(value, min(place, self.size))
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def _range(self, value: int, place: int) -> tuple[int, int]:
        if value < 0 or value >> self.depth:
            return 0, 0
        low, high = 0, place
        for plane in range(self.depth):
            ones = self._ones_before(plane, low), self._ones_before(plane, high)
            if value >> (self.depth - 1 - plane) & 1:
                low, high = self.zeros[plane] + ones[0], self.zeros[plane] + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def select(self, value: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``value``."""
        low, high = self._range(value, self.size)
        if not 0 <= k < high - low:
            raise IndexError(k)
        place = low + k
        for plane in range(self.depth - 1, -1, -1):
            one = value >> (self.depth - 1 - plane) & 1
            place = self._select_bit(plane, one, place - self.zeros[plane] if one else place)
        return place

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The place of the bit of this value that has ``k`` equal ones before it."""
        low, high = 0, self.size
        while high - low > 1:
            middle = (low + high) // 2
            ones = self._ones_before(plane, middle)
            if (ones if bit else middle - ones) <= k:
                low = middle
            else:
                high = middle
        return low

    def occurrences(self, value: int):
        """All places of ``value``, in order."""
        return (self.select(value, k) for k in range(self.count(value)))

    def all(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        values = np.zeros(self.size, kind)
        if not self.size:
            return values
        for plane in range(self.depth - 1, -1, -1):
            parts = [self._block(plane * self.per_plane + b)[1] for b in range(self.per_plane)]
            bit = np.unpackbits(np.concatenate(parts), count=self.size, bitorder="little").astype(bool)
            order = np.empty(self.size, kind)
            order[np.flatnonzero(~bit)] = values[: self.zeros[plane]]
            order[np.flatnonzero(bit)] = values[self.zeros[plane] :] | kind(1 << (self.depth - 1 - plane))
            values = order
        return values
