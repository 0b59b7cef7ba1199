"""Token ids as a binary corpus: static range asymmetric numeral system (range ANS).

One shared frequency table codes all blocks. A block holds whole documents, is coded by ``LANES``
interleaved states and decodes alone; checkpoints inside it (word offset and all states every
``CHECKPOINT`` rows of symbols) let it be decoded in parallel pieces. Its layout, little-endian:

====================  =====================================================================
magic                 4 bytes ``RNS1``
header                u32 x 6: symbols, lanes, rows, documents, checkpoints, words
first id              i64: corpus position of the block's first symbol
crc                   u32: crc32 of all ids as unsigned 32-bit integers
states                u64 x lanes: decoder states before row 0
checkpoints           (u32 word offset, u64 x lanes states) for rows CHECKPOINT, 2*CHECKPOINT ...
documents             u32 x documents: symbols of each
words                 u32 x words
====================  =====================================================================
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, LANES, CHECKPOINT, BITS = b"RNS1", 4096, 64, 18
_LOW = np.uint64(1 << 31)
_32, _M32 = np.uint64(32), np.uint64(0xFFFFFFFF)


@dataclass
class Table:
    """Frequencies that add up to 2**BITS; symbols that never occur have none."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.bound = self.freq << np.uint64(63 - BITS)

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        """Scale counts to 2**BITS, at least 1 for what occurs. Nothing counted: symbol 0 has all."""
        counts = np.asarray(counts, np.float64)
        if not counts.any():
            counts = np.ones(1)
        room = (1 << BITS) - int((counts > 0).sum())
        if room < 0:
            raise ValueError("too many symbols for the table")
        exact = counts / counts.sum() * room
        freq = np.floor(exact).astype(np.int64) + (counts > 0)
        rest = (1 << BITS) - int(freq.sum())
        freq[np.argsort(-(exact - np.floor(exact)), kind="stable")[:rest]] += 1
        if counts.size and (freq[counts == 0] > 0).any():  # the remainders of what never occurs are zero and come last
            spare = int(freq[counts == 0].sum())
            freq[counts == 0] = 0
            freq[int(counts.argmax())] += spare
        return Table(freq)


def encode(ids: np.ndarray, sizes: np.ndarray, first: int, table: Table) -> bytes:
    """One block of whole documents; ``sizes`` are the symbols of each."""
    n = len(ids)
    rows = -(-n // LANES)
    mask = np.uint64(BITS)
    x = np.full(LANES, _LOW, np.uint64)
    words, marks = [], {}
    for row in range(rows - 1, -1, -1):
        s = ids[row * LANES : (row + 1) * LANES]
        y = x[: len(s)]
        f = table.freq[s]
        over = y >= table.bound[s]
        words.append((y[over] & _M32).astype(np.uint32))
        y = np.where(over, y >> _32, y)
        q = y // f
        x[: len(s)] = (q << mask) + (y - q * f) + table.start[s]
        if row and row % CHECKPOINT == 0:
            marks[row] = (len(words), x.copy())
    words.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64) if rows else np.zeros(1, np.int64)
    flat = np.concatenate(words) if rows else np.zeros(0, np.uint32)
    points = b"".join(struct.pack("<I", int(at[row])) + marks[row][1].astype("<u8").tobytes() for row in sorted(marks))
    head = struct.pack("<4s6IqI", MAGIC, n, LANES, rows, len(sizes), len(marks), len(flat), first, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + x.astype("<u8").tobytes() + points + sizes.astype("<u4").tobytes() + flat.astype("<u4").tobytes()


_HEAD = struct.calcsize("<4s6IqI")


@dataclass
class Block:
    """A parsed block; ``decode`` gives its ids, or those of the rows from one checkpoint to the next."""

    first: int
    n: int
    crc: int
    sizes: np.ndarray
    rows: int
    points: list[tuple[int, np.ndarray]]
    words: np.ndarray

    @staticmethod
    def parse(data: bytes) -> Block:
        magic, n, lanes, rows, docs, points, words, first, crc = struct.unpack_from("<4s6IqI", data)
        if magic != MAGIC or lanes != LANES:
            raise ValueError("not a block of this format")
        at = _HEAD
        found = [(0, np.frombuffer(data, "<u8", lanes, at).astype(np.uint64))]
        at += 8 * lanes
        for _ in range(points):
            (offset,) = struct.unpack_from("<I", data, at)
            found.append((offset, np.frombuffer(data, "<u8", lanes, at + 4).astype(np.uint64)))
            at += 4 + 8 * lanes
        sizes = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        flat = np.frombuffer(data, "<u4", words, at + 4 * docs)
        return Block(first, n, crc, sizes, rows, found, flat)

    def piece(self, k: int, table: Table) -> np.ndarray:
        """The ids from checkpoint ``k`` to the next; pieces need nothing of each other."""
        offset, x = self.points[k]
        x = x.copy()
        low, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
        last = self.rows if k + 1 == len(self.points) else (k + 1) * CHECKPOINT
        out = []
        for row in range(k * CHECKPOINT, last):
            y = x[: min(LANES, self.n - row * LANES)]
            slot = y & low
            s = table.symbol[slot]
            y = table.freq[s] * (y >> bits) + slot - table.start[s]
            short = np.flatnonzero(y < _LOW)
            y[short] = (y[short] << _32) | self.words[offset : offset + len(short)]
            offset += len(short)
            x[: len(y)] = y
            out.append(s)
        if last == self.rows and ((x != _LOW).any() or offset != len(self.words)):
            raise ValueError("the block's states do not come back to where coding began")
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, table: Table) -> np.ndarray:
        ids = np.concatenate([self.piece(k, table) for k in range(len(self.points))])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError("the block's checksum differs")
        return ids
