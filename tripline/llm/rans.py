"""Range asymmetric numeral system over token ids: one static table, independent interleaved blocks.

A block spreads its ids over lanes, id ``i`` in lane ``i mod lanes``, so that a
step codes one id of every lane with whole-array operations. At every
``checkpoint_steps`` steps the lane states and the place in the word stream are
recorded, so stretches of a block can be decoded by themselves.

Layout of a block, little-endian:
  magic 4 bytes, format u16, lanes u16, ids u32, documents u32, checkpoint_steps u32, checkpoints u32,
  words u32, crc32 of the table u32, crc32 of the ids as u32 u32;
  one u32 length per document; per checkpoint u32 word index and u64 state per lane;
  the words, u32 each; crc32 of all bytes before it, u32.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, FORMAT = b"TLRA", 1
#: Frequencies of a table add up to 2 to this power.
SCALE_BITS = 20
#: Lane states lie between 2**31 and 2**63.
LOW_BITS, WORD_BITS = 31, 32
MAX_LANES = 2048
IDS_PER_LANE = 64
CHECKPOINT_STEPS = 256
_HEAD = struct.Struct("<4sHHIIIIIII")


class Table:
    """Quantised frequencies of all ids that occur; every one of them gets at least one slot."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        self.ids = ids.astype(np.uint32)
        self.frequencies = frequencies.astype(np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(self.frequencies)[:-1])).astype(np.uint64)
        # The place of each id in the table; ids that are not in it get the place behind the last.
        self.places = np.full(int(self.ids[-1]) + 2 if len(self.ids) else 1, len(self.ids), dtype=np.uint32)
        self.places[self.ids] = np.arange(len(self.ids))
        self.checksum = zlib.crc32(self.ids.astype("<u4").tobytes() + self.frequencies.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        total = 1 << SCALE_BITS
        if len(ids) > total:
            raise ValueError(f"{len(ids)} different ids need more than {total} slots")
        if not len(ids):
            return cls(ids, counts)
        shares = counts / counts.sum() * (total - len(ids))
        slots = 1 + np.floor(shares).astype(np.int64)
        rest = total - int(slots.sum())
        slots[np.argsort(np.floor(shares) - shares, kind="stable")[:rest]] += 1
        return cls(ids, slots)

    def slot_symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.frequencies.astype(np.int64))


@dataclass(frozen=True)
class Block:
    lengths: np.ndarray
    ids: np.ndarray


def encode(ids: np.ndarray, lengths: np.ndarray, table: Table) -> bytes:
    """A block of the ids of whole documents; ``lengths`` has the number of ids of each."""
    count = len(ids)
    lanes = max(1, min(MAX_LANES, count // IDS_PER_LANE))
    symbols = table.places[np.minimum(ids, len(table.places) - 1)]
    if count and symbols.max() >= len(table.ids):
        raise ValueError("an id is not in the table")
    steps = -(-count // lanes)
    states = np.full(lanes, 1 << LOW_BITS, dtype=np.uint64)
    scale, word, mask = np.uint64(SCALE_BITS), np.uint64(WORD_BITS), np.uint64((1 << WORD_BITS) - 1)
    room = np.uint64(LOW_BITS - SCALE_BITS + WORD_BITS)
    emitted: list[np.ndarray] = [None] * steps
    saved: dict[int, np.ndarray] = {}
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(count, (step + 1) * lanes))
        part, symbol = states[: at.stop - at.start], symbols[at]
        frequency = table.frequencies[symbol]
        full = part >= frequency << room
        emitted[step] = (part[full] & mask).astype("<u4")
        part[full] >>= word
        quotient, rest = np.divmod(part, frequency)
        part[:] = (quotient << scale) + rest + table.starts[symbol]
        if step % CHECKPOINT_STEPS == 0:
            saved[step] = states.copy()
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in emitted]))).astype(np.int64)
    checkpoints = b"".join(
        struct.pack("<I", sizes[step]) + saved[step].astype("<u8").tobytes() for step in sorted(saved)
    )
    words = b"".join(x.tobytes() for x in emitted)
    head = _HEAD.pack(
        MAGIC, FORMAT, lanes, count, len(lengths), CHECKPOINT_STEPS, len(saved), len(words) // 4, table.checksum,
        zlib.crc32(ids.astype("<u4").tobytes()),
    )
    body = head + np.asarray(lengths, dtype="<u4").tobytes() + checkpoints + words
    return body + struct.pack("<I", zlib.crc32(body))


class Decoder:
    """Decodes blocks that were written with ``table``; raises ValueError for damaged ones."""

    def __init__(self, table: Table):
        self.table = table
        self._symbols = table.slot_symbols()

    def _open(self, data: bytes):
        if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged")
        magic, kind, lanes, count, documents, every, checkpoints, words, table, checksum = _HEAD.unpack_from(data)
        if magic != MAGIC or kind != FORMAT:
            raise ValueError("not a block of this format")
        if table != self.table.checksum:
            raise ValueError("block was written with another table")
        at = _HEAD.size
        lengths = np.frombuffer(data, "<u4", documents, at)
        at += 4 * documents
        saved = []
        for _ in range(checkpoints):
            saved.append((struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", lanes, at + 4)))
            at += 4 + 8 * lanes
        return lanes, count, every, lengths, saved, np.frombuffer(data, "<u4", words, at), checksum

    def stretch(self, data: bytes, number: int) -> np.ndarray:
        """The ids between one checkpoint and the next."""
        lanes, count, every, _, saved, words, _ = self._open(data)
        return self._from(saved[number], words, number * every * lanes, min(count, (number + 1) * every * lanes), lanes)

    def _from(self, checkpoint, words: np.ndarray, first: int, last: int, lanes: int) -> np.ndarray:
        position, states = checkpoint[0], checkpoint[1].astype(np.uint64)
        scale, word = np.uint64(SCALE_BITS), np.uint64(WORD_BITS)
        mask, low = np.uint64((1 << SCALE_BITS) - 1), np.uint64(1 << LOW_BITS)
        out = np.empty(last - first, dtype=np.uint32)
        for at in range(first, last, lanes):
            size = min(lanes, last - at)
            part = states[:size]
            slots = part & mask
            symbols = self._symbols[slots]
            out[at - first : at - first + size] = symbols
            part[:] = self.table.frequencies[symbols] * (part >> scale) + slots - self.table.starts[symbols]
            empty = part < low
            taken = int(empty.sum())
            part[empty] = (part[empty] << word) | words[position : position + taken]
            position += taken
        return self.table.ids[out] if len(out) else out

    def decode(self, data: bytes) -> Block:
        lanes, count, every, lengths, saved, words, checksum = self._open(data)
        parts = [
            self._from(saved[k], words, k * every * lanes, min(count, (k + 1) * every * lanes), lanes)
            for k in range(len(saved))
        ]
        ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
            raise ValueError("decoded ids do not match their checksum")
        return Block(lengths, ids)
