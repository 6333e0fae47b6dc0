"""Token ids in files, by a static range asymmetric numeral system.

All blocks share one frequency table.  A block holds the ids of up to
``BLOCK_TOKENS`` tokens in interleaved lanes with a state each, and is decoded
on its own: its entry in the file's index (the checkpoint) names its place, its
first token and a checksum, so blocks can be decoded in parallel.

File: magic, length of the head, head (JSON: table digest, base, counts), blocks,
index (JSON, compressed), length of the index, magic.  The index has a column for
documents too: id, number of tokens.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import zstandard

MAGIC = b"GMRANS1\n"
SCALE = 20
LANES = 8192
BLOCK_TOKENS = 1 << 20
_LOW = np.uint64(1 << 32)


class Table:
    """Shared frequencies that sum to 2^20; each id that occurs has one at least."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        if not counts.sum():
            counts = np.ones(max(1, min(len(counts), 2)), np.int64)
        seen = np.flatnonzero(counts)
        if len(seen) > 1 << SCALE:
            raise ValueError("more ids than frequencies")
        share = np.floor(counts[seen] * ((1 << SCALE) / counts.sum())).astype(np.int64)
        share = np.maximum(share, 1)
        extra = int(share.sum()) - (1 << SCALE)
        order = np.argsort(-share, kind="stable")
        k = 0
        while extra:
            i = order[k % len(order)]
            step = min(extra, int(share[i]) // 2) if extra > 0 else extra
            share[i] -= step
            extra -= step
            k += 1
        self.freq = np.zeros(len(counts), np.uint64)
        self.freq[seen] = share.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        narrow = np.uint16 if len(counts) <= 1 << 16 else np.uint32
        self.symbol = np.repeat(np.arange(len(counts), dtype=narrow), self.freq.astype(np.int64))

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(3).compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        freq = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")
        return cls(freq.astype(np.int64))

    def digest(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block: number of tokens and lanes, the lanes' final states, the words in the order of decoding."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    rows = -(-n // lanes)
    freq, start = table.freq, table.start
    state = np.full(lanes, 1 << 32, np.uint64)
    words: list[np.ndarray] = []
    shift, low, scale = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(SCALE)
    top = np.uint64(64 - SCALE)
    for r in range(rows - 1, -1, -1):
        row = ids[r * lanes : (r + 1) * lanes]
        x = state[: len(row)]
        f = freq[row]
        full = x >= (f << top) if len(freq) > 1 else np.zeros(len(row), bool)
        full &= f < np.uint64(1 << SCALE)
        if full.any():
            words.append((x[full] & low).astype("<u4"))
            x = np.where(full, x >> shift, x)
        q = x // f
        state[: len(row)] = (q << scale) + (x - q * f) + start[row]
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    return struct.pack("<II", n, lanes) + state.astype("<u8").tobytes() + stream.tobytes()


def decode_block(data: bytes, table: Table) -> np.ndarray:
    n, lanes = struct.unpack_from("<II", data)
    state = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", -1, 8 + 8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    at = 0
    for r in range(0, n, lanes):
        x = state[: min(lanes, n - r)]
        slot = x & mask
        row = table.symbol[slot]
        out[r : r + len(row)] = row
        f = table.freq[row]
        x = f * (x >> scale) + slot - table.start[row]
        need = (x < _LOW) & (f < np.uint64(1 << SCALE))
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << shift) | stream[at : at + k]
            at += k
        state[: len(row)] = x
    if at != len(stream):
        raise ValueError("a block has words left over")
    return out


class Writer:
    """Writes one file; documents come in order, blocks end where they must."""

    def __init__(self, out, table: Table, base: int, block_tokens: int = BLOCK_TOKENS):
        self.out, self.table, self.base, self.block_tokens = out, table, base, block_tokens
        self.pending: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.docs: list[tuple] = []
        self.blocks: list[tuple] = []
        head = json.dumps({"table": table.digest(), "base": base}).encode()
        first = MAGIC + struct.pack("<I", len(head)) + head
        self.out.write(first)
        self.at = len(first)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block_tokens:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        at = 0
        while len(flat) - at >= self.block_tokens or (last and at < len(flat)):
            ids = flat[at : at + self.block_tokens]
            data = encode_block(ids, self.table)
            self.blocks.append((self.at, len(data), self.tokens, len(ids), zlib.crc32(data)))
            self.out.write(data)
            self.at += len(data)
            self.tokens += len(ids)
            at += len(ids)
        self.pending, self.held = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(True)
        index = zstandard.ZstdCompressor(3).compress(json.dumps({"blocks": self.blocks, "docs": self.docs}).encode())
        self.out.write(index + struct.pack("<I", len(index)) + MAGIC)
        self.out.close()


class Reader:
    """Random access to the blocks of one file, which is opened for seeking."""

    def __init__(self, stream, size: int, table: Table):
        self.stream, self.table = stream, table
        if size < 2 * len(MAGIC) + 8 or self._at(0, len(MAGIC)) != MAGIC or self._at(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("no token file, or one that isn't whole")
        (n,) = struct.unpack("<I", self._at(len(MAGIC), 4))
        head = json.loads(self._at(len(MAGIC) + 4, n))
        if head["table"] != table.digest():
            raise ValueError("the file was written with another table")
        self.base = head["base"]
        (n,) = struct.unpack("<I", self._at(size - len(MAGIC) - 4, 4))
        index = json.loads(zstandard.ZstdDecompressor().decompress(self._at(size - len(MAGIC) - 4 - n, n)))
        self.blocks, self.docs = index["blocks"], index["docs"]

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def block(self, k: int) -> np.ndarray:
        at, size, _, n, check = self.blocks[k]
        data = self._at(at, size)
        if zlib.crc32(data) != check:
            raise ValueError(f"block {k} is damaged")
        ids = decode_block(data, self.table)
        if len(ids) != n:
            raise ValueError(f"block {k} has {len(ids)} tokens instead of {n}")
        return ids

    def documents(self, first: int = 0, last: int | None = None):
        """(doc_id, start, ids) of each document that begins in the blocks from ``first`` up to ``last``, in order.

        Holds one block and one document.  Documents without tokens belong to
        the block before which they stand, or to the last one.
        """
        sizes = np.array([n for _, n in self.docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        begins = np.array([b[2] for b in self.blocks] or [0], np.int64)
        of = np.clip(np.searchsorted(begins, starts, "right") - 1, 0, len(begins) - 1)
        lo, hi = np.searchsorted(of, [first, len(begins) if last is None else max(last, 1)])
        k, held, at = first, np.empty(0, np.uint32), 0
        if lo < hi and self.blocks:
            k = int(of[lo])
            held, at, k = self.block(k), int(starts[lo] - begins[k]), k + 1
        for doc_id, n in self.docs[lo:hi]:
            start, parts, need = self.base + int(starts[lo]), [], n
            while need:
                if at == len(held):
                    held, at, k = self.block(k), 0, k + 1
                piece = held[at : at + need]
                parts.append(piece)
                at += len(piece)
                need -= len(piece)
            yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.uint32)])
            lo += 1
