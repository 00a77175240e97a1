"""A file of token ids as planes: blocks of ids, transposed, each plane compressed.

Layout, little-endian:

    b"IDPLANE1"
    blocks: the compressed planes of one block after the other
    index:  per block  u64 offset, u64 first id's number, u32 ids, u32 size of each plane
    docs:   zstd of i64 doc ids, u8 null marks, u64 id counts, one of each per document
    footer: u64 index offset, u64 blocks, u64 docs offset, u64 docs, u64 ids, u32 planes, b"IDPLANE1"

With 4 planes a plane holds one byte of each id, with 32 one bit of each. A plane of
zeros has size 0. A reader needs the footer and the index to reach any block.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
_FOOTER = struct.Struct("<QQQQQI8s")
_KINDS = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, planes: int) -> np.ndarray:
    """Rows of bytes, one per plane."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return np.ascontiguousarray(octets.T)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def from_planes(rows: np.ndarray, n: int) -> np.ndarray:
    if len(rows) == 4:
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes ids to a binary stream; keeps one block and 17 bytes per document."""

    def __init__(self, out, kind: str = "byte", level: int = 3):
        self.out, self.planes = out, _KINDS[kind]
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.offset, self.ids, self.blocks, self.docs = 0, 0, [], []
        self.waiting, self.held = [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            held = np.concatenate(self.waiting)
            full = len(held) - len(held) % BLOCK
            for start in range(0, full, BLOCK):
                self._block(held[start : start + BLOCK])
            self.waiting, self.held = [held[full:]], len(held) - full

    def _block(self, ids: np.ndarray) -> None:
        offset = self.offset
        packed = [self.pack(r.tobytes()) if r.any() else b"" for r in to_planes(ids, self.planes)]
        self.blocks.append(
            struct.pack(f"<QQI{self.planes}I", offset, self.ids, len(ids), *map(len, packed))
        )
        for data in packed:
            self._put(data)
        self.ids += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = self.offset
        self._put(b"".join(self.blocks))
        docs = self.offset
        table = (
            np.array([d[0] for d in self.docs], "<i8").tobytes()
            + np.array([d[1] for d in self.docs], "u1").tobytes()
            + np.array([d[2] for d in self.docs], "<u8").tobytes()
        )
        self._put(self.pack(table))
        self._put(
            _FOOTER.pack(
                index, len(self.blocks), docs, len(self.docs), self.ids, self.planes, MAGIC
            )
        )


class Reader:
    """Reads a file that can be sought in."""

    def __init__(self, source):
        self.source = source
        end = source.size() - _FOOTER.size
        index, n_blocks, docs, n_docs, self.ids, self.planes, magic = _FOOTER.unpack(
            self._at(end, _FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        entry = struct.Struct(f"<QQI{self.planes}I")
        self.blocks = list(entry.iter_unpack(self._at(index, n_blocks * entry.size)))
        self.unpack = zstandard.ZstdDecompressor()
        table = self.unpack.decompress(
            self._at(docs, end - docs), max_output_size=17 * n_docs
        ) if n_docs else b""
        self.doc_ids = np.frombuffer(table, "<i8", n_docs)
        self.doc_null = np.frombuffer(table, "u1", n_docs, 8 * n_docs).astype(bool)
        self.doc_sizes = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        offset, _, n, *sizes = self.blocks[k]
        data, at = self._at(offset, sum(sizes)), 0
        rows = np.zeros((self.planes, n if self.planes == 4 else -(-n // 8)), np.uint8)
        for row, size in zip(rows, sizes, strict=True):
            if size:
                row[:] = np.frombuffer(
                    self.unpack.decompress(data[at : at + size], max_output_size=len(row)), np.uint8
                )
            at += size
        return from_planes(rows, n)

    def read(self, start: int, count: int) -> np.ndarray:
        """Some ids by their numbers in the file; reads only the blocks that hold them."""
        parts = [
            self.block(k)[max(0, start - b[1]) : max(0, start + count - b[1])]
            for k, b in enumerate(self.blocks)
            if b[1] < start + count and b[1] + b[2] > start
        ]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def documents(self):
        """Yield (row, pieces of its ids) for each document, one block in memory."""
        k, rest = 0, np.empty(0, "<u4")

        def pieces(size):
            nonlocal k, rest
            while size:
                if not len(rest):
                    rest, k = self.block(k), k + 1
                part, rest = rest[:size], rest[size:]
                size -= len(part)
                yield part

        for row, size in enumerate(self.doc_sizes.tolist()):
            yield row, pieces(size)
