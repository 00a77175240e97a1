"""Seekable Zstandard bundles of WARC records.

A bundle is a row of independent frames, each some records of WARC/1.1, and two
skippable frames that any Zstandard reader passes over: the record map (for each
record its identifier, frame, offset in the frame and length) and, as the last thing
in the file, the seek table of Zstandard's seekable format. Read from its end, a
bundle gives any record at the price of one frame.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import zstandard

FRAME_BYTES = 1 << 18
_SKIPPABLE = struct.Struct("<II")
_MAP_MAGIC, _SEEK_MAGIC, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_SEEK_FOOTER = struct.Struct("<IBI")
_MAP_ENTRY = np.dtype(
    [("id", "<i8"), ("none", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")]
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    value = urn.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def record(
    page_id: int | None,
    url: str | None,
    date: str,
    digest: str,
    size: int,
    payload: bytes | None,
    refers_to: int | None = None,
) -> bytes:
    """A response with its payload, or, without one, a revisit of another record."""
    block = b"" if payload is None else _HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
    ]
    if url:
        # a line break in a header would end it
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if payload is None:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _REVISIT)]
    else:
        fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    block, payload = rest[: int(fields["Content-Length"])], None
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _id_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _id_of(fields["WARC-Refers-To"]) if payload is None else None,
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
    }


class Writer:
    """Writes records to a binary stream; keeps one frame and 29 bytes per record."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.written, self.frames, self.map = 0, [], []
        self.waiting, self.held = [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        self.map.append((page_id or 0, page_id is None, len(self.frames), self.held, len(data)))
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        packed = self.pack(b"".join(self.waiting))
        self.frames.append((len(packed), self.held))
        self._put(packed)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        entries = self.pack(np.array(self.map, _MAP_ENTRY).tobytes())
        body = struct.pack("<Q", len(self.map)) + entries
        self._put(_SKIPPABLE.pack(_MAP_MAGIC, len(body)) + body)
        map_size = _SKIPPABLE.size + len(body)
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        # the map is a frame of the file too, one without content
        table += struct.pack("<II", map_size, 0)
        size = len(table) + _SEEK_FOOTER.size
        footer = _SEEK_FOOTER.pack(len(self.frames) + 1, 0, _SEEK_END)
        self._put(_SKIPPABLE.pack(_SEEK_MAGIC, size) + table + footer)


class Reader:
    """Reads a bundle that can be sought in."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.size()
        frames, _, magic = _SEEK_FOOTER.unpack(self._at(end - _SEEK_FOOTER.size, _SEEK_FOOTER.size))
        if magic != _SEEK_END:
            raise ValueError("no seek table")
        start = end - _SEEK_FOOTER.size - 8 * frames
        *table, (map_size, _) = struct.iter_unpack("<II", self._at(start, 8 * frames))
        self.sizes = table
        self.offsets = np.concatenate(([0], np.cumsum([a for a, _ in table]))).astype(int).tolist()
        body = self._at(self.offsets[-1] + _SKIPPABLE.size, map_size - _SKIPPABLE.size)
        (records,) = struct.unpack_from("<Q", body)
        entries = self.unpack.decompress(body[8:], max_output_size=records * _MAP_ENTRY.itemsize)
        self.map = np.frombuffer(entries, _MAP_ENTRY, records)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return self.unpack.decompress(self._at(self.offsets[k], packed), max_output_size=size)

    def record(self, page_id: int | None) -> dict:
        """The first record of an identifier, from its frame alone."""
        wanted = (self.map["none"] == (page_id is None)) & (self.map["id"] == (page_id or 0))
        if not wanted.any():
            raise KeyError(page_id)
        at = self.map[np.argmax(wanted)]
        return parse(self.frame(at["frame"])[at["offset"] : at["offset"] + at["length"]])

    def records(self):
        """All records in order, one frame in memory."""
        for k in range(len(self.sizes)):
            data = self.frame(k)
            here = self.map[self.map["frame"] == k]
            for at, size in zip(here["offset"].tolist(), here["length"].tolist(), strict=True):
                yield parse(data[at : at + size])
