"""Deletion vectors and Puffin files as the queries and tests write them."""

from __future__ import annotations

import json
import struct
import zlib


def roaring(positions: list[int]) -> bytes:
    """A 64-bit roaring bitmap: run containers for unbroken spans, bitsets for over 4096 positions, arrays for the rest."""
    groups: dict[int, list[int]] = {}
    for p in sorted(positions):
        groups.setdefault(p >> 16, []).append(p & 0xFFFF)
    heads, bodies, flags = b"", b"", 0
    for i, (key, low) in enumerate(groups.items()):
        heads += struct.pack("<HH", key, len(low) - 1)
        if low[-1] - low[0] == len(low) - 1:
            flags |= 1 << i
            bodies += struct.pack("<HHH", 1, low[0], len(low) - 1)
        elif len(low) > 4096:
            bodies += sum(1 << v for v in low).to_bytes(8192, "little")
        else:
            bodies += struct.pack(f"<{len(low)}H", *low)
    n = len(groups)
    cookie = struct.pack("<I", 12347 | (n - 1) << 16) + flags.to_bytes((n + 7) // 8, "little")
    offsets = b"\0" * 4 * n if n >= 4 else b""
    body = b"\xd1\xd3\x39\x64" + struct.pack("<QI", 1, 0) + cookie + heads + offsets + bodies
    return len(body).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")


def puffin(vectors: dict[str, list[int]]) -> bytes:
    out, blobs = bytearray(b"PFA1"), []
    for name, positions in vectors.items():
        blob = roaring(positions)
        where = {"offset": len(out), "length": len(blob), "snapshot-id": 1, "sequence-number": 1, "fields": []}
        blobs.append({"type": "deletion-vector-v1", **where, "properties": {"referenced-data-file": name, "cardinality": str(len(positions))}})
        out += blob
    footer = json.dumps({"blobs": blobs}).encode()
    return bytes(out) + b"PFA1" + footer + struct.pack("<iI", len(footer), 0) + b"PFA1"
