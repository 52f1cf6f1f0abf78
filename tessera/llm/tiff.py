"""TIFF as a media column: pack bytes into TIFF, walk image directories, and read every page back.

The reader handles both byte orders, strips and tiles, no compression, PackBits, LZW and deflate,
the horizontal predictor, samples of 1, 2, 4, 8 and 16 bits (chunky or planar) and chains of directories; one row
per page. Samples of up to 8 bits come out as a byte each, those of 16 bits as two (little-endian).

Sizes in a file are not trusted: a page of over ``MOST_BYTES`` is an error before anything is allocated, and a
strip is unpacked to its own size at most.

The query stores every text by a codec, predictor, layout, number of pages and byte order that its digest chooses
(``layout_of``), so all of them occur.

Cases: null media gives no row; a broken page gives one row with the error and no samples, the pages around it
are read; broken media give one such row; an empty table gives no rows; equal bytes give equal values; a null text
is an empty payload; columns of any name are kept (where one has the name of ours, ours has a number after it)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    compression: int
    data: bytes


#: Most bytes of samples in a page.
MOST_BYTES = 1 << 28


def packbits_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Most significant bit first, codes widen one early; stops once there are ``most`` bytes."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, previous = list(first), 9, [], None
    bits = held = made = 0
    for byte in data:
        if made >= most:
            break
        held = (held << 8) | byte
        bits += 8
        while bits >= width:
            bits -= width
            code = (held >> bits) & ((1 << width) - 1)
            held &= (1 << bits) - 1
            if code == 256:
                table, width, previous = list(first), 9, None
                continue
            if code == 257:
                return b"".join(out)
            if previous is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code out of range")
                entry = table[code] if code < len(table) else previous + previous[:1]
                if len(table) < 4096:
                    table.append(previous + entry[:1])
            out.append(entry)
            made += len(entry)
            previous = entry
            size = len(table) + 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table = {bytes([i]): i for i in range(256)}
    following, width, w = 258, 9, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        codes.append((table[w], width))
        table[w + c] = following
        following += 1
        if following == 4094:
            codes.append((256, width))
            table = {bytes([k]): k for k in range(256)}
            following, width = 258, 9
        else:
            width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        w = c
    if w:
        codes.append((table[w], width))
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    codes.append((257, width))
    value = bits = 0
    out = bytearray()
    for code, n in codes:
        value = (value << n) | code
        bits += n
        while bits >= 8:
            bits -= 8
            out.append((value >> bits) & 255)
            value &= (1 << bits) - 1
    if bits:
        out.append((value << (8 - bits)) & 255)
    return bytes(out)


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: lambda d: d, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}[compression](data)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    """``size`` bytes of a strip or tile."""
    if compression == NONE:
        out = data
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size) if size else b""
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: int = 0, order: str = "<") -> bytes:
    """Pages of shape (height, width) or (height, width, samples), 8 bits each, as one TIFF."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for page in pages:
        p = np.ascontiguousarray(page, np.uint8)
        p = p[:, :, None] if p.ndim == 2 else p
        h, w, s = p.shape
        if tile:
            parts = []
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile, s), np.uint8)
                    cut = p[y : y + tile, x : x + tile]
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(block)
        else:
            parts = [p[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        where, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            packed = _pack(part.tobytes(), compression)
            where.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * s), (259, 3, [compression]), (262, 3, [2 if s == 3 else 1]), (277, 3, [s]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, where), (325, 4, sizes)] if tile else [(273, 4, where), (278, 4, [rows_per_strip]), (279, 4, sizes)]
        tags.sort()
        out += b"\0" * (len(out) % 2)
        at = len(out)
        struct.pack_into(order + "I", out, link, at)
        body, extra = bytearray(struct.pack(order + "H", len(tags))), bytearray()
        beyond = at + 2 + 12 * len(tags) + 4
        for tag, kind, values in tags:
            raw = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            body += struct.pack(order + "HHI", tag, kind, len(values))
            if len(raw) <= 4:
                body += raw.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", beyond + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        link = len(out) + len(body)
        out += body + b"\0\0\0\0" + extra
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory of a TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags: dict[int, tuple] = {}
        n = struct.unpack_from(order + "H", data, at)[0]
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            if kind in _CODES and size <= len(data):
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                if place + size <= len(data):
                    tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _samples(raw: bytes, rows: int, width: int, depth: int, bits: int, order: str) -> np.ndarray:
    """(rows, width, depth) samples of one strip or tile."""
    if bits == 16:
        return np.frombuffer(raw, order + "u2").reshape(rows, width, depth).astype(np.uint16)
    if bits == 8:
        return np.frombuffer(raw, np.uint8).reshape(rows, width, depth)
    single = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : width * depth * bits]
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return (single.reshape(rows, width * depth, bits) * weights).sum(axis=2, dtype=np.uint8).reshape(rows, width, depth)


def read_page(data: bytes, number: int, order: str, tags: dict[int, tuple], most: int = MOST_BYTES) -> Page:
    def one(tag: int, default: int) -> int:
        value = tags.get(tag, (default,))
        return int(value[0]) if value else default

    w, h, s, compression, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(317, 1)
    kinds = set(tags.get(258, (8 if s > 1 else 1,) if 258 not in tags else ()))
    if len(kinds) != 1 or (bits := int(kinds.pop())) not in (1, 2, 4, 8, 16):
        raise ValueError("samples are not all of 1, 2, 4, 8 or 16 bits")
    if min(w, h, s) < 1 or w * h * s * (2 if bits == 16 else 1) > most:
        raise ValueError("the page has no samples or too many")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError(f"predictor {predictor} is not supported")
    planar = one(284, 1) == 2 and s > 1
    depth = 1 if planar else s
    tiled = 324 in tags
    places, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    tw, th = (one(322, 0), one(323, 0)) if tiled else (w, min(one(278, h), h) or h)
    packed = -(-tw * depth * bits // 8)
    if min(tw, th) < 1 or packed * th > most:
        raise ValueError("tiles or strips have no size or too large a one")
    across, down = -(-w // tw), -(-h // th)
    if len(places) < across * down * (s if planar else 1) or len(sizes) < len(places):
        raise ValueError("strips or tiles are missing")
    planes = []
    kind = np.uint16 if bits == 16 else np.uint8
    for plane in range(s if planar else 1):
        full = np.zeros((h, w, depth), kind)
        for k in range(across * down):
            i = plane * across * down + k
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, h - y)
            raw = _unpack(data[places[i] : places[i] + sizes[i]], compression, rows * packed)
            part = _samples(raw, rows, tw, depth, bits, order)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind)
            full[y : y + rows, x : x + tw] = part[: h - y, : w - x]
        planes.append(full)
    whole = np.concatenate(planes, axis=2) if planar else planes[0]
    return Page(number, w, h, s, compression, whole.astype("<u2").tobytes() if bits == 16 else whole.tobytes())


_BROKEN = (ValueError, KeyError, IndexError, OverflowError, MemoryError, TypeError, struct.error, zlib.error)


def read_tiff(data: bytes, most: int = MOST_BYTES) -> Iterator[Page | Exception]:
    """Pages of a TIFF in the order of their directories; for a broken one its error."""
    number, found = 0, directories(data)
    while True:
        try:
            order, tags = next(found)
        except StopIteration:
            return
        except _BROKEN as e:
            yield e
            return
        try:
            yield read_page(data, number, order, tags, most)
        except _BROKEN as e:
            yield e
        number += 1


def read_pages(media: DataFrame, column: str = "media", most: int = MOST_BYTES) -> DataFrame:
    """One row per page: the other columns, page, width, height, samples, compression, data, error."""
    others = [c for c in media.columns if c != column]
    own = [common.free_name(others, c) for c in ("page", "width", "height", "samples", "compression", "data", "error")]
    fields = [T.StructField(c, T.IntegerType()) for c in own[:5]] + [T.StructField(own[5], T.BinaryType()), T.StructField(own[6], T.StringType())]
    schema = T.StructType([*[media.schema[c] for c in others], *fields])
    kinds = [*[pa.int32()] * 5, pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob = batch.column(len(others))[i].as_py()
                if blob is None:
                    continue
                head = [batch.column(k).slice(i, 1) for k in range(len(others))]
                for number, p in enumerate(read_tiff(blob, most)):
                    row = (number, None, None, None, None, None, str(p) or type(p).__name__) if isinstance(p, Exception) else (*p, None)
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array([v], t) for v, t in zip(row, kinds, strict=True)]], names=schema.names)

    common.ship(media.sparkSession)
    return media.select(*others, column).mapInArrow(run, schema)


def layout_of(payload: bytes) -> dict:
    """How a payload is stored: chosen by its digest, so equal texts are stored alike."""
    d = hashlib.md5(payload).digest()
    return {
        "compression": (NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE)[d[0] % 5],
        "predictor": 1 + d[1] % 2,
        "rows_per_strip": (16, 64, 1024)[d[2] % 3],
        "tile": (0, 0, 32)[d[3] % 3],
        "order": "<>"[d[4] % 2],
    } | {"pages": 1 + d[5] % 3}


def stored_payload(text: str | None) -> tuple:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of one text."""
    raw = (text or "").encode("utf-8", "replace")
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    layout = layout_of(payload)
    pages = min(layout.pop("pages"), len(payload) // 64)
    media = write_tiff(np.array_split(np.frombuffer(payload, np.uint8).reshape(-1, 64), pages), **layout)
    read = list(read_tiff(media, max(MOST_BYTES, 2 * len(payload))))
    if broken := [p for p in read if isinstance(p, Exception)]:
        raise broken[0]
    back = b"".join(p.data for p in read)
    image = np.frombuffer(back, np.uint8)
    counts = np.bincount(image >> 4, minlength=16)
    rows = image.reshape(-1, 64)
    step = int(np.abs(np.diff(rows.astype(np.int16), axis=1)).sum())
    feature = f"w=64;h={len(rows)};pages={len(read)};codec={read[0].compression};sum={int(image.sum(dtype=np.int64))};step={step};hist=" + ",".join(map(str, counts))
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.StringType() if k == pa.string() else T.LongType()) for n, k in zip(names[1:], kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stored_payload(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    common.ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_tiff(spark, sf_dir: str) -> DataFrame:
    return media_features(common.tables(spark, sf_dir, "documents"))
