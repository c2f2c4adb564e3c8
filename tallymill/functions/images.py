"""Pictures as bytes: PNG pixels, grey values at a small size, difference codes, and what the metadata gives away.

Pixels are decoded from PNG of every colour type and depth without interlace; JPEG is read for its metadata alone. A file that is
damaged, is of another kind or lies about its sizes raises Unreadable, and nothing is allocated on a header's word beyond MOST pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MOST = 1 << 28
PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in grey, of 65,536.
GREY = (19595, 38470, 7471)
#: Tags of an image directory.
ORIENTATION, GPS = 0x0112, 0x8825
DATES, DEVICES = {0x0132, 0x9003, 0x9004}, {0x010F, 0x0110, 0xA431, 0xA435}
#: Bytes of a value by its type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class Unreadable(ValueError):
    """Bytes that are no picture of a known kind."""


def _chunks(data: bytes):
    at = len(PNG)
    while True:
        if at + 12 > len(data):
            raise Unreadable("ends inside a chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Unreadable(f"chunk {kind!r} is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of filter byte and differences to rows of bytes; step: bytes of a pixel."""
    high, wide = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((high + 1, wide), dtype=np.uint8)
    for y in range(high):
        kind, line, above, row = raw[y, 0], raw[y, 1:], out[y], out[y + 1]
        if kind == 0:
            row[:] = line
        elif kind == 1:
            padded = np.zeros(-(-wide // step) * step, dtype=np.uint8)
            padded[:wide] = line
            row[:] = np.add.accumulate(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:wide]
        elif kind == 2:
            row[:] = line + above
        elif kind in (3, 4):
            a, c = np.zeros(step, dtype=np.int64), np.zeros(step, dtype=np.int64)
            for x in range(0, wide, step):  # each pixel needs the one before
                b, d = above[x : x + step].astype(np.int64), line[x : x + step]
                n = len(d)
                if kind == 3:
                    guess = (a[:n] + b) // 2
                else:
                    p = a[:n] + b - c[:n]
                    pa, pb, pc = abs(p - a[:n]), abs(p - b), abs(p - c[:n])
                    guess = np.where((pa <= pb) & (pa <= pc), a[:n], np.where(pb <= pc, b, c[:n]))
                row[x : x + step] = (d + guess) & 255
                a, c = row[x : x + step].astype(np.int64), b
        else:
            raise Unreadable(f"filter {kind}")
    return out[1:]


def decode_png(data: bytes) -> tuple[np.ndarray, bytes]:
    """(rows, columns, samples) of bytes, and the picture's metadata block, which may be empty. Palettes become red, green, blue; 16-bit
    samples keep their high byte; fewer bits are spread to 0..255."""
    if not data.startswith(PNG):
        raise Unreadable("not a PNG file")
    head, palette, exif, packed = None, None, b"", []
    for kind, body in _chunks(data):
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        elif kind == b"eXIf":
            exif = body
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise Unreadable("no header")
    wide, high, depth, color, method, filtering, laced = head
    if not wide or not high or color not in SAMPLES or depth not in (1, 2, 4, 8, 16) or method or filtering or (depth < 8 and color not in (0, 3)) or (depth == 16 and color == 3):
        raise Unreadable("header out of range")
    if laced or wide * high > MOST:
        raise Unreadable("interlaced or too large")
    bits = SAMPLES[color] * depth
    line = 1 + (wide * bits + 7) // 8
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(packed), high * line + 1)
    except zlib.error as e:
        raise Unreadable(f"packed data: {e}") from None
    if len(raw) != high * line:
        raise Unreadable("too few or too many rows")
    rows = _unfiltered(np.frombuffer(raw, dtype=np.uint8).reshape(high, line), max(1, bits // 8))
    if depth == 16:
        pixels = rows.reshape(high, wide, -1, 2)[..., 0]
    elif depth == 8:
        pixels = rows.reshape(high, wide, -1)
    else:
        spread = np.unpackbits(rows, axis=1).reshape(high, -1, depth)[:, :wide]
        pixels = (spread @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
        if color == 0:
            pixels = (pixels.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if color == 3:
        if palette is None or int(pixels.max()) >= len(palette):
            raise Unreadable("palette lacks a colour")
        pixels = palette[pixels[..., 0]]
    return pixels, exif


def turned(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """A picture as it is meant to be seen, by its orientation of 1 to 8; others leave it as it is."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    flip_rows, flip_columns = orientation in (3, 4, 7, 8), orientation in (2, 3, 6, 7)
    return pixels[:: -1 if flip_rows else 1, :: -1 if flip_columns else 1]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey values; transparency is not looked at."""
    x = pixels.astype(np.int64)
    if x.shape[2] < 3:
        return x[..., 0]
    return (x[..., 0] * GREY[0] + x[..., 1] * GREY[1] + x[..., 2] * GREY[2] + (1 << 15)) >> 16


def _weights(size: int, out: int, lobes: int = 3) -> np.ndarray:
    """(out, size): what each sample gives to each result, of 2**22 in all, by the windowed sinc of `lobes` lobes."""
    scale = size / out
    wide, table = max(scale, 1.0), np.zeros((out, size))
    for i in range(out):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - lobes * wide + 0.5)), min(size, int(centre + lobes * wide + 0.5))
        x = (np.arange(low, high) - centre + 0.5) / wide
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        table[i, low:high] = w / w.sum()
    return np.where(table < 0, np.ceil(table * (1 << 22) - 0.5), np.floor(table * (1 << 22) + 0.5)).astype(np.int64)


def resized(x: np.ndarray, wide: int, high: int) -> np.ndarray:
    """Grey values at another size: columns first, then rows, each rounded to 0..255. A side of the wanted size is left alone."""
    for axis, out in ((1, wide), (0, high)):
        if x.shape[axis] != out:
            w = _weights(x.shape[axis], out)
            x = np.clip((np.tensordot(x, w, axes=(axis, 1)) if axis == 1 else np.tensordot(w, x, axes=(1, 0))) + (1 << 21) >> 22, 0, 255)
    return x


def small_grey(data: bytes, wide: int = 9, high: int = 8) -> list[int]:
    """A PNG's grey values, upright, at a small size, row by row."""
    pixels, exif = decode_png(data)
    tags = directory(exif) if exif else {}
    return resized(grey(turned(pixels, tags.get(ORIENTATION, 1))), wide, high).reshape(-1).tolist()


def directory(block: bytes, most: int = 1 << 12) -> dict[int, object]:
    """Tags of the first directory of a metadata block: whole numbers as such, others as bytes. Offsets that lead outside or onto a
    directory again, unknown types and more than `most` entries are refused."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8 or struct.unpack_from(f"{order}H", block, 2)[0] != 42:
        raise Unreadable("not a directory")
    (at,) = struct.unpack_from(f"{order}I", block, 4)
    out, seen = {}, set()
    if at == 0:
        return out
    if at + 2 > len(block) or at < 8:
        raise Unreadable("directory outside its block")
    (n,) = struct.unpack_from(f"{order}H", block, at)
    if n > most or at + 2 + 12 * n > len(block):
        raise Unreadable("directory longer than its block")
    seen.add(at)
    for k in range(n):
        tag, kind, count, value = struct.unpack_from(f"{order}HHII", block, at + 2 + 12 * k)
        if kind not in SIZES:
            raise Unreadable(f"type {kind} of tag {tag}")
        size = SIZES[kind] * count
        place = at + 2 + 12 * k + 8 if size <= 4 else value
        if place + size > len(block) or place in seen:
            raise Unreadable(f"value of tag {tag} outside its block")
        raw = block[place : place + size]
        whole = {1: "B", 3: "H", 4: "I"}.get(kind)
        out[tag] = struct.unpack(order + whole, raw)[0] if whole and count == 1 else raw
    return out


def metadata(data: bytes) -> bytes:
    """The metadata block of a PNG or JPEG file, empty if it has none."""
    if data.startswith(PNG):
        return next((body for kind, body in _chunks(data) if kind == b"eXIf"), b"")
    if not data.startswith(b"\xff\xd8"):
        raise Unreadable("neither PNG nor JPEG")
    at = 2
    while at + 4 <= len(data):
        mark, kind, size = struct.unpack_from(">BBH", data, at)
        if mark != 0xFF or size < 2 or at + 2 + size > len(data):
            raise Unreadable("broken segments")
        if kind == 0xDA:
            return b""
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    raise Unreadable("no picture in it")


def metadata_findings(data: bytes) -> list[str]:
    """What a picture's metadata gives away, sorted: image_exif_present, image_exif_gps, image_exif_datetime, image_device_metadata; or
    image_unreadable."""
    try:
        block = metadata(data)
        tags = directory(block) if block else {}
    except (Unreadable, struct.error):
        return ["image_unreadable"]
    found = {"image_exif_present"} if tags else set()
    filled = {t for t, v in tags.items() if v not in (0, b"") and v != b"\0"}
    found |= {"image_exif_gps"} if GPS in filled else set()
    found |= {"image_exif_datetime"} if filled & DATES else set()
    found |= {"image_device_metadata"} if filled & DEVICES else set()
    return sorted(found)


def encode_png(pixels: np.ndarray, filters: list[int] | None = None, exif: bytes = b"") -> bytes:
    """A PNG of 8-bit samples; filters: the filter of each row, in turn."""
    high, wide, samples = pixels.shape
    color = {v: k for k, v in SAMPLES.items() if k != 3}[samples]
    x, lines = pixels.reshape(high, -1).astype(np.int64), []
    for y in range(high):
        kind = (filters or [0])[y % len(filters or [0])]
        above = x[y - 1] if y else np.zeros_like(x[0])
        left, corner = (np.concatenate((np.zeros(samples, dtype=np.int64), r[:-samples])) for r in (x[y], above))
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = (np.zeros_like(left), left, above, (left + above) // 2, paeth)[kind]
        lines.append(bytes([kind]) + ((x[y] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, color, 0, 0, 0))
    return PNG + head + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
