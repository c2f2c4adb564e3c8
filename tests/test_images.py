"""Pictures against plain versions: pixels, sizes, turns, metadata, damage."""

import math
import struct
import zlib

import numpy as np
import pytest

from tallymill.functions import images as I
from tallymill.sources import files as S


def brute_resized(x: list[list[float]], out: int) -> list[list[float]]:
    """Rows at another width by the plain sum over the window, unrounded: what resized is held against."""
    size = len(x[0])
    scale = size / out
    wide, rows = max(scale, 1.0), []
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    for row in x:
        line = []
        for i in range(out):
            centre, total, weight = (i + 0.5) * scale, 0.0, 0.0
            for k in range(max(0, int(centre - 3 * wide + 0.5)), min(size, int(centre + 3 * wide + 0.5))):
                t = (k - centre + 0.5) / wide
                w = sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0
                total, weight = total + w * row[k], weight + w
            line.append(total / weight)
        rows.append(line)
    return rows


def rgb(seed, high, wide, samples):
    return np.random.default_rng(seed).integers(0, 256, (high, wide, samples)).astype(np.uint8)


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 0, 3, 1, 2]])
def test_pixels_come_back(samples, filters):
    x = rgb(samples, 13, 17, samples)
    got, exif = I.decode_png(I.encode_png(x, filters, b"MM block"))
    assert (got == x).all() and exif == b"MM block"


def packed(wide, high, depth, color, rows, palette=None):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return I.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_other_depths_and_palettes():
    assert I.decode_png(packed(3, 1, 1, 0, b"\0\xa0"))[0].reshape(-1).tolist() == [255, 0, 255]
    assert I.decode_png(packed(3, 1, 2, 0, b"\0\x1b"))[0].reshape(-1).tolist() == [0, 85, 170]
    assert I.decode_png(packed(2, 1, 16, 0, b"\0\x12\x34\xff\x00"))[0].reshape(-1).tolist() == [0x12, 0xFF]
    assert I.decode_png(packed(3, 1, 4, 3, b"\0\x01\x20", bytes(range(9))))[0].tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]]]
    with pytest.raises(I.Unreadable):
        I.decode_png(packed(2, 1, 4, 3, b"\0\x0f", bytes(range(9))))


@pytest.mark.parametrize("high,wide", [(8, 9), (8, 40), (61, 9), (100, 133), (3, 2), (1, 1), (8, 4)])
def test_sizes_against_plain_sums(high, wide):
    x = rgb(high * wide, high, wide, 1)[..., 0].astype(np.int64)
    got = I.resized(x, 9, 8)
    columns = [[min(255, max(0, round(v))) for v in line] for line in (brute_resized(x.tolist(), 9) if wide != 9 else x.tolist())]
    turned = [list(c) for c in zip(*columns)]
    want = np.array(brute_resized(turned, 8) if high != 8 else turned).T
    # Fixed-point weights may round a half the other way.
    assert got.shape == (8, 9) and np.abs(got - np.clip(want, 0, 255)).max() <= 1.0 + 1e-6


def test_grey_and_turns():
    assert I.grey(np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], dtype=np.uint8)).tolist() == [[255, 76, 150, 29]]
    x = np.arange(6).reshape(2, 3, 1)
    want = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.swapaxes(0, 1), 6: np.rot90(x, -1), 7: np.rot90(x, 2).swapaxes(0, 1), 8: np.rot90(x), 9: x}
    for k, w in want.items():
        assert (I.turned(x, k) == w).all(), k


def block(tags, order="<"):
    """A metadata block: (tag, type, count, value or bytes)."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8)
    body, tail, at = struct.pack(f"{order}H", len(tags)), b"", 8 + 2 + 12 * len(tags) + 4
    for tag, kind, count, value in tags:
        if isinstance(value, bytes):
            if len(value) <= 4:
                field = value.ljust(4, b"\0")
            else:
                field, tail = struct.pack(f"{order}I", at + len(tail)), tail + value
        else:
            field = struct.pack(f"{order}H", value).ljust(4, b"\0") if kind == 3 else struct.pack(f"{order}I", value)
        body += struct.pack(f"{order}HHI", tag, kind, count) + field
    return head + body + struct.pack(f"{order}I", 0) + tail


def jpeg(exif):
    part = b"Exif\0\0" + exif
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xda\x00\x02"


@pytest.mark.parametrize("order", ["<", ">"])
def test_findings(order):
    date, make, gps, turn = (0x0132, 2, 20, b"2024:01:02 03:04:05\0"), (0x010F, 2, 3, b"ab\0"), (0x8825, 4, 1, 26), (0x0112, 3, 1, 6)
    for tags, want in (
        ([], []),
        ([turn], ["image_exif_present"]),
        ([make, date, gps], ["image_device_metadata", "image_exif_datetime", "image_exif_gps", "image_exif_present"]),
        ([(0x8825, 4, 1, 0), (0x010F, 2, 1, b"\0")], ["image_exif_present"]),
    ):
        for data in (jpeg(block(tags, order)), I.encode_png(rgb(1, 2, 2, 3), exif=block(tags, order))):
            assert I.metadata_findings(data) == want
    assert I.directory(block([turn], order))[I.ORIENTATION] == 6
    assert I.metadata_findings(I.encode_png(rgb(1, 2, 2, 1))) == [] and I.metadata_findings(b"\xff\xd8\xff\xda\x00\x02") == []


def test_loops_and_bad_offsets_are_refused():
    whole = block([(0x0132, 2, 20, b"2024:01:02 03:04:05\0")])
    outside = whole[:18] + struct.pack("<I", 1 << 20) + whole[22:]
    loop = whole[:18] + struct.pack("<I", 8) + whole[22:]  # the value is said to be the directory itself
    many = whole[:8] + struct.pack("<H", 60_000) + whole[10:]
    far = whole[:4] + struct.pack("<I", 10_000) + whole[8:]
    kind = whole[:12] + struct.pack("<H", 99) + whole[14:]
    for bad in (outside, loop, many, far, kind, b"II", b"XX" + whole[2:]):
        assert I.metadata_findings(jpeg(bad)) == ["image_unreadable"]
    for data in (b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xe1\xff\xff", I.PNG, I.encode_png(rgb(1, 3, 3, 1))[:-5]):
        assert I.metadata_findings(data) == ["image_unreadable"]


def test_damage_is_counted_and_not_fatal(spark):
    whole = I.encode_png(rgb(5, 30, 40, 3), [4, 1])
    flipped = whole[:60] + bytes([whole[60] ^ 1]) + whole[61:]
    bomb = packed(9, 8, 8, 0, bytes(10_000))
    huge = packed(1 << 30, 1 << 30, 8, 0, b"")
    upright, sideways = rgb(6, 8, 9, 1), rgb(6, 8, 9, 1).swapaxes(0, 1)[:, ::-1]
    rows = [(1, whole), (2, whole[:50]), (3, flipped), (4, b"text"), (5, None), (6, b""), (7, bomb), (8, huge), (9, I.encode_png(upright)), (10, I.encode_png(sideways, exif=block([(0x0112, 3, 1, 8)])))]
    got = {r.id: r for r in S.image_facts(spark.createDataFrame(rows, "id long, content binary"), "content", ["id"]).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: "unreadable", 3: "unreadable", 4: "unreadable", 5: "missing", 6: "missing", 7: "unreadable", 8: "unreadable", 9: None, 10: None}
    g = upright[..., 0].astype(int)
    bits = sum(1 << (8 * y + x) for y in range(8) for x in range(8) if g[y, x + 1] > g[y, x])
    assert got[9].code % 2**64 == got[10].code % 2**64 == bits and got[5].code is None and got[10].findings == ["image_exif_present"]


def test_findings_join_those_of_the_text(spark):
    from tallymill.operators import tables as O

    exif = block([(0x8825, 4, 1, 26)])
    rows = [(1, "mail a@b.org", I.encode_png(rgb(1, 2, 2, 1), exif=exif)), (2, "nothing", jpeg(exif)), (3, "nothing", b"bad"), (4, "nothing", None), (5, "see https://x.org", None)]
    df = spark.createDataFrame(rows, "id long, text string, content binary")
    facts = S.image_facts(df, "content", ["id", "text"])
    found = sorted(tuple(r.finding_types) for r in O.private_findings(facts, "text", "id", "sixteen letters!", others="findings").collect())
    gps = ("image_exif_gps", "image_exif_present")
    assert len(found) == 4 and found.count(gps) == 1 and ("image_unreadable",) in found and any(set(gps) < set(f) for f in found)
