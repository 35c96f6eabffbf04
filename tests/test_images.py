import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from framestride.errors import DatasetError
from framestride.functions import images


def png(width, height, bits, colour, rows, *chunks, interlace=0, level=6):
    """A PNG of rows of filtered bytes (each with its filter in front)."""
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlace)
    return images.PNG + images._chunk(b"IHDR", head) + b"".join(images._chunk(*c) for c in chunks) + images._chunk(b"IDAT", zlib.compress(b"".join(rows), level)) + images._chunk(b"IEND", b"")


def tiff(order, width, height, data, bits=(8,), form=1, compression=1, extra=(), photometric=2, strips=None):
    mark = "<" if order == b"II" else ">"
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, list(bits)), (259, 3, [compression]), (262, 3, [photometric]), (273, 4, strips or [8]), (277, 3, [len(bits)]), (278, 4, [height]), (279, 4, [len(data)]), (338, 3, list(extra)), (339, 3, [form] * len(bits))]
    fields = [f for f in fields if f[2]]
    at = 8 + len(data) + len(data) % 2
    more, table = b"", b""
    for tag, kind, values in fields:
        raw = struct.pack(f"{mark}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            place = at + 2 + 12 * len(fields) + 4 + len(more)
            more += raw
            raw = struct.pack(mark + "I", place)
        table += struct.pack(mark + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return order + struct.pack(mark + "HI", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack(mark + "H", len(fields)) + table + b"\0" * 4 + more


@settings(max_examples=30)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_round_trips(w, h, seed):
    rng = np.random.default_rng(seed)
    rgb = rng.integers(0, 256, (h, w, 3), np.uint8)
    got = images.decode(images.encode_png(rgb))
    assert (got["image"], got["width"], got["height"], got["channels"], got["dtype"]) == (rgb.tobytes(), w, h, 3, "uint8")
    for kind in (np.uint16, np.float32):
        depth = (rng.random((h, w)) * 60000).astype(kind)
        got = images.decode(images.encode_tiff(depth))
        assert (got["image"], got["channels"], got["dtype"]) == (depth.tobytes(), 1, np.dtype(kind).name)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (4, 5, 3), np.uint8)
    rows, above = [], np.zeros(15, int)
    for line in want.reshape(4, 15).astype(int):
        left = np.concatenate([[0, 0, 0], line[:-3]])
        corner = np.concatenate([[0, 0, 0], above[:-3]])
        p = left + above - corner
        paeth = [min((abs(q - a), i, a) for i, a in enumerate((x, y, z)))[2] for q, x, y, z in zip(p, left, above, corner, strict=True)]
        guess = [np.zeros(15, int), left, above, (left + above) // 2, np.array(paeth)][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    assert images.decode(png(5, 4, 8, 2, rows))["image"] == want.tobytes()


def test_png_kinds():
    assert images.decode(png(2, 1, 16, 0, [b"\0\x01\x02\x03\x04"]))["image"] == b"\x02\x01\x04\x03"
    assert images.decode(png(8, 1, 1, 0, [b"\0\xa0"]))["image"] == bytes([255, 0, 255, 0, 0, 0, 0, 0])
    palette = (b"PLTE", bytes([255, 0, 0, 0, 255, 0, 0, 0, 255]))
    got = images.decode(png(3, 1, 8, 3, [b"\0\0\1\2"], palette, (b"tRNS", bytes([255, 128]))))
    assert got["image"].hex().upper() == "FF0000FF00FF00800000FFFF" and got["channels"] == 4
    with pytest.raises(DatasetError, match="palette"):
        images.decode(png(1, 1, 8, 3, [b"\0\5"], palette))
    with pytest.raises(DatasetError, match="gray images with alpha"):
        images.decode(png(1, 1, 8, 4, [b"\0\0\0"]))
    seven = images.decode(png(1, 1, 8, 2, [b"\0abc"], interlace=1))
    assert seven["image"] == b"abc"


@pytest.mark.parametrize("order", [b"II", b"MM"])
def test_tiff_kinds(order):
    assert images.decode(tiff(order, 2, 1, bytes.fromhex("123456abcdee"), (8, 8, 8)))["image"].hex() == "123456abcdee"
    got = images.decode(tiff(order, 2, 1, zlib.compress(bytes.fromhex("12345680abcdee20")), (8,) * 4, compression=8, extra=(2,)))
    assert got["image"].hex() == "12345680abcdee20" and got["channels"] == 4
    depth = np.array([[1, 515]], np.uint16)
    data = depth.astype(depth.dtype.newbyteorder("<" if order == b"II" else ">")).tobytes()
    assert images.decode(tiff(order, 2, 1, data, (16,), photometric=1))["image"] == depth.tobytes()


@pytest.mark.parametrize(
    "blob",
    [
        b"", b"GIF89a", images.PNG, bytes.fromhex("49492a00ffffffff"), images.encode_png(np.zeros((2, 2, 3), np.uint8))[:-20], tiff(b"II", 2, 1, b"abcdef", (8, 8, 16)), tiff(b"II", 9, 9, b"abcdef", (8, 8, 8)),
        tiff(b"II", 2, 1, b"abcdefgh", (8,) * 4), tiff(b"II", 2, 1, zlib.compress(b"abcdef")[:-3], (8, 8, 8), compression=8), tiff(b"II", 1, 1, zlib.compress(b"abcd"), (32,), form=3, compression=8), tiff(b"II", 2, 1, b"abcdef", (8, 8, 8), strips=[10**6]),
        png(100000, 100000, 8, 2, [b"\0"]), png(2, 2, 8, 2, [b"\0abc"]), png(1, 1, 8, 2, [b"\7abc"]),
    ],
)
def test_bad_images(blob):
    with pytest.raises(DatasetError):
        images.decode(blob)


def test_a_changed_byte_is_found():
    blob = bytearray(images.encode_png(np.zeros((2, 2, 3), np.uint8)))
    blob[-18] ^= 1
    with pytest.raises(DatasetError, match="CRC"):
        images.decode(bytes(blob))


def test_columns(spark):
    good = images.encode_png(np.full((1, 2, 3), 7, np.uint8))
    rows = spark.createDataFrame([(i, good if i % 2 else None) for i in range(500)], "i int, b binary")
    got = rows.select(images.decode_image("b").alias("d")).selectExpr("count(d) n", "max(d.width) w").first()
    assert (got["n"], got["w"]) == (250, 2)
    with pytest.raises(PySparkException, match="requires a PNG or TIFF"):
        spark.createDataFrame([(b"text",)], "b binary").select(images.decode_image("b")).collect()


@pytest.mark.parametrize(("channels", "kinds"), [(1, (0, 1, 2, 3, 4)), (3, (3, 4)), (4, (4,)), (3, (3,)), (3, (0, 4))])
def test_rows_of_every_filter(channels, kinds):
    """Against the filters undone a byte at a time, as the format defines them."""
    rng = np.random.default_rng(channels)
    h, w = 9, 7
    raw = rng.integers(0, 256, (h, w * channels + 1)).astype(np.uint8)
    raw[:, 0] = rng.choice(kinds, h)
    want = np.zeros((h + 1, w + 1, channels), int)
    for y, x, c in np.ndindex(h, w, channels):
        left, up, corner = want[y + 1, x, c], want[y, x + 1, c], want[y, x, c]
        nearest = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
        guess = (0, left, up, (left + up) // 2, nearest)[raw[y, 0]]
        want[y + 1, x + 1, c] = (int(raw[y, 1 + x * channels + c]) + guess) % 256
    got = images._unfilter(raw.ravel(), h, w * channels, channels)
    assert got.tolist() == want[1:, 1:].reshape(h, w * channels).tolist()


def test_a_large_image_of_the_hardest_filter_takes_seconds_at_most():
    raw = np.random.default_rng(1).integers(0, 256, (1080, 1920 * 3 + 1)).astype(np.uint8)
    raw[:, 0] = 4
    began = time.process_time()
    images._unfilter(raw.ravel(), 1080, 1920 * 3, 3)
    assert time.process_time() - began < 5
