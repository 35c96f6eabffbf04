"""PNG and TIFF images as raw pixels and back, with zlib and NumPy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import DatasetError

MOST = 64 << 20
PNG = b"\x89PNG\r\n\x1a\n"
TIFF = (b"II*\0", b"MM\0*")
DECODED = "struct<image: binary, width: int, height: int, channels: int, dtype: string>"

# Adam7 passes as (first column, first row, column step, row step).
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
# TIFF tags and the bytes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, ORIENTATION, SAMPLES, ROWS, SIZES, PLANAR, PREDICTOR, EXTRA, FORMAT = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279, 284, 317, 338, 339
_FIELD = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit RGB image (height x width x 3)."""
    h, w, _ = image.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def encode_tiff(image: np.ndarray) -> bytes:
    """A depth map (height x width), uint16 or float32, little-endian and not compressed."""
    h, w = image.shape
    data = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()
    bits, form = image.dtype.itemsize * 8, 3 if image.dtype.kind == "f" else 1
    fields = ((WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, bits), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (STRIPS, 4, 8), (SAMPLES, 3, 1), (ROWS, 4, h), (SIZES, 4, len(data)), (PLANAR, 3, 1), (FORMAT, 3, form))
    pad = len(data) % 2
    table = b"".join(struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v)) for tag, kind, v in fields)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + pad) + data + b"\0" * pad + struct.pack("<H", len(fields)) + table + struct.pack("<I", 0)


def _unfilter_diagonals(raw: np.ndarray, height: int, width: int, step: int) -> np.ndarray:
    """Undo row filters of any kind: the pixels of one anti-diagonal depend on the two before it only."""
    if (raw[:, 0] > 4).any():
        raise DatasetError("PNG image has an unknown row filter")
    kind, pixels = raw[:, 0], raw[:, 1:].reshape(height, width, step).astype(np.int16)
    # A row and a column of zeros stand above and to the left.
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, k = d - y, kind[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        dl, du, dc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, paeth, 0))))
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width * step)


def _unfilter(raw: np.ndarray, height: int, line: int, step: int) -> np.ndarray:
    """Undo the row filters; step is the bytes of a pixel."""
    if len(raw) < height * (line + 1):
        raise DatasetError("PNG image data is truncated")
    raw = raw[: height * (line + 1)].reshape(height, line + 1)
    if height and raw[:, 0].max() > 2:
        return _unfilter_diagonals(raw, height, line // step, step)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = row + above
        else:
            for k in range(min(step, line)):
                out[y, k::step] = np.cumsum(row[k::step], dtype=np.uint64).astype(np.uint8)
        above = out[y]
    return out


def _samples(lines: np.ndarray, width: int, bits: int, channels: int) -> np.ndarray:
    h = len(lines)
    if bits == 16:
        return lines.view(">u2").astype(np.uint16).reshape(h, width, channels)
    if bits == 8:
        return lines.reshape(h, width, channels)
    unpacked = np.unpackbits(lines, axis=1).reshape(h, -1, bits)
    return (unpacked @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)[:, : width * channels].reshape(h, width, channels)


def decode_png(blob: bytes) -> np.ndarray:
    at, head, palette, clear, data, ended = len(PNG), None, None, None, [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise DatasetError("PNG image is truncated")
        (n,), kind = struct.unpack_from(">I", blob, at), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + n]
        if at + 12 + n > len(blob):
            raise DatasetError("PNG image is truncated")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", blob, at + 8 + n)[0]:
            raise DatasetError("PNG image has a chunk whose CRC differs")
        at += 12 + n
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
    if head is None or not data or not ended:
        raise DatasetError("PNG image is incomplete")
    w, h, bits, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if not channels or not w or not h or bits not in ((8, 16) if colour in (2, 4, 6) else (1, 2, 4, 8, 16) if colour == 0 else (1, 2, 4, 8)):
        raise DatasetError("PNG image has an unsupported header")
    if w * h * max(channels, 3 if colour == 3 else 1) * (2 if bits == 16 else 1) > MOST:
        raise DatasetError("image exceeds the decoded size limit")
    if colour == 4:
        raise DatasetError("gray images with alpha are not supported")
    # Bounded: rows are no longer than the header says.
    line = lambda width: (width * channels * bits + 7) // 8
    most = sum(-(-(h - y0) // dy) * (line(-(-(w - x0) // dx)) + 1) for x0, y0, dx, dy in _PASSES if w > x0 and h > y0) if interlace else h * (line(w) + 1)
    try:
        pack = zlib.decompressobj()
        raw = np.frombuffer(pack.decompress(b"".join(data), most + 64), np.uint8)
    except zlib.error as e:
        raise DatasetError("PNG image data does not inflate") from e
    if not pack.eof:
        raise DatasetError("PNG image data is truncated or too long")
    step = max(1, channels * bits // 8)
    if interlace:
        pixels, at = np.zeros((h, w, channels), np.uint16 if bits == 16 else np.uint8), 0
        for x0, y0, dx, dy in _PASSES:
            pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
            if w > x0 and h > y0:
                lines = _unfilter(raw[at:], ph, line(pw), step)
                pixels[y0::dy, x0::dx] = _samples(lines, pw, bits, channels)
                at += ph * (line(pw) + 1)
    else:
        pixels = _samples(_unfilter(raw, h, line(w), step), w, bits, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise DatasetError("PNG image has colours outside its palette")
        table = palette
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            table = np.concatenate([palette, alpha[:, None]], axis=1)
        return table[pixels[:, :, 0]]
    if colour == 0 and bits < 8:
        pixels = pixels * np.uint8(255 // ((1 << bits) - 1))
    if colour == 2 and clear is not None and bits == 8:
        alpha = np.where((pixels == np.frombuffer(clear, ">u2").astype(np.uint8)).all(2), 0, 255).astype(np.uint8)
        pixels = np.concatenate([pixels, alpha[:, :, None]], axis=2)
    return pixels


def decode_tiff(blob: bytes) -> np.ndarray:
    order = "<" if blob[:2] == b"II" else ">"
    fail = lambda what: DatasetError(f"TIFF image {what}")
    try:
        (at,) = struct.unpack_from(order + "I", blob, 4)
        (n,) = struct.unpack_from(order + "H", blob, at)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
            size = _FIELD.get(kind, 0) * count
            if kind not in (1, 3, 4) or size > len(blob):
                continue
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(order + "I", blob, place)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", blob, place))
    except struct.error as e:
        raise fail("is truncated") from e
    get = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    w, h, samples, packing = get(WIDTH), get(HEIGHT), get(SAMPLES, 1), get(COMPRESSION, 1)
    if not w or not h or STRIPS not in tags or get(PLANAR, 1) != 1:
        raise fail("has an unsupported layout")
    bits, forms = tags.get(BITS, [1]), tags.get(FORMAT, [1])
    if len(set(bits)) > 1 or len(set(forms)) > 1 or len(bits) not in (1, samples) or len(forms) not in (1, samples):
        raise fail("has channels of unlike types")
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((bits[0], forms[0]))
    if kind is None or samples not in (1, 3, 4) or get(PHOTOMETRIC, 1) not in (1, 2) or get(ORIENTATION, 1) != 1 or get(PREDICTOR, 1) != 1:
        raise fail("has an unsupported pixel type")
    if samples == 4 and tags.get(EXTRA) != [2]:
        raise fail("needs unassociated alpha")
    if packing not in (1, 8, 32946) or (kind == "f4" and packing != 1):
        raise fail("has an unsupported compression")
    total = w * h * samples * np.dtype(kind).itemsize
    if total > MOST:
        raise DatasetError("image exceeds the decoded size limit")
    per, line = get(ROWS, h), w * samples * np.dtype(kind).itemsize
    if len(tags.get(SIZES, [])) != len(tags[STRIPS]) or len(tags[STRIPS]) != -(-h // per):
        raise fail("has strips that do not match its size")
    out = []
    for i, (start, size) in enumerate(zip(tags[STRIPS], tags[SIZES], strict=True)):
        want = min(per, h - i * per) * line
        if start + size > len(blob):
            raise fail("has a strip outside the file")
        strip = blob[start : start + size]
        if packing != 1:
            pack = zlib.decompressobj()
            try:
                strip = pack.decompress(strip, want + 64)
            except zlib.error as e:
                raise fail("strip does not inflate") from e
            if not pack.eof:
                raise fail("strip is truncated or too long")
        if len(strip) < want:
            raise fail("strip is truncated")
        out.append(strip[:want])
    pixels = np.frombuffer(b"".join(out), np.dtype(kind).newbyteorder(order))
    return pixels.astype(kind).reshape(h, w, samples)


def decode(blob: bytes) -> dict:
    """A PNG or TIFF as raw row-major pixels, little-endian."""
    if len(blob) > MOST:
        raise DatasetError("image exceeds the encoded size limit")
    if blob.startswith(PNG):
        pixels = decode_png(blob)
    elif blob[:4] in TIFF:
        pixels = decode_tiff(blob)
    else:
        raise DatasetError("decode_image requires a PNG or TIFF BLOB")
    h, w, c = pixels.shape
    return {"image": np.ascontiguousarray(pixels, pixels.dtype.newbyteorder("<")).tobytes(), "width": w, "height": h, "channels": c, "dtype": pixels.dtype.name}


def _decode_all(blobs: pa.Array) -> pa.Array:
    kind = pa.struct([("image", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dtype", pa.string())])
    return pa.array([None if b is None else decode(b) for b in blobs.to_pylist()], kind)


def decode_image(blob):
    """A column of PNG or TIFF images as DECODED structs; null stays null."""
    return F.arrow_udf(_decode_all, DECODED)(blob)


def encode_image(raw, height: int, width: int, dtype: str):
    """A column of raw frames as images: 'uint8' RGB as PNG, 'uint16' or 'float32' depth as TIFF."""

    def run(frames: pa.Array) -> pa.Array:
        return pa.array([None if b is None else encode_raw(b, height, width, dtype) for b in frames.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(raw)


def encode_raw(raw: bytes, height: int, width: int, dtype: str) -> bytes:
    if dtype == "uint8":
        return encode_png(np.frombuffer(raw, np.uint8).reshape(height, width, 3))
    return encode_tiff(np.frombuffer(raw, np.dtype(dtype).newbyteorder("<")).reshape(height, width))
