"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized through integral images, written as NPY
tiles with difference hashes."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Side of the grey tile stored for each image, and the unit that payloads are padded to: one row of 192 RGB pixels.
TILE = 16
UNIT = 576
PAD = 255


class MediaError(ValueError):
    """Bytes that are no supported image."""


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after the magic, skipping blanks and comments, and the offset behind the last."""
    numbers, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")
    while len(numbers) < n:
        m = token.match(data, at)
        if not m:
            raise MediaError("bad Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    return numbers, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: (height, width) or (height, width, 3); uint8, or uint16 where the maximum exceeds 255."""
    kind = data[1] - 48
    bitmap, colour, plain = kind in (1, 4), kind in (3, 6), kind < 4
    numbers, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not 0 < top < 65536 or width < 1 or height < 1:
        raise MediaError("bad Netpbm size")
    shape, count = ((height, width, 3), 3 * width * height) if colour else ((height, width), width * height)
    kind_of = np.uint8 if top < 256 else np.uint16
    if plain:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        if bitmap:
            body = b" ".join(re.findall(rb"[01]", body))
        values = np.array(body.split()[:count], dtype=np.int64)
    elif bitmap:
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if packed.size < row * height:
            raise MediaError("short Netpbm body")
        values = np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, offset=at + 1, count=-1 if (len(data) - at - 1) % (1 + (top > 255)) == 0 else (len(data) - at - 1) // 2)[:count]
    if values.size < count:
        raise MediaError("short Netpbm body")
    values = values.astype(kind_of, copy=False).reshape(shape)
    return (1 - values) * np.uint8(255) if bitmap else values


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits a pixel: (height, width, 3) uint8."""
    if len(data) < 54:
        raise MediaError("short BMP")
    at, head = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    width, height = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packing or bits not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise MediaError("unsupported BMP")
    rows, stride = abs(height), (bits * width + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, offset=at)[: stride * rows]
    if body.size < stride * rows:
        raise MediaError("short BMP body")
    body = body.reshape(rows, stride)
    if bits >= 24:
        image = body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        index = np.unpackbits(body, axis=1) if bits == 1 else np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1) if bits == 4 else body
        colours = int.from_bytes(data[46:50], "little") or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
        index = index[:, :width]
        if index.max(initial=0) >= len(palette):
            raise MediaError("BMP index outside its palette")
        image = palette[index][:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(data: bytes) -> np.ndarray:
    """The image's samples; whatever is wrong with the bytes raises MediaError."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return decode_netpbm(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except (ValueError, OverflowError) as error:  # numbers that are none or too large, offsets behind the end
        raise MediaError(str(error)) from error
    raise MediaError("neither Netpbm nor BMP")


def encode_ppm(payload: bytes, width: int = UNIT // 3) -> bytes:
    """Payload, whose size is a multiple of 3 * width, as the samples of a binary P6 image."""
    return b"P6\n%d %d\n255\n" % (width, len(payload) // (3 * width)) + payload


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(np.int64)
    total = np.zeros(image.shape[:2], np.int32)
    for weight, c in ((299, 0), (587, 1), (114, 2)):  # samples of up to 16 bits stay within 31
        total += weight * image[..., c].astype(np.int32)
    return total // 1000


def area_resize(plane: np.ndarray, height: int, width: int, integral: np.ndarray | None = None) -> np.ndarray:
    """Mean over each output pixel's area, fractions of pixels included, from the integral image."""
    if integral is None:
        integral = integral_image(plane)
    ys, xs = np.linspace(0, plane.shape[0], height + 1), np.linspace(0, plane.shape[1], width + 1)
    y0, x0 = np.minimum(ys.astype(int), plane.shape[0] - 1), np.minimum(xs.astype(int), plane.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], xs - x0
    rows = integral[y0] * (1 - fy) + integral[y0 + 1] * fy
    at = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / ((plane.shape[0] / height) * (plane.shape[1] / width))


def integral_image(plane: np.ndarray) -> np.ndarray:
    out = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    np.cumsum(plane, axis=0, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def difference_hash(plane: np.ndarray, integral: np.ndarray | None = None) -> int:
    """64 bits: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = np.round(area_resize(plane, 8, 9, integral), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    """The array in NPY format, version 1.0."""
    head = f"{{'descr': '{np.lib.format.dtype_to_descr(array.dtype)}', 'fortran_order': False, 'shape': {array.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + np.ascontiguousarray(array).tobytes()


def tile(image: np.ndarray, side: int = TILE) -> tuple[bytes, str]:
    """NPY tile of the grey image, and the difference hash as 16 hex digits."""
    plane = grey(image)
    integral = integral_image(plane)
    return npy(np.round(area_resize(plane, side, side, integral)).astype(np.uint8)), f"{difference_hash(plane, integral):016x}"


def media_columns(df: DataFrame, media: str, side: int = TILE) -> DataFrame:
    """df with height, width, channels, tile (NPY bytes), dhash and media_error for a binary column of images.

    Null or undecodable bytes give nulls and, where not null, the reason in media_error; nothing is dropped.
    """
    kinds = [("media_height", T.LongType(), pa.int64()), ("media_width", T.LongType(), pa.int64()), ("media_channels", T.LongType(), pa.int64()), ("media_tile", T.BinaryType(), pa.binary()), ("media_dhash", T.StringType(), pa.string()), ("media_error", T.StringType(), pa.string())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for value in batch.column(batch.schema.names.index(media)):
            try:
                image = decode(value.as_buffer().to_pybytes()) if value.is_valid else None
                rows.append((*image.shape[:2], 1 if image.ndim == 2 else 3, *tile(image, side), None) if image is not None else (None,) * 6)
            except MediaError as error:
                rows.append((*[None] * 5, str(error)))
        return [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(kinds)]

    return common.append_columns(df, [T.StructField(name, kind) for name, kind, _ in kinds], compute)


def store_payload(text_bytes: bytes) -> tuple[int, int, str, int, int, str, str, str]:
    """A text as a stored P6 image, read back: the digest columns of the query, and the digest of its NPY tile."""
    n = len(text_bytes)
    size = max(1, -(-n // UNIT)) * UNIT
    stored = encode_ppm(text_bytes + bytes([PAD]) * (size - n))
    image = decode(stored)
    payload = image.tobytes()
    small, feature = tile(image)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, hashlib.sha256(small).hexdigest()


def op5_media(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload and media digests, the difference hash (feature) and the tile's digest of all documents'
    texts. A null text counts as empty: one row of 255s, like an empty one; repeated rows and ties are stored one by one with
    equal values; an empty table gives an empty one; other columns of documents aren't read. A text is held whole, and
    its image, grey plane and integral image take some 10 times its bytes, so the longest must fit in a task's memory so often."""
    kinds = [("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string()), ("tile_sha256", T.StringType(), pa.string())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = common.text_views(batch.column(batch.schema.names.index("text")))
        rows = [store_payload(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(kinds)]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return common.append_columns(docs, [T.StructField(name, kind) for name, kind, _ in kinds], compute).drop("text")


SQL: dict[str, str] = {}
