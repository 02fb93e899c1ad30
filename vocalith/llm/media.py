"""Media columns: texts as PNG images in a binary column, and features of what is read back.

A text's UTF-8 bytes, padded with spaces to rows of 192, are the 8-bit RGB samples of an image 64 pixels wide.  The
encoder filters rows (none, Sub or Up, whichever leaves the least sum of differences) and writes zlib chunks with
checksums.  The decoder tests signature, order and checksum of the chunks, inflates, unfilters all five kinds with
numpy and returns the samples.  The feature is the sign pattern of an image's 8 x 8 lowest cosine frequencies.

Cases: a null or empty text is one row of spaces; equal texts have equal images and features; any length works, rows
are encoded one by one in constant passes; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vocalith.llm.common import utf8

WIDTH, CHANNELS = 64, 3
STRIDE = WIDTH * CHANNELS
LEVEL = 4
#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def payload(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % STRIDE if text else STRIDE)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, STRIDE)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, CHANNELS:], above[1:] = rows[:, :-CHANNELS], rows[:-1]
    choices = (rows, rows - left, rows - above)
    kind = min((NONE, SUB, UP), key=lambda k: int(np.abs(choices[k].view(np.int8)).sum(dtype=np.int64)))
    filtered = np.empty((len(rows), STRIDE + 1), np.uint8)
    filtered[:, 0], filtered[:, 1:] = kind, choices[kind]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """height x width x channels samples of an 8-bit grey, RGB or RGBA image without interlacing; ValueError if broken."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, header, ended = 8, [], None, False
    while at < len(png):
        if len(png) < at + 12:
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        data, crc = png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if header is None or not ended:
        raise ValueError("no header or end")
    width, height, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("kind of image not supported")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != height * (width * channels + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(height, -1), channels).reshape(height, width, channels)


def unfilter(filtered: np.ndarray, channels: int) -> np.ndarray:
    """Runs of rows with one filter: None is a copy, Sub sums along a row and Up down the rows; the others go by pixel."""
    kinds, rows = filtered[:, 0], filtered[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(rows)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        kind = int(kinds[lo])
        if kind == SUB:
            pixels = rows[lo:hi].reshape(hi - lo, -1, channels)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == UP:
            if lo:
                rows[lo] += rows[lo - 1]
            np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8, out=rows[lo:hi])
        elif kind in (AVERAGE, PAETH):
            for y in range(lo, hi):
                _by_pixel(rows, y, channels, kind)
        elif kind > PAETH:
            raise ValueError("unknown filter")
    return rows


def _by_pixel(rows: np.ndarray, y: int, channels: int, kind: int) -> None:
    above = rows[y - 1].astype(np.int16) if y else np.zeros(rows.shape[1], np.int16)
    row, zero = rows[y].astype(np.int16), np.zeros(channels, np.int16)
    for x in range(0, len(row), channels):
        now = slice(x, x + channels)
        a, b = (row[x - channels : x] if x else zero), above[now]
        if kind == AVERAGE:
            guess = (a + b) // 2
        else:
            c = above[x - channels : x] if x else zero
            pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        row[now] = (row[now] + guess) & 255
    rows[y] = row


GRID, LOW = 32, 8
_COSINES = np.cos(np.pi / GRID * (np.arange(GRID) + 0.5)[None, :] * np.arange(LOW)[:, None])


def low_frequency_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 64 lowest cosine frequencies of the 32 x 32 grey image are over their median."""
    grey = image.mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(GRID + 1) * n // GRID
        sums = np.concatenate([np.zeros_like(np.take(grey, [0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
        lo, hi = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
        shape = (-1, 1) if axis == 0 else (1, -1)
        grey = (np.take(sums, hi, axis) - np.take(sums, lo, axis)) / (hi - lo).reshape(shape)
    low = np.round(_COSINES @ grey @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media (PNG) in place of the text. No shuffle."""
    own = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "media")]

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch, text)
            columns = [batch.column(f.name) for f in own]
            columns += [pa.array(map(len, texts), pa.int64()), pa.array([encode_png(payload(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in own), "n_bytes", "media"])

    schema = T.StructType([*own, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(*[f.name for f in own], text).mapInArrow(encode, schema)


FEATURES = (
    ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
)


def describe(media: DataFrame) -> DataFrame:
    """Decodes the media column; its digests and features replace it."""
    own = [f for f in media.schema.fields if f.name not in {"media", *(n for n, _ in FEATURES)}]

    def one(png: bytes) -> tuple:
        image = decode_png(png)
        data = image.tobytes()
        return (
            len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]),
            len(png), hashlib.sha256(png).hexdigest(), low_frequency_hash(image),
        )

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            found = [one(x) for x in batch.column("media").to_pylist()]
            kinds = [pa.int64() if isinstance(k, T.LongType) else pa.string() for _, k in FEATURES]
            columns = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *columns], [*(f.name for f in own), *(n for n, _ in FEATURES)])

    schema = T.StructType([*own, *(T.StructField(n, k) for n, k in FEATURES)])
    return media.select(*[f.name for f in own], "media").mapInArrow(decode, schema)
