"""Media columns: texts or bytes as PNG images in a binary column, their checked decoding, and cosine-transform hashes.

A payload becomes an 8-bit grey image of 64 columns: signature, IHDR, zlib-compressed IDAT chunks, IEND, each chunk with
its CRC-32. Every row takes the filter (none, sub, up, average, Paeth) whose residuals have the least absolute sum; ties go to
the first. `stored` writes images, `described` reads any such column: it tests every checksum, inflates, undoes the filters
with numpy along diagonals of several images at once, and adds digests and the hash: the sign pattern of the 8 x 8 lowest
frequencies of a 32 x 32 thumbnail's cosine transform against their median, as 8 bytes.

Defined results: a null or empty text is one row of 64 zero bytes; texts are taken whole whatever their length; equal
texts have equal images and features, and rows that repeat are described each; a null image has null results; a damaged image
raises ValueError naming the test that failed. Columns of the input other than those named are dropped, so clashing
names do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 20
#: Bytes of images whose filters are undone at once.
TOGETHER = 1 << 20
STORED = "doc_id long, n_bytes long, media binary"
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _guesses(rows: np.ndarray) -> np.ndarray:
    """What each filter expects of each sample: filters x rows x columns."""
    left, up, corner = np.zeros((3, *rows.shape), np.int16)
    left[:, 1:], up[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    return np.stack([np.zeros_like(left), left, up, (left + up) >> 1, _paeth(left, up, corner)])


def encode_png(payload: bytes, level: int = 6, kinds: tuple[int, ...] = ()) -> bytes:
    """A grey image of 64 columns; row r uses the filter kinds[r % len(kinds)], or the one of least absolute sum if none are named."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [_filtered(rows, max(a - 1, 0), a, min(a + 16_384, len(rows)), kinds) for a in range(0, len(rows), 16_384)]
    body = zlib.compress(b"".join(parts), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)) + _chunk(b"IEND", b"")


def _filtered(rows: np.ndarray, before: int, a: int, b: int, kinds: tuple[int, ...]) -> bytes:
    """Rows a to b with their filter bytes; `before` is the row above, or a itself at the top."""
    part = rows[before:b]
    residual = (part - _guesses(part)).astype(np.uint8)[:, a - before :]
    if kinds:
        kind = np.array(kinds, np.uint8)[np.arange(a, b) % len(kinds)]
    else:
        kind = np.abs(residual.view(np.int8).astype(np.int16)).sum(2).argmin(0).astype(np.uint8)
    return np.concatenate([kind[:, None], residual[kind, np.arange(b - a)]], 1).tobytes()


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def inflated(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(filters of the rows, filtered rows) of an 8-bit grey image; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, body, head, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError(f"the image ends inside a chunk at {at}")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        part, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + part):
            raise ValueError(f"checksum of chunk {kind!r} at {at} does not hold")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no header, no end, or not an 8-bit grey image without interlace")
    wide, high = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != high * (wide + 1):
        raise ValueError("the number of samples does not fit the header")
    raw = raw.reshape(high, wide + 1)
    if high and raw[:, 0].max() > 4:
        raise ValueError("unknown row filter")
    return raw[:, 0], raw[:, 1:]


def decode_png(media: bytes) -> np.ndarray:
    """The samples (rows x columns) of an 8-bit grey image."""
    return unfiltered([inflated(media)])[0]


def unfiltered(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Undoes the row filters of images (filters, rows): those of like size together, TOGETHER bytes at once."""
    out: list = [None] * len(images)
    group: list[int] = []
    for i in sorted(range(len(images)), key=lambda i: images[i][1].shape[::-1]):
        high, wide = images[i][1].shape
        if group and (wide != images[group[0]][1].shape[1] or (len(group) + 1) * high * wide > TOGETHER):
            _undo(images, group, out)
            group = []
        group.append(i)
    if group:
        _undo(images, group, out)
    return out


def _undo(images: list, group: list[int], out: list) -> None:
    """A sample needs those to its left and above, so the samples of one diagonal, of all images, are made at once."""
    high, wide = images[group[-1]][1].shape
    raw = np.zeros((high, wide, len(group)), np.uint8)
    kinds = np.zeros((high, len(group)), np.uint8)
    for j, i in enumerate(group):
        kinds[: len(images[i][0]), j], raw[: len(images[i][1]), :, j] = images[i]
    done = np.zeros((high + 1, wide + 1, len(group)), np.uint8)
    simple = not (kinds > 2).any()
    for t in range(high + wide - 1):
        r = np.arange(max(0, t - wide + 1), min(high, t + 1))
        c = t - r
        kind, left, up = kinds[r], done[r + 1, c].astype(np.int16), done[r, c + 1].astype(np.int16)
        guess = np.where(kind == 1, left, 0) + np.where(kind == 2, up, 0)
        if not simple:
            guess += np.where(kind == 3, (left + up) >> 1, 0) + np.where(kind == 4, _paeth(left, up, done[r, c].astype(np.int16)), 0)
        done[r + 1, c + 1] = raw[r, c] + guess.astype(np.uint8)
    for j, i in enumerate(group):
        out[i] = done[1 : len(images[i][1]) + 1, 1:, j]


_K = np.arange(32)
_DCT = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:8, None] / 64)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the lowest frequencies of the 32 x 32 thumbnail lie above their median."""
    high, wide = samples.shape
    cols = np.add.reduceat(samples, np.arange(32) * wide // 32, axis=1, dtype=np.int64) if wide >= 32 else samples[:, np.arange(32) * wide // 32].astype(np.int64)
    if high >= 32:
        edge = np.arange(33) * high // 32
        small = np.add.reduceat(cols, edge[:-1], axis=0) / np.diff(edge)[:, None]
    else:
        small = cols[np.arange(32) * high // 32].astype(float)
    low = (_DCT @ small @ _DCT.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes()


def stored(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes and the whole text as an image in a binary column."""

    def convert(batches):
        import pyarrow as pa

        for batch in batches:
            data, at = utf8(batch.column("text"))
            media = [encode_png(padded(data[at[i] : at[i + 1]].tobytes()), level) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(convert, STORED)


def described(media: DataFrame) -> DataFrame:
    """What the images of a binary column hold; see DESCRIBED. media: doc_id, n_bytes, media."""

    def convert(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DESCRIBED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            images = batch.column("media").to_pylist()
            there = [i for i, m in enumerate(images) if m is not None]
            cols: list[list] = [[None] * len(images) for _ in kinds]
            for i, samples in zip(there, unfiltered([inflated(images[i]) for i in there]), strict=True):
                back = samples.tobytes()
                for col, v in zip(cols, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(images[i]), hashlib.sha256(images[i]).hexdigest(), cosine_hash(samples)), strict=True):
                    col[i] = v
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(convert, DESCRIBED)
