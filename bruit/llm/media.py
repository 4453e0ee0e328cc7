"""Media columns: PNG images of byte payloads, and perceptual hashes (operator 9).

A payload of 192 bytes a row becomes an RGB image 64 pixels wide.  ``png_write``
makes signature, header, zlib-compressed data and end chunks with checksums;
``png_read`` tests signature and every checksum, joins the data chunks, and
undoes the row filters with numpy.  ``dct_hash`` averages the image to 32 x 32
grey cells and keeps the signs of its low cosine frequencies against their
median, as 8 bytes.

Defined results: null or empty text is one row of blanks; any text length works,
in memory proportional to the text; equal texts give equal values; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, pick, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class MediaParams:
    """``width`` in pixels of three bytes; ``level`` of compression; ``chunk`` bytes of a data chunk."""

    width: int = 64
    level: int = 1
    chunk: int = 1 << 20
    pad: int = 32


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_write(payload: bytes, p: MediaParams = MediaParams()) -> bytes:
    """An 8-bit RGB image of whole rows; each row has the filter (none or up) that leaves fewer distinct runs."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, p.width * 3)
    up = rows.copy()
    up[1:] -= rows[:-1]
    # A row equal to the one above becomes zeros; text compresses best as it is.
    kind = (up == 0).mean(axis=1) > 0.5
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = kind * 2
    lines[:, 1:] = np.where(kind[:, None], up, rows)
    data = zlib.compress(lines.tobytes(), p.level)
    head = struct.pack(">IIBBBBB", p.width, len(rows), 8, 2, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + p.chunk]) for i in range(0, len(data), p.chunk))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def png_read(image: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit grey, RGB, or RGBA image; ValueError if it is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, head, data = 8, None, []
    while True:
        if at + 12 > len(image):
            raise ValueError("the image ends early")
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if image[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("a kind of image that isn't read here")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("wrong size of the image's data")
    lines = raw.reshape(height, width * channels + 1)
    return _unfilter(lines[:, 0], lines[:, 1:], channels).reshape(height, width, channels)


def _unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    out = lines.copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    zero = np.zeros(lines.shape[1], np.uint8)
    at = 0
    while at < len(out):
        kind, end = kinds[at], at + 1
        if kind in (0, 1, 2):  # runs of rows of the same filter go at once
            while end < len(out) and kinds[end] == kind:
                end += 1
        if kind == 1:
            pixels = out[at:end].reshape(end - at, -1, step)
            out[at:end] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(end - at, -1)
        elif kind == 2:
            if at:
                out[at] += out[at - 1]
            out[at:end] = np.cumsum(out[at:end], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            _unfilter_row(out[at], out[at - 1] if at else zero, kind, step)
        at = end
    return out


def _unfilter_row(row: np.ndarray, above: np.ndarray, kind: int, step: int) -> None:
    """Average or Paeth: each pixel needs the one before it; its channels go together."""
    left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
    for i in range(0, len(row), step):
        up = above[i : i + step].astype(np.int32)
        if kind == 3:
            guess = (left + up) >> 1
        else:
            base = left + up - corner
            a, b, c = abs(base - left), abs(base - up), abs(base - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = (row[i : i + step] + guess) & 255
        row[i : i + step] = left
        corner = up


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), 2 * np.arange(n) + 1) / (2 * n))


_BASE = _cosines(32, 8)


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Averages of the first axis in ``n`` ranges; an axis shorter than that is repeated."""
    if len(a) < n:
        a = np.repeat(a, -(-n // len(a)), axis=0)
    cuts = np.arange(n) * len(a) // n
    return np.add.reduceat(a, cuts, axis=0) / np.diff([*cuts, len(a)])[:, None]


def dct_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies (the constant one aside) exceed their median."""
    grey = samples.sum(axis=2, dtype=np.float64) / samples.shape[2]
    small = _means(_means(grey, 32).T, 32).T
    low = np.round(_BASE @ small @ _BASE.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def media(docs: DataFrame, p: MediaParams = MediaParams()) -> DataFrame:
    """Per document the stored image and what is read back from it:
    doc_id, n_bytes, image (binary), payload (binary), feature (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = p.width * 3
        for b in batches:
            for k in range(0, len(b), 200):
                part, rows = b.iloc[k : k + 200], []
                for text in part["text"]:
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    short = -len(raw) % unit if raw else unit
                    image = png_write(raw + bytes([p.pad]) * short, p)
                    samples = png_read(image)
                    rows.append((len(raw), image, samples.tobytes(), dct_hash(samples)))
                out = pd.DataFrame(rows, columns=["n_bytes", "image", "payload", "feature"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_pandas(docs, run, "doc_id long, n_bytes long, image binary, payload binary, feature binary")


def op9_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(table(spark, sf_dir, "documents"))
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
