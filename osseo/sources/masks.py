"""Stores of masks that were made beforehand: packed bits by frame, and pictures in a folder; frames without one get a live mask."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type


def packed(mask: np.ndarray) -> bytes:
    """A mask as bits, eight pixels a byte, the first in the highest bit."""
    return np.packbits(np.asarray(mask, bool).ravel()).tobytes()


def unpacked(store: DataFrame) -> DataFrame:
    """frame_id, y, x of the set pixels of packed masks (frame_id, h, w, bits); a mask with too few bits is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame_id, h, w, bits in zip(batch.frame_id, batch.h, batch.w, batch.bits, strict=True):
                if bits is None or len(bits) * 8 < h * w:
                    continue
                y, x = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: h * w].reshape(h, w))
                yield pd.DataFrame({"frame_id": frame_id, "y": y, "x": x})

    kind = dict(store.dtypes)["frame_id"]
    return store.select("frame_id", "h", "w", "bits").mapInPandas(run, f"frame_id {kind}, y int, x int")


def decoded(data: bytes) -> np.ndarray:
    """The grey values of a PNG picture: the first sample of grey ones, the usual weights of colours, indices of palettes.

    Bit depths of 1 to 16 (the high byte), all row filters; interlaced pictures are an error.
    """
    if data[:8] != _SIGNATURE:
        raise ValueError("no picture")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced pictures are not supported")
    samples = _SAMPLES[colour]
    step, stride = max(1, samples * depth // 8), (w * samples * depth + 7) // 8
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, stride + 1)
    rows, above = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        above = rows[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * samples]
        values = bits @ (1 << np.arange(depth)[::-1])
        return (values * 255 // ((1 << depth) - 1) if colour != 3 else values).astype(np.uint8)
    grid = rows.reshape(h, w, samples, depth // 8)[..., 0]
    if colour in (2, 6):
        return np.rint(grid[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return grid[..., 0]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its filtered ones and the row above."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    out = np.zeros(len(line) + step, np.int64)  # ``step`` zeros before the first pixel
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    if kind == 1:  # each byte adds to that of the pixel before: a running sum of its own for each place in a pixel
        for k in range(step):
            out[step + k :: step] = np.cumsum(line[k::step].astype(np.int64)) & 255
        return out[step:].astype(np.uint8)
    for i, v in enumerate(line.tolist(), step):
        left, over, corner = int(out[i - step]), int(up[i]), int(up[i - step])
        if kind == 3:
            guess = (left + over) // 2
        else:
            near = left + over - corner
            guess = min((abs(near - left), 0, left), (abs(near - over), 1, over), (abs(near - corner), 2, corner))[2]
        out[i] = (v + guess) & 255
    return out[step:].astype(np.uint8)


def encoded(grey: np.ndarray) -> bytes:
    """Grey values as a PNG picture of eight bits."""
    h, w = grey.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.asarray(grey, np.uint8)], 1)
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """frame_id (the file's name without suffix), y, x, value of the pixels of the PNG files of a folder; broken ones give nothing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("frame_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame_id, content in zip(batch.frame_id, batch.content, strict=True):
                try:
                    grid = decoded(content)
                except (ValueError, KeyError, TypeError, struct.error, zlib.error):
                    continue
                y, x = np.indices(grid.shape)
                yield pd.DataFrame({"frame_id": frame_id, "y": y.ravel(), "x": x.ravel(), "value": grid.ravel()})

    return files.mapInPandas(run, "frame_id string, y int, x int, value int")


def with_fallback(frames: DataFrame, store: DataFrame | None, live: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """Rows of ``store`` for the frames (frame_id) that it has, and of ``live`` for the others; ``live`` may give none (None).

    ``live`` gets only the frames that the store lacks, as one frame may cost much.
    """
    wanted = frames.select("frame_id").distinct()
    if store is None:
        return live(wanted)
    held = store.join(wanted, "frame_id", "left_semi")
    more = live(wanted.join(store.select("frame_id").distinct(), "frame_id", "left_anti"))
    return held if more is None else held.unionByName(more)
