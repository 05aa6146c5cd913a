"""Radar tiles as they are published: PNG files, one a tile, scanned in parallel."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.sources.feeds import complete_frames, tile_hits

# Fixed values of the format: the first bytes of a file, and how many bytes a pixel has by kind of colour (grey, RGB, palette, grey with alpha, RGBA).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
STRIDE = 2
#: Frame, column and row of a tile in its path.
PLACE = r"(\d+)/(\d+)/(\d+)\.png$"
PIXELS = "frame_time long, x long, y long, px int, py int, r int, g int, b int, a int"


class NotATile(ValueError):
    """A file that is no PNG this reader knows."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise NotATile("no signature")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise NotATile("a chunk is cut off or damaged")
        yield kind, body
        at += 12 + size


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes with the filter that each row names in its first byte undone; ``step`` bytes make a pixel.

    Three filters add what is known of a whole row at once; the mean and the predictor of three
    neighbours need the pixel before, so that they go from pixel to pixel, all channels together.
    """
    rows = np.zeros((raw.shape[0], raw.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(rows.shape[1], dtype=np.uint8)
    for k, (how, row) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        if how == 0:
            own = row
        elif how == 1:
            own = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            own = row + above
        elif how in (3, 4):
            left, corner = [0] * step, [0] * step
            done = bytearray()
            up, given = above.tolist(), row.tolist()
            for at in range(0, len(given), step):
                over = up[at : at + step]
                if how == 3:
                    left = [(given[at + c] + (left[c] + over[c]) // 2) & 255 for c in range(step)]
                else:
                    left = [(given[at + c] + _nearest(left[c], over[c], corner[c])) & 255 for c in range(step)]
                    corner = over
                done += bytes(left)
            own = np.frombuffer(bytes(done), dtype=np.uint8)
        else:
            raise NotATile(f"filter {how}")
        rows[k] = above = own
    return rows


def _nearest(left: int, over: int, corner: int) -> int:
    """Of three neighbours the one that is nearest to left + over - corner; of equals in this order."""
    guess = left + over - corner
    return min((left, over, corner), key=lambda x: abs(guess - x))


def decoded(data: bytes) -> np.ndarray:
    """``[row, column, (r, g, b, a)]`` of a PNG with eight bits a sample, not interlaced."""
    head, body, shades, clear = None, [], None, b""
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            shades = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise NotATile("not eight bits a sample, or interlaced")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    except zlib.error as error:
        raise NotATile(str(error)) from error
    if len(raw) != height * (width * step + 1):
        raise NotATile("more or fewer pixels than the head says")
    p = _unfiltered(raw.reshape(height, -1), step).reshape(height, width, step)
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if head[3] == 3:
        if shades is None or p.max(initial=0) >= len(shades):
            raise NotATile("a pixel without a shade")
        alpha = np.full(len(shades), 255, dtype=np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, dtype=np.uint8)[: len(shades)]
        out[..., :3], out[..., 3] = shades[p[..., 0]], alpha[p[..., 0]]
    else:
        out[..., :3] = p[..., :3] if step >= 3 else p[..., :1]
        if step in (2, 4):
            out[..., 3] = p[..., -1]
    return out


def _pixels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PIXELS.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            frame, x, y, content = (batch.column(c)[row].as_py() for c in ("frame_time", "x", "y", "content"))
            try:
                own = decoded(content)[::STRIDE, ::STRIDE]
            except NotATile:
                # A row of nulls: a tile that came and could not be read, which its frame lacks.
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((frame, x, y, *[None] * 6), _KINDS, strict=True)], names=names)
                continue
            py, px = np.mgrid[0 : own.shape[0], 0 : own.shape[1]] * STRIDE
            seen = own[..., 3].ravel() > 0
            # A clear tile has a pixel too, so that it counts as there.
            seen[0] = True
            n = int(seen.sum())
            flat = [px.ravel()[seen], py.ravel()[seen], *(own[..., c].ravel()[seen] for c in range(4))]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, v), pa.int64()) for v in (frame, x, y)), *(pa.array(v.astype(np.int32)) for v in flat)], names=names)


_KINDS = [pa.int64()] * 3 + [pa.int32()] * 6


def tile_files(spark: SparkSession, folder: str) -> DataFrame:
    """``frame_time, x, y, content`` of the tiles in a folder, ``<frame>/<column>/<row>.png``; other files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).where(F.col("path").rlike(PLACE))
    at = lambda k: F.regexp_extract("path", PLACE, k).cast("long")
    return files.select(at(1).alias("frame_time"), at(2).alias("x"), at(3).alias("y"), "content")


def tile_pixels(files: DataFrame) -> DataFrame:
    """Every second pixel both ways of tiles, those that are not clear (``PIXELS``); a tile that cannot be read is one row without a pixel. A task holds one batch of tiles."""
    return files.mapInArrow(_pixels, PIXELS)


def scan_tiles(spark: SparkSession, folder: str, cover: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (``frame_time, lat, lon, rate``) of all frames in a folder of tiles, and ``frame_time, complete``: whether every tile of the ``cover`` (x, y) came and could be read."""
    pixels = tile_pixels(tile_files(spark, folder))
    read = pixels.where("px is not null")
    frames = tile_files(spark, folder).select("frame_time").distinct()
    whole = frames.join(complete_frames(read.select("frame_time", "x", "y").distinct(), cover), "frame_time", "left").select("frame_time", F.coalesce("complete", F.lit(False)).alias("complete"))
    return tile_hits(read), whole
