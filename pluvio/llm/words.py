"""Words of many texts at once, as numpy arrays over Arrow buffers.

A word is a maximal run of bytes other than space and tab to carriage return; these six are single
bytes in UTF-8, so that words of bytes are words of code points. Texts are taken in pieces of a few
MB, whole texts each, which bounds the memory of a task; one text above that size is a piece alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * GOLDEN
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Piece:
    """Some whole texts: ``data`` their bytes, ``ends[i]:ends[i + 1]`` the bytes of text i, ``first`` the row of text 0."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int) -> None:
        self.data, self.ends, self.first, self.n = data, ends, first, len(ends) - 1

    def words(self, data: np.ndarray | None = None, blank: np.ndarray | None = None) -> None:
        """Sets ``starts`` and ``stops`` of the words in bytes, ``per_text`` their number and ``bounds``: text i has words ``bounds[i]:bounds[i + 1]``."""
        solid = ~(IS_BLANK[self.data if data is None else data] if blank is None else blank)
        edge = np.zeros(len(solid) + 1, dtype=bool)
        edge[self.ends] = True
        before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
        after = np.concatenate((solid[1:], [False])) & ~edge[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.stops = np.flatnonzero(solid & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.ends)
        self.per_text = np.diff(self.bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[starts[i]:stops[i]]``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = stops - starts
    total = int(length.sum())
    at = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    value = BYTE[data[np.repeat(starts, length) + at]] * powers(GOLDEN, int(length.max()))[at]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * STEP)


def hash_runs(word: np.ndarray, k: int, factor: np.uint64 = GOLDEN) -> np.ndarray:
    """64-bit hashes of every ``k`` consecutive words, as if all were of one text; ``len(word) - k + 1`` of them."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = word[:n].copy()
    for i in range(1, k):
        h = h * factor + word[i : n + i]
    return mix(h)


def inside(bounds: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the ``n_words - k + 1`` runs of ``k`` words lie within one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(n, dtype=bool)
    for i in range(1, k):
        cut = bounds[1:-1] - i
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the ends between them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[Piece]:
    data, ends = texts(column)
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield Piece(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], i)
        i = j


def per_piece(f: Callable[[Piece, pa.RecordBatch], pa.RecordBatch | None], text_col: str = "text", most: int = PIECE_BYTES) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``f(piece, rows)`` on each piece of the batches, with the piece's rows; pieces have about ``most`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(text_col), most):
                out = f(piece, batch.slice(piece.first, piece.n))
                if out is not None and out.num_rows:
                    yield out

    return run


def _slices(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``most`` bytes."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > most):
        half = batch.num_rows // 2
        yield from _slices(batch.slice(0, half), rows, most)
        yield from _slices(batch.slice(half), rows, most)
    elif batch.num_rows:
        yield batch


def per_group(f: Callable[[pa.Table], pa.RecordBatch | None], key: str, rows: int = 4096, most: int = 4 << 20) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows sorted by ``key``: ``f`` on tables of whole groups, of about ``rows`` rows, ``most`` bytes, or one group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in (part for b in batches for part in _slices(b, rows, most)):
            if held and (n >= rows or size >= most):
                # A full table ends where a group does.
                keys = batch.column(key).to_numpy(zero_copy_only=False)
                own = int((keys != held[-1].column(key)[-1].as_py()).argmax()) if keys[-1] != held[-1].column(key)[-1].as_py() else len(keys)
                if own < len(keys):
                    done, held, n, size = pa.Table.from_batches([*held, batch.slice(0, own)]), [], 0, 0
                    batch = batch.slice(own)
                    if (out := f(done)) is not None and out.num_rows:
                        yield out
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if held and (out := f(pa.Table.from_batches(held))) is not None and out.num_rows:
            yield out

    return run
