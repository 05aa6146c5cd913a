"""Removing passages that stood earlier in the corpus: anchors from winnowing, extended both ways."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.runtime import cut, dealt_anew
from pluvio.llm.words import GOLDEN, STEP, Piece, hash_runs, hash_words, inside, mix, per_piece, powers

#: Words of a winnowed gram. A passage of ``length`` words holds ``length - GRAM + 1`` of them, and its anchor is the least.
GRAM = 6
#: Runs of one anchor that are compared with its first one in a group.
GROUP = 500
#: Up to so many ids are broadcast to pick texts before these are shuffled.
BROADCAST_IDS = 500_000


class Spans:
    """The words of a piece, hashed so that any span of them has a hash at once."""

    def __init__(self, word: np.ndarray, bounds: np.ndarray) -> None:
        self.word, self.bounds, self.n = word, bounds, len(word)
        self.sums: dict[np.uint64, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, piece: Piece) -> Spans:
        piece.words()
        return cls(hash_words(piece.data, piece.starts, piece.stops), piece.bounds)

    def hashes(self, starts: np.ndarray, stops: np.ndarray, base: np.uint64 = GOLDEN) -> np.ndarray:
        """Hashes of the words ``starts[i]:stops[i]``, alike for like words wherever they stand."""
        if base not in self.sums:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            self.sums[base] = np.concatenate(([np.uint64(0)], np.cumsum(self.word * powers(base, self.n), dtype=np.uint64))), powers(inverse, self.n + 1)
        total, back = self.sums[base]
        return mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Starts of the windows of ``length`` words that lie within one text."""
        return np.flatnonzero(inside(self.bounds, self.n, length))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


def _least(a: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values."""
    done = 1
    while done < k:
        step = min(done, k - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    return a


def _runs(length: int):
    """Runs of windows with one anchor: start, number of windows, anchor, and the hash of all their words."""

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        spans = Spans.of(piece)
        at = spans.windows(length)
        if not len(at):
            return None
        anchor = _least(hash_runs(spans.word, GRAM), length - GRAM + 1)[at]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
        size = np.diff(np.concatenate((new, [len(at)])))
        start = at[new]
        text = spans.text_of(start)
        content = spans.hashes(start, start + size + length - 1)
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(text)), pa.array((start - spans.bounds[text]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor[new].view(np.int64)), pa.array(content.view(np.int64))],
            names=["doc_id", "start", "size", "anchor", "content"],
        )

    return per_piece(run)


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists, and the named fields of the structs."""
    filled = column.is_valid().to_numpy(zero_copy_only=False)
    length = np.where(filled, np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    flat = column.drop_null().flatten()
    return np.repeat(np.arange(len(column)), length), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _contexts(length: int):
    """The words of the runs listed with each text, as hashes, where in them the anchor stands, and whether it stands there once. Of an anchor's first run a copy goes to each of its groups (``salts``)."""

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        spans = Spans.of(piece)
        text, (start, size, anchor, content, n, lead, salt, salts) = _lists(rows.column("runs"), "start", "size", "anchor", "content", "n", "lead", "salt", "salts")
        start, size = start.astype(np.int64) + spans.bounds[text], size.astype(np.int64)
        ok = start + size + length - 1 <= spans.bounds[text + 1]
        # Rows of one id may hold other texts.
        ok[ok] = spans.hashes(start[ok], (start + size + length - 1)[ok]).view(np.int64) == content[ok]
        text, start, size, anchor, n, lead, salt, salts = (x[ok] for x in (text, start, size, anchor, n, lead, salt, salts))
        if not len(text):
            return None
        gram, at = hash_runs(spans.word, GRAM).view(np.int64), start + size - 1
        for _ in range(length - GRAM):
            at = at + (gram[at] != anchor)
        grams = size + length - GRAM
        inside_ = np.repeat(start - np.cumsum(grams) + grams, grams) + np.arange(int(grams.sum()))
        once = np.add.reduceat((gram[inside_] == np.repeat(anchor, grams)).astype(np.int64), np.cumsum(grams) - grams) == 1
        copies = np.where(lead, salts, 1)
        row = np.repeat(np.arange(len(text)), copies)
        salt = np.where(lead[row], np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies), salt[row])
        words = [spans.word[a:b].tobytes() for a, b in zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)]
        out = {
            "doc_id": rows.column("doc_id").take(pa.array(text[row])), "start": pa.array((start - spans.bounds[text])[row].astype(np.int32)), "anchor": pa.array(anchor[row]), "salt": pa.array(salt.astype(np.int32)), "lead": pa.array(lead[row]),
            "n": pa.array(n[row]), "at": pa.array((at - start)[row].astype(np.int32)), "once": pa.array(once[row]), "words": pa.array(words, pa.binary()).take(pa.array(row)),
        }
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return per_piece(run)


CONTEXT = "doc_id long, start int, anchor long, salt int, lead boolean, n long, at int, once boolean, words binary"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, one after the other, and how many a row has."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), dtype=np.uint64), np.fromiter((len(w) // 8 for w in held), np.int64, len(held))


def _aligned(flat: np.ndarray, n: np.ndarray, at: np.ndarray, wide: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """The words in rows of ``wide``, each shifted so that its anchor, word ``at``, stands in column ``left``; and which are filled."""
    row = np.repeat(np.arange(len(n)), n)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) - np.repeat(at, n) + left
    ok = (column >= 0) & (column < wide)  # runs over a text that repeats itself may be longer
    out, filled = np.zeros((len(n), wide), np.uint64), np.zeros((len(n), wide), bool)
    out[row[ok], column[ok]], filled[row[ok], column[ok]] = flat[ok], True
    return out, filled


def _extend(length: int):
    """Each run against the first of its group, which goes before it: the match extended to the left and to the right of the anchor, and the windows that it leaves, as hashes."""
    left, wide = length - GRAM, 2 * length - GRAM

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (b.slice(i, 8192) for b in batches for i in range(0, b.num_rows, 8192)):
            fresh = 0 if held is None else 1
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            column = lambda c: table.column(c).to_numpy()
            doc, start, at, lead, anchor = column("doc_id"), column("start").astype(np.int64), column("at").astype(np.int64), column("lead"), column("anchor")
            flat, n = _words(table.column("words"))
            own, filled = _aligned(flat, n, at, wide, left)
            first = np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))
            beside = lead[first] & (anchor[first] == anchor)
            equal = (own == own[first]) & filled & filled[first]
            low = left - np.cumprod(equal[:, :left][:, ::-1], axis=1).sum(axis=1)
            high = left + np.cumprod(equal[:, left:], axis=1).sum(axis=1)
            match = beside & (high - low >= length) & (high > left) & (doc[first] < doc)
            # Of two runs whose anchors stand at one place each, the match says all.
            settled = beside & (column("n") == 2) & column("once") & column("once")[first]
            held = table.slice(int(first[-1]), 1).combine_chunks().to_batches()[0] if lead[first[-1]] else None
            words = Spans(flat, np.concatenate(([0], np.cumsum(n))))
            base, origin = words.bounds[:-1], left - at
            windows = np.where(settled, 0, n - length + 1)
            windows[:fresh] = 0
            row = np.repeat(np.arange(len(n)), windows)
            k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            alone = ~(match[row] & (k + origin[row] >= low[row]) & (k + origin[row] + length <= high[row]))
            row, k = row[alone], k[alone]
            match[:fresh] = False
            hit = np.flatnonzero(match)
            a, b = (low - origin)[hit], (high - origin)[hit]
            content = words.hashes(base[hit] + a, base[hit] + b)
            whole, second = words.hashes(base[row] + k, base[row] + k + length), words.hashes(base[row] + k, base[row] + k + length, STEP)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((doc[hit], doc[row]))), pa.array(np.concatenate((start[hit] + a, start[row] + k)).astype(np.int32)), pa.array(np.concatenate((start[hit] + b, start[row] + k + length)).astype(np.int32)),
                    pa.array(np.concatenate((content, whole)).view(np.int64)), pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(second.view(np.int64))]),
                ],
                names=["doc_id", "start", "stop", "content", "second"],
            )

    return run


def _cover(length: int):
    """What is left of each text without the listed spans and without windows that stood earlier in the text itself."""

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
        spans = Spans.of(piece)
        covered = np.zeros(spans.n + 1, dtype=np.int64)
        text, (start, stop, content) = _lists(rows.column("spans"), "start", "stop", "content")
        start, stop = start.astype(np.int64) + spans.bounds[text], stop.astype(np.int64) + spans.bounds[text]
        ok = stop <= spans.bounds[text + 1]
        start, stop = start[ok], stop[ok]
        ok = spans.hashes(start, stop).view(np.int64) == content[ok]
        np.add.at(covered, start[ok], 1)
        np.add.at(covered, stop[ok], -1)
        every = np.arange(max(0, spans.n - length + 1))
        window = spans.hashes(every, every + length)
        for a, b in zip(spans.bounds[:-1].tolist(), spans.bounds[1:].tolist(), strict=True):
            own = window[a : max(a, b - length + 1)]
            inorder = np.sort(own)
            if (inorder[1:] == inorder[:-1]).any():
                order = np.argsort(own, kind="stable")
                again = a + order[1:][own[order[1:]] == own[order[:-1]]]
                np.add.at(covered, again, 1)
                np.add.at(covered, again + length, -1)
        gone = np.cumsum(covered[:-1]) > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[spans.bounds])
        data, kept, ends = piece.data.tobytes(), [], piece.ends.tolist()
        bounds = spans.bounds.tolist()
        for i in range(piece.n):
            words = data[ends[i] : ends[i + 1]].split()
            if removed[i]:
                words = [w for w, x in zip(words, gone[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not x]
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(spans.bounds)), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return per_piece(run)


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a window of ``length`` words covers whose words start earlier too, in a smaller id or earlier in the same text.

    Each window has an anchor, the least hash of its grams, so that equal windows have equal
    anchors (winnowing). Anchors that only one id has are dropped. A run is all windows of one
    occurrence of an anchor; runs of the same words are of one kind, and all but the first of a kind
    are repeats. Where an anchor has several kinds, the first run of each is extended from the
    anchor to the left and to the right against the anchor's first occurrence, and the maximal match
    is a repeat if it holds ``length`` words. Windows that this leaves may still repeat each other;
    these are compared by hashes of 128 bits. What repeats within a text is found there. So no pair
    of occurrences is formed but with the first, whatever their number, and nothing is lost.

    A null text has no words. A row without id removes nothing elsewhere and is judged by itself.
    Rows with the same id count as one place: neither removes the other's words. An empty table
    gives no rows; other columns are ignored.

    Returns ``doc_id, n_words, n_removed, kept_text`` (the words left, joined by one space).
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = rows.where("doc_id is not null").mapInArrow(_runs(length), "doc_id long, start int, size int, anchor long, content long")
    seeds = runs.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high"))
    seeds = cut(seeds.where("first < last").select("anchor", "first", (F.col("low") != F.col("high")).alias("mixed")))
    members = dealt_anew(cut(runs.join(dealt_anew(seeds), "anchor").where("mixed or doc_id > first")))

    stop = (F.col("start") + F.col("size") + (length - 1)).alias("stop")
    plain = members.where("not mixed").select("doc_id", "start", stop, "content")
    kinds = members.where("mixed").groupBy("anchor", "content", "size").agg(F.min("doc_id").alias("kind_first"))
    mixed = dealt_anew(cut(members.where("mixed").join(dealt_anew(cut(kinds)), ["anchor", "content", "size"])))
    later = mixed.where("doc_id > kind_first").select("doc_id", "start", stop, "content")
    apart = mixed.where("doc_id = kind_first").select("anchor", "doc_id", "start", "size", "content", "first").distinct()
    groups = apart.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.when(F.col("doc_id") == F.col("first"), F.col("start"))).alias("lead_start"))
    groups = groups.withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int"))
    apart = dealt_anew(cut(apart)).join(dealt_anew(cut(groups)), "anchor")
    lead, salt = (F.col("doc_id") == F.col("first")) & (F.col("start") == F.col("lead_start")), F.pmod(F.xxhash64("doc_id", "start"), "salts").cast("int")
    listed = apart.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "anchor", "content", "n", lead.alias("lead"), salt.alias("salt"), "salts")).alias("runs"))
    listed = cut(listed)
    texts = rows
    if listed.count() <= BROADCAST_IDS:
        texts = rows.join(F.broadcast(listed.select("doc_id")), "doc_id", "left_semi")
    contexts = texts.join(listed, "doc_id").mapInArrow(_contexts(length), CONTEXT)
    # A group's first run comes before the others.
    contexts = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("lead"))
    extended = dealt_anew(cut(contexts.mapInArrow(_extend(length), "doc_id long, start int, stop int, content long, second long")))
    matched, windows = extended.where("second is null").drop("second"), extended.where("second is not null")
    repeated = windows.groupBy("content", "second").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest").drop("highest")
    single = windows.join(dealt_anew(cut(repeated)), ["content", "second"]).where("doc_id > lowest").select("doc_id", "start", "stop", "content")

    spans = plain.unionByName(later).unionByName(matched).unionByName(single).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "content")).alias("spans"))
    return rows.join(spans, "doc_id", "left").mapInArrow(_cover(length), "doc_id long, n_words long, n_removed long, kept_text string")
