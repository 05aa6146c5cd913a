"""Benchmark decontamination by templates: numbers, names and units become typed slots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.llm.runtime import cut
from pluvio.llm.words import GOLDEN, IS_BLANK, LOWER, Piece, hash_runs, hash_words, inside, mix, per_piece

WINDOW = 12
#: Items of fewer tokens are looked for as whole sentences or lines.
SHORTEST = 5
#: Bits of a window's hash by which documents' windows are looked up before the join: a table of 16 MB whatever the benchmark's size.
BITS = 24
#: Benchmarks of up to so many windows are broadcast to the join.
BROADCAST_WINDOWS = 200_000
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon
gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh""".split()
NUMBER_WORDS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy
eighty ninety hundred thousand million dozen""".split()
NUMBER, UNIT, NAME = 1, 2, 3
SLOT = mix(np.arange(100, 104, dtype=np.uint64))
#: Keeps hashes of words apart from those of templates.
VERBATIM = np.uint64(1 << 32)

_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[48:58] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[65:91] = True
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:"]] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in "\n\r.!?"]] = True
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[ord(c) for c in ":\"'"]] = True


class Template:
    """Tokens of a piece: words in lower case without punctuation, or typed slots.

    A number is a word of digits and punctuation, one that begins with a digit (``5kg``), or one of
    ``NUMBER_WORDS``; a unit is one of ``UNITS`` after a number; a name begins with a capital that
    does not begin a line or follow a full stop. Words of punctuation alone are no tokens.
    """

    def __init__(self, piece: Piece) -> None:
        piece.words()
        data = piece.data
        low = LOWER[data]
        after_c3 = np.concatenate(([False], data[:-1] == 0xC3))
        accented = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low[accented] += 0x20
        keep = ~IS_BLANK[data] & ~_IS_MARK[data]
        at = np.concatenate(([0], np.cumsum(keep)))
        starts, stops = at[piece.starts], at[piece.stops]
        some = np.flatnonzero(stops > starts)
        self.raw = data
        self.begin, self.end = piece.starts[some], piece.stops[some]
        starts, stops = starts[some], stops[some]
        self.low = low[keep]
        self.starts, self.stops = starts, stops
        word = hash_words(self.low, starts, stops)
        n = len(word)
        self.bounds = np.searchsorted(self.begin, piece.ends)
        self.n = n
        first = np.flatnonzero(keep)[starts]
        number = _IS_DIGIT[data[first]] | np.isin(word, _NUMBER_HASHES)
        line = np.concatenate(([0], np.cumsum(data == 0x0A)))
        opens = np.ones(n, dtype=bool)
        if n:
            # The word before may be punctuation alone, so the byte before the blanks is looked at.
            before = np.searchsorted(piece.starts, self.begin) - 1
            last = piece.stops[np.maximum(before, 0)] - 1
            opens = (before < 0) | _ENDS[data[last]] | (line[self.begin] != line[np.minimum(last, self.begin)])
            opens[self.bounds[:-1][self.bounds[:-1] < n]] = True
        capital = _IS_UPPER[data[first]] | ((data[first] == 0xC3) & accented[np.minimum(first + 1, max(0, len(data) - 1))])
        kind = np.where(number, NUMBER, np.where(capital & ~opens, NAME, 0))
        self.opening = capital & opens & ~number
        follows = np.concatenate(([False], number[:-1])) if n else number
        if n:
            follows[self.bounds[:-1][self.bounds[:-1] < n]] = False
            kind[follows & np.isin(word, _UNIT_HASHES)] = UNIT
        self.kind = kind
        self.first, self.last = first, np.flatnonzero(keep)[stops - 1]
        self.literal = word
        self.word = np.where(kind > 0, SLOT[kind], word)

    def windows(self, length: int) -> list[tuple[np.ndarray, np.ndarray, int | None]]:
        """Windows of ``length`` tokens within one text: starts, hashes, and from which of their tokens slots count, None for windows by their words.

        All windows by their words in lower case, or, of fewer than ``SHORTEST`` tokens, those that
        are whole sentences or lines. Otherwise also those with a template, half of them words at
        least. One that begins with a name has another in which its first token is a word, as it is
        where it opens a text; one that begins with a capital that opens a sentence has another in
        which that is a name (-1).
        """
        ok = inside(self.bounds, self.n, length)
        if not len(ok):
            return []
        size = np.uint64(length)
        at = np.flatnonzero(ok & self._whole(length) if length < SHORTEST else ok)
        out = [(at, mix(hash_runs(self.literal, length)[at] + VERBATIM + size), None)]
        if length < SHORTEST:
            return out
        slots = np.concatenate(([0], np.cumsum(self.kind > 0)))
        n_slots = slots[length:] - slots[:-length]
        rest = hash_runs(self.word[1:], length - 1)
        named = np.full(self.n, SLOT[NAME])
        begins = self.kind[: len(ok)] == NAME, self.opening[: len(ok)] & (self.kind[: len(ok)] == 0)
        for skip, first, fits in ((0, self.word, 2 * n_slots <= length), (1, self.literal, begins[0] & (2 * (n_slots - 1) <= length)), (-1, named, begins[1] & (2 * (n_slots + 1) <= length))):
            at = np.flatnonzero(ok & fits)
            out.append((at, mix(first[at] * GOLDEN + rest[at] + size), skip))
        return out

    def _whole(self, length: int) -> np.ndarray:
        """Which runs of ``length`` tokens begin and end as a sentence, a quotation or a line does."""
        gap = np.concatenate(([0], self.last + 1)), np.concatenate((self.first, [len(self.raw)]))
        edge = np.zeros(self.n + 1, dtype=bool)
        edge[self.bounds] = True
        within = lambda marks: (c := np.concatenate(([0], np.cumsum(marks[self.raw]))))[gap[1]] > c[gap[0]]
        ends = edge | within(_STOPS)
        begins = ends | within(_LEADS)
        return begins[: self.n - length + 1] & ends[length:]

    def slots(self, start: int, length: int, skip: int) -> list[str]:
        """What stands in the slots of a run of tokens; its first token is none if ``skip`` is 1, and one if it is -1."""
        return [self.low[self.starts[i] : self.stops[i]].tobytes().decode("utf-8", "replace") for i in range(start, start + length) if (self.kind[i] if i > start or not skip else skip < 0)]


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    piece = Piece(data, np.array([0, len(data)]), 0)
    piece.words()
    return hash_words(data, piece.starts, piece.stops)


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)


def _lengths(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.diff(Template(piece).bounds).astype(np.int64))], names=["n"])


def _windows(lengths: list[int], wanted, whole: bool):
    """Windows as rows; ``wanted``: None for all, or a broadcast table of hash prefixes. ``whole``: shorter lengths only for texts of that length."""

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        t = Template(piece)
        ids, of, out = rows.column("id").to_pylist(), rows.column("of").to_pylist(), []
        for length, (at, h, skip) in ((n, w) for n in lengths for w in t.windows(n)):
            if wanted is not None:
                hit = wanted.value[(h >> np.uint64(64 - BITS)).astype(np.int64)]
                at, h = at[hit], h[hit]
            text = np.searchsorted(t.bounds, at, side="right") - 1
            for i, key, k in zip(at.tolist(), h.view(np.int64).tolist(), text.tolist(), strict=True):
                if whole and length < WINDOW and t.bounds[k + 1] - t.bounds[k] != length:
                    continue
                out.append((ids[k], of[k], i - int(t.bounds[k]), key, skip is None, [] if skip is None else t.slots(i, length, skip)))
        if not out:
            return None
        types = {"id": pa.int64(), "of": pa.int64(), "at": pa.int64(), "h": pa.int64(), "literal": pa.bool_(), "slots": pa.list_(pa.string())}
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=list(types))

    return per_piece(run)


_COLUMNS = "id long, of long, at long, h long, literal boolean, slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The benchmark items that each document repeats, with other numbers, names or units or with the same.

    Texts become templates (``Template``). Windows of ``WINDOW`` tokens of documents and items are
    joined by hash; an item shorter than that is one window, and one of fewer than ``SHORTEST``
    tokens counts word for word alone, where it is a whole sentence, quotation or line. A name that
    begins a window is looked up as a word too, for it may have opened the item, and a capital that
    opens a sentence as a name. Of each run of adjoining windows of one text and one item's text at one distance, the slots must
    map one to one: equal values to equal values, unequal ones to unequal ones. Windows with more slots than words have
    no template. Every window is looked up by its words in lower case too, and one that is the same
    word for word counts whatever its slots and its case.

    A null or empty text repeats nothing, nor does an item without text. Documents of one id are
    judged text by text, and what is found counts together; rows without id are left out. Repeated
    items, and items under one id, count once. Tables may be empty; other columns are ignored.

    Returns ``doc_id, item_id, n_windows, reparameterised`` (whether, wherever the item is
    found, some slot beside it holds another value).
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null").withColumn("of", F.xxhash64("text"))
    short = items.select("text").mapInArrow(per_piece(_lengths), "n long").where(f"n > 0 and n < {WINDOW}").distinct()
    lengths = [WINDOW, *(r.n for r in short.orderBy("n").collect())]  # at most WINDOW - 1 rows
    wanted = cut(items.mapInArrow(_windows(lengths, None, True), _COLUMNS).distinct())
    found = wanted.select(F.shiftrightunsigned("h", 64 - BITS).alias("p")).distinct().toArrow().column("p").to_numpy()  # at most 2**BITS rows
    table = np.zeros(1 << BITS, dtype=bool)
    table[found] = True
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    near = rows.withColumn("of", F.xxhash64("text")).mapInArrow(_windows(lengths, shared, False), _COLUMNS)
    item = wanted.select(F.col("id").alias("item_id"), F.col("of").alias("item_of"), F.col("at").alias("item_at"), "h", F.col("literal").alias("item_literal"), F.col("slots").alias("item_slots"))
    if wanted.count() <= BROADCAST_WINDOWS:
        item = F.broadcast(item)
    pairs = near.join(item, "h").where((F.col("literal") == F.col("item_literal")) & (F.size("slots") == F.size("item_slots"))).withColumn("distance", F.col("at") - F.col("item_at"))
    place = ["id", "of", "item_id", "item_of", "distance"]
    # Windows that adjoin rise together with their rank; those of repeated rows have one rank.
    pairs = pairs.withColumn("run", F.col("at") - F.dense_rank().over(Window.partitionBy(*place, "literal").orderBy("at")))
    runs = pairs.groupBy(*place, "literal", "run").agg(F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("slots"))
    one_to_one = (F.size(F.array_distinct("slots.item_slots")) == F.size("slots")) & (F.size(F.array_distinct("slots.slots")) == F.size("slots"))
    other = F.exists("slots", lambda x: x["item_slots"] != x["slots"])
    ats = F.array_distinct(F.flatten(F.collect_list(F.when(one_to_one, F.col("ats")))))
    aligned = runs.groupBy(*place).agg(ats.alias("ats"), F.max(other).alias("other")).where(F.size("ats") > 0)
    windows = F.array_distinct(F.flatten(F.collect_list(F.transform("ats", lambda x: F.struct("distance", x.alias("at"))))))
    return aligned.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.size(windows).cast("long").alias("n_windows"), F.min("other").alias("reparameterised"))


def judge_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, contaminated, n_windows, item_ids`` (sorted), by ``contaminated``."""
    found = contaminated(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.sum("n_windows").alias("n_windows"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))
