"""Token ids in files: texts encoded, ids of a shard compressed by a grammar of frequent pairs, read back whole or in part."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids under one grammar at most; texts are encoded so many bytes at a time, a longer one in stretches of so many code points.
GRAMMAR_IDS, BYTES, AT_ONCE = 1 << 20, 1 << 23, 1 << 22
#: A pair that stands less often gets no rule.
LEAST_PAIRS = 16
#: Words whose ids an encoder remembers.
MOST_WORDS = 1_000_000
GRAMMAR = "struct<n:long,terminals:long,width:int,rules:binary,lengths:binary,sequence:binary>"
#: One row of the files: whole documents in order. ``first`` counts the ids of the same part before it.
SHARD = f"part int, shard int, first long, n_ids long, doc_id array<long>, n_tokens array<long>, grammars array<{GRAMMAR}>"


# The grammar.


def _chosen(pair: np.ndarray, least: int, room: int) -> tuple[np.ndarray, int]:
    """The pairs that get rules in this round, the most frequent first: those at least a sixteenth as frequent as the first; and how often that is."""
    ordered = np.sort(pair)
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    count = np.diff(edge)
    top = int(count.max())
    of = np.flatnonzero(count >= max(least, top // 16))
    of = of[np.argsort(-count[of], kind="stable")][:room]
    return ordered[edge[of]], top


def re_pair(ids: np.ndarray, terminals: int, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rules, lengths, sequence`` of a grammar that derives ``ids`` alone.

    Round by round frequent pairs of neighbours become nonterminals, numbered from ``terminals`` on;
    rule k is the pair behind ``terminals + k``, and ``lengths[k]`` the number of ids it expands to.
    A round takes every pair that stands at least a sixteenth as often as the most frequent one, so
    that there are a few rounds instead of one a rule; of overlapping pairs of one round the left
    one is replaced. Symbols stay below 2^16 where the terminals do, so that they are held in two
    bytes; the rounds end there, or where no pair stands ``least`` times.
    """
    wide = terminals >= 1 << 16
    limit = (1 << 31) if wide else (1 << 16)
    shift, kind = (32, np.uint64) if wide else (16, np.uint32)
    seq = ids.astype(kind)
    rules: list[np.ndarray] = []
    size = np.ones(terminals, dtype=np.int64)
    while len(seq) > least:
        pair = (seq[:-1] << kind(shift)) | seq[1:]
        new, top = _chosen(pair, least, limit - len(size))
        if top < least or not len(new):
            break
        # A table of hashed pairs tells at once which rule a pair may have; of two chosen pairs with one hash the rarer waits for a later round.
        bucket = lambda x: ((x * kind(0x9E3779B1)) >> kind(44 if wide else 14)).astype(np.int64) & ((1 << 18) - 1)
        table = np.full(1 << 18, -1, dtype=np.int32)
        table[bucket(new[::-1])] = np.arange(len(new) - 1, -1, -1, dtype=np.int32)
        may = table[bucket(pair)]
        at = np.flatnonzero(may >= 0)
        rule = may[at]
        good = new[rule] == pair[at]
        at, rule = at[good], rule[good]
        # Of a run of overlapping pairs every second one is taken, from the left.
        fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - start) % 2 == 0
        at, rule = at[taken], rule[taken]
        used = np.bincount(rule, minlength=len(new))
        keep = used >= 2
        number = np.cumsum(keep) - 1 + len(size)
        ok = keep[rule]
        at, rule = at[ok], rule[ok]
        if not len(at):
            break
        left, right = (new[keep] >> kind(shift)).astype(np.int64), (new[keep] & kind((1 << shift) - 1)).astype(np.int64)
        rules.append(np.stack((left, right), axis=1))
        seq[at] = number[rule].astype(kind)
        size = np.concatenate((size, size[left] + size[right]))
        seq = np.delete(seq, at + 1)
    held = np.uint32 if wide else np.uint16
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return table.astype(held), size[terminals:].astype(np.uint32), seq.astype(held)


def _levels(seq: np.ndarray, rules: np.ndarray, size: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols derive, all nonterminals of a level at once."""
    ends = np.cumsum(size[seq])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    at = ends - size[seq]
    while len(seq):
        done = seq < terminals
        out[at[done]] = seq[done]
        seq, at = seq[~done], at[~done]
        pair = rules[seq - terminals].astype(np.int64)
        at = np.concatenate((at, at + size[pair[:, 0]]))
        seq = np.concatenate((pair[:, 0], pair[:, 1]))
    return out


def expand(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that a sequence of symbols derives: each rule is expanded once, then copied wherever it stands."""
    size = np.concatenate((np.ones(terminals, dtype=np.int64), lengths.astype(np.int64)))
    # What stands for each symbol: itself, or its rule's ids, behind those of the terminals.
    start = np.cumsum(size) - size
    ids = np.concatenate((np.arange(terminals, dtype=np.uint32), _levels(np.arange(terminals, len(size)), rules, size, terminals)))
    per = size[sequence]
    upto = np.cumsum(per)
    return ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start[sequence] - upto + per, per)]


def expand_part(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from ``start`` on, by the lengths alone: only symbols that reach into the part are expanded."""
    size = np.concatenate((np.ones(terminals, dtype=np.int64), lengths.astype(np.int64)))
    ends = np.cumsum(size[sequence.astype(np.int64)])
    i, j = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, start + n, side="left"))
    before = int(ends[i - 1]) if i else 0
    return expand(sequence[i : j + 1], rules, lengths, terminals)[start - before : start - before + n]


def _packed(ids: np.ndarray, terminals: int) -> dict:
    rules, lengths, sequence = re_pair(ids, terminals)
    return {"n": len(ids), "terminals": terminals, "width": sequence.itemsize, "rules": rules.tobytes(), "lengths": lengths.tobytes(), "sequence": sequence.tobytes()}


def _unpacked(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    kind = "<u2" if g["width"] == 2 else "<u4"
    return np.frombuffer(g["sequence"], kind), np.frombuffer(g["rules"], kind).reshape(-1, 2), np.frombuffer(g["lengths"], "<u4"), g["terminals"]


# The encoder.


class Numbered(dict):
    """Texts by number, in the order in which they were first met."""

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The numbers of texts, and those of them that are new, each once."""
        coded = texts.dictionary_encode()
        own = coded.dictionary.to_pylist()
        known = np.array(list(map(self.get, own)), dtype=np.float64)  # None becomes NaN
        fresh = np.flatnonzero(np.isnan(known))
        new, n = [own[i] for i in fresh.tolist()], len(self)
        known[fresh] = np.arange(n, n + len(new))
        self.update(zip(new, range(n, n + len(new)), strict=True))
        return known.astype(np.int64)[coded.indices.to_numpy()], new


def gathered(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``ids[ends[k]:ends[k + 1]]`` of each k in ``at``, one after the other, and their sizes."""
    start = ends[at]
    size = ends[at + 1] - start
    upto = np.cumsum(size)
    return ids[np.arange(upto[-1] if len(at) else 0) + np.repeat(start - upto + size, size)], size


class Splitter:
    """What a tokenizer makes of plain words before it looks for tokens, learned from the tokenizer itself, character by character.

    The tokenizer must lower-case, and cut a word into ``contractions``, runs of letters, single
    numbers, and runs of all else, whatever stands around the word. A word is plain if its
    characters are, which are those up to ``LAST`` that become one character and are not dropped.
    """

    LAST = 0x4FF

    def __init__(self, tokenizer: Any, contractions: tuple[str, ...]) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        pieces = lambda x: len(tokenizer.pre_tokenizer.pre_tokenize_str(x))
        self.lower, kinds = {}, {"letter": "", "number": "", "other": ""}
        for c in map(chr, range(self.LAST + 1)):
            small = tokenizer.normalizer.normalize_str(c)
            # Marks may join what is before them, or change places.
            if unicodedata.category(c).startswith("M") or len(small) != 1 or small.isspace() or pieces(f"a{small}a") not in (1, 3):
                continue
            self.lower[ord(c)] = small
            if small == c:
                kinds["letter" if pieces(f"a{c}a") == 1 else "other" if pieces(f"!{c}!") == 1 else "number"] += re.escape(c)
        self.lower = {c: x for c, x in self.lower.items() if ord(x) in self.lower}
        plain = "".join(re.escape(chr(c)) for c in self.lower if chr(c) != "\n")
        self.plain = re.compile(f"[{plain}]*").fullmatch
        self.find = re.compile("|".join([*map(re.escape, contractions), f"[{kinds['letter']}]+", f"[{kinds['number']}]", f"[{kinds['other']}]+", "\n"])).findall
        # The same vocabulary and merges, for parts that need no more than being told apart.
        self.lean = Tokenizer(tokenizer.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        suffix = tokenizer.model.end_of_word_suffix
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        self.at, self.ids, self.bounds = Numbered(), np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain words and how many each has, each distinct part encoded once; None if the vocabulary does not tell where a part ends."""
        if len(self.at) > MOST_WORDS:
            self.forget()
        found = pa.array(self.find("\n".join(words).translate(self.lower) + "\n"), pa.large_string())
        line = pc.equal(found, "\n")
        number, new = self.at.numbers(found.filter(pc.invert(line)))
        if new:
            joined = [" ".join(new[k : k + 1000]) for k in range(0, len(new), 1000)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.lean.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(new):
                self.forget()
                return None
            self.ids, self.bounds = np.concatenate((self.ids, ids)), np.concatenate((self.bounds, self.bounds[-1] + stops))
        ids, size = gathered(self.ids, self.bounds, number)
        line = line.to_numpy(zero_copy_only=False)
        return ids, np.bincount((np.cumsum(line) - line)[~line], weights=size, minlength=len(words)).astype(np.int64)


class Encoder:
    """Ids of texts by a tokenizer's file, without special tokens added.

    With ``by_word`` the tokenizer must treat all white space alike and drop it, and look at nothing
    across it; then each distinct word between spaces is encoded once and remembered, about
    ``MOST_WORDS`` of them, which gives the ids of the whole text for a fraction of the work. With
    ``contractions`` words are first split as by ``Splitter``, where they are plain.
    """

    def __init__(self, path: str, by_word: bool = False, contractions: tuple[str, ...] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = Splitter(self.tokenizer, contractions) if contractions is not None else None
        self.forget()

    def forget(self) -> None:
        self.at, self.ids, self.ends = Numbered(), np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole``, with plain words split first."""
        if self.split is None:
            return self._whole(words)
        plain = np.array([self.split.plain(w) is not None for w in words], dtype=bool)
        if any(x in "\n".join(words) for x in self.special):
            plain &= ~np.array([any(x in w for x in self.special) for w in words], dtype=bool)
        chosen = plain.tolist()
        first = self.split.encode([w for w, p in zip(words, chosen, strict=True) if p])
        if first is None:
            return self._whole(words)
        second = self._whole([w for w, p in zip(words, chosen, strict=True) if not p])
        # Back in the words' order.
        size, start = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        for on, (ids, own), base in ((plain, first, 0), (~plain, second, len(first[0]))):
            size[on] = own
            start[on] = base + np.cumsum(own) - own
        upto = np.cumsum(size)
        ids = np.concatenate((first[0], second[0]))
        return ids[np.arange(upto[-1] if len(words) else 0) + np.repeat(start - upto + size, size)], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        if not self.by_word:
            return self._whole(texts.to_pylist())
        if len(self.at) > MOST_WORDS:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        per_text = lists.value_lengths().to_numpy()
        number, new = self.at.numbers(lists.flatten())
        if new:
            ids, size = self._words(new)
            self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))
        ids, size = gathered(self.ids, self.ends, number)
        return ids, np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per_text)))])

    def stretches(self, text: str) -> Iterator[str]:
        """A long text in stretches that can be encoded one by one: cut at spaces, where those part what is encoded."""
        at = 0
        while self.by_word and len(text) - at > AT_ONCE:
            cut = text.rfind(" ", at, at + AT_ONCE)
            cut = cut if cut > at else text.find(" ", at + AT_ONCE)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text


@lru_cache(maxsize=2)
def _encoder(path: str, by_word: bool, contractions: tuple[str, ...] | None) -> Encoder:
    return Encoder(path, by_word, contractions)


# The files.


class _Writer:
    """Gathers documents' ids into rows of the files; holds at most one grammar's ids, and what is packed of one row."""

    def __init__(self, part: int, terminals: int) -> None:
        self.part, self.terminals, self.shard, self.first = part, terminals, 0, 0
        self._clear()

    def _clear(self) -> None:
        self.doc_id: list = []
        self.n_tokens: list[int] = []
        self.grammars: list[dict] = []
        self.open: list[np.ndarray] = []
        self.held = self.n_ids = 0

    def _pack(self) -> None:
        if self.held:
            self.grammars.append(_packed(np.concatenate(self.open), self.terminals))
            self.open, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        """More ids of the document that is being written."""
        for k in range(0, len(ids), GRAMMAR_IDS):
            own = ids[k : k + GRAMMAR_IDS]
            if self.held + len(own) > GRAMMAR_IDS:
                self._pack()
            self.open.append(own)
            self.held += len(own)
            self.n_ids += len(own)

    def end(self, doc_id: int | None, n: int) -> Iterator[pa.RecordBatch]:
        """The document is whole; a row is, when a grammar's worth of ids has come."""
        self.doc_id.append(doc_id)
        self.n_tokens.append(n)
        if self.n_ids >= GRAMMAR_IDS // 2:
            yield from self.row()

    def row(self) -> Iterator[pa.RecordBatch]:
        if self.doc_id:
            self._pack()
            row = {"part": self.part, "shard": self.shard, "first": self.first, "n_ids": self.n_ids, "doc_id": self.doc_id, "n_tokens": self.n_tokens, "grammars": self.grammars}
            self.shard, self.first = self.shard + 1, self.first + self.n_ids
            self._clear()
            yield pa.RecordBatch.from_pylist([row], schema=ROW)


_BLOCK = pa.struct([("n", pa.int64()), ("terminals", pa.int64()), ("width", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())])
ROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("grammars", pa.list_(_BLOCK))])


def _groups(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``most`` bytes in all, as bounds; a longer one stands alone."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, by_word: bool = False, contractions: tuple[str, ...] | None = None) -> None:
    """Ids of every text of ``docs`` (``doc_id, text``), each with ``end_id`` behind it, as files under ``path``.

    ``tokenizer`` is the path of a tokenizer's file, the same on every executor; for ``by_word`` and
    ``contractions`` see ``Encoder``. Documents are dealt
    by ranges of ``doc_id`` and stand in ascending order in the files; rows of one id in the order
    of a hash of their text, and, so that no id fills one part, rows alike in both may stand in
    several parts. The files are Parquet, one row a shard (``SHARD``): the ids and lengths of its
    documents, and the grammar that derives their tokens (``re_pair``). A shard holds whole documents
    of half to one ``GRAMMAR_IDS``; a longer document has a shard of its own with several grammars.

    Null texts are empty, and have the end alone; null ids stand first. An empty table gives files
    without rows. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, by_word, contractions)
        out = _Writer(TaskContext.get().partitionId(), max(encoder.n_ids, end_id + 1))
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts, ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id").to_pylist()
            for i, j in _groups(texts, BYTES):
                if j == i + 1:
                    n = 0
                    for stretch in encoder.stretches(texts[i].as_py()):
                        found, _ = encoder.encode(pa.array([stretch]))
                        out.add(found)
                        n += len(found)
                    out.add(end)
                    yield from out.end(ids[i], n + 1)
                else:
                    found, size = encoder.encode(texts.slice(i, j - i))
                    upto = np.cumsum(size)
                    ended, stops = np.insert(found, upto, end_id), (upto + np.arange(1, j - i + 1)).tolist()
                    for k, start, stop in zip(range(i, j), [0, *stops[:-1]], stops, strict=True):
                        out.add(ended[start:stop])
                        yield from out.end(ids[k], stop - start)
        yield from out.row()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    dealt = keyed.repartitionByRange("doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "i").select("doc_id", "text")
    dealt.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with ``start``, the number of ids in all parts before plus those before in its own."""
    rows = spark.read.schema(SHARD).parquet(path)
    # One row a part, of which there are as many as partitions wrote.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
        grammars, have, at, crcs = iter(row["grammars"]), np.zeros(0, dtype="<u4"), 0, []
        for n in row["n_tokens"]:
            crc = 0
            while n:
                if at == len(have):
                    have, at = expand(*_unpacked(next(grammars))).astype("<u4"), 0
                own = have[at : at + n]
                crc, at, n = zlib.crc32(own.tobytes(), crc), at + len(own), n - len(own)
            crcs.append(crc)
        size = np.array(row["n_tokens"], dtype=np.int64)
        start = row["start"] + np.cumsum(size) - size
        yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(start), pa.array(size), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the ids that the files derive."""
    return shards(spark, path).select("start", "doc_id", "n_tokens", "grammars").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``start, ids``: the tokens from ``start`` to before ``stop`` of all documents, one after the other, one row for each grammar that has some. Shards outside are not read, symbols outside not expanded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            at = row["start"]
            for g in row["grammars"]:
                low, high = max(start, at), min(stop, at + g["n"])
                if low < high:
                    ids = expand_part(*_unpacked(g), low - at, high - low)
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["start", "ids"])
                at += g["n"]

    rows = shards(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return rows.select("start", "grammars").mapInArrow(run, "start long, ids array<long>")
