"""Cross-tokenizer alignment: groups of tokens that end together, and how often an id of one goes with an id of the other."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.runtime import cut
from pluvio.llm.token_files import gathered

#: Labels of a byte: no token ends behind it, one of A does, one of B does, both do.
NONE, A_END, B_END, BOTH = b".ab+"
SPAN = re.compile(rb"[.ab]*\+")
#: Where a text may be cut: at a space behind something else, which is no mark of B either, and before a mark of ASCII, a letter or a digit.
CUT = re.compile(r"(?<=[^ ▁]) (?=[!-~]|[^\W_])")
#: Stretches of a block at about which it ends, distinct ones that a worker remembers, and code points that are cut at once.
BLOCK_WORDS, MOST_KINDS, AT_ONCE = 1_500_000, 600_000, 1 << 20
MARK = "▁"


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others for characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        of = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode() for p in pieces]
        # A text may be cut before a mark only if no piece holds one behind anything else.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: Each id as text with what follows it.
        self.named = np.array([[n + mark for n in names] for mark in (",", "|", ";")], dtype=object)

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts that begin with a space; B adds it itself."""
        return [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)], self.b.encode([w[1:] for w in words], num_threads=1)


class Aligned:
    """What the alignment of some distinct texts comes to, text k by text k."""

    def __init__(self, pair: Pair, words: list[str]) -> None:
        a, b = pair.encode(words)
        self.ok = np.fromiter((b"".join(map(pair.a_bytes.__getitem__, x)) == (raw := w.encode()) == b"".join(map(pair.b_bytes.__getitem__, y)) for w, x, y in zip(words, a, b, strict=True)), bool, len(words))
        size = lambda ids: np.fromiter((len(x) if ok else 0 for x, ok in zip(ids, self.ok, strict=True)), np.int64, len(words))
        flat = lambda ids, n: np.fromiter(chain.from_iterable(x for x, ok in zip(ids, self.ok, strict=True) if ok), np.int64, int(n.sum()))
        self.n_a, self.n_b = size(a), size(b)
        ids_a, ids_b = flat(a, self.n_a), flat(b, self.n_b)
        ends_a, ends_b = np.cumsum(pair.a_size[ids_a]), np.cumsum(pair.b_size[ids_b])
        label = np.full(int(ends_a[-1]) if len(ends_a) else 0, NONE, dtype=np.uint8)
        label[ends_a - 1] = A_END
        label[ends_b - 1] = np.where(label[ends_b - 1] == A_END, BOTH, B_END)
        # Groups: spans up to each label of both; a text ends with one, so that none reaches over two.
        spans = SPAN.findall(label.tobytes())
        known: dict[bytes, tuple[int, int]] = {}
        for s in set(spans):
            known[s] = s.count(b"a") + 1, s.count(b"b") + 1
        of = np.array([known[s] for s in spans], dtype=np.int64).reshape(-1, 2)
        upto_a, upto_b = np.cumsum(of[:, 0]), np.cumsum(of[:, 1])
        bytes_of = np.add.reduceat(pair.a_size[ids_a], upto_a - of[:, 0]) if len(of) else np.zeros(0, np.int64)
        text_end = np.cumsum(np.array([len(w.encode()) if ok else 0 for w, ok in zip(words, self.ok, strict=True)], dtype=np.int64))
        self.n_groups = np.diff(np.concatenate(([0], np.searchsorted(np.cumsum(bytes_of), text_end, side="right"))))
        # Their text: the A ids of a group, then its B ids.
        named = np.empty(len(ids_a) + len(ids_b), dtype=object)
        place_a = np.arange(len(ids_a)) + np.repeat(upto_b - of[:, 1], of[:, 0])
        place_b = np.arange(len(ids_b)) + np.repeat(upto_a, of[:, 1])
        after_a, after_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        after_a[upto_a - 1], after_b[upto_b - 1] = 1, 2
        named[place_a], named[place_b] = pair.named[after_a, ids_a], pair.named[after_b, ids_b]
        tokens, ends = named.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = ["".join(tokens[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        # Links: between two ends that follow one another lies one token of A and one of B, and no two such stretches have the same two.
        at = np.flatnonzero(label != NONE)
        in_a, in_b = label[at] != B_END, label[at] != A_END
        self.a_id, self.b_id = ids_a[np.cumsum(in_a) - in_a], ids_b[np.cumsum(in_b) - in_b]
        self.n_links = np.diff(np.concatenate(([0], np.searchsorted(at, text_end))))


class _Growing:
    """An array that is added to at its end."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.zeros(max(len(self.held), len(more)), dtype=self.held.dtype)))
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class _Numbered(dict):
    """Stretches by number; one that is not known yet gets the next, and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Kinds:
    """Every distinct stretch of text that this worker has met, aligned once."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.at, self.groups = pair, _Numbered(), []
        self.ok = _Growing(bool)
        self.counts = {name: _Growing(np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        self.ends, self.link = _Growing(np.int64), _Growing(np.int64)
        self.ends.add(np.zeros(1, dtype=np.int64))

    def learn(self) -> None:
        """Aligns what has been numbered since."""
        new, self.at.new = self.at.new, []
        if new:
            found = Aligned(self.pair, new)
            self.ok.add(found.ok)
            for name, held in self.counts.items():
                held.add(getattr(found, name))
            self.ends.add(self.link.n + np.cumsum(found.n_links))
            self.link.add((found.a_id << 32) | found.b_id)
            self.groups += found.groups


class _Block:
    """Documents as stretches by number."""

    def __init__(self) -> None:
        self.doc_id: list = []
        self.words: list[np.ndarray] = []
        self.hashes: list[str] = []
        self.n = 0

    def add(self, kinds: Kinds, doc_ids: list, texts: list[str]) -> None:
        number = kinds.at.__getitem__
        own = [np.fromiter(map(number, _cut(" " + text) if kinds.pair.cuts else [" " + text]), np.int32) if text else np.zeros(0, np.int32) for text in texts]
        kinds.learn()
        ok, groups = kinds.ok.all(), kinds.groups.__getitem__
        for at in own:
            at = at if len(at) and ok[at].all() else at[:0]
            self.hashes.append(hashlib.sha256(";".join(map(groups, at.tolist())).encode()).hexdigest() if len(at) else "")
            self.words.append(at)
            self.n += len(at)
        self.doc_id += doc_ids

    def row(self, kinds: Kinds, number: int) -> pa.RecordBatch:
        per_doc = np.array([len(w) for w in self.words], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(per_doc)))
        own, words, often = np.unique(np.concatenate(self.words), return_inverse=True, return_counts=True)
        summed = lambda name: np.diff(np.concatenate(([0], np.cumsum(kinds.counts[name].all()[own][words])))[ends])
        link, links = gathered(kinds.link.all(), kinds.ends.all(), own)
        pair, which = np.unique(link, return_inverse=True)
        count = np.bincount(which, weights=np.repeat(often, links).astype(np.float64), minlength=len(pair)).astype(np.int64)
        row = {
            "block": number, "doc_id": self.doc_id, **{c: summed(c) for c in kinds.counts}, "groups_sha256": self.hashes,
            "doc_ends": ends.tobytes(), "words": words.astype(np.int32).tobytes(), "links": links.astype(np.int32).tobytes(), "pairs": which.astype(np.int32).tobytes(), "pair": pair, "times": count,
        }
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), ROW.types, strict=True)], schema=ROW)


_L = pa.list_(pa.int64())
ROW = pa.schema([("block", pa.int64()), ("doc_id", _L), ("n_a", _L), ("n_b", _L), ("n_groups", _L), ("n_links", _L), ("groups_sha256", pa.list_(pa.string())), ("doc_ends", pa.binary()), ("words", pa.binary()), ("links", pa.binary()), ("pairs", pa.binary()), ("pair", _L), ("times", _L)])
BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, doc_ends binary, words binary, links binary, pairs binary, pair array<long>, times array<long>"
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _cut(text: str) -> list[str]:
    """A text cut before every space that ``CUT`` finds: tokens of neither tokenizer reach over such a place."""
    at = [m.start() for m in CUT.finditer(text)]
    return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]


@lru_cache(maxsize=1)
def _known(a_path: str, b_path: str) -> list[Kinds]:
    """What a worker keeps from task to task, to be replaced when it has grown too large."""
    return [Kinds(Pair(a_path, b_path))]


def _blocks(a_path: str, b_path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, block = _known(a_path, b_path), TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                texts, size, start = pc.fill_null(some.column("text"), "").to_pylist(), 0, 0
                for j, text in enumerate(texts):
                    size += len(text)
                    if size < AT_ONCE and j < len(texts) - 1:
                        continue
                    block.add(known[0], some.column("doc_id").slice(start, j + 1 - start).to_pylist(), texts[start : j + 1])
                    start, size, full = j + 1, 0, len(known[0].at) >= MOST_KINDS
                    if block.n >= BLOCK_WORDS or full:
                        yield block.row(known[0], number)
                        block, number = _Block(), number + 1
                    if full:
                        known[0] = Kinds(known[0].pair)
        if block.doc_id:
            yield block.row(known[0], number)

    return run


def _finished(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block, with what the corpus's counts of its pairs come to."""
    found = found.sort_by("place")
    count, best = found.column("count").to_numpy(), found.column("best").to_numpy()
    out = []
    for k in range(rows.num_rows):
        row = rows.slice(k, 1)
        raw = lambda name, kind, row=row: np.frombuffer(row.column(name)[0].as_buffer(), kind)
        pairs, links, words, ends = raw("pairs", np.int32), raw("links", np.int32), raw("words", np.int32), raw("doc_ends", np.int64)
        upto = np.concatenate(([0], np.cumsum(links)))
        by_doc = lambda value: np.diff(np.concatenate(([0], np.cumsum(np.diff(np.concatenate(([0], np.cumsum(value[pairs])))[upto])[words])))[ends])
        own = [row.column(c)[0].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        out.append(pa.Table.from_arrays([*own, pa.array(by_doc((count == best).astype(np.int64))), pa.array(by_doc(count))], names=[c.split()[0] for c in FOUND.split(", ")]))
    return pa.concat_tables(out) if out else pa.table({c.split()[0]: pa.array([], pa.string() if c.endswith("string") else pa.int64()) for c in FOUND.split(", ")})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links of all documents hold each pair (A's id in the upper 32 bits, B's in the lower), and the highest count of its B id."""
    times = blocks.select(F.inline(F.arrays_zip("pair", "times"))).groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    times = cut(times.where("count > 0"))
    best = times.groupBy("b").agg(F.max("count").alias("best"))
    return times.join(F.broadcast(best), "b").drop("b")  # one row an id of B, whose vocabulary bounds them


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How the tokens of two tokenizers go together in each text of ``docs`` (``doc_id, text``).

    ``a_path`` is a byte-level tokenizer's file, ``b_path`` a sentencepiece model with byte
    fallback, both the same on every executor; A encodes a space and the text, B the text, before
    which it puts a space itself. Each byte has a label: whether a token of A, of B, of both or of
    neither ends behind it. Spans up to each label of both are the groups; the labels in a span say
    how many tokens of each a group has. Tokens of A and B whose bytes overlap are linked; a pair of
    ids counts as often as links of all documents hold it.

    Texts are cut at spaces that neither tokenizer's tokens reach over (``CUT``; the whole text
    where B's vocabulary has pieces that do), and each distinct stretch is encoded and aligned once by a worker, which
    remembers about ``MOST_KINDS`` of them. A block is a row of documents of about ``BLOCK_WORDS``
    stretches, or one longer document. The corpus's counts go to the blocks, not to the documents: a block asks for each pair once.

    Null and empty texts, and those whose joined bytes of A's or B's tokens are not a space and the
    text, have zeros and no groups. Repeated rows give repeated results, null ids stay null, an
    empty table gives no rows; other columns are ignored.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = cut(rows.mapInArrow(_blocks(a_path, b_path), BLOCK))
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pair").alias("place", "pair"))
    found = asked.join(pair_counts(blocks), "pair", "left").select("of", "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(1)).alias("best"))
    held = blocks.drop("pair", "times")
    return held.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_finished, FOUND)
