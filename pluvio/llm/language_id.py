"""Language identification: known words first, shorter and shorter letter n-grams for the others."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvio.llm.runtime import cut
from pluvio.llm.words import STEP, Piece, mix, per_piece, powers

UNKNOWN = "und"
N_CODES = 0x3000
WORD, LONGEST = 9, 5
GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of texts that are taken at once: n-grams of five lengths stand for each.
PIECE = 1 << 20
#: Texts by languages that are scored at once.
CELLS = 1 << 21


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of the code points below N_CODES: which are letters, and their lower case. Those above have no case and are looked up as they occur."""
    codes = [chr(i) for i in range(N_CODES)]
    is_letter = np.array([unicodedata.category(c)[0] == "L" for c in codes])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(codes)], dtype=np.uint32)
    return is_letter, lower


IS_LETTER, LOWER = _letters()


def _words(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, starts and stops of the words (runs of letters), and the text of each word."""
    raw = piece.data.tobytes()
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = (piece.data & 0xC0) != 0x80
    ends = np.concatenate(([0], np.cumsum(lead)))[piece.ends]
    low = code < N_CODES
    at = np.where(low, code, 0)
    letter = np.where(low, IS_LETTER[at], False)
    high, which = np.unique(code[~low], return_inverse=True)
    letter[~low] = np.array([unicodedata.category(chr(c))[0] == "L" for c in high.tolist()], dtype=bool)[which]
    code = np.where(low, LOWER[at], code)
    edge = np.zeros(len(code) + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate(([False], letter[:-1])) & ~edge[:-1]
    after = np.concatenate((letter[1:], [False])) & ~edge[1:]
    starts, stops = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return code, starts, stops, np.searchsorted(ends, starts, side="right") - 1


def _spans(code: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the code points ``starts[i]:stops[i]``, other for each kind."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = stops - starts
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = (code[np.repeat(starts, length) + at].astype(np.uint64) + np.uint64(1)) * STEP
    value = (value ^ (value >> np.uint64(31))) * powers(GRAM, int(length.max()))[at]
    return mix(np.add.reduceat(value, begin) + np.uint64(kind))


def _grams(code: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, and the word of each."""
    count = np.maximum(stops - starts - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    begin = np.repeat(starts, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(len(begin), dtype=np.uint64)
    for i in range(n):
        h = h * GRAM + (code[begin + i].astype(np.uint64) + np.uint64(1)) * STEP
    return mix(h + np.uint64(n)), word


def _counts() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For texts with the number of their language, ``of``: how often each word and n-gram occurs."""

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
        code, starts, stops, text = _words(piece)
        lang = rows.column("of").to_numpy()
        parts: list[list[np.ndarray]] = []
        for n in (WORD, *range(LONGEST, 0, -1)):
            h, word = (_spans(code, starts, stops, WORD), np.arange(len(starts))) if n == WORD else _grams(code, starts, stops, n)
            of = lang[text[word]].astype(np.int32)
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))) if len(h) else np.zeros(0, np.int64)
            parts.append([np.full(len(new), n, np.int32), h[new].view(np.int64), of[new], np.diff(np.concatenate((new, [len(h)])))])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["kind", "key", "lang", "n"])

    return per_piece(run, most=PIECE)


class LanguageModel:
    """For each kind (word, n-gram of each length) its sorted keys, and for each key the languages that have it.

    A key that a language has n times scores ``base[language] + log(2 n + 1)`` in it, and ``base``
    in the languages that lack it: so only what was seen is held, whatever the number of languages.
    """

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.langs, self.tables = langs, tables

    def look_up(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are known; and of the languages that have them: place of the key, language, gain."""
        keys, starts, lang, gain, _ = self.tables[kind]
        if not len(keys):
            none = np.zeros(0, np.int64)
            return np.zeros(len(key), bool), none, none, np.zeros(0)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[at] == key
        place = np.flatnonzero(known)
        begin, n = starts[at[place]], starts[at[place] + 1] - starts[at[place]]
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return known, np.repeat(place, n), lang[entry], gain[entry]

    def score(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each text (-1: no letter) and its share of the probability."""
        code, starts, stops, text = _words(piece)
        used: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        known, word, lang, gain = self.look_up(WORD, _spans(code, starts, stops, WORD))
        used.append((WORD, text[known], text[word], lang, gain))
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, of = _grams(code, starts[left], stops[left], n)
            hit, gram, lang, gain = self.look_up(n, h)
            some = np.bincount(of[hit], minlength=len(left))
            word = of[gram]
            used.append((n, text[left[some > 0]], text[left[word]], lang, gain / some[word]))
            left = left[some == 0]
        n_words = np.bincount(text, minlength=piece.n)
        best, share, n_langs = np.full(piece.n, -1), np.zeros(piece.n), len(self.langs)
        # As many texts at once as the table of texts by languages allows.
        some = max(1, CELLS // n_langs)
        for a in range(0, piece.n, some):
            b = min(piece.n, a + some)
            total = np.zeros((b - a, n_langs))
            for kind, of, at, lang, gain in used:
                i, j = np.searchsorted(of, (a, b))
                total += np.bincount(of[i:j] - a, minlength=b - a)[:, None] * self.tables[kind][4]
                own = slice(*np.searchsorted(at, (a, b)))
                total += np.bincount((at[own] - a) * n_langs + lang[own], weights=gain[own], minlength=(b - a) * n_langs).reshape(b - a, n_langs)
            # The words of a text are not independent: their mean counts as ten words at most.
            total *= (np.minimum(n_words[a:b], 10) / np.maximum(n_words[a:b], 1))[:, None]
            best[a:b] = total.argmax(axis=1)
            share[a:b] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(n_words > 0, best, -1), np.where(n_words > 0, share, 0.0)


#: A word or n-gram that was seen so often is known in any case.
COMMON = 1000


def fit_language_model(labelled: DataFrame, texts_per_language: int = 1000, most_texts: int = 100_000, least_count: int = 2, most_languages: int = 100_000, most_counts: int = 20_000_000, id_col: str = "doc_id") -> LanguageModel:
    """Counts words and letter n-grams of ``labelled`` (id, text, lang), on Spark.

    ``texts_per_language`` and ``most_texts`` bound the sample: texts are taken by the hash of their
    id, with the chance that gives about as many of each language, the lesser of the first and an
    even part of the second; languages with fewer are taken whole, and of each language at least the
    text whose id has the least hash, however small its part. The model, which goes to every task,
    holds what was seen alone. Every language is learned; more than ``most_languages`` values raise
    an error, for such a column names no languages. Words and n-grams seen fewer than
    ``least_count`` times are unknown, and where more than ``most_counts`` counts of a word or n-gram
    in a language are left, as of very long texts, those seen more often than that alone are known. Rows without text or language are
    ignored; a tie between languages goes to the first by name.
    """
    rows = labelled.select(F.col(id_col).alias("id"), "text", "lang").dropna(subset=["text", "lang"])
    of_id = F.xxhash64("id")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(of_id).alias("least"))
    sizes = sorted((r["lang"], r["n"], r["least"]) for r in found.limit(most_languages + 1).collect())
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    langs = [x for x, _, _ in sizes]
    nothing = np.zeros(0, np.int64)
    if not langs:
        return LanguageModel([], {n: (np.zeros(0, np.uint64), np.zeros(1, np.int64), nothing, np.zeros(0), np.zeros(0)) for n in (WORD, *range(1, LONGEST + 1))})
    part = min(texts_per_language, most_texts / len(langs))
    numbers = labelled.sparkSession.createDataFrame([(x, i, min(1.0, part / n), least) for i, (x, n, least) in enumerate(sizes)], "lang string, of int, chance double, least long")
    picked = rows.join(F.broadcast(numbers), "lang").where((F.pmod(of_id, F.lit(1_000_000)) < F.col("chance") * 1_000_000) | (of_id == F.col("least")))
    seen = picked.select("text", "of").mapInArrow(_counts(), "kind int, key long, lang int, n long")
    # Dealt by kind and key once, for the sums by language, the sums over all, and their join.
    counts = cut(seen.repartition("kind", "key").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("kind", "key").agg(F.sum("n").alias("total"), F.count("*").alias("held")).where(F.col("total") >= least_count)
    # How many counts are left from each total on: the first that leaves few enough is the least.
    steps = totals.groupBy(F.least("total", F.lit(COMMON)).alias("total")).agg(F.sum("held").alias("held")).collect()  # COMMON rows
    left, least = 0, COMMON
    for r in sorted(steps, reverse=True):
        left += r["held"]
        if left > most_counts:
            break
        least = r["total"]
    often = totals.where(F.col("total") >= least).select("kind", "key")
    found = counts.join(often, ["kind", "key"], "left_semi").toArrow()
    kind, key, lang, n = (found.column(c).to_numpy() for c in ("kind", "key", "lang", "n"))
    key = key.view(np.uint64)
    tables = {}
    for k in (WORD, *range(1, LONGEST + 1)):
        own = np.flatnonzero(kind == k)
        own = own[np.lexsort((lang[own], key[own]))]
        keys, starts = np.unique(key[own], return_index=True)
        size = np.bincount(lang[own], weights=n[own], minlength=len(langs))
        tables[k] = (keys, np.append(starts, len(own)), lang[own].astype(np.int64), np.log(2.0 * n[own] + 1), np.log(0.5 / (size + 0.5 * (len(keys) + 1))))
    return LanguageModel(langs, tables)


def label_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language of each text by ``model``; columns of these names are replaced.

    Words are runs of letters in lower case. A known word adds its log frequency in each language;
    an unknown one the mean log frequency of its known n-grams of the greatest length that has any.
    Texts that are null, empty or without letters are ``und`` with score 0, as are all texts under
    a model that learned no language. Repeated rows give repeated results, an empty table none.
    """
    names = np.array([*model.langs, UNKNOWN], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value.langs:
            best, score = shared.value.score(piece)
        else:
            best, score = np.full(piece.n, -1), np.zeros(piece.n)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(per_piece(run, text_col, PIECE), schema)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs``, by ``label_language``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return label_language(rows, model).select("doc_id", "lang_pred", "score")
