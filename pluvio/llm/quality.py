"""Quality classifier: n-gram indicators scaled by naive Bayes ratios, and a hinge loss fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.llm.runtime import cut
from pluvio.llm.words import LOWER, STEP, Piece, hash_runs, hash_words, inside, mix, per_piece

#: Bits of a feature's number; n-grams that share a number share a weight.
BITS = 18
#: Longest n-gram of words, and of word shapes.
WORDS, SHAPES = 2, 3


def _classes() -> np.ndarray:
    """Of each byte: 0 lower case or other, 1 upper case, 2 digit, 3 mark."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[65:91] = 1
    kind[48:58] = 2
    kind[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = 3
    return kind


CLASS = _classes()


def _shapes(piece: Piece, word: np.ndarray) -> np.ndarray:
    """A number for what each word looks like: case, digits, marks at its end, length, and whether it repeats one of the two words before."""
    n = len(word)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    kind, starts, stops = CLASS[piece.data], piece.starts, piece.stops
    length = stops - starts
    upto = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3)]
    upper, digit, mark = (u[stops] - u[starts] for u in upto)
    case = np.where(upper == 0, 0, np.where(upper + digit + mark >= length, 2, 1))
    last = np.where(kind[stops - 1] == 3, piece.data[stops - 1], 0)
    marks = np.minimum(mark, 3)
    size = np.minimum(np.log2(length + 1).astype(np.int64), 5)
    again = np.zeros(n, dtype=np.int64)
    again[1:] += word[1:] == word[:-1]
    again[2:] += 2 * (word[2:] == word[:-2])
    # Words of the text before do not count.
    first = piece.bounds[:-1]
    again[first[first < n]] = 0
    again[first[piece.per_text >= 2] + 1] &= 1
    packed = ((((case * 256 + last) * 4 + marks) * 8 + size) * 2 + (digit > 0)) * 4 + again
    return mix(packed.astype(np.uint64) * STEP + np.uint64(7))


def indicators(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of the texts, one after the other, and the bounds between them."""
    data = LOWER[piece.data]
    piece.words(data)
    word = hash_words(data, piece.starts, piece.stops)
    n = len(word)
    text = np.repeat(np.arange(piece.n, dtype=np.int64), piece.per_text)
    keys = []
    for salt, stream, longest in ((1, word, WORDS), (2, _shapes(piece, word), SHAPES)):
        for k in range(1, longest + 1):
            h = mix(hash_runs(stream, k) + np.uint64(salt * 16 + k))
            ok = inside(piece.bounds, n, k)
            keys.append((text[: len(h)][ok] << BITS) | (h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
    keys.append(np.arange(piece.n, dtype=np.int64) << BITS)  # one that every text has, the bias
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(piece.n + 1, dtype=np.int64) << BITS)


def _labelled(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
    feature, bounds = indicators(piece)
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(feature.astype(np.int32)))
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), lists], names=["doc_id", "label", "features"])


class QualityModel:
    """Naive Bayes ratio and fitted weight of each feature."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, scale: float) -> None:
        self.ratio, self.weight, self.scale = ratio.astype(np.float32), weight.astype(np.float32), scale

    def score(self, piece: Piece) -> np.ndarray:
        feature, bounds = indicators(piece)
        r = self.ratio[feature].astype(np.float64)
        norm = np.sqrt(np.maximum(np.add.reduceat(r * r, bounds[:-1]), 1e-12))
        margin = np.add.reduceat(r * self.weight[feature], bounds[:-1]) / norm
        return 1 / (1 + np.exp(-np.clip(self.scale * margin, -30, 30)))


def fit_quality_model(labelled: DataFrame, most_rows: int = 12_000, most_features: int = 16_000_000, alpha: float = 1.0, cost: float = 4.0, epochs: int = 12, seed: int = 5) -> QualityModel:
    """Fits on ``labelled`` (``doc_id, text, label``): label 1 is good, 0 is not.

    Features are indicators of word n-grams (to ``WORDS``) and word-shape n-grams (to ``SHAPES``),
    hashed to ``BITS`` bits. Each is scaled by the log ratio of its class shares, smoothed by
    ``alpha``; vectors have length one. The hinge loss with L2 regularisation is minimised by dual
    coordinate descent, ``epochs`` passes in seeded order, the classes weighed evenly. The sample
    that reaches the driver has at most ``most_rows`` rows and ``most_features`` features in all.
    Rows of one id, label and features count once, and an id with very many others gives a hundredth
    of the rows and a fiftieth of the features at most, so that no id crowds out the rest; then ids
    are taken in the order of their hash as long as both bounds hold, and those above the bound of
    features by themselves are passed over. Callers draw ids by the same order first
    (``sample_labels``), so that few texts are read in vain. Rows without id or label are ignored. A single class, or no row, gives a model that scores that class, or 0.5.
    """
    found = labelled.where("label is not null").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = found.mapInArrow(per_piece(_labelled), f"doc_id {dict(labelled.dtypes)['doc_id']}, label int, features array<int>")
    same = F.xxhash64("features")
    rows = rows.where("doc_id is not null").groupBy("doc_id", "label", same.alias("h")).agg(F.first("features").alias("features"))
    own = Window.partitionBy("doc_id").orderBy("h", "label")
    rows = rows.withColumns({"place": F.row_number().over(own), "upto": F.sum(F.size("features")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    rows = cut(rows.where((F.col("place") <= max(1, most_rows // 100)) & ((F.col("place") == 1) | (F.col("upto") <= most_features // 50))).drop("h", "place", "upto"))
    each = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.size("features")).alias("size"))
    each = each.where(F.col("size") <= most_features).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # most_rows rows
    taken = each.withColumns({"n": F.sum("n").over(so_far), "size": F.sum("size").over(so_far)}).where((F.col("n") <= most_rows) & (F.col("size") <= most_features))
    got = rows.join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi").orderBy("doc_id", "label", "features").select("label", "features").toArrow()
    lists = pa.chunked_array(got.column("features").chunks, pa.list_(pa.int32())).combine_chunks()
    feature, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
    y = np.where(got.column("label").to_numpy() > 0, 1.0, -1.0)
    size = 1 << BITS
    if not len(y) or (y == y[0]).all():
        weight = np.zeros(size)
        ratio = np.zeros(size)
        ratio[0], weight[0] = 1.0, float(y.sum() and y[0])
        return QualityModel(ratio, weight, 4.0)
    sign = np.repeat(y, np.diff(bounds))
    p, q = alpha + np.bincount(feature[sign > 0], minlength=size), alpha + np.bincount(feature[sign < 0], minlength=size)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[0] = ratio[0] or 1e-3
    value = ratio[feature]
    value /= np.repeat(np.sqrt(np.maximum(np.add.reduceat(value * value, bounds[:-1]), 1e-12)), np.diff(bounds))
    upper = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    square = np.add.reduceat(value * value, bounds[:-1])
    weight, dual, order = np.zeros(size), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)).tolist():
            f, x = feature[bounds[i] : bounds[i + 1]], value[bounds[i] : bounds[i + 1]]
            slope = y[i] * (weight[f] @ x) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), upper[i])
            if new != dual[i]:
                weight[f] += (new - dual[i]) * y[i] * x
                dual[i] = new
    return QualityModel(ratio, weight, 4.0)


def sample_labels(labels: DataFrame, label_col: str, most_rows: int = 12_000, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, label``, one row an id, of at most ``most_rows`` labelled ids; drawn by the hash of the id where there are more. Labels of one id that differ go to the majority, a tie to 0."""
    one = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).dropna().groupBy("doc_id").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row of ``docs``: from 0 to 1, higher where label 1 is likelier.

    Null and empty texts have the bias alone. Repeated rows give repeated results, an empty table
    none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shared.value.score(piece))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(per_piece(run), "doc_id long, score double")
