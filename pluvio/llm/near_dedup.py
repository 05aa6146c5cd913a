"""Near-duplicates by chosen paths: documents branch on minwise tokens until nodes are small."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.components import components
from pluvio.llm.runtime import cut, dealt_anew
from pluvio.llm.words import GOLDEN, LOWER, STEP, Piece, hash_runs, hash_words, mix, per_group, per_piece, pieces

SHINGLE = 5
#: Minwise tokens of a document; tree t branches on token t first.
N_TOKENS = 128
TREES = 12
#: Nodes of up to so many documents are compared exhaustively; their full sets are held for so many shingles at once.
LEAF, MOST_SHINGLES = 2500, 3_000_000
#: Nodes above so many documents have leaders before they branch.
LED_FROM = 10_000
#: Documents that one copy of a leader's text serves.
LED = 200
#: Up to so many leaders' tokens (10 MB), and up to so many ids, are broadcast.
BROADCAST_LEADERS, BROADCAST_IDS = 20_000, 500_000
#: Documents outside a node's main group up to which these are compared with all of it, in blocks; with more the node branches.
REST = 2500
#: Children of a document in a larger node. With links at 0.8 or 0.85, more than one expected child keeps both ends.
BRANCHES = 2
DEPTH = 4

FACTORS = mix(np.arange(1, N_TOKENS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingle_sets(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one after the other, and the bounds between them."""
    data = LOWER[piece.data]
    piece.words(data)
    word = hash_words(data, piece.starts, piece.stops)
    run = hash_runs(word, SHINGLE)
    found = []
    for i, (a, b) in enumerate(zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            own = np.sort(run[a : b - SHINGLE + 1])
            found.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            found.append(hash_runs(word[a:b], b - a) + np.uint64(b - a))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), bounds


def minwise(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``N_TOKENS`` minwise tokens of each set, 32 bits each; zeros for an empty set."""
    out = np.zeros((len(bounds) - 1, N_TOKENS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for t in range(N_TOKENS):
            out[full, t] = (np.minimum.reduceat(sets * FACTORS[t], bounds[full]) >> np.uint64(32)).astype(np.uint32)
    return out


def _sign(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
    sets, bounds = shingle_sets(piece)
    size = np.diff(bounds)
    keys = np.zeros((2, piece.n), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        for i, salt in enumerate((GOLDEN, STEP)):
            keys[i, full] = np.add.reduceat(mix(sets ^ salt), bounds[full])
    tokens = minwise(sets, bounds)
    heads = pa.FixedSizeListArray.from_arrays(pa.array(tokens[:, :TREES].astype(np.int64).ravel()), TREES).cast(pa.list_(pa.int64()))
    packed = pa.array([x.tobytes() for x in tokens], pa.binary())
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), heads, packed], names=["doc_id", "n_shingles", "k1", "k2", "heads", "tokens"])


def _tokens(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, N_TOKENS)


def _near_leader(least: int, percent: int):
    """The documents that agree with a leader in ``least`` tokens and have a size that allows a link; and whether they agree in as many as linked ones do in the mean."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, other = (batch.column(c).to_numpy() for c in ("n_shingles", "l_size"))
            equal = (_tokens(batch.column("tokens")) == _tokens(batch.column("l_tokens"))).sum(axis=1)
            at = np.flatnonzero((equal >= least) & (100 * np.minimum(size, other) >= percent * np.maximum(size, other)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("leader", "doc_id")], pa.array(100 * equal[at] >= percent * N_TOKENS)], names=["leader", "doc_id", "sure"])

    return run


def _verify(percent: int):
    """Which texts are linked with the leader's text beside them, on the full sets."""

    def run(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(piece)
        beside = rows.column("l_text").dictionary_encode()
        which = beside.indices.to_numpy()
        linked = np.zeros(piece.n, dtype=bool)
        for other in pieces(beside.dictionary):
            leader, ends = shingle_sets(other)
            for k in range(other.n):
                own = leader[ends[k] : ends[k + 1]]
                for i in np.flatnonzero(which == other.first + k).tolist():
                    x = sets[bounds[i] : bounds[i + 1]]
                    common = int(np.isin(x, own, assume_unique=True).sum())
                    linked[i] = 100 * common >= percent * (len(x) + len(own) - common)
        at = pa.array(np.flatnonzero(linked))
        return pa.RecordBatch.from_arrays([rows.column(c).take(at) for c in ("leader", "doc_id")], names=["a", "b"])

    return per_piece(run)


def _led(large: DataFrame, source: DataFrame, least: int, percent: int) -> DataFrame:
    """Links of documents of very large nodes with leaders.

    The least id of a node that no leader has reached leads: all documents of the node are compared
    with it by tokens. So a large group of near copies is reached in a few times as many comparisons
    as it has documents. A round is for the nodes of one tree that have more than ``LEAF`` documents
    which were not reached; all candidates are then confirmed on the full sets, in one pass over
    their texts. What is connected then needs no comparison any more; all other pairs still do.
    """
    nodes = cut(large.select("path", "doc_id", "tree"))
    held = cut(large.select("doc_id", "n_shingles", "tokens").dropDuplicates(["doc_id"]))
    found, reached = [], []
    for tree in sorted(r["tree"] for r in nodes.select("tree").distinct().collect()):  # at most TREES
        own_tree = nodes.where(F.col("tree") == tree)
        free = own_tree.join(dealt_anew(functools.reduce(DataFrame.unionByName, reached)), "doc_id", "left_anti") if reached else own_tree
        lead = free.groupBy("path").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where(F.col("n") > LEAF).select("path", "leader")
        pairs = cut(dealt_anew(own_tree).join(dealt_anew(cut(lead)), "path").where("doc_id <> leader").select("leader", "doc_id"))
        if pairs.isEmpty():
            continue
        leaders = pairs.select("leader").distinct().join(held.select(F.col("doc_id").alias("leader"), F.col("n_shingles").alias("l_size"), F.col("tokens").alias("l_tokens")), "leader")
        leaders = cut(leaders)
        beside = F.broadcast(leaders) if leaders.count() <= BROADCAST_LEADERS else dealt_anew(leaders)
        near = cut(pairs.join(held, "doc_id").join(beside, "leader").mapInArrow(_near_leader(least, percent), "leader long, doc_id long, sure boolean"))
        found.append(near.select("leader", "doc_id"))
        reached.append(cut(near.where("sure").select("doc_id").unionByName(leaders.select(F.col("leader").alias("doc_id"))).distinct()))
    near = cut(functools.reduce(DataFrame.unionByName, found).distinct())
    salts = cut(near.groupBy("leader").agg(F.ceil(F.count("*") / LED).cast("int").alias("salts")))
    texts = _only(source, salts.select(F.col("leader").alias("doc_id"))).select(F.col("doc_id").alias("leader"), F.col("text").alias("l_text"))
    texts = texts.join(dealt_anew(salts), "leader").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = near.join(dealt_anew(salts), "leader").select("leader", "doc_id", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"))
    return cut(dealt.join(_only(source, near.select("doc_id").distinct()), "doc_id").join(texts, ["leader", "salt"]).mapInArrow(_verify(percent), "a long, b long"))


def _only(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids; where these are few enough to broadcast, no other text is shuffled."""
    ids = cut(ids)
    return source.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else source.join(ids, "doc_id", "left_semi")


def _open(nodes: DataFrame) -> DataFrame:
    """The rows of nodes that hold more than one label, with the node's ``size``, its most frequent label ``major``, and how many documents have another, ``rest``."""
    each = nodes.groupBy("path", "label").agg(F.count("*").alias("n")).groupBy("path").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("size"))
    each = each.select("path", F.col("m.label").alias("major"), (F.col("size") - F.col("m.n")).alias("rest"), "size").where("rest > 0")
    return cut(nodes.join(dealt_anew(cut(each)), "path"))


def _elsewhere(tree: np.ndarray, small: np.ndarray) -> np.ndarray:
    """For each row the trees whose small nodes have its pairs first: those before its own, or all if its own node was large."""
    own_small = (small >> tree) & 1
    trees = np.arange(TREES)
    return (((small[:, None] >> trees) & 1) == 1) & ((trees < tree[:, None]) | (own_small == 0)[:, None])


def _pairs(rows: pa.Table, tokens: np.ndarray, size: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row pairs of one leaf (rows in the order of ``path``) with ``least`` equal tokens, sizes that allow a link, and labels that do not yet link them, which no small node of another tree has first: distance and rows."""
    path, tree, small, label = (rows.column(c).to_numpy() for c in ("path", "tree", "small", "label"))
    first = _elsewhere(tree, small)
    for d in range(1, len(path)):
        i = np.flatnonzero(path[:-d] == path[d:])
        if not len(i):
            return
        i = i[(label[i] != label[i + d]) & (100 * np.minimum(size[i], size[i + d]) >= percent * np.maximum(size[i], size[i + d]))]
        for part in np.array_split(i, len(i) // 4096 + 1):
            part = part[~((tokens[part, :TREES] == tokens[part + d, :TREES]) & first[part]).any(axis=1)]
            part = part[(tokens[part] == tokens[part + d]).sum(axis=1) >= least]
            if len(part):
                yield d, part


def _leaf_members(least: int, percent: int):
    """Of each leaf the documents with a pair that is worth a look at the full sets."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        wanted = np.zeros(rows.num_rows, dtype=bool)
        for d, i in _pairs(rows, _tokens(rows.column("tokens")), rows.column("n_shingles").to_numpy(), least, percent):
            wanted[i] = wanted[i + d] = True
        at = pa.array(np.flatnonzero(wanted))
        return pa.RecordBatch.from_arrays([rows.column(c).take(at).combine_chunks() for c in MEMBER], names=list(MEMBER))

    return per_group(run, "path")


MEMBER = {"path": "long", "tree": "int", "small": "int", "label": "long", "n_shingles": "long", "doc_id": "long"}


def _confirm(least: int, percent: int):
    """A spanning forest of each leaf's links, each confirmed on the full sets. Documents that are connected already are not compared."""

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        sets = []
        for piece in pieces(rows.column("text")):
            x, bounds = shingle_sets(piece)
            sets += [x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        size = np.array([len(x) for x in sets])
        flat, bounds = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))
        del sets
        found = list(_pairs(rows, minwise(flat, bounds), size, least, percent))
        if not found:
            return None
        a, b = np.concatenate([i for _, i in found]), np.concatenate([i + d for d, i in found])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        distinct, place = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(distinct), dtype=bool)
        # One path's labels are others than the next one's.
        _, group = np.unique(np.stack((rows.column("path").to_numpy(), rows.column("label").to_numpy())), axis=1, return_inverse=True)
        group = group.ravel()
        links = []
        cuts = np.flatnonzero(np.diff(a)) + 1
        for i, others in zip(a[np.concatenate(([0], cuts))].tolist(), np.split(b, cuts), strict=True):
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            # One set against its candidates at once: its shingles are marked, and theirs looked up.
            own = place[bounds[i] : bounds[i + 1]]
            mark[own] = True
            for part in np.array_split(others, len(others) // 256 + 1):
                length = size[part]
                begin = np.cumsum(length) - length
                at = np.repeat(bounds[part] - begin, length) + np.arange(int(length.sum()))
                common = np.add.reduceat(mark[place[at]].astype(np.int64), begin)
                for j in part[100 * common >= percent * (size[i] + length - common)].tolist():
                    if group[j] != group[i]:
                        group[group == group[j]] = group[i]
                        links.append((i, j))
            mark[own] = False
        if not links:
            return None
        ids = rows.column("doc_id")
        return pa.RecordBatch.from_arrays([ids.take(pa.array([k[s] for k in links])).combine_chunks() for s in (0, 1)], names=["a", "b"])

    return per_group(run, "path", rows=512)


def _in_blocks(rows: DataFrame, blocks: Column, other_blocks: Column, odd: Column) -> DataFrame:
    """Nodes that are too large as pairs of blocks: all documents in ``blocks``, and those that are ``odd`` in ``other_blocks``; so each pair with an odd document meets."""
    one = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    two = F.pmod(F.xxhash64("doc_id", F.lit(1)), other_blocks).cast("int")
    every = rows.withColumns({"__i": one, "__j": F.explode(F.sequence(F.lit(0), other_blocks.cast("int") - 1))})
    some = rows.where(odd).withColumns({"__i": F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)), "__j": two})
    return every.unionByName(some).withColumn("path", F.xxhash64("path", "__i", "__j", F.lit("blocks"))).drop("__i", "__j")


def near_duplicate_links(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and links between the classes.

    Returns ``(rows, links)``: for each row of ``docs`` its ``doc_id``, ``n_shingles`` and ``rep``,
    the smallest id of its class (null without shingles); and links ``a, b`` between class
    representatives, enough of them to connect what ``100 * intersection >= percent * union``
    connects.

    ``TREES`` independent trees branch all representatives on a minwise token each. Of a node above
    ``LED_FROM`` documents, some are compared with all others first (``_led``); what they link is
    connected. A node above ``LEAF`` documents branches on, ``BRANCHES`` tokens a level that hashing
    its path selects, up to ``DEPTH`` levels; but where no more than ``REST`` documents, or after
    the last level any, lie outside its main connected group, these are compared with all of the
    node, block by block. Leaves compare tokens exhaustively, and full sets a bounded number of shingles
    at a time. A linked pair meets in no small node with probability ``(1 - percent / 100) ** TREES``
    at most where nodes are small, below 1e-8 from 79 percent on, and agrees in fewer tokens than
    ``least``, 4.6 standard deviations below the mean, with probability of about 1e-5.
    Every link that counts is confirmed on the full sets.
    """
    least = max(1, int(N_TOKENS * (percent / 100 - 4.6 * (percent / 100 * (1 - percent / 100) / N_TOKENS) ** 0.5)))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(source.mapInArrow(per_piece(_sign), "doc_id long, n_shingles long, k1 long, k2 long, heads array<long>, tokens binary"))
    full = signed.where("n_shingles > 0")
    classes = cut(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    rows = signed.drop("heads", "tokens").join(dealt_anew(classes), ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep")
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2", "n_shingles"], "left_semi")

    heads = reps.select("doc_id", F.posexplode("heads").alias("tree", "head"))
    sizes = heads.groupBy("tree", "head").agg(F.count("*").alias("size")).where("size > 1")
    nodes = heads.join(dealt_anew(cut(sizes)), ["tree", "head"]).groupBy("doc_id").agg(F.collect_set(F.struct("tree", "head", "size")).alias("nodes"))
    small = F.aggregate(F.filter("nodes", lambda x: x["size"] <= LEAF), F.lit(0), lambda s, x: s.bitwiseOR(F.pow(F.lit(2), x["tree"]).cast("int")))
    placed = reps.select("doc_id", "n_shingles", "tokens").join(nodes, "doc_id").select("doc_id", "n_shingles", "tokens", small.alias("small"), F.explode("nodes").alias("node"))
    placed = cut(placed.select("doc_id", "n_shingles", "tokens", "small", F.col("doc_id").alias("label"), "node.tree", F.xxhash64("node.tree", "node.head").alias("path"), "node.size"))

    columns = [c for c in placed.columns if c != "size"]
    leaves, large = placed.where(F.col("size") <= LEAF).select(*columns), placed.where(F.col("size") > LEAF)
    links = None
    if not large.isEmpty():
        huge = large.where(F.col("size") > LED_FROM)
        if not huge.isEmpty():
            links = _led(huge, source, least, percent)
            named = components(links).select(F.col("a").alias("doc_id"), F.col("b").alias("named"))
            large = large.join(dealt_anew(named), "doc_id", "left").withColumn("label", F.coalesce("named", "label"))
        large = _open(large.select(*columns))
        for level in range(DEPTH + 1):
            if large.isEmpty():
                break
            wide = (F.col("size") > LEAF) & F.lit(level < DEPTH) & (F.col("rest") > REST)
            blocks = lambda n: F.greatest(F.lit(1), F.ceil(n * 2 / LEAF))
            leaves = leaves.unionByName(large.where(F.col("size") <= LEAF).select(*columns))
            leaves = leaves.unionByName(_in_blocks(large.where((F.col("size") > LEAF) & ~wide), blocks(F.col("size")), blocks(F.col("rest")), F.col("label") != F.col("major")).select(*columns))
            branch = large.where(wide).withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
            chosen = F.pmod(F.xxhash64("path", "branch"), F.lit(N_TOKENS)).cast("int")
            large = _open(branch.withColumn("path", F.xxhash64("path", "branch", F.substring("tokens", chosen * 4 + 1, F.lit(4)), F.lit(level))).select(*columns))

    schema = ", ".join(f"{c} {t}" for c, t in MEMBER.items())
    members = cut(leaves.repartition("path").sortWithinPartitions("path").mapInArrow(_leaf_members(least, percent), schema).distinct())
    heavy = cut(members.groupBy("path").agg(F.sum("n_shingles").alias("weight")).where(F.col("weight") > MOST_SHINGLES))
    if not heavy.isEmpty():
        blocks = F.ceil(F.col("weight") * 2 / MOST_SHINGLES)
        split = _in_blocks(members.join(heavy, "path"), blocks, blocks, F.lit(True)).select(*MEMBER).distinct()
        members = members.join(heavy, "path", "left_anti").unionByName(split)
    wanted = _only(source, members.select("doc_id").distinct())
    confirmed = members.join(wanted, "doc_id").repartition("path").sortWithinPartitions("path").mapInArrow(_confirm(least, percent), "a long, b long")
    return rows, confirmed if links is None else confirmed.unionByName(links)


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its component of near-duplicates, named by the smallest id in it.

    A text's set is its distinct shingles of five words, A-Z in lower case; a text of one to four
    words has the whole sequence as its one shingle; a null or blank text has none and is linked
    with nothing. Rows with equal sets are one class whatever their number. A row without id comes
    back alone, with null ``component_id``. Repeated ids are judged by the sets of their rows. An
    empty table gives no rows; other columns are ignored.

    Returns ``doc_id, n_shingles, component_id, kept``.
    """
    rows, links = near_duplicate_links(docs, percent, id_col, text_col)
    named = components(links)
    found = rows.join(named, rows["rep"] == named["a"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("b", "rep", "doc_id").alias("component_id"))
    lost = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = lost.mapInArrow(per_piece(_sign), "doc_id long, n_shingles long, k1 long, k2 long, heads array<long>, tokens binary").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(lost).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
