"""The registered queries that SQL cannot express, row by row against plain Python on given tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_brute_force import brute_contaminated, brute_exponent, brute_languages, brute_shards

from pluvio.llm import queries as Q
from pluvio.llm import sharding
from pluvio.llm.quality import indicators
from pluvio.llm.words import pieces

SMALL = f"{DATA}/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1_scores(spark):
    """Ratios by counting, and the dual by one coordinate after the other, on dictionaries."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r["quality"] is not None}
    sets = {}
    for i, text in rows:
        feature, _ = indicators(next(pieces(pa.array([text or ""]))))
        sets[i] = feature.tolist()
    known = sorted((i, labels[i], sets[i]) for i, _ in rows if i in labels and fold(i, 3) != 1)
    counts = {1: defaultdict(lambda: 1.0), 0: defaultdict(lambda: 1.0)}
    for _, label, own in known:
        for f in own:
            counts[label][f] += 1
    total = {k: (1 << 18) - len(c) + sum(c.values()) for k, c in counts.items()}
    ratio = {f: math.log(counts[1][f] / total[1]) - math.log(counts[0][f] / total[0]) for own in sets.values() for f in own}
    ratio[0] = ratio[0] or 1e-3
    vector = {i: {f: ratio[f] / math.sqrt(max(sum(ratio[g] ** 2 for g in own), 1e-12)) for f in own} for i, own in sets.items()}
    n = {k: sum(1 for _, label, _ in known if label == k) for k in (0, 1)}
    weight, dual, order = defaultdict(float), [0.0] * len(known), np.random.default_rng(5)
    for _ in range(12):
        for k in order.permutation(len(known)).tolist():
            i, label, _ = known[k]
            y, x = (1 if label else -1), vector[i]
            slope = y * sum(weight[f] * v for f, v in x.items()) - 1
            new = min(max(dual[k] - slope / sum(v * v for v in x.values()), 0.0), 4.0 * len(known) / (2 * n[label]))
            for f, v in x.items():
                weight[f] += (new - dual[k]) * y * v
            dual[k] = new
    got = Q.op1_quality(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    for r in got:
        margin = sum(weight[f] * v for f, v in vector[r["doc_id"]].items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, 4 * margin)))), abs=2e-3)
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.5)


def test_op6_copies(spark):
    """The weights by search over exponents, the copies by the permutation that the hashes give."""
    got = {r["doc_id"]: r for r in Q.op6_mix_sources(spark, SMALL).collect()}
    docs = documents(spark).select("doc_id", "source", "text", F.xxhash64(F.lit(18), "doc_id").alias("h")).collect()
    blank = str.maketrans("\t\n\v\f\r", "     ")
    size = {r["doc_id"]: len([w for w in (r["text"] or "").translate(blank).split(" ") if w]) for r in docs}
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append((r["h"], r["doc_id"]))
    tokens = {s: sum(size[i] for _, i in own) for s, own in by.items()}
    names, budget = sorted(tokens, key=repr), sum(tokens.values())
    a = brute_exponent([tokens[s] for s in names if tokens[s]], budget, 0.99, 4.0, 8.0)
    whole = sum((tokens[s] / budget) ** a for s in names if tokens[s])
    assert set(got) == set(size) and max(tokens.values()) < 1_000_000  # one block a source
    for s in names:
        weight = got[by[s][0][1]]["weight"]
        assert weight == pytest.approx((tokens[s] / budget) ** a / whole if tokens[s] else 0.0, abs=2e-4)
        dealt = math.floor(weight * budget)
        passes = dealt // tokens[s] if tokens[s] else 1
        rest, upto = (dealt - passes * tokens[s] if tokens[s] else 0), 0
        for _, i in sorted(by[s]):
            upto += size[i]
            want = passes + int(upto <= rest and rest > 0) if size[i] else passes + int(passes == 0)
            assert (got[i]["n_tokens"], got[i]["copies"], got[i]["source"]) == (size[i], want, s)
    assert len({r["copies"] for r in got.values()}) > 1


def test_op7_shards(spark):
    rows = documents(spark).select("doc_id", sharding._bits(F.xxhash64(F.lit(1), F.col("doc_id").cast("string"))).alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    want = brute_shards([(r["bits"], r["n"]) for r in rows], min(64 << 20, sum(r["n"] for r in rows) // 64))
    of = {r["doc_id"]: (want[r["bits"]], r["n"]) for r in rows}
    held, count = Counter(), Counter()
    for shard, n in of.values():
        held[shard] += n
        count[shard] += 1
    got = Q.op7_sharding(spark, SMALL).collect()
    assert {r["doc_id"]: (r["shard"], r["n_bytes"], r["shard_bytes"], r["shard_rows"]) for r in got} == {i: (s, n, held[s], count[s]) for i, (s, n) in of.items()} and len(got) == len(rows) and len(held) >= 64


def test_op8_judgements(spark, tmp_path):
    """Every text of the table that brute force can take, and passages of the benchmark within others."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len(r["text"]) < 900][:12]
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect() if r["text"] is None or len(r["text"]) < 1200]
    docs += [(90_000 + i, "some words before it " + t + " and some after") for i, t in items[:6]] + [(90_100, None), (90_101, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = brute_contaminated([(i, t or "") for i, t in docs], items)
    got = {r["doc_id"]: (r["contaminated"], r["n_windows"], r["item_ids"]) for r in Q.op8_decontaminate(spark, str(tmp_path)).collect()}
    want = {}
    for i, _ in docs:
        own = sorted(k for d, k in found if d == i)
        want[i] = (bool(own), sum(found[i, k][0] for k in own), own)
    assert got == want and sum(x[0] for x in want.values()) >= 6


def test_op10_predictions(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).collect()]
    learnt = [(t, x) for i, t, x in rows if t is not None and x is not None and fold(i, 4) != 2]
    want = brute_languages(learnt, [t or "" for _, t, _ in rows])
    got = {r["doc_id"]: r for r in Q.op10_language_id(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-6) and got[i]["held_out"] == (fold(i, 4) == 2)


def test_boilerplate_in_many_documents_and_items(spark):
    """One instruction opens every item and stands in every document: each document is found, with every item that has it, and a clean one is not."""
    from pluvio.llm.decontaminate import judge_documents

    head = "please read the following story with care and then choose one answer of these four"
    items = spark.createDataFrame([(i, f"{head} item{i}x alpha{i}y beta{i}z gamma") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"page{d}a {head} other{d}b words{d}c") for d in range(300)] + [(1000, "nothing of the kind stands here at all, only plain words that go on for some time")], "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in judge_documents(docs, items).collect()}
    assert got.pop(1000) == (False, []) and len(got) == 300 and all(found == (True, list(range(40))) for found in got.values())
