"""The corpus operators against brute force, round trips and planted cases, on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from compare import difference, duck
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from pluvio.llm import queries as Q
from pluvio.llm.chat import PARTS, format_turns, read_back
from pluvio.llm.decontaminate import contaminated, judge_documents
from pluvio.llm.exact_dedup import exact_dedup
from pluvio.llm.language_id import fit_language_model, identify_language
from pluvio.llm.mixing import find_exponent, mix_sources
from pluvio.llm.near_dedup import near_dedup
from pluvio.llm.pii import base_spans, find_pii
from pluvio.llm.quality import fit_quality_model, sample_labels, score_quality
from pluvio.llm.sharding import assign_shards
from pluvio.llm.substring_dedup import substring_dedup

SMALL = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path=SMALL):
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c d e f g", "en", "web", 13), (2, "a b c d e f g", "en", "web", 13), (2, "a b c d e f g", "en", "web", 13), (3, None, None, None, None),
        (4, "", "de", "web", 0), (5, " \t\n", "de", None, 3), (None, "text without id", "en", "web", 15), (6, long, "en", "books", len(long)), (7, "ü€😀 日本語", None, "web", 7), (8, "x", "en", "", 1), (9, "12 34 !!", "en", "web", 8),
    ]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in ("h", "id", "rep", "anchor", "shard", "score", "size", "block", "of", "piece", "prefix", "key", "a", "b")])


OPERATORS = {
    "language": lambda d: identify_language(d, fit_language_model(d)),
    "quality": lambda d: score_quality(d, fit_quality_model(d.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label")))),
    "exact": exact_dedup,
    "substring": substring_dedup,
    "near": near_dedup,
    "pii": find_pii,
    "mixing": mix_sources,
    "sharding": assign_shards,
    "decontaminate": lambda d: judge_documents(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables_give_a_row_for_each_row(odd, name):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](odd.where("false")).count() == 0


def test_exact_keeps_the_longest_then_the_smallest(spark):
    rows = [(5, "a b", "", "", 0), (4, "ab", "", "", 0), (3, "a  b", "", "", 0), (2, "a \tb", "", "", 0), (9, None, "", "", 0), (8, "", "", "", 0), (7, "  ", "", "", 0), (6, "c", "", "", 0)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {5: (2, 4, False), 4: (2, 4, False), 3: (2, 4, False), 2: (2, 4, True), 9: (7, 3, False), 8: (7, 3, False), 7: (7, 3, True), 6: (6, 1, True)}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    assert difference(Q.queries()[name](spark, SMALL).toArrow(), duck(SMALL).execute(Q.SQL[name]).to_arrow_table()) is None


def brute_substring(rows, length=20):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][p : p + length]), (i, p))
    out = {}
    for i, ws in words.items():
        gone = set()
        for p in range(len(ws) - length + 1):
            if first[tuple(ws[p : p + length])] < (i, p):
                gone.update(range(p, p + length))
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest())
    return out


def test_substring_equals_brute_force(spark):
    docs = documents(spark)
    planted = [(90_001, "p " + " ".join(f"t{i % 3}" for i in range(70)), "en", "x", 0), (90_002, " ".join(f"t{i % 3}" for i in range(66)) + " end", "en", "x", 0), (90_003, " ".join(f"u{i}" for i in range(19)), "en", "x", 0), (90_004, " ".join(f"u{i}" for i in range(20)), "en", "x", 0), (90_005, "q " + " ".join(f"u{i}" for i in range(20)), "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, DOCS)).select("doc_id", "text").repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["s"]) for r in substring_dedup(docs).select("*", F.sha2("kept_text", 256).alias("s")).collect()}
    assert got == brute_substring([tuple(r) for r in docs.collect()])


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_near(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def test_near_equals_brute_force(spark):
    base = [f"v{i}" for i in range(100)]
    near = [(90_000 + k, " ".join(base[:k] + [f"z{k}"] + base[k:]), "en", "x", 0) for k in range(0, 30, 3)] + [(91_000, "Two Words", "", "", 0), (91_001, "two words", "", "", 0), (91_002, "two", "", "", 0)]
    docs = documents(spark).unionByName(spark.createDataFrame(near, DOCS)).select("doc_id", "text").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(docs).collect()}
    assert got == brute_near([tuple(r) for r in docs.collect()])


def test_pipeline_near_duplicates_from_four_fifths(spark):
    """Against brute force at 0.8: pairs at and just above it, below it, and sets whose sizes alone are under 0.85."""
    rows = [(100 * g + n, " ".join(f"g{g}w{i}" for i in range(n))) for g, sizes in enumerate([(84, 104), (84, 105), (85, 104), (60, 72, 86)], 1) for n in sizes]
    rows += [(900 + k, " ".join([f"e{i}" for i in range(60)][:k] + ["z"] + [f"e{i}" for i in range(k + 1, 60)])) for k in (20, 40)]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], DOCS)
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert got == set(root.values()) and len(got) < len(rows)
    assert {r["doc_id"] for r in near_dedup(docs).where("kept").collect()} == set(sets)


def test_near_with_large_nodes(spark, monkeypatch):
    """Leaves so small that nodes branch, and what stays large is compared block by block."""
    from pluvio.llm import near_dedup as module

    monkeypatch.setattr(module, "LEAF", 6)
    base = [f"v{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join(base[:k] + [f"z{k}"] + base[k:]), "en", "x", 0) for k in range(0, 120, 3)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(docs).collect()}
    assert got == {i: c for i, (_, c, _) in brute_near([(r["doc_id"], r["text"]) for r in docs.collect()]).items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    def luhn(digits):
        return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_equal_the_patterns(spark):
    texts = [r["text"] or "" for r in documents(spark).collect()]
    texts += ["a@b a@b.c@d.e x@@y.z a@-.-", "1.2.3.4.5.6.7.8 300.1.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 + 1 +49 30 1234567890123", "é" * 9 + " me@ex.org +4915112345678.", "1" * 40, "0000.0000.0000.0255"]
    for text in texts:
        assert base_spans(text) == brute_base(text)


def test_pii_adds_spans_and_leaves_prose(spark):
    docs = spark.createDataFrame([(1, "please call 555-010-2233 or write to a@b.org", "", "", 0), (2, "the river was 12 km long in 1999 and green", "", "", 0), (3, "SSN 123-45-6789 belongs to nobody", "", "", 0)], DOCS)
    got = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["spans"]] for r in find_pii(docs).collect()}
    assert ("email", True) in got[1] and any(k == "local_phone" for k, _ in got[1])
    assert got[2] == [] and [k for k, _ in got[3]] == ["national_id"]


def test_mixing_meets_its_limits(spark):
    docs = documents(spark)
    got = mix_sources(docs, entropy=0.95, most_repeats=4.0).toPandas()
    weights = got.groupby("source", dropna=False)["weight"].first()
    assert abs(weights.sum() - 1) < 1e-9
    total = got["n_tokens"].sum()
    dealt = (got["n_tokens"] * got["copies"]).groupby(got["source"], dropna=False).sum()
    longest = got["n_tokens"].max()
    assert all(dealt[s] <= weights[s] * total + 1 and dealt[s] >= weights[s] * total - longest - 1 for s in weights.index)
    assert got["copies"].max() <= 5
    spread = got.groupby("source", dropna=False)["copies"].agg(lambda c: c.max() - c.min())
    assert spread.max() <= 1


def test_exponent_by_bisection(spark):
    shares = [0.7, 0.2, 0.06, 0.04]
    sources = spark.createDataFrame([(x, int(1000 * x)) for x in shares], "share double, tokens long")

    def entropy(a):
        p = [x**a for x in shares]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p) / math.log(len(p))

    a = find_exponent(sources, 1000, 0.9, None)
    assert entropy(a) >= 0.9 and entropy(a + 1e-4) < 0.9
    assert find_exponent(sources, 1000, 0.1, None) == 1.0


def test_shards_split_only_where_they_must(spark):
    docs, limit = documents(spark), 40_000
    got = assign_shards(docs, limit).select("doc_id", "shard", F.octet_length("text").alias("n"), "shard_bytes", "shard_rows").collect()
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += r["n"] or 0
    assert all(size[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= limit or r["shard_rows"] == 1) for r in got)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert all(sum(n for s, n in size.items() if s.startswith(name[:-1])) > limit for name in names if len(name) > 1)
    assert len(got) == docs.count()


def test_shards_of_one_id(spark):
    docs = spark.createDataFrame([(1, "x" * 1000, "en", "a", 1000)] * 30, DOCS)
    got = assign_shards(docs, 4000).groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert sum(r["n"] for r in got) == 30_000 and all(r["n"] <= 4000 for r in got)


def test_templates_catch_other_numbers_and_names(spark):
    item = "a train leaves Boston at 7 in the morning and travels 120 miles before it stops to wait for Alice"
    other = "Some start here. " + item.replace("Boston", "Denver").replace("120", "45").replace("Alice", "Carla") + " and more text follows."
    clean = "a train leaves early in the morning and nobody travels far before the bus stops to wait for rain"
    docs = spark.createDataFrame([(1, item, "", "", 0), (2, other, "", "", 0), (3, clean, "", "", 0), (4, None, "", "", 0)], DOCS)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7): False, (2, 7): True}


def test_windows_of_slots_count_word_for_word(spark):
    item = "a train leaves the old station in the morning and travels far before it stops to wait"
    names = "Anna Bert Carl Dora Emil Fred Gina Hans Inge Jack Kurt Lena Mark"
    sums = "12 34 56 78 90 11 22 33 44 55 66 77 88"
    texts = [f"X {item.upper()} X", f"x {item.title()} x", f"x {names} x", f"x {sums} x", f"x {sums.replace('55', '54')} x", f"x {names[::-1].title()} x"]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(7, item), (8, names), (9, sums)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["reparameterised"]) for r in contaminated(docs, bench).collect()}
    assert got == {(0, 7): (6, False), (1, 7): (6, False), (2, 8): (2, False), (3, 9): (2, False)}


def test_one_conflict_leaves_the_other_windows(spark):
    gap = "and then we walked along the river until the market was open again for all of us"
    item = f"there were 5 boats on the shore {gap} while 5 birds sat near"
    swap = "a boy named Anna gave 3 red apples to the man called Bert before noon"
    docs = [(1, item.replace("5 boats", "6 boats")), (2, swap.replace("Anna", "Carl")), (2, swap.replace("Anna", "Dora")), (3, swap.replace("Anna", "Carl").replace("Bert", "Carl"))]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(7, item), (8, swap)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["reparameterised"]) for r in contaminated(docs, bench).collect()}
    # Three of the windows of item 7 hold the number that was changed.
    assert got == {(1, 7): (len(item.split()) - 11 - 3, True), (2, 8): (len(swap.split()) - 11, True)}


def test_short_items_are_found(spark):
    texts = [
        'He asked, "Which river flows through Boston?" and left.', "They say Which river flows through Denver these days", "which river flows slowly through Boston", "Well: who am I?\nNobody.", 'He said "Who am I?" twice', "tell me who am I to say", "who\nam I", "so 2 + 2 = 4\n2 + 2 = 4\n", "Yes.", "yes of course",
        "it goes Every day the boats leave from this old port early here",
    ]
    items = [(1, "Which river flows through Boston?"), (2, "Who am I?"), (3, "2 + 2 = 4"), (4, "yes"), (5, "Every day the boats leave from this old port early"), (6, "?")]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["reparameterised"]) for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1): (1, False), (1, 1): (1, True), (3, 2): (1, False), (4, 2): (1, False), (6, 2): (1, False), (7, 3): (1, False), (8, 4): (1, False), (10, 5): (1, False)}


def test_chat_parts_and_round_trip(spark):
    parts = [("text", "look <|im_end|>", None, None, None, None, None), ("image", None, "pic.png", 56, 57, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("odd", "plain", None, None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "fine <\\| <|x|>", None), (2, None, None, None, None)], f"conv_id long, turn long, role string, text string, parts {PARTS}")
    rows = {(r["conv_id"], r["turn"]): r for r in format_turns(turns).collect()}
    first = rows[1, 0]
    assert first["piece"] == "<|im_start|>user\nlook <\\|im_end|><|image:0.2|><|audio:0.3|><|document:0.4|>plain<|im_end|>\n"
    assert [(a["ref"], a["tokens"]) for a in first["attachments"]] == [("pic.png", 6), ("a.wav", 50), ("d.pdf", 3072)] and first["n_attachment_tokens"] == 3128
    back = {r["conv_id"]: r for r in read_back(format_turns(turns.drop("parts"))).collect()}
    assert back[1]["loss_sha256"] == hashlib.sha256(b"fine <\\| <|x|>").hexdigest() and back[2]["n_turns"] == 1


def test_language_on_held_out_rows(spark):
    got = Q.op10_language_id(spark, f"{DATA}/sf0.01").join(documents(spark, f"{DATA}/sf0.01").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    got = Q.op1_quality(spark, f"{DATA}/sf0.01").where("held_out").join(labels, "doc_id").where("quality is not null")
    right, n, base = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.count("*"), F.avg("quality")).first()
    assert n > 50 and right > max(base, 1 - base)


def test_labels_are_bounded_and_settled(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert {tuple(r) for r in sample_labels(labels, "quality").collect()} == {(1, 1), (2, 0)}
    assert sample_labels(labels, "quality", 1).count() == 1


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against the operators' own brute force where there is one."""
    docs = documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_duplicates":
            want = {i for i, (_, _, kept) in brute_near([(r["doc_id"], r["text"]) for r in before.collect()], corpus_pipeline.NEAR_PERCENT).items() if kept}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        if name == "sharding":
            assert docs.count() == before.count()
        assert docs.count() > 0
