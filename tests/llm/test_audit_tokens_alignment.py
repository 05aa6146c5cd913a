"""The filter audit, token files and the alignment of tokenizers against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import difference, duck
from conftest import DATA
from tokenizers import Tokenizer

from pluvio.llm import alignment, token_files
from pluvio.llm import queries as Q
from pluvio.llm.filter_audit import audit_filters
from pluvio.llm.token_files import read_digests, read_tokens, shards, write_tokens

SMALL = f"{DATA}/sf0.001"
A_FILE, B_FILE, W_FILE = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a \n b", "\ta b", "don't  stop 's", "▁x", "a▁ b", "<0x41>", "<|endoftext|>", "x <|endoftext|> y", "<s> </s> <unk>", "日本語 中文 text", "é é ́ x", "İ Σας ΣΑΣ", "᠎ a ᠎b", "a \x1cb \x85 c",
    "emoji 😀😀 👩‍👩 end", "\u0000nul", "١٢٣ 12 ½", "ﬁ ﬂ", "a" * 5000, "ab " * 3000, "x\r\ny", " 　 z", "__init__ (self) { return; }",
]


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd(spark, texts=ODD):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, 0), (3, texts[-1], None, "s", 0), (3, texts[-1], None, "s", 0)]
    return spark.createDataFrame(rows, DOCS + "").selectExpr("*", "1 as block", "2 as pair", "3 as shard", "4 as part", "5 as of")


# The filter audit


def brute_audit(rows, labels):
    """Every document through every order, step by step."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, part in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        own = labels.get(i, (None, None))
        seen.append((part or "", bad, own[0] == 1, own[1] == 1))
    out, shapley = {}, Counter()
    for part in {s[0] for s in seen}:
        for order in permutations("ABCDE"):
            left = [s for s in seen if s[0] == part]
            for k, f in enumerate(order):
                gone, stay = [s for s in left if s[1][f]], [s for s in left if not s[1][f]]
                fails = [s for s in seen if s[0] == part and s[1][f]]
                out[part, "".join(order), k + 1] = [len(stay), len(gone), len(fails) - len(gone), sum(sum(s[1].values()) == 1 for s in fails), sum(s[2] for s in gone), sum(s[3] for s in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(found):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in found.collect()}


def test_audit_equals_its_sql(spark):
    assert difference(Q.op12_filter_audit(spark, SMALL).toArrow(), duck(SMALL).execute(Q.SQL["op12_filter_audit"]).to_arrow_table()) is None


def test_audit_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "A B", "x " * 300, " ".join(f"w{k}" for k in range(250)), "a#b", "CAPS", "x\v y"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "p", "q"])) for _ in range(200)] + [(7, "hot", "p")] * 50 + [(k, "hot", "q") for k in range(50)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(25) if k % 3] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "2 as good", "3 as same", "4 as subset", "5 as toxic")
    found = audited(audit_filters(docs, spark.createDataFrame([*labels, *labels], "doc_id long, quality int, toxic int")))
    assert found == brute_audit(rows, {k: v for k, *v in labels if k is not None}) and len(found) == 3 * 600


def test_audit_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit_filters(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# Token files


def brute_tokens(rows):
    """``doc_id, start, n, crc`` by the tokenizer on whole texts."""
    tokenizer, out, start = Tokenizer.from_file(W_FILE), [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_tokenizer(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    assert sorted(map(tuple, Q.op13_token_files(spark, SMALL).collect())) == brute_tokens(rows)


SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@pytest.mark.parametrize(("by_word", "short"), [(True, SHORT), (True, None), (False, None)])
def test_token_files_of_odd_rows(spark, tmp_path, by_word, short):
    path = str(tmp_path / "tokens")
    write_tokens(odd(spark), path, W_FILE, 2, by_word, short)
    found = sorted(map(tuple, read_digests(spark, path).collect()), key=lambda r: r[1])
    ids = [r[0] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == len(ODD) + 3
    texts = {**dict(enumerate(ODD)), None: "no id"}
    own = lambda i, text: brute_tokens([(i, text)])[0][2:]
    assert sorted(map(repr, ((r[0], r[2], r[3]) for r in found))) == sorted(map(repr, [(i, *own(i, t)) for i, t in texts.items()] + [(3, *own(3, ODD[-1]))] * 2))
    assert [r[1] for r in found] == [sum(r[2] for r in found[:k]) for k in range(len(found))]


def test_tokens_are_read_in_part(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(documents(spark), path, W_FILE, 2, True)
    tokenizer, whole = Tokenizer.from_file(W_FILE), []
    for _, text in sorted((r["doc_id"], r["text"]) for r in documents(spark).collect()):
        whole += [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    for start, stop in ((0, 10), (777, 25_000), (len(whole) - 5, len(whole) + 100), (0, len(whole)), (5, 5)):
        got = [i for r in read_tokens(spark, path, start, stop).orderBy("start").collect() for i in r["ids"]]
        assert got == whole[start:stop]
    assert sum(r["n_ids"] for r in shards(spark, path).collect()) == len(whole)


def test_token_files_of_no_rows(spark, tmp_path):
    write_tokens(documents(spark).where("false"), str(tmp_path / "t"), W_FILE, 2, True)
    assert read_digests(spark, str(tmp_path / "t")).count() == 0


def test_the_grammar_derives_its_ids_alone():
    rng = np.random.default_rng(7)
    for k in range(150):
        terminals = int(rng.choice([7, 70_000]))
        ids = rng.integers(0, rng.integers(1, 7), rng.integers(0, 600)).astype(np.uint32)
        ids = np.tile(ids, rng.integers(1, 5)) if k % 3 else ids
        rules, lengths, sequence = token_files.re_pair(ids, terminals, 2)
        assert (token_files.expand(sequence, rules, lengths, terminals) == ids).all()
        assert all(lengths[i] == len(token_files.expand(np.array([terminals + i]), rules, lengths, terminals)) for i in range(len(rules)))
        for _ in range(3):
            start = int(rng.integers(0, len(ids) + 1))
            n = int(rng.integers(0, len(ids) - start + 1))
            assert (token_files.expand_part(sequence, rules, lengths, terminals, start, n) == ids[start : start + n]).all()
    often = np.tile(np.arange(50, dtype=np.uint32), 2000)
    rules, _, sequence = token_files.re_pair(often, 50_000)
    assert len(sequence) < len(often) / 500 and sequence.itemsize == 2


def test_a_document_above_one_grammar_has_several(monkeypatch):
    monkeypatch.setattr(token_files, "GRAMMAR_IDS", 1000)
    out, rng = token_files._Writer(0, 100), np.random.default_rng(3)
    docs = [rng.integers(0, 100, n).astype(np.uint32) for n in (10, 5300, 1, 400, 200, 999)]
    rows = [r for k, d in enumerate(docs) for r in (out.add(d), list(out.end(k, len(d))))[1]] + list(out.row())
    assert max(len(r["grammars"]) for b in rows for r in b.to_pylist()) > 4
    starts = token_files.pa.RecordBatch.from_pylist([{**r, "start": r["first"]} for b in rows for r in b.to_pylist()])
    got = [tuple(r.values()) for b in token_files._digests([starts]) for r in b.to_pylist()]
    assert got == [(k, sum(map(len, docs[:k])), len(d), zlib.crc32(d.astype("<u4").tobytes())) for k, d in enumerate(docs)]


def test_words_and_parts_lose_nothing():
    """Every character of ASCII beside letters, marks and spaces, and some others; in words, in parts and whole."""
    rng, plain = random.Random(4), Tokenizer.from_file(W_FILE)
    bits = [chr(c) for c in range(128)] * 3 + [chr(c) for c in range(128, 0x530)] + ["'s", "'LL", "'re", "  ", "The", "don't", "é", "́", "İ", "Σ", "日", "\u00a0", "\x85", "<|endoftext|>", "<|startoftext|>", "12", "ſ", "K", " ", " ", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(8000)]
    whole = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for short in (SHORT, None):
        encoder = token_files.Encoder(W_FILE, True, short)
        for k in range(0, len(texts), 500):
            ids, size = encoder.encode(token_files.pa.array(texts[k : k + 500]))
            assert size.tolist() == [len(w) for w in whole[k : k + 500]] and ids.tolist() == [i for w in whole[k : k + 500] for i in w]


def test_long_texts_are_cut_where_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(token_files, "AT_ONCE", 50)
    encoder = token_files.Encoder(W_FILE, True)
    for text in ("word " * 100, "a" * 300, "x" * 80 + " " + "y" * 90, "", " " * 200, "one two " + "z" * 200 + " three"):
        parts = list(encoder.stretches(text))
        assert "".join(parts) == text
        assert encoder.encode(token_files.pa.array(parts))[0].tolist() == Tokenizer.from_file(W_FILE).encode(text, add_special_tokens=False).ids


# The alignment


def brute_alignment(rows):
    """Tokens of whole texts, groups and links by their offsets, pair by pair."""
    a_tok, b_tok = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_tok.encode_special_tokens = True
    of = alignment.byte_level()
    a_bytes = lambda t: bytes(of[c] for c in a_tok.id_to_token(t))

    def b_bytes(t):
        piece = b_tok.id_to_piece(t)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    found, times = [], Counter()
    for i, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            found.append((i, [], [], "", []))
            continue
        spans = []
        for ids, to in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for t in ids:
                own.append((at, at + len(to(t)), t))
                at += len(to(t))
            spans.append(own)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(t) for s, e, t in own if low <= s and e <= high) for own in spans))
            low = high
        links, j = [], 0
        for s, e, t in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((t, spans[1][k][2]))
                k += 1
        times.update(links)
        found.append((i, a, b, hashlib.sha256(";".join(groups).encode()).hexdigest(), links, len(groups)))
    best = Counter()
    for (_, b), n in times.items():
        best[b] = max(best[b], n)
    return [(f[0], len(f[1]), len(f[2]), f[5] if f[4] else 0, len(f[4]), f[3], sum(times[x] == best[x[1]] for x in f[4]), sum(times[x] for x in f[4])) for f in found]


def test_alignment_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = sorted(tuple(r[c] for c in names) for r in Q.op11_cross_tokenizer(spark, SMALL).collect())
    assert got == sorted(brute_alignment(rows)) and sum(r[4] for r in got) > 10_000


def test_alignment_of_odd_rows(spark):
    docs = odd(spark)
    got = sorted(map(tuple, alignment.align(docs, A_FILE, B_FILE).collect()), key=repr)
    assert got == sorted(brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    assert {r[0] for r in got if r[1] == 0 and r[0] is not None} >= {0, 1}
    assert alignment.align(docs.where("false"), A_FILE, B_FILE).count() == 0


def test_cuts_lose_nothing():
    """Stretches encoded one by one give the ids of the whole text, in both tokenizers."""
    rng, pair = random.Random(9), alignment.Pair(A_FILE, B_FILE)
    bits = [" ", "  ", "\n", "\t", "a", "B", "'s", "'", "12", ".", "é", "日", " ", "　", "▁", "😀", "<", "the", " and", "᠎", "\x1c", "́"]
    assert pair.cuts
    for _ in range(3000):
        text = " " + "".join(rng.choices(bits, k=rng.randint(1, 25)))
        parts = alignment._cut(text)
        (whole_a,), (whole_b,) = pair.encode([text])
        a, b = pair.encode(parts)
        assert "".join(parts) == text and sum(a, []) == whole_a and sum(b, []) == whole_b
