"""Periodic runs, packing and alignment against plain Python, and on odd rows."""

import bisect
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import periodic_runs, token_alignment, vector_packing
from gradeloom.llm.queries import END_ID
from gradeloom.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} x{i}" for i in range(10_000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "one two one two one two one two one"),
    (5, "one two one two one two one two one"),
    (5, "the same id, another text"),
    (None, "a text without an id"),
    (None, None),
    (6, "naïve Ünïcode 日本語 text ▁ with a mark"),
    (7, "<|endoftext|> and </s> are plain text <0x0A>"),
    (8, "  two blanks,   three blanks\x0b\x1f x "),
    (-20, "🦊🦊🦊🦊🦊🦊🦊🦊"),
]


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    names = "runs words n a p block place pairs links part sequence offset ids start length".split()
    return docs.select("*", *(F.lit(1).alias(n) for n in names))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# --- periodic runs -----------------------------------------------------------------


def plain_runs(words):
    """All runs by comparing the words with themselves, shifted by each period; the smallest period of a stretch counts."""
    numbers = np.unique(np.array(words, object).astype(str), return_inverse=True)[1]
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        same = np.flatnonzero(np.diff(np.r_[False, numbers[:-q] == numbers[q:], False].astype(int)))
        for i, j in same.reshape(-1, 2).tolist():
            length = j + q - i
            if length >= max(6, 4 * q):
                inside = numbers[i : j + q]
                if not any((inside[:-d] == inside[d:]).all() for d in range(1, q)):
                    out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept))


def by_text(rows):
    return sorted(rows, key=str)


@needs_data
def test_runs_of_documents(spark, rows):
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()]
    assert by_text(got) == by_text([expected_runs(i, t) for i, t in rows])
    assert sum(r[1] for r in got) > 0


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(600):
        kinds, n = rng.choice([1, 2, 3, 6]), rng.randrange(60)
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            p, a = rng.randrange(1, 9), rng.randrange(n)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert [tuple(r) for r in periodic_runs.runs_of(words)] == plain_runs(words)
        if n:  # the trees over all words say the same as those over stretches
            found = periodic_runs.all_runs([w + 1 for w in words])
            assert [tuple(r) for r in found if r[1] >= max(6, 4 * r[2])] == plain_runs(words)


def test_extensions_are_common_prefixes():
    rng = random.Random(5)
    words = [rng.randrange(1, 3) for _ in range(80)]
    extend = periodic_runs.Extensions(*periodic_runs.SuffixTree(words).tour())
    one, other = np.array([(i, j) for i in range(81) for j in range(81) if i != j]).T
    want = [len(os.path.commonprefix([words[i:], words[j:]])) for i, j in zip(one, other)]
    assert extend(one, other).tolist() == want


def test_runs_of_odd_rows(odd, empty):
    got = [tuple(r) for r in periodic_runs.digests(periodic_runs.found(periodic_runs.with_planted(odd))).collect()]
    assert by_text(got) == by_text([expected_runs(i, t) for i, t in ODD])
    assert periodic_runs.digests(periodic_runs.found(periodic_runs.with_planted(empty))).collect() == []
    texts = {r.doc_id: r.collapsed for r in periodic_runs.found(odd.filter("doc_id in (2, 3, 5)")).collect()}
    assert texts[2] == "" and texts[3] == "" and texts[5] in ("one two", "the same id, another text")


# --- packing -----------------------------------------------------------------------


def token_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_FILE)
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID]) for i, t in rows]


def check_packing(got, examples, limits):
    """Each id lies in one piece, sequences are gapless and within the limits; returns their lengths."""
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for doc_id, ids in examples:
        want[doc_id, len(ids)].append(ids)
    assert set(pieces) == set(want)
    for key, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, length, crc in sorted(pieces[key]):
                assert start == at and length > 0
                assert crc == zlib.crc32(np.array(texts[0][start : start + length], "<u4"))
                at += length
            assert at == key[1]
        else:
            assert sum(length for _, length, _ in pieces[key]) == key[1] * len(texts)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(held) <= limits.segments and sum(r.loss for r in held) <= limits.loss
    return [sum(r.length for r in held) for held in sequences.values()]


@needs_data
def test_documents_are_packed_without_padding(spark, rows):
    got = QUERIES["op12_vector_packing"](spark, DATA).collect()
    sizes = check_packing(got, token_ids(rows), vector_packing.Limits())
    assert all(n & (n - 1) == 0 for n in sizes)  # full, or a power of two
    assert sum(n == 4096 for n in sizes) >= len(sizes) - 12


def test_tasks_share_their_last_sequences(spark, rows):
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string").repartition(80)
    got = vector_packing.packed(docs, WORD_FILE, END_ID).collect()
    sizes = check_packing(got, token_ids(rows * 2), vector_packing.Limits())
    assert sum(n < 4096 for n in sizes) <= 2 * 12


@pytest.mark.parametrize(
    "limits",
    [
        vector_packing.Limits(512, 3, 512),
        vector_packing.Limits(512, 64, 100),
        vector_packing.Limits(512, 5, 200, cut=False),
        vector_packing.Limits(7, 1, 7),
        vector_packing.Limits(64, 4, 1),
    ],
)
def test_prompts_bear_no_loss(spark, limits):
    rng = random.Random(6)
    text = lambda most: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(most)))
    rows = [(i, text(40), text(120) if i % 3 else None) for i in range(300)]
    got = vector_packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string, prompt string"), WORD_FILE, END_ID, limits).collect()
    answers, prompts = token_ids([(i, t) for i, t, _ in rows]), token_ids([(i, p) for i, _, p in rows])
    check_packing(got, [(i, p[:-1] + t) for (i, t), (_, p) in zip(answers, prompts)], limits)
    assert sum(r.loss for r in got) == sum(len(t) for _, t in answers)
    if not limits.cut:
        assert all(r.length == r.doc_tokens for r in got if r.doc_tokens <= limits.tokens and r.doc_tokens - 120 < limits.loss and r.loss <= 40)


def test_dot_product_prefers_what_the_room_is_good_for():
    limits = vector_packing.Limits(100, 10, 100)
    item = lambda n, prompt: vector_packing.Item(n, 0, n, prompt, np.zeros(n, np.int64))
    pool = vector_packing.Pool([item(40, 39), item(38, 0), item(10, 5)], limits)
    at = lambda tokens, loss: (int(pool.tokens[k]), int(pool.losses[k])) if (k := pool.best(tokens, loss, True)) is not None else None
    assert at(100, 100) == (38, 38)  # far more loss for nearly as many tokens
    assert at(100, 5) == (40, 1)  # where loss is nearly used up, tokens count
    assert at(9, 100) is None


def test_packing_of_odd_rows(spark, odd, empty):
    got = vector_packing.packed(odd, WORD_FILE, END_ID).collect()
    sizes = check_packing(got, token_ids(ODD), vector_packing.Limits())
    assert all(n & (n - 1) == 0 for n in sizes)
    assert vector_packing.packed(empty, WORD_FILE, END_ID).collect() == []
    same = spark.createDataFrame([(1, "x")] * 5000, "doc_id bigint, text string")
    sizes = check_packing(vector_packing.packed(same, WORD_FILE, END_ID).collect(), token_ids([(1, "x")] * 5000), vector_packing.Limits())
    assert sum(sizes) == 10_000 and all(n & (n - 1) == 0 for n in sizes)  # 256 segments end a sequence


# --- alignment ---------------------------------------------------------------------


def plain_alignments(rows):
    """Links and groups by byte offsets, and counts over all rows."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        links, groups, ids = [], [], ([], [])
        if text:
            raw = (" " + text).encode()
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts = (
                [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
                [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], b.id_to_piece(ids[1]))],
            )
            if all(b"".join(p) == raw for p in parts):
                ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
                for i, end in enumerate(ends[0]):
                    start = end - len(parts[0][i])
                    j = bisect.bisect_right(ends[1], start)
                    while j < len(ends[1]) and ends[1][j] - len(parts[1][j]) < end:
                        links.append((ids[0][i], ids[1][j]))
                        j += 1
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    upto = [bisect.bisect_right(e, cut) for e in ends]
                    groups.append(tuple(ids[s][at[s] : upto[s]] for s in (0, 1)))
                    at = upto
            else:
                ids = [], []
        counts.update(set(links))
        found.append((doc_id, ids, groups, links))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, ids, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n_best, total = sum(counts[link] == best[link[0]] for link in links), sum(counts[link] for link in links)
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), n_best, total, text, shared))
    return out


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups n_shared".split()


@needs_data
def test_alignments_of_documents(spark, rows):
    want = plain_alignments(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    got = QUERIES["op13_token_alignment"](spark, DATA)
    assert by_text([tuple(r) for r in got.collect()]) == by_text([(*w[:7], sha(w[7]), w[8]) for w in want])


def test_alignments_of_odd_rows(odd, empty):
    got = token_alignment.aligned(odd, A, B).select(*COLUMNS)
    want = plain_alignments(ODD)
    assert by_text([tuple(r) for r in got.collect()]) == by_text(want)
    assert {w[0] for w in want if not w[1]} >= {1, 2, 6}  # the mark is no blank, so the text is not that of B
    assert token_alignment.aligned(empty, A, B).collect() == []


def test_long_texts_are_cut_where_both_tokenizers_cut(spark, monkeypatch):
    rows = [(1, LONG), (2, "x" * 5000 + " y " + "  z" * 900), (3, "a 日本語 ▁ " * 300), (4, "short")]
    tokenizers = token_alignment.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())
    whole = token_alignment._block(tokenizers, [t for _, t in rows])
    monkeypatch.setattr(token_alignment, "PART", 200)
    cut = token_alignment._block(tokenizers, [t for _, t in rows])
    assert len(token_alignment.pieces_of(rows[0][1], 200)) > 50
    assert all((whole[0][c] == cut[0][c]).all() for c in whole[0]) and whole[1:] == cut[1:]


def test_products_of_matrices():
    rng = np.random.default_rng(7)
    a, b = rng.random((9, 14)) < 0.3, rng.random((14, 6)) < 0.3
    csr = lambda m: (np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1])
    rows, columns, values = token_alignment.product(csr(a), csr(b), 6)
    dense = np.zeros((9, 6), int)
    dense[rows, columns] = values
    assert (dense == a.astype(int) @ b.astype(int)).all() and (values > 0).all()
    pointers, held = token_alignment.transpose(*csr(a), 14)
    assert (pointers == csr(a.T)[0]).all() and (held == csr(a.T)[1]).all()


def test_batches_of_alignments_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 100] * 1000)], names=["k", "groups"])
    parts = list(token_alignment.sliced(batch, token_alignment.ROWS))
    assert [p.num_rows for p in parts] == [256, 256, 256, 232]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert list(token_alignment.sliced(batch.slice(0, 0), 4)) == []


def test_repeated_words_are_encoded_once(monkeypatch):
    tokenizers = token_alignment.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())
    seen, encode = [], tokenizers.encode
    monkeypatch.setattr(tokenizers, "encode", lambda texts: seen.extend(texts) or encode(texts))
    rows = [(1, "one two three " * 400 + "four"), (2, None), (3, "two  blanks and three one ▁"), (4, "one two"), (5, LONG)]
    counts, groups, links, pairs = token_alignment._block(tokenizers, [t for _, t in rows])
    assert len(seen) == len(set(seen)) and sum(map(len, seen)) < len(LONG)
    want = plain_alignments(rows)
    got = zip(*(counts[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")), groups)
    assert list(got) == [(*w[1:5], w[8], w[7]) for w in want]
    assert not links[1] and not links[2]  # the mark is no blank
    held = np.frombuffer(pairs, token_alignment.PAIR)
    assert all(held["n"] > 0) and len(np.unique(held[["a", "b"]])) == len(held)
