"""Operators that SQL cannot express, against plain Python on whole small tables."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import components, decontaminate, hilbert, language_crf, license_index, link_graph, mixing, prob_minhash, token_store, toxicity, unigram_count
from gradeloom.llm.registry import QUERIES
from gradeloom.llm.words import mix

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    weight = lambda n: 1 + math.log(n) / 4 if n else 0.0
    kinds = collections.Counter((weight(a.get(x, 0)), weight(b.get(x, 0))) for x in set(a) | set(b))
    return sum(m / sum(n * max(p / u, q / v) for (p, q), n in kinds.items()) for (u, v), m in kinds.items() if u and v)


def classes(rows):
    """doc_id -> least doc_id of its class, over all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, b in bags.items():
        for s in b:
            holders[s].append(i)
    pairs = {(x, y) for h in holders.values() for k, y in enumerate(h) for x in h[:k]}
    for x, y in pairs:
        # No pair with so different numbers of shingles can be alike enough.
        if min(len(bags[x]), len(bags[y])) * 2 > max(len(bags[x]), len(bags[y])) and probability_jaccard(bags[x], bags[y]) >= 0.8 - 1e-12:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]


@needs_data
def test_near_duplicates(spark, rows):
    got = {r.doc_id: r.class_id for r in QUERIES["op9_prob_minhash"](spark, DATA).collect()}
    assert got == classes(rows)


def test_a_crowd_of_near_copies(spark):
    """One group with every likeness between its members, large enough for blocks."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            text[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(docs).collect()}
    assert got == classes(rows)


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = {}, {}
    for s in range(60):
        a[s], b[s] = int(rng.integers(0, 4)), int(rng.integers(0, 4))
    registers = 40_000
    found = []
    for w in (a, b):
        keys = mix(np.array([s for s, n in w.items() if n], np.uint64))
        counts = np.array([n for n in w.values() if n])
        found.append(prob_minhash.signatures(np.zeros(len(keys), int), keys, counts, 1, registers)[0])
    want = probability_jaccard({k: v for k, v in a.items() if v}, {k: v for k, v in b.items() if v})
    assert abs((found[0] == found[1]).mean() - want) < 0.02


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(i, (i * 7) % 151) for i in range(151)], []])
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            for x in (a, b):
                parent.setdefault(x, x)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    got = components.components(links).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert all(find(r.node) == find(r.root) for r in components.leaders(links.filter("a <> b")).collect())


@needs_data
def test_token_store(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for doc_id, text in sorted(rows):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op1_token_store"](spark, DATA).collect()) == want


def test_words_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), token_store.Encoder(open(path, encoding="utf-8").read(), 2)
    assert encode.cut is not None
    rng = random.Random(0)
    alphabets = ["aB 's\n\t  é́日1!<|endoftext|>😀", "".join(map(chr, range(1, 256))), "'stremvldSTLLDRE .,…ab", "ÀÖ×ß÷ÿªµº²¼\xa0\x85\x1c x's"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(80))) for a in alphabets for _ in range(2500)]
    texts += ["<|endoftext|> x", "a<|startoftext|>b", "<|ENDOFTEXT|>", " ", "\n", None, "İstanbul ΣΑΣ œuvre"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(b, encode.kind).tolist() for b in encode(texts)] == want
    other = token_store.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), 2)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(b, other.kind).tolist() for b in other(texts)] == [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 50_000))
    index = token_store.Index.build(keys, np.arange(len(keys)), np.arange(len(keys) + 1))
    index = token_store.Index.load(index.dump())
    assert sorted(index.values(keys).tolist()) == list(range(len(keys)))
    assert index.find(keys).tolist() == list(range(len(keys)))
    strangers = np.setdiff1d(np.random.default_rng(1).integers(-(2**62), 2**62, 50_000), keys)
    assert (index.find(strangers) >= 0).sum() <= 1


def test_token_counts_equal_the_library():
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    def library(vocabulary):
        low = min(vocabulary.entries.values())
        entries = [("<unk>", low)] + [(f"<0x{b:02X}>", low) for b in range(256)] + list(vocabulary.entries.items())
        tokenizer = Tokenizer(models.Unigram(entries, unk_id=0, byte_fallback=True))
        marks = pre_tokenizers.Metaspace(replacement=mark, prepend_scheme="always", split=False)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([marks, pre_tokenizers.Split(Regex(f"{mark}*[^{mark}]+|{mark}+"), "isolated")])
        return tokenizer

    rng = random.Random(0)
    mark = unigram_count.MARK
    parts = [mark, mark * 2, mark * 5, mark * 2 + "a", "a", "b", "ab", "ba", "aa", "bb", "aba", "bab", "abab", mark + "a", mark + "ab", "bbb", "c"]
    for seed in range(3):
        rng.seed(seed)
        vocabulary = unigram_count.Vocabulary({p: -float(rng.randint(1, 3)) for p in parts})  # many ties
        counter, tokenizer = unigram_count.Counter(vocabulary), library(vocabulary)
        for _ in range(2000):
            text = "".join(rng.choice("abcdé \n▁") for _ in range(rng.randint(0, 40)))
            assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_runs_of_blanks_match_their_entries():
    counter = unigram_count.Counter(unigram_count.from_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    assert counter.count("a" + " " * 8 + "b") <= 4
    assert counter.count("x" * 200_000) > 0  # no place is kept for each character


@needs_data
def test_token_counts_of_documents(spark, rows):
    import sentencepiece  # noqa: F401

    vocabulary = unigram_count.from_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    counter = unigram_count.Counter(vocabulary)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op10_unigram_count"](spark, DATA).collect()}
    assert got == {i: counter.count(t) for i, t in rows}


@needs_data
def test_neighbours_are_exact_and_windows_help(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    table = [(r.vec_id, np.array(r.embedding, np.float32).astype(float)) for r in vectors.collect()]
    ids, matrix = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    got = collections.defaultdict(list)
    for r in hilbert.search(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in np.flatnonzero(ids % 20 == 0):
        score = hilbert.scores(np.repeat(matrix[q : q + 1], len(ids), 0), matrix)
        order = [ids[k] for k in np.lexsort((ids, -score)) if k != q][:20]
        assert got[ids[q]] == order


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_every_dimension_in_small_blocks(spark, monkeypatch, kind):
    for name, value in {"BLOCK": 16, "GROUP": 2, "CHUNK": 4, "QUERY_PART": 8, "SLICE": 5}.items():
        monkeypatch.setattr(hilbert, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=(3, 5, 12)[i % 3]) * (1e30 if kind == "double" and i % 50 == 0 else 1)).tolist()) for i in range(600)]
    if kind == "float":
        rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    vectors = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    got = collections.defaultdict(list)
    for r in hilbert.search(vectors, every=5, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))

    def plain(a, b):  # sum() of floats is compensated, the operator adds in order
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    for q, vector in rows[::5]:
        scored = [(-plain(vector, other), i) for i, other in rows if i != q and len(other) == len(vector)]
        assert got[q] == [(i, -score) for score, i in sorted(scored)[:7]], q
    assert len(got) == 120


def test_windows_find_neighbours_in_structured_data(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(400, 16)) * 3
    points = (centres[rng.integers(0, 400, 12_000)] + rng.normal(size=(12_000, 16)) * 0.05).astype(np.float32)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    # By angle, as neighbours by inner product of vectors of one length.
    vectors = vectors.withColumn("embedding", F.expr("transform(embedding, x -> cast(x / sqrt(aggregate(embedding, 0D, (s, y) -> s + y * y)) AS float))"))
    exact = {(r.query_id, r.vec_id) for r in hilbert.search(vectors, every=200).collect()}
    near = {(r.query_id, r.vec_id) for r in hilbert.search(vectors, every=200, exact=False).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_hilbert_keys_visit_neighbouring_cells():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, transitions = rng.normal(size=(50, 3)) * 2, rng.normal(size=(3, 3))
    sizes = [0, 1, 5, 127, 128, 129, 700, 0, 256]
    pointers = np.r_[0, np.cumsum(sizes)]
    word = rng.integers(0, 50, pointers[-1])
    got = language_crf.label_words(scores, word, pointers, transitions)
    move = np.exp(transitions)
    for a, b in zip(pointers[:-1], pointers[1:]):
        local = np.exp(scores[word[a:b]])
        forward, backward = [], [np.ones(3)]
        for t in range(b - a):
            state = (forward[-1] @ move if t else 1) * local[t]
            forward.append(state / state.sum())
        for t in range(b - a - 1, 0, -1):
            state = move @ (local[t] * backward[0])
            backward.insert(0, state / state.sum())
        if b > a:
            want = np.array(forward) * np.array(backward)
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


@needs_data
def test_language_accuracy_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op5_language_crf"](spark, DATA).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_code_switched_words():
    import pyarrow as pa

    german, spanish = "der hund und die katze sind nicht im haus ", "el perro y la gata no están en la casa "
    model = language_crf.fit([(0, german * 20), (1, spanish * 20)], ["de", "es"])
    _, pointers, marginals = language_crf.tagged(pa.array([german * 3 + spanish * 3]), model)
    assert marginals[:27].argmax(1).tolist() == [0] * 27 and marginals[27:].argmax(1).tolist() == [1] * 30


def test_language_of_long_texts_alone_is_learned(spark):
    german, spanish = "der hund und die katze sind nicht im haus ", "el perro y la gata no están en la casa "
    rows = [(i, german * 5, "de") for i in range(40)] + [(i, spanish * 2000, "es") for i in range(40, 80)] + [(i, spanish, None) for i in range(80, 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_crf.learned(docs)
    assert model.languages == ["de", "es"]
    assert {r.doc_id: r.lang_pred for r in language_crf.judged(docs, model).collect()} == {i: "de" if i < 40 else "es" for i in range(90)}


def test_excerpts_are_what_is_fitted_on():
    import pyarrow as pa

    texts = ["", "?!", "one", " ".join(f"wört{i}" for i in range(200)), ", ".join(f"wört{i}" for i in range(100_000)), "語" * 50_000]
    got = language_crf.excerpts(pa.array([*texts, None])).to_pylist()
    assert got[:4] == ["", "", "one", texts[3]] and got[6] == "" and got[5] == "語" * language_crf.SAMPLE_CHARS
    assert len(words(got[4])) == language_crf.SAMPLE_WORDS and got[4] in texts[4]
    assert language_crf.excerpts(pa.array(got)).to_pylist() == got


def test_toxic_words_are_learned(spark):
    rng = random.Random(5)
    bad = ["grumphole", "snarkwit", "blightface"]
    rows, labels = [], []
    for i in range(1500):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, int(rng.random() < 0.8), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chain = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    want = {i for i, t in rows if any(b in t for b in bad)}
    got = {r.doc_id for r in toxicity.judged(docs, chain).collect() if r.rejected}
    unseen = {i for i, _ in rows if i % 2 == 0}
    assert len(got & want & unseen) >= 0.97 * len(want & unseen) and len((got - want) & unseen) <= 0.01 * len(unseen)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma alpha"), (4, "beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    exact = decontaminate.proximity(docs, items, slop=0).collect()
    assert [(r.doc_id, r.start, r.stop) for r in exact] == [(2, 0, 3)]
    assert {r.doc_id for r in decontaminate.proximity(docs, items, slop=1).collect()} == {1, 2}


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">.</a>' for h in hosts)
    pages = [
        (1, "https://good.org/fr/a", link("friend.com")),
        (2, "https://friend.com/x", link("friend2.com")),
        (3, "https://friend2.com/x", ""),
        (4, "https://bad.net/x", ""),
        (5, "https://farm.com/x", link("bad.net") + '<a href="/own">'),
        (6, "https://feeder.com/x", '<a href="//farm.com/y">'),
        (7, "https://alone.com/x", None),
    ]
    rules = [("block", "net", "/"), ("allow", "org", "/fr/")]
    got = {r.page_id: r for r in link_graph.judged(spark.createDataFrame(pages, "page_id bigint, url string, html string"), rules).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow"}
    assert got[1].trust == pytest.approx(0.15) and got[2].trust == pytest.approx(0.15 * 0.85) and got[3].trust == pytest.approx(0.15 * 0.85**2)
    assert got[6].distrust == pytest.approx(0.15 * 0.85**2) and got[6].trust == 0


def test_links_of_any_distance_and_cycles_settle(spark):
    edges = [(f"h{i}", f"h{i + 1}") for i in range(20)] + [("a", "b"), ("b", "a")]
    seeds = spark.createDataFrame([(h, float(h in ("h0", "a"))) for h in [*(f"h{i}" for i in range(21)), "a", "b"]], "host string, seed double")
    got = {r.host: r.score for r in link_graph.spread(seeds, spark.createDataFrame(edges, "src string, dst string"), damping=0.5).collect()}
    want = {f"h{i}": 0.5 ** (i + 1) for i in range(21)} | {"a": 2 / 3, "b": 1 / 3}
    assert got == pytest.approx(want, abs=1e-8)


def test_licence_notices(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "Some text.\nReleased under the MIT License. CC by, cc BY"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "License of the general apache public; all rights are reserved"),
        (5, "Licensed under CC BY-NC 4.0. All rights reserved."),
        *((i, f"plain text number {i} of the corpus under a tree") for i in range(10, 60)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_index.scanned(docs).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["apache-2.0", "cc-by,mit", "gpl,gpl-3.0", "", "cc-by,cc-by-nc-4.0,reserved"]
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 7, 9)
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (2, 2, 7, "cc-by,reserved")
    assert all(got[i].labels == "" and got[i].n_base == 0 for i in range(10, 60))


def test_all_notices_of_one_file_are_found(spark):
    notices = [text.replace("[", "").replace("]", "") for text in license_index.TEMPLATES.values()]
    texts = [*notices, " plain words between ".join(notices)] + ["plain text of no licence at all"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in license_index.scanned(docs).collect()}
    assert all(label in got[i] for i, label in enumerate(license_index.TEMPLATES))
    assert set(license_index.TEMPLATES) <= got[len(notices)]


@pytest.mark.parametrize("n", [1, 20])
def test_notice_that_every_file_holds_is_found(spark, n):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame([(i, f"{notice} file {i}") for i in range(n)], "doc_id bigint, text string")
    assert [(r.labels, r.score) for r in license_index.scanned(docs).collect()] == [("apache-2.0", 1.0)] * n


def test_poisson_counts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 19_000, "big").when(F.col("id") < 19_990, "small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 2.0)], "source string, weight double")
    got = mixing.mixed(docs, weights, total=40_000).select("_row.source", "copy").groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in got}
    for source, mean in (("big", 10_000), ("small", 10_000), (None, 20_000)):
        assert abs(counts[source] - mean) < 5 * math.sqrt(mean)
    once = mixing.replicated(docs, mixing.rates(docs, weights, total=40_000)).groupBy("_row.doc_id").agg(F.count("*").alias("n")).select("doc_id", "n")
    few = [r["n"] for r in once.collect() if r["doc_id"] < 19_000]
    rate = 10_000 / 19_000
    assert abs(sum(n == 1 for n in few) / 19_000 - rate * math.exp(-rate)) < 0.02


@needs_data
def test_pipeline(spark):
    """Every stage against a plain version of it, each on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, DATA)
    assert clean.columns == docs.columns
    chain = toxicity.learned(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.judged(docs, chain).collect() if r.rejected}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - rejected

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    unique = stages["near-duplicates"](spark, clean, DATA)
    kept = classes([(r.doc_id, r.text) for r in clean.collect()])
    wordless = {i for i in kept if not words(texts[i])}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(kept.values()) | wordless)

    unique = spark.createDataFrame(unique.collect(), docs.schema)
    fresh = stages["decontamination"](spark, unique, DATA)
    windows = set()
    for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()
    sizes = {len(x) for x in windows}

    def contaminated(text):
        w = words(text)
        hit = {i + k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    assert sorted(r.doc_id for r in fresh.collect()) == sorted(r.doc_id for r in unique.collect() if not contaminated(r.text))

    fresh = spark.createDataFrame(fresh.collect(), docs.schema)
    mixture = stages["mixing"](spark, fresh, DATA)
    again = [tuple(r) for r in stages["mixing"](spark, fresh, DATA).collect()]
    assert [tuple(r) for r in mixture.collect()] == again and {r[0] for r in again} <= {r.doc_id for r in fresh.collect()}

    tokens = stages["token ids"](spark, spark.createDataFrame(again, docs.schema), DATA).collect()
    assert collections.Counter(r.doc_id for r in tokens) == collections.Counter(r[0] for r in again)
