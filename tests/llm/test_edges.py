"""Every operator on odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import (
    decontaminate,
    hilbert,
    language_crf,
    license_index,
    link_graph,
    mixing,
    oracles,
    prob_minhash,
    token_store,
    toxicity,
    unigram_count,
)

LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside, or return.
CLASH = "n_words int, class_id string, tie int, _row int, block int, words string, rate int, copy int, bucket int, `_id` int, p int, root int"
PASSAGE = "the quick brown fox jumps over the lazy dog near the old river bank at noon today"


def odd_rows():
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "!!! ... ---", None, None),
        (4, LONG, "en", "b"),
        (5, PASSAGE + " and more", "en", "b"),
        (5, PASSAGE + " and more", "en", "b"),
        (5, "another text with the same id", "de", "a"),
        (None, "a text without an id", "fr", "c"),
        (None, None, None, None),
        (6, "naïve Ünïcode 日本語 text 12345", "de", "c"),
        (7, "one", "en", "c"),
        (-20, "idiot scum", "en", "c"),
        (8, PASSAGE + " and MORE!", "en", "b"),
    ]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(odd_rows(), SCHEMA)
    extra = [F.lit(None).cast(part.rsplit(" ", 1)[1]).alias(part.strip().rsplit(" ", 1)[0].strip("`")) for part in CLASH.split(",")]
    return plain.select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, PASSAGE), (10, "one"), (11, "not in any document at all")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_decontamination(docs, empty, benchmark):
    rows = decontaminate.contamination(docs, benchmark).collect()
    assert len(rows) == len(odd_rows())
    hit = sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in rows if r.n_hit)
    n = len(PASSAGE.split())
    assert hit == [(5, n + 2, n, ["1"], True), (5, n + 2, n, ["1"], True), (7, 1, 1, ["10"], True), (8, n + 2, n, ["1"], True)]
    assert [r.n_words for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.filter("false")).collect())


def test_near_duplicates(docs, empty):
    rows = prob_minhash.classes(docs).collect()
    assert len(rows) == len(odd_rows())
    of = {(r.doc_id, r.root): (r.class_id, r.class_size) for r in rows}
    same = [v for (i, root), v in of.items() if i in (5, 8) and v[1] > 1]
    assert same and set(same) == {(5, 3)}
    assert all(v == (i, 1) for (i, root), v in of.items() if i in (1, 2, 3, 4, 6, 7))
    assert prob_minhash.classes(empty).count() == 0


def test_survivors_keep_one_row_and_all_columns(docs, empty):
    kept = prob_minhash.survivors(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(rows, key=repr) == sorted({(r[0], r[1]) for r in odd_rows() if r[0] != 8}, key=repr)
    assert prob_minhash.survivors(empty).count() == 0


def test_toxicity(docs, empty, labels):
    chain = toxicity.learned(docs, labels)
    rows = toxicity.judged(docs, chain).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r[f"p_{name}"] <= 1 for r in rows for name in chain.categories)
    none = toxicity.learned(empty, labels.filter("false"))
    assert toxicity.judged(empty, none).count() == 0
    assert toxicity.accepted(docs, none).columns == docs.columns
    assert toxicity.accepted(docs, none).count() == len(odd_rows())


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    folder, manifest = token_store.write(docs, path, 2)
    rows = token_store.lookup(folder, manifest, docs).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=repr)
    assert got == sorted(((r[0], len(ids(r[1])), zlib.crc32(ids(r[1]))) for r in odd_rows()), key=repr)
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
    by_start = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda i: (i is not None, i or 0))
    store = token_store.TokenStore(spark, folder, manifest)
    assert [a.tolist() for a in store[6]] == [ids(odd_rows()[9][1]).tolist()]
    assert len(store[5]) == 3 and store[12345] == []
    strangers = spark.createDataFrame([(777,), (-5,), (10**15,)], "doc_id bigint")
    assert token_store.lookup(folder, manifest, strangers).count() == 0
    folder, manifest = token_store.write(empty, path, 2)
    assert token_store.lookup(folder, manifest, docs).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mixed(docs, total=40).select("_row.*", "copy", "place").collect()
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    assert {r.source for r in rows} <= {"a", "b", "c", None}
    assert mixing.mixed(empty).count() == 0


def test_licences(docs, empty):
    rows = license_index.scanned(docs).collect()
    assert len(rows) == len(odd_rows()) and all(r.n_base == 0 and r.labels == "" for r in rows)
    assert license_index.scanned(empty).count() == 0


def test_language(docs, empty):
    rows = language_crf.judged(docs, language_crf.learned(docs)).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] for r in odd_rows()}
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3) or (r.doc_id is None and r.score == 0)) for r in rows if r.doc_id in texts)
    assert language_crf.judged(empty, language_crf.learned(empty)).count() == 0
    assert all(r.lang_pred == "und" and r.score == 0 for r in language_crf.judged(docs, language_crf.learned(empty)).collect())


def test_token_counts(docs, empty):
    vocabulary = unigram_count.from_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = unigram_count.counted(docs, vocabulary).collect()
    assert len(rows) == len(odd_rows()) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert unigram_count.counted(empty, vocabulary).count() == 0


def test_url_filter(spark):
    schema = "page_id bigint, url string, html string, verdict string, rule int, trust int"
    rows = [(1, None, None), (2, "no scheme/en/", "x"), (3, "http://A.Example.NET/en/1?q#f", "<a href='//b.org/x'>"), (None, "http://h:8080", None), (3, "https://net", "")]
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], schema)
    got = link_graph.judged(pages, oracles.URL_RULES).collect()
    seen = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr)
    assert seen == sorted(
        [
            (1, "", "", None, "allow"),
            (2, "", "", None, "allow"),
            (3, "a.example.net", "/en/1", "example.net/en/", "allow"),
            (None, "h:8080", "", None, "allow"),
            (3, "net", "", None, "allow"),
        ],
        key=repr,
    )
    assert link_graph.judged(pages.filter("false"), oracles.URL_RULES).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (40, []), (-20, [2.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id bigint, embedding array<float>, score string, rank int")
    got = [tuple(r) for r in hilbert.search(vectors, k=3).orderBy("query_id", "rank").collect()]
    assert got == [
        (-20, 1, 0, 2.0), (-20, 2, 1, 2.0), (-20, 3, 9, 2.0),
        (0, 1, -20, 2.0), (0, 2, 1, 1.0), (0, 3, 9, 1.0),
        (20, 1, -20, 1.0), (20, 2, 0, 0.5), (20, 3, 1, 0.5),
    ]
    assert hilbert.search(vectors.filter("false")).count() == 0
    assert [r.vec_id for r in hilbert.search(vectors.filter("vec_id IN (0, 1)"), k=20).collect()] == [1]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, docs, labels, benchmark, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert out.dtypes == docs.dtypes
    out.collect()
