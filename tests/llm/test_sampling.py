"""What classifiers learn from: few labels, foreign labels, repeated rows; and the chain against a plain version."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import language_crf, license_index, mixing, oracles, token_store, toxicity
from gradeloom.llm.common import grouped_sample
from gradeloom.llm.words import mix


@pytest.fixture(scope="module")
def texts(spark):
    """1 000 documents, every fifth with toxic words."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1000):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if i % 5 == 0:
            words[3], words[20] = ("scum", "filth", "vermin")[i % 3], "idiots"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def rejected(docs, labels):
    return {r.doc_id for r in toxicity.judged(docs, toxicity.learned(docs, labels)).where("rejected").collect()}


def test_labels_of_other_documents_do_not_use_up_the_sample(spark, texts):
    own = spark.range(1000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 5 = 0) AS toxic")
    foreign = spark.range(1000, 2_000_000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 3 = 0) AS toxic")
    assert rejected(texts, own.unionByName(foreign)) == set(range(0, 1000, 5))


@pytest.mark.parametrize("toxic", ["doc_id IN (0, 5, 10, 15)", "false", "true", "doc_id % 2 = 0 AND doc_id < 4", "doc_id % 7 = 0"])
def test_nothing_is_rejected_without_signs(spark, texts, toxic):
    """Few toxic labels, none, all, or labels that no word goes with."""
    labels = spark.range(1000).selectExpr("id AS doc_id").selectExpr("doc_id", "1 AS quality", f"int({toxic}) AS toxic")
    assert rejected(texts, labels) == set()
    assert rejected(texts, labels.where("doc_id < 3")) == set()


def test_rows_that_repeat_are_sampled(spark):
    rows = [("xx", 7)] * 3000 + [("yy", k) for k in range(500)] + [("zz", 1)]
    frame = spark.createDataFrame(rows, "lang string, doc_id bigint").repartition(7)
    got = collections.Counter(r.lang for r in grouped_sample(frame, 40, "lang", "doc_id").collect())
    assert got == {"xx": 40, "yy": 40, "zz": 1}
    other = [sorted(r.doc_id for r in grouped_sample(frame.repartition(n), 40, "lang", "doc_id").where("lang = 'yy'").collect()) for n in (1, 5)]
    assert other[0] == other[1] and len(set(other[0])) == 40


def test_a_language_of_one_repeated_row_is_learned(spark):
    rows = [(5, "xx", "zorblax quimbly vantroop")] * 3000
    rows += [(k, "de", f"der hund und die katze {k} laufen") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language_crf.learned(docs)
    assert model.languages == ["de", "xx"]
    got = {r.doc_id: r.lang_pred for r in language_crf.judged(docs.dropDuplicates(["doc_id"]), model).collect()}
    assert got[5] == "xx" and collections.Counter(got.values())["de"] == 200


def newton(x, y, penalty):
    """Weights of a ridge logistic regression; the intercept, last, is not penalised."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, penalty), 0.0])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return w


def test_chain_against_a_plain_version():
    """Folds, screening, out-of-fold log odds, kept models and threshold, with dense matrices and Newton's method."""
    rng = np.random.default_rng(12)
    signs = np.array([11, 22, 33, 44], np.uint32)
    rows = []
    for _ in range(240):
        y = [int(rng.random() < 0.4), 0, int(rng.random() < 0.3)]
        y[1] = y[0] & y[2]
        words = set(rng.integers(100, 160, 12).tolist())
        words |= {int(s) for s, k in zip(signs, (0, 0, 2, 2)) if rng.random() < (0.8 if y[k] else 0.1)}
        rows.append((y, np.array(sorted(words), np.uint32)))
    chain = toxicity.train(rows)

    targets = np.array([y for y, _ in rows], float)
    vocabulary = sorted({int(w) for _, ws in rows for w in ws})
    dense = np.array([[int(w in set(ws.tolist())) for w in vocabulary] for _, ws in rows], float)
    often = dense.sum(0) >= toxicity.LEAST
    dense, vocabulary = dense[:, often], np.array(vocabulary)[often]
    fold = np.array([int(mix(np.array([ws.sum(dtype=np.uint64)], np.uint64))[0] % np.uint64(toxicity.FOLDS)) for _, ws in rows])

    def model(train, k, extra):
        x, y = dense[train], targets[train]
        n, keep = x.sum(0), np.zeros(x.shape[1], bool)
        for j in range(y.shape[1]):
            share = y[:, j].mean()
            keep |= np.abs(x.T @ y[:, j] - n * share) >= toxicity.SCREEN * np.sqrt(np.maximum(n * share * (1 - share), 1))
        keep &= n >= toxicity.LEAST
        w = newton(np.c_[x[:, keep], extra[train]], y[:, k], toxicity.PENALTY)
        out = np.zeros(x.shape[1])
        out[keep] = w[: keep.sum()]
        return out, w[keep.sum() :]

    everything, earlier = np.ones(len(rows), bool), np.zeros((len(rows), 0))
    used = np.isin(vocabulary, chain.vocabulary)
    for k in range(targets.shape[1]):
        odds = np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            words, rest = model(fold != f, k, earlier)
            here = fold == f
            odds[here] = dense[here] @ words + earlier[here] @ rest[:-1] + rest[-1]
        words, rest = model(everything, k, earlier)
        assert np.allclose(chain.weights[k], np.r_[words[used], rest], atol=2e-3) and not words[~used].any()
        earlier = np.c_[earlier, np.clip(odds, -40, 40)]
    p = 1 / (1 + np.exp(-earlier[:, -1]))
    cuts = {}
    for cut in sorted(set(p)):
        above, y = p >= cut, targets[:, -1]
        cuts[cut] = 2 * (above & (y > 0)).sum() / (above.sum() + y.sum())
    best = max(cuts, key=lambda c: (cuts[c], c))
    below = max((q for q in p if q < best), default=0.0)
    assert abs(chain.threshold - (best + below) / 2) < 2e-3


def test_rows_without_an_id_are_drawn_each_for_itself(spark):
    docs = spark.range(1000).selectExpr("cast(NULL AS bigint) AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    wanted = mixing.rates(docs, total=1000)
    for seed in range(4):
        rows = mixing.replicated(docs, wanted, seed).select("_row.text", "copy", "place").collect()
        assert 850 < len(rows) < 1150 and len({r.place for r in rows}) == len(rows)


def test_mixing_and_licence_sql_on_hard_tables(spark, tmp_path):
    """Null ids, repeated rows, notices that all files share, and a file of all notices."""
    import duckdb

    from gradeloom.plans.check import rows_of

    notices = [" ".join(w) for w in license_index.template_words().values()]
    tables = {
        "shared": [(k, notices[0] + f" file {k}", "a") for k in range(5)],
        "mixed": [(k, notices[k % len(notices)] + f" {k}", "ab"[k % 2]) for k in range(40)] + [(90, " x ".join(notices), "b"), (None, notices[1], "b"), (None, "plain", None)],
    }
    for name, rows in tables.items():
        docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        docs.coalesce(1).write.parquet(str(tmp_path / name))
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        for got, sql in ((license_index.scanned(docs), oracles.LICENSES), (mixing.mixed(docs).select("_row.*", "copy", "place"), oracles.MIXING)):
            want = connection.sql(sql)
            assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_folders_of_token_stores(spark, tmp_path):
    assert token_store.qualified(spark, str(tmp_path)).startswith("file:/")
    assert token_store._open(f"file:{tmp_path}")[1] == token_store._open(f"file://{tmp_path}")[1] == str(tmp_path)
    assert token_store._uri("s3a://bucket/some/folder") == "s3://bucket/some/folder"  # opening it asks the network
    with pytest.raises(ValueError, match="tasks cannot open"):
        token_store.qualified(spark, "viewfs://cluster/tokens")


def test_mixture_of_many_sources_is_that_of_few(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"t{n}", f"s{n % 40}" if n % 3 else None) for n in range(900)], "doc_id long, text string, source string")
    few = [tuple(r) for r in mixing.mixed(docs).select("_row.doc_id", "copy", "place").collect()]
    monkeypatch.setattr(mixing, "SOURCES", 0)
    monkeypatch.setattr(mixing, "ROWS", 10)  # more partitions, the same order
    many = [tuple(r) for r in mixing.mixed(docs).select("_row.doc_id", "copy", "place").collect()]
    assert few == many and [r[2] for r in few] == sorted(r[2] for r in few)
