"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. The model of a category sees the words
of the text, the beginnings of its longer words (which inflected forms share) and the
log odds of all earlier categories. It is trained with log odds
predicted out of fold, as it would see them on new texts; the models that are kept
are fitted on the whole sample. The last category decides rejection, at the
threshold that serves its out-of-fold predictions best. If the rows above that threshold are not toxic
clearly more often than any rows, the labels have not taught to tell the classes apart (too few of
them, or no word that goes with them), and nothing is rejected.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import hashed_sample
from gradeloom.llm.linear import Sparse, fit, margin, sigmoid
from gradeloom.llm.words import located_words, mix, parts, prefix_hashes

SAMPLE = 6000  # labelled documents used for fitting
FOLDS = 4
PENALTY = 1.0
SCREEN = 4.0  # a word is a feature if it differs from independence by so many standard errors
LEAST = 5  # and stands in so many documents of the sample
PREFIXES = (4, 5)  # bytes
NEVER = 2.0  # a threshold above every probability


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts and of their beginnings, and where each text's begin.

    Two features of one hash count as one; of a million features that befalls a few hundred.
    """
    hashes, pointers, raw, starts, ends = located_words(texts)
    table = np.repeat(hashes[:, None], 1 + len(PREFIXES), axis=1)  # a short word stands for its own beginning
    for k, size in enumerate(PREFIXES):
        prefix, longer = prefix_hashes(raw, starts, ends, size)
        table[longer, k + 1] = prefix
    return (table.ravel() >> np.uint64(32)).astype(np.uint32), pointers * table.shape[1]


@dataclass
class Chain:
    categories: list[str]
    vocabulary: np.ndarray  # sorted hashes
    weights: list[np.ndarray]
    threshold: float


# Category -> condition on a row of labels. The table names two faults; the chain goes from the
# fault that is no toxicity over the graver kind of toxicity to toxicity as such.
CATEGORIES = {"poor": "quality = 0", "toxic_poor": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}


def sample(docs: DataFrame, labels: DataFrame, size: int) -> list[tuple[list[int], np.ndarray]]:
    """At most ``size`` labelled documents, chosen by hash: their categories and distinct features.

    A document labelled several times has a category if any label says so; labels
    that are null say nothing. Only hashes come to the driver.
    """
    marks = [F.max(F.coalesce(F.expr(rule), F.lit(False)).cast("int")).alias(f"y_{name}") for name, rule in CATEGORIES.items()]
    names = list(CATEGORIES)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(*marks)
    # Labels of documents that are not here would use up the sample.
    here = known.join(docs.select(F.col("doc_id").cast("bigint").alias("_id")), "_id", "left_semi")
    chosen = hashed_sample(here, size, "_id")
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # at most ``size`` rows

    def words(batches):
        for batch in batches:
            sets = []
            for lo, hi in parts(batch.column(1)):
                hashes, pointers = features(batch.column(1)[lo:hi])
                sets += [np.unique(hashes[a:b]).tobytes() for a, b in zip(pointers[:-1], pointers[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(f"y_{n}") for n in names), pa.array(sets, pa.binary())],
                names=["_id", *(f"y_{n}" for n in names), "words"],
            )

    schema = "_id bigint, " + ", ".join(f"y_{n} int" for n in names) + ", words binary"
    # Rows that repeat a doc_id could exceed the bound: one text stands for each id.
    rows = texts.mapInArrow(words, schema).groupBy("_id").agg(F.min_by(F.struct("*"), "words").alias("r")).select("r.*")
    return [(list(r[1:-1]), np.frombuffer(r[-1], np.uint32)) for r in sorted(rows.collect(), key=lambda r: r[0])]


def screened(words: Sparse, targets: np.ndarray) -> np.ndarray:
    """Features that occur LEAST times or more and go with some category clearly more or less often than by chance."""
    n = np.bincount(words.feature, minlength=words.features)
    keep = np.zeros(words.features, bool)
    for y in targets.T:
        share = y.mean()
        both = words.transposed(y)
        error = np.sqrt(np.maximum(n * share * (1 - share), 1))
        keep |= np.abs(both - n * share) >= SCREEN * error
    return keep & (n >= LEAST)


def fitted(words: Sparse, dense: np.ndarray, targets: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
    """The model of category ``k`` from some rows; words that those rows do not recommend weigh nothing."""
    words, targets = words.take(rows), targets[rows]
    keep = screened(words, targets)
    inside = keep[words.feature]
    chosen = Sparse(words.row[inside], (np.cumsum(keep) - 1)[words.feature[inside]], words.rows, int(keep.sum()))
    found = fit(chosen, dense[rows], targets[:, k], PENALTY)
    weights = np.zeros(words.features)
    weights[keep] = found[: chosen.features]
    return np.r_[weights, found[chosen.features :]]


def train(rows: list[tuple[list[int], np.ndarray]], folds: int = FOLDS) -> Chain:
    """The chain fitted on ``rows``; without rows, or toxic ones, or signs of them, it rejects nothing."""
    categories = list(CATEGORIES)
    targets = np.array([y for y, _ in rows], float).reshape(-1, len(categories))
    if not len(rows) or not targets[:, -1].any():
        return Chain(categories, np.zeros(0, np.uint32), [np.r_[np.zeros(k), -40.0] for k in range(len(categories))], NEVER)
    values, counts = np.unique(np.concatenate([w for _, w in rows]), return_counts=True)
    vocabulary = values[counts >= LEAST]
    known = [vocabulary.searchsorted(w[np.isin(w, vocabulary, assume_unique=True)]) for _, w in rows]
    words = Sparse(np.repeat(np.arange(len(rows)), [len(k) for k in known]), np.concatenate(known), len(rows), len(vocabulary))
    # Copies of a text are in one fold: the fold is a hash of the words.
    fold = np.array([int(mix(np.add.reduce(w, keepdims=True, dtype=np.uint64))[0] % np.uint64(folds)) for _, w in rows])
    dense, weights = np.zeros((len(rows), 0)), []
    everything = np.ones(len(rows), bool)
    for k in range(len(categories)):
        unseen = np.zeros(len(rows))
        for f in range(folds):
            rest = fold != f
            if rest.any() and not rest.all():
                unseen[~rest] = margin(words.take(~rest), dense[~rest], fitted(words, dense, targets, k, rest))
        weights.append(fitted(words, dense, targets, k, everything))
        dense = np.c_[dense, np.clip(unseen, -40, 40)]
    # Only words that some model weighs need to be looked up in texts.
    used = np.any([w[: len(vocabulary)] != 0 for w in weights], axis=0)
    weights = [np.r_[w[: len(vocabulary)][used], w[len(vocabulary) :]] for w in weights]
    return Chain(categories, vocabulary[used], weights, _best_threshold(sigmoid(dense[:, -1]), targets[:, -1]))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut, in the middle of the gap between two scores, with the best F measure; NEVER if chance explains it."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits, above = np.cumsum(y), np.arange(1, len(y) + 1)
    score = 2 * hits / (above + y.sum())
    score[:-1][p[:-1] == p[1:]] = -1  # equal scores stay together
    best = int(np.argmax(score))
    share = y.mean()
    if hits[best] - above[best] * share < SCREEN * np.sqrt(max(above[best] * share * (1 - share), 1)):
        return NEVER
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


def _features(hashes: np.ndarray, pointers: np.ndarray, vocabulary: np.ndarray) -> Sparse:
    texts = len(pointers) - 1
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    row = np.repeat(np.arange(texts), np.diff(pointers))[known]
    pairs = np.unique(row * max(len(vocabulary), 1) + at[known])
    return Sparse(pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1), texts, len(vocabulary))


def probabilities(chain: Chain, hashes: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """One column for each category."""
    words = _features(hashes, pointers, chain.vocabulary)
    dense = np.zeros((words.rows, 0))
    for weights in chain.weights:
        dense = np.c_[dense, np.clip(margin(words, dense, weights), -40, 40)]
    return sigmoid(dense)


def scored(text: Column, chain: Chain) -> Column:
    """An array of the categories' probabilities; a null or wordless text has those of no words."""

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        out = [probabilities(chain, *features(texts[lo:hi])) for lo, hi in parts(texts)]
        rows = np.concatenate(out) if out else np.zeros((0, len(chain.categories)))
        return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(chain.categories)).cast(pa.list_(pa.float64()))

    return score(text)


def learned(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain:
    return train(sample(docs, labels, size))


def judged(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, one probability for each category, rejected) for each row."""
    rows = docs.select("doc_id", scored(F.col("text"), chain).alias("p"))
    named = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(chain.categories)]
    return rows.select("doc_id", *named, (F.col("p")[len(chain.categories) - 1] >= chain.threshold).alias("rejected"))


def accepted(docs: DataFrame, chain: Chain) -> DataFrame:
    """Rows of ``docs`` that are not rejected; columns of any name pass through."""
    last = len(chain.categories) - 1
    rows = docs.select(F.struct("*").alias("_row"))
    return rows.filter(scored(F.col("_row.text"), chain)[last] < chain.threshold).select("_row.*")
