"""Language of text, word by word, by a linear-chain conditional random field.

A word's score for a language is the sum of the weights of its features: the word itself
(lexicon), its first and last one to four bytes (affixes), and all pairs and triples
of its bytes (n-grams). Neighbouring words are tied by a learned transition matrix. The
forward-backward algorithm gives each word's probabilities in the context of the whole
text; a text's language is the one with the largest sum over its words.

The model is fitted on a bounded sample of labelled texts. Spans of different
languages are spliced to sequences, so that the transitions learn to switch.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import grouped_sample, row_tie
from gradeloom.llm.linear import minimise
from gradeloom.llm.words import buffers, located_words, mix, parts

SAMPLE_TEXTS = 120  # labelled texts of each language used for fitting
SAMPLE_WORDS = 200  # words taken of each, from a place drawn by hash
SAMPLE_CHARS = 20_000  # characters that these words and what stands between them take up at most
SPAN, SEQUENCE = 25, 100  # words of a spliced span on average, and of a training sequence
BUCKETS = 1 << 17
PENALTY = 0.3
STEPS = 40
SEGMENT = 128


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray  # from x to


# --- features ----------------------------------------------------------------------


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code + np.uint64(kind << 56)) >> np.uint64(64 - 17)).astype(np.int32)


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
    """Buckets of the features of some words, word after word, and where each word's begin."""
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    letters = raw[np.repeat(starts, lengths) + inside].astype(np.uint64)
    letters += np.uint64(32) * ((letters >= 65) & (letters <= 90))
    left = np.repeat(lengths, lengths) - inside  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(starts)), lengths)
    words, buckets = [np.arange(len(starts))], [_bucket(hashes & np.uint64((1 << 56) - 1), 1)]
    gram = letters
    for n in range(1, 5):
        if n > 1:
            following = np.zeros_like(letters)
            following[: -(n - 1) or None] = letters[n - 1 :]
            gram = gram[: len(letters)] << np.uint64(8) | following
        whole = left >= n
        for kind, at in ((10 + n, whole & (inside == 0)), (20 + n, left == n), (30 + n, whole if 1 < n < 4 else None)):
            if at is not None:
                words.append(owner[at])
                buckets.append(_bucket(gram[at], kind))
    words, buckets = np.concatenate(words), np.concatenate(buckets)
    order = np.argsort(words, kind="stable")
    return buckets[order], np.searchsorted(words[order], np.arange(len(starts) + 1))


def emissions(weights: np.ndarray, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Scores of words (rows) for languages (columns)."""
    if not len(buckets):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[buckets], begin[:-1], axis=0)


# --- training ----------------------------------------------------------------------


def _taken(hashes: np.ndarray, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the first of the SAMPLE_WORDS words used for fitting, and the one after the last."""
    sizes = np.diff(pointers)
    first, some = pointers[:-1].copy(), np.flatnonzero(sizes)
    places = np.maximum(sizes[some] - SAMPLE_WORDS, 1).astype(np.uint64)
    first[some] += (mix(hashes[pointers[some]]) % places).astype(np.int64)
    return first, np.minimum(first + SAMPLE_WORDS, pointers[1:])


def excerpts(texts: pa.Array) -> pa.Array:
    """The part of each text that is used for fitting, empty without words."""
    out = []
    for lo, hi in parts(texts):
        hashes, pointers, raw, starts, ends = located_words(texts[lo:hi])
        for first, last in zip(*_taken(hashes, pointers)):
            # No character has more than four bytes.
            held = raw[starts[first] : min(ends[last - 1], starts[first] + 4 * SAMPLE_CHARS)].tobytes() if last > first else b""
            out.append(held.decode(errors="ignore")[:SAMPLE_CHARS])
    return pa.array(out, pa.string())


def _spliced(texts: list[tuple[int, np.ndarray]], rng) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences of word numbers and languages: spans of the texts in shuffled order."""
    spans = []
    for language, words in texts:
        at = 0
        while at < len(words):
            size = int(rng.geometric(1 / SPAN))
            spans.append((language, words[at : at + size]))
            at += size
    order = rng.permutation(len(spans))
    words = np.concatenate([spans[i][1] for i in order]) if spans else np.zeros(0, np.int64)
    marks = np.concatenate([np.full(len(spans[i][1]), spans[i][0]) for i in order]) if spans else np.zeros(0, np.int64)
    whole = len(words) // SEQUENCE * SEQUENCE
    if not whole:  # too little for one sequence: repeat it
        whole = SEQUENCE if len(words) else 0
        words, marks = np.resize(words, whole), np.resize(marks, whole)
    return words[:whole].reshape(-1, SEQUENCE), marks[:whole].reshape(-1, SEQUENCE)


def fit(texts: list[tuple[int, pa.Array]], languages: list[str], seed: int = 0) -> Model:
    """The model with the largest penalised likelihood of the spliced sequences."""
    k = len(languages)
    raw_texts = pa.array([t for _, t in texts], pa.string())
    hashes, pointers, raw, starts, ends = located_words(raw_texts)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    buckets, begin = word_features(raw, starts[first], ends[first], distinct)
    rng = np.random.default_rng(seed)
    taken = zip(texts, *_taken(hashes, pointers))
    words, marks = _spliced([(language, number[first:last]) for (language, _), first, last in taken], rng)
    if not len(words):
        return Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    used, bucket = np.unique(buckets, return_inverse=True)
    owner = np.repeat(np.arange(len(distinct)), np.diff(begin))
    flat = words.ravel()
    truth = np.zeros((len(flat), k))
    truth[np.arange(len(flat)), marks.ravel()] = 1
    truth = truth.reshape(*words.shape, k)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (marks[:, :-1].ravel(), marks[:, 1:].ravel()), 1)

    def value_and_slope(x):
        weights, transitions = x[: len(used) * k].reshape(-1, k), x[len(used) * k :].reshape(k, k)
        scores = np.add.reduceat(weights[bucket], begin[:-1], axis=0)[words]
        evidence, marginals, moves = _expectations(scores, transitions)
        loss = evidence - (scores * truth).sum() - (transitions * pairs).sum() + PENALTY / 2 * (x**2).sum()
        error = (marginals - truth).reshape(-1, k)
        by_word = np.stack([np.bincount(flat, error[:, c], len(distinct)) for c in range(k)], axis=1)
        by_bucket = np.stack([np.bincount(bucket, by_word[owner, c], len(used)) for c in range(k)], axis=1)
        return loss, np.r_[by_bucket.ravel(), (moves - pairs).ravel()] + PENALTY * x

    x = minimise(value_and_slope, np.zeros(len(used) * k + k * k), STEPS)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = x[: len(used) * k].reshape(-1, k)
    return Model(languages, weights, x[len(used) * k :].reshape(k, k))


def _expectations(scores: np.ndarray, transitions: np.ndarray):
    """Log evidence of all sequences, marginals of their words, and expected transitions."""
    n, length, k = scores.shape
    shift = scores.max(2, keepdims=True)
    local, move = np.exp(scores - shift), np.exp(transitions)
    alpha, scale = np.empty_like(local), np.empty((n, length))
    state = np.ones((n, k))
    for t in range(length):
        state = (state @ move if t else state) * local[:, t]
        scale[:, t] = state.sum(1)
        state = state / scale[:, t : t + 1]
        alpha[:, t] = state
    beta = np.ones((n, k))
    marginals, moves = np.empty_like(local), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        marginals[:, t] = alpha[:, t] * beta
        if t:
            ahead = local[:, t] * beta / scale[:, t : t + 1]
            moves += move * (alpha[:, t - 1].T @ ahead)
            beta = ahead @ move.T
    return np.log(scale).sum() + shift.sum(), marginals, moves


# --- prediction --------------------------------------------------------------------


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def label_words(scores: np.ndarray, word: np.ndarray, pointers: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginal probabilities of all words of some texts; ``scores[word]`` are their emissions.

    Texts are cut into segments of SEGMENT words. All segments advance by one word at a time:
    first to their transfer matrices, with which the forward and backward messages are
    handed from segment to segment, and then again between those messages. The result
    is that of one pass over each text, but a long text takes no longer loop.
    """
    k = scores.shape[1]
    sizes = np.diff(pointers)
    parts = -(-sizes // SEGMENT)
    first = np.cumsum(parts) - parts  # of each text, among all segments
    text = np.repeat(np.arange(len(sizes)), parts)
    place = np.arange(len(text)) - first[text]
    begin = pointers[text] + place * SEGMENT
    size = np.minimum(SEGMENT, pointers[text + 1] - begin)
    local = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    move = np.exp(transitions - transitions.max())
    # Longest segments first: those that still run are always the first rows.
    order = np.argsort(-size, kind="stable")
    begin, head = begin[order], (place == 0)[order]
    running = len(order) - np.searchsorted(size[order][::-1], np.arange(size.max(initial=0)), side="right")

    transfer = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t, n in enumerate(running):
        step = transfer[:n] @ move
        if t == 0:
            step[head[:n]] = np.eye(k)  # nothing precedes a text
        step *= local[word[begin[:n] + t]][:, None, :]
        transfer[:n] = step / step.sum((1, 2), keepdims=True)
    along = np.empty_like(transfer)
    along[order] = transfer

    ahead, behind = np.ones((len(order), k)), np.ones((len(order), k))
    longest = np.argsort(-parts, kind="stable")
    going = len(parts) - np.searchsorted(parts[longest][::-1], np.arange(parts.max(initial=0)), side="right")
    for j in range(1, len(going)):
        at = first[longest[: going[j]]] + j
        ahead[at] = _normal(np.einsum("nk,nkl->nl", ahead[at - 1], along[at - 1]))
    for j in range(len(going) - 1, 0, -1):
        at = first[longest[: going[j]]] + j
        behind[at - 1] = _normal(np.einsum("nkl,nl->nk", along[at], behind[at]))

    out = np.empty((len(word), k))
    state = ahead[order]
    for t, n in enumerate(running):
        moved = state[:n] @ move
        if t == 0:
            moved[head[:n]] = 1
        state = _normal(moved * local[word[begin[:n] + t]])
        out[begin[:n] + t] = state
    back = behind[order]
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = begin[:n] + t
        out[at] = _normal(out[at] * back[:n])
        if t:
            back[:n] = _normal((local[word[at]] * back[:n]) @ move.T)
    return out


def _lettered(texts: pa.Array, raw: np.ndarray, starts: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Which texts hold a letter."""
    ascii_ = (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122)
    offsets = np.r_[0, np.cumsum(ascii_)]
    at = buffers(texts)[1]
    has = offsets[at[1:]] > offsets[at[:-1]]
    for i in np.flatnonzero(~has & (np.diff(pointers) > 0)):
        has[i] = any(c.isalpha() for c in texts[i].as_py())
    return has


def tagged(texts: pa.Array, model: Model):
    """For each of some texts: whether it has a letter, where its words begin, and all words' marginals."""
    hashes, pointers, raw, starts, ends = located_words(texts)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    buckets, begin = word_features(raw, starts[first], ends[first], distinct)
    scores = emissions(model.weights, buckets, begin).astype(float)
    return _lettered(texts, raw, starts, pointers), pointers, label_words(scores, number, pointers, model.transitions)


def predicted(text: Column, model: Model) -> Column:
    """A struct (lang_pred, score): ``und`` and 0 for a null text or one without letters, else the
    language with the largest share of the words' probabilities, and that share; ties go to the
    first language in the order of their names. A model of no language knows ``und`` alone."""
    if not model.languages:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, shares = [], []
        for lo, hi in parts(texts):
            lettered, pointers, marginals = tagged(texts[lo:hi], model)
            sums = np.diff(np.r_[np.zeros((1, len(model.languages))), np.cumsum(marginals, axis=0)][pointers], axis=0)
            best = sums.argmax(1)
            for i in range(hi - lo):
                known = lettered[i] and pointers[i + 1] > pointers[i]
                names.append(model.languages[best[i]] if known else "und")
                shares.append(min(1.0, max(0.0, float(sums[i, best[i]] / (pointers[i + 1] - pointers[i])))) if known else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by CRC-32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learned(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> Model:
    """Fitted on at most ``texts`` documents of each language, chosen by hash, of those that are
    not held out. They may be of any length; only what is used of them leaves the tasks."""

    @F.arrow_udf("string")
    def excerpt(batch: pa.Array) -> pa.Array:
        return excerpts(batch)

    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = known.select("lang", "doc_id", row_tie(F.col("text")).alias("tie"), "text")
    chosen = grouped_sample(own, texts, "lang", "doc_id", "tie").select("lang", "doc_id", "tie", excerpt("text").alias("text"))
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"], r["tie"]))
    languages = sorted({r["lang"] for r in rows})
    sample = [(languages.index(r["lang"]), r["text"]) for r in rows]
    return fit(sample, languages) if sample else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
