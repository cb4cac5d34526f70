"""Periodic runs of the words of a text, by suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends
keeping the period. Every run of at least two periods has a root that is the longest
Lyndon word at its place for one of two opposite orders of the words (the runs theorem).
So for each place and both orders: the Lyndon word is found from the order of the suffixes,
then it is extended to the right and to the left by longest common extensions. Those are
depths of lowest common ancestors in the Ukkonen suffix trees of the words and of their
reversal. The Euler tour of a tree is kept as the depths of its turning points between one
leaf and the next; the least of a range of them, from a table of ranges of 2^k, is the depth
of the ancestor, so an extension costs two reads.

Trees are built for those stretches of a document that can hold a run, and no others: all
windows of five words inside a run of four periods and six words come again inside it,
one period away. Stretches of windows that come again in the same stretch are found with
hashes (a collision only adds words), a run lies in one of them as a whole, and so the runs
are those of trees over the whole document.

Null, empty and blank texts have no words and no runs. Rows that repeat are judged one by one,
extra columns are ignored. Memory grows with the longest single stretch (some 600 bytes a word).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.words import mix, parts

# Fixed values of the contract: a run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
GRAM = 5  # the longest window that comes again in every run of those lengths
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class SuffixTree:
    """Ukkonen's suffix tree of symbols 1, 2, ...; the end is the symbol 0, the least."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        n, sigma = len(text), max(text) + 1
        start, stop, link, suffix = [0], [0], [0], [-1]  # of each node; the root is 0
        child: dict[int, int] = {}  # node * sigma + first symbol of the edge
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            last = 0  # the inner node that still lacks its suffix link
            while waiting:
                if not length:
                    edge = i
                key = node * sigma + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i), stop.append(n), link.append(0), suffix.append(i - waiting + 1)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = stop[below] - start[below]
                    if length >= span:  # walk down
                        edge += span
                        length -= span
                        node = below
                        continue
                    middle = start[below] + length
                    if text[middle] == symbol:
                        length += 1
                        if last and node:
                            link[last] = node
                        break
                    split = len(start)
                    child[key] = split
                    start.append(start[below]), stop.append(middle), link.append(0), suffix.append(-1)
                    start[below] = middle
                    child[split * sigma + text[middle]] = below
                    child[split * sigma + symbol] = split + 1
                    start.append(i), stop.append(n), link.append(0), suffix.append(i - waiting + 1)
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self.first = np.searchsorted(keys[order], np.arange(len(start) + 1) * sigma).tolist()
        self.ends_here = np.isin(np.arange(len(start)) * sigma, keys).tolist()  # nodes with an edge of the symbol 0
        self.span = (np.array(stop) - np.array(start)).tolist()
        self.suffix = suffix

    def tour(self, opposite: bool = False) -> tuple[list[int], list[int]]:
        """Suffixes in their order, and the least depth on the way to each from the one before.

        ``opposite`` turns the order of the symbols round; the end stays the least.
        """
        below, first, span, suffix, ends_here = self.below, self.first, self.span, self.suffix, self.ends_here
        nodes, above = [0], [0]
        found, turns, turn = [], [], 0
        while nodes:
            node, depth = nodes.pop(), above.pop()
            if depth < turn:
                turn = depth
            if suffix[node] >= 0:
                found.append(suffix[node])
                turns.append(turn)
                turn = 1 << 62
                continue
            inner = below[first[node] : first[node + 1]]
            if not opposite:
                inner.reverse()  # the last one on the stack comes first
            elif ends_here[node]:
                inner.append(inner.pop(0))
            nodes += inner
            above += [depth + span[node]] * len(inner)
        return found, turns


class Extensions:
    """Longest common extensions of pairs of suffixes, from a tour of their tree."""

    def __init__(self, found: list[int], turns: list[int]):
        self.rank = np.empty(len(found), np.int64)
        self.rank[found] = np.arange(len(found))
        self.least = [np.array(turns, np.int32)]
        while 2 << len(self.least) - 1 <= len(turns):
            half, last = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The common length of the suffixes at ``one`` and at ``other``, which differ."""
        a, b = self.rank[one], self.rank[other]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.least[k][lo[here]], self.least[k][hi[here] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> np.ndarray:
    """Where the longest Lyndon word that begins at each place ends: at the next smaller suffix."""
    ends = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j = i + 1
        while rank[j] > rank[i]:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:-1], np.int64)


def all_runs(symbols: list[int]) -> np.ndarray:
    """(start, length, period) of all runs of at least two periods, by start and period."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    tours = [tree.tour(), tree.tour(opposite=True)]
    right, left = Extensions(*tours[0]), Extensions(*SuffixTree(symbols[::-1]).tour())
    del tree
    place, runs = np.arange(n), []
    for found, _ in tours:
        rank = np.empty(n + 1, np.int64)
        rank[found] = np.arange(n + 1)
        end = lyndon_ends(rank.tolist())
        back = left(n - place, n - end)  # the words before both ends of the root
        length = end - place + back + right(place, end)
        runs.append(np.stack([place - back, length, end - place], 1)[length >= 2 * (end - place)])
    runs = np.concatenate(runs)
    return np.unique(runs[np.lexsort((runs[:, 2], runs[:, 0]))], axis=0) if len(runs) else runs


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words whose windows of five all come again within the range."""
    if len(words) < LEAST_WORDS:
        return []
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = mix(grams * np.uint64(3) + words[k : k + len(grams)].astype(np.uint64) + np.uint64(k + 1))
    place, group = np.arange(len(grams)), np.zeros(len(grams), np.uint64)
    while len(place):
        _, kind, times = np.unique(mix(grams[place] + group), return_inverse=True, return_counts=True)
        again = times[kind] > 1
        if again.all():
            break
        place = place[again]
        group = np.cumsum(np.diff(place, prepend=-2) > 1).astype(np.uint64)
    if not len(place):
        return []
    cut = np.flatnonzero(np.diff(place) > 1) + 1
    return [(int(p[0]), int(p[-1]) + GRAM) for p in np.split(place, cut)]


def runs_of(words: list) -> np.ndarray:
    """(start, length, period) of the runs of a list of words, by start and period."""
    ids: dict = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    out = [np.zeros((0, 3), np.int64)]
    if len(ids) < len(words):
        for lo, hi in stretches(numbers):
            symbols = np.unique(numbers[lo:hi], return_inverse=True)[1] + 1
            found = all_runs(symbols.tolist())
            found = found[found[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * found[:, 2])]
            out.append(found + np.array([lo, 0, 0]))
    return np.concatenate(out)


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)] if len(runs) else words


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of documents(doc_id, text).

    ``runs`` holds (start, length, period) by start and period, in words; ``collapsed`` is the
    text with the first period of each run alone, its words joined by one blank.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in parts(batch.column(1)):
                counts, sizes, numbers, texts = [], [], [np.zeros((0, 3), np.int64)], []
                for text in batch.column(1)[lo:hi].to_pylist():
                    words = (text or "").encode().split()  # at white space in ASCII
                    runs = runs_of(words)
                    counts.append(len(words))
                    sizes.append(len(runs))
                    numbers.append(runs)
                    texts.append(b" ".join(collapse(words, runs)).decode())
                runs = pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(numbers).T], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), runs)
                columns = [batch.column(0)[lo:hi], pa.array(counts, pa.int64()), runs, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(judge, SCHEMA)


def with_planted(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) with the words of every tenth row made periodic, as the contract says.

    The share and the place follow from the hash of the doc_id; a null doc_id has none.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("bigint").cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("a", F.expr("if(n > 0, g % n, 0)").cast("int"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    changed = F.expr(f"array_join(concat(slice(words, 1, a), {tail}), ' ')")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """The columns of the contract from ``found``."""
    # The greatest exact ratio first, then the smallest start and period; all runs differ.
    before = "x.length * y.period > y.length * x.period or (x.length * y.period = y.length * x.period and (x.start < y.start or (x.start = y.start and x.period < y.period)))"
    best = runs.withColumn("best", F.get(F.expr(f"array_sort(runs, (x, y) -> if({before}, -1, 1))"), F.lit(0)))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
