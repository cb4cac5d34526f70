"""Benchmark decontamination with a positional inverted index of the training words.

The index is a table of blocks. A block holds about three megabytes of whole
documents; its documents lie on one axis of positions with a gap after each, so a
phrase can never span two documents. Postings are (word, ascending positions).
Searching intersects, block by block, the lists of a phrase's words after taking
each word's offset in the phrase off its positions, from the rarest word (by its
count in the whole corpus) to the most frequent one. Blocks are independent: a
search shuffles only what it found.

The benchmark is the stated query set. It is read in blocks of whole items, each
searched in one pass over the index, so its size bounds neither driver nor tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import texts_of
from gradeloom.llm.words import parts, word_hashes
from gradeloom.session import settle

BLOCK_BYTES = 3 << 20  # text of a block of the index
WINDOW = 13
ITEM_BLOCK = 5000  # benchmark items searched in one pass

INDEX_SCHEMA = (
    "block bigint, doc_ids array<bigint>, ties array<bigint>, starts array<bigint>, n_words array<bigint>, "
    "words binary, counts binary, positions binary"
)
MATCH_SCHEMA = "block bigint, ord int, item_id string, start bigint, stop bigint"


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of documents(doc_id, text).

    A block is a row: ids, ties (text hashes), first position and number of words
    of its documents; ``words`` (distinct 64-bit word hashes, ascending), ``counts``
    (occurrences of each) and ``positions`` (differences of neighbouring positions,
    word after word, modulo 2**32). Null and empty texts have no words but are listed.
    """

    def blocks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in parts(batch.column(2), BLOCK_BYTES):
                block, at = word_hashes(batch.column(2)[lo:hi])
                gaps = np.arange(hi - lo)
                positions = np.arange(len(block)) + np.repeat(gaps, np.diff(at))
                order = np.argsort(block, kind="stable")
                block, positions = block[order], positions[order].astype(np.uint32)
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
                counts = np.diff(np.r_[first, len(block)]).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([batch.column(0)[lo:hi].to_pylist()], pa.list_(pa.int64())),
                        pa.array([batch.column(1)[lo:hi].to_pylist()], pa.list_(pa.int64())),
                        pa.array([at[:-1] - at[0] + gaps], pa.list_(pa.int64())),
                        pa.array([np.diff(at)], pa.list_(pa.int64())),
                        pa.array([block[first].tobytes()], pa.binary()),
                        pa.array([counts.tobytes()], pa.binary()),
                        pa.array([np.diff(positions, prepend=np.uint32(0)).tobytes()], pa.binary()),
                    ],
                    names=["block", "doc_ids", "ties", "starts", "n_words", "words", "counts", "positions"],
                )
                number += 1

    # Small row groups: a task reads a block or a few at a time.
    return settle(texts_of(docs).mapInArrow(blocks, INDEX_SCHEMA), **{"parquet.block.size": 8 << 20, "compression": "zstd"})


class Phrases:
    """The phrases of some items: rows of word numbers into a sorted vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashes, pointers = word_hashes(pa.array([text for _, text in items], pa.string()))
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.item_ids = [item for item, _ in items]
        rows, owner = [], []
        for i in range(len(items)):
            words = number[pointers[i] : pointers[i + 1]]
            if not len(words):
                continue
            if len(words) < window:
                rows.append(np.r_[words, np.full(window - len(words), -1)][None, :])
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(words, window))
            owner.append(np.full(len(rows[-1]), i))
        self.words = np.concatenate(rows) if rows else np.zeros((0, window), int)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, int)
        self.length = (self.words >= 0).sum(1)
        # Windows whose words are the same need one search each and item.
        both = np.c_[self.owner, self.words]
        if len(both):
            keep = np.unique(both, axis=0, return_index=True)[1]
            self.words, self.owner, self.length = self.words[keep], self.owner[keep], self.length[keep]

    def order_by(self, frequency: np.ndarray) -> None:
        """Offsets of each phrase from its rarest word to its most frequent one."""
        often = np.where(self.words >= 0, np.r_[frequency, 0][self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable")


def _rows(batch: pa.RecordBatch):
    """The blocks of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _lists(row: dict, vocabulary: np.ndarray):
    """Occurrences of each vocabulary word in a block and their (word number, position), sorted."""
    words = np.frombuffer(row["words"], np.uint64)
    counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
    at = np.searchsorted(words, vocabulary)
    has = at < len(words)
    has[has] = words[at[has]] == vocabulary[has]
    count = np.zeros(len(vocabulary) + 1, np.int64)
    count[:-1][has] = counts[at[has]]
    begin = np.cumsum(counts) - counts
    n = count[:-1][has]
    index = np.repeat(begin[at[has]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    positions = np.cumsum(np.frombuffer(row["positions"], np.uint32), dtype=np.uint32)[index].astype(np.int64)
    return count, (np.repeat(np.flatnonzero(has), n) << 33) | positions


def occurrences(row: dict, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, document) of all matches in a block.

    With ``slop`` 0 a match is the exact phrase. Otherwise it is a proximity match:
    the rarest word stands at its place and every other word within ``slop`` words
    of the place it would have in the exact phrase, in the same document.
    """
    count, lists = _lists(row, phrases.vocabulary)
    count[-1] = 1  # beyond the end of a short phrase
    able = np.flatnonzero((count[phrases.words] > 0).all(1))
    if not len(able):
        return able, able, able
    words, order = phrases.words[able], phrases.order[able]
    pick = np.arange(len(able))
    # The rarest word's list, moved back by the word's offset.
    offset = order[:, 0]
    word = words[pick, offset]
    n = count[word]
    begin = np.searchsorted(lists, word << 33)
    index = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    phrase = np.repeat(pick, n)
    anchor = lists[index] & ((1 << 33) - 1)
    start = anchor - offset[phrase]
    starts = np.array(row["starts"])
    doc = np.searchsorted(starts, anchor, side="right") - 1
    end = starts + np.array(row["n_words"])
    for k in range(1, words.shape[1]):
        offset = order[phrase, k]
        word = words[phrase, offset]
        low = np.maximum(start + offset - slop, starts[doc])
        high = np.minimum(start + offset + slop, end[doc] - 1)
        at = np.searchsorted(lists, (word << 33) | low)
        found = lists[np.minimum(at, len(lists) - 1)] - (word << 33)
        fits = (word < 0) | ((found >= low) & (found <= high))
        phrase, start, doc = phrase[fits], start[fits], doc[fits]
    return able[phrase], start, doc


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of the vocabulary's words in the whole corpus."""

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in _rows(batch):
                words = np.frombuffer(row["words"], np.uint64)
                at = np.searchsorted(words, vocabulary)
                has = at < len(words)
                has[has] = words[at[has]] == vocabulary[has]
                total[has] += np.frombuffer(row["counts"], np.uint32)[at[has]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])

    counted = index.select("words", "counts").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for word, n in counted.toLocalIterator():  # as many rows as the item block has words
        out[word] = n
    return out


def _item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text), ITEM_BLOCK at a time. Rows without id or text are no items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    block = []
    for row in items.dropna().distinct().toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def find(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Matches (block, ord, item_id, start, stop): words [start, stop) of a document
    match ``item_id``; touching matches of one item are one row."""
    found = None
    for items in _item_blocks(benchmark):
        phrases = Phrases(items, window)
        phrases.order_by(_frequencies(index, phrases.vocabulary))

        def search(batches, phrases=phrases):
            for batch in batches:
                for row in _rows(batch):
                    which, start, doc = occurrences(row, phrases, slop)
                    if not len(which):
                        continue
                    item, stop = phrases.owner[which], start + phrases.length[which]
                    order = np.lexsort((start, doc, item))
                    item, start, stop, doc = item[order], start[order], stop[order], doc[order]
                    run = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])
                    first, last = start[run], np.maximum.reduceat(stop, run)
                    base = np.array(row["starts"])[doc[run]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(run), row["block"])),
                            pa.array(doc[run].astype(np.int32)),
                            pa.array([phrases.item_ids[i] for i in item[run]], pa.string()),
                            pa.array(first - base),
                            pa.array(last - base),
                        ],
                        names=["block", "ord", "item_id", "start", "stop"],
                    )

        part = index.drop("doc_ids", "ties").mapInArrow(search, MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], MATCH_SCHEMA)
    return settle(found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """One row per row of ``docs``: how many of its words lie in occurrences of benchmark windows.

    (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, tie). A
    document is contaminated if at least ``percent`` % of its words, and at least
    one, are hit. Null text has no words; repeated rows are judged each for itself.
    """
    index = build_index(docs)
    matches = find(index, benchmark, window)
    doc = Window.partitionBy("block", "ord").orderBy("start", "stop")
    before = F.max("stop").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, "start")))
    hits = (
        matches.withColumn("fresh", fresh)
        .groupBy("block", "ord")
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    listed = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "ties", "n_words")).alias("ord", "doc"))
    listed = listed.select("block", "ord", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.ties").alias("tie"), F.col("doc.n_words").alias("n_words"))
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return listed.join(hits, ["block", "ord"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
        items.alias("items"),
        "tie",
    )


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 3) -> DataFrame:
    """(doc_id, item_id, start, stop) of proximity matches; with ``slop`` 0, of exact phrases.

    ``start`` and ``stop`` are where the exact phrase would stand, counted from the
    document's first word; ``start`` may then be negative and ``stop`` beyond the end.
    """
    index = build_index(docs)
    matches = find(index, benchmark, window, slop)
    ids = index.select("block", F.posexplode("doc_ids").alias("ord", "doc_id"))
    return matches.join(ids, ["block", "ord"]).select("doc_id", "item_id", "start", "stop")
