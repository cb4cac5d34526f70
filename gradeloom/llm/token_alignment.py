"""Alignment of the tokens of two tokenizers, by incidence matrices of tokens and bytes.

A is the matrix of the first tokenizer's tokens (rows) and the bytes they stand for (columns),
B that of the second. The entries of A B' that are not zero are the links: pairs of tokens
whose bytes overlap. Where tokens of both end, the bytes are cut into groups; with the
incidence of tokens and groups, G_A G_B' links tokens that share a group. Matrices are rows of
column numbers one after another (CSR) and products go row by row (Gustavson): the rows of the
right matrix that a row's entries name are added up. G_A G_B' is counted, not written out, as it
grows with the square of a group; the groups themselves say the same.

Texts are encoded and multiplied in blocks of some megabytes. A block keeps its distinct linked
id pairs once, with the number of its documents that hold each, so the corpus-wide counts and
the way back move pairs of blocks, not of documents: no pair, however frequent, has more rows
than there are blocks.

A text is encoded as a blank and the text. Null and empty texts, and texts whose joined token bytes
are not those (for either tokenizer), have no tokens, groups or links. Rows that repeat count each
as a document. A text is cut where both tokenizers end a token: before each lone blank
between two characters that are no white space (if no piece of B goes on after such a blank).
Tokens, groups and links of a piece do not depend on its neighbours, so a block encodes and
multiplies its distinct pieces and adds them up by the incidence of documents and pieces.
"""

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import worker_cache
from gradeloom.llm.words import parts
from gradeloom.session import settle

MARK = "▁"
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")  # one between two characters that are no white space
BLOCK = 4 << 20  # bytes of text whose pairs are kept together
PART = 1 << 18  # characters of distinct pieces encoded and multiplied at a time
ROWS = 256  # documents sent to the JVM at once

SCHEMA = (
    "doc_id bigint, block bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "n_shared bigint, groups string, links binary, pairs binary"
)
PAIR = np.dtype([("a", "<i4"), ("b", "<i4"), ("n", "<i4")])  # a block's distinct pairs and the documents that hold them
LINK = np.dtype([("pair", "<i4"), ("n", "<i4")])  # a document's pairs, by their number in the block, and its links of each


# --- matrices ----------------------------------------------------------------------


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (sizes[i] of them), one span after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def transpose(pointers: np.ndarray, columns: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    order = np.argsort(columns, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(columns, minlength=n_columns))], rows[order]


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int):
    """Gustavson's product of two 0/1 matrices: (rows, columns, values) of its entries, ``width`` columns."""
    (a_pointers, a_columns), (b_pointers, b_columns) = a, b
    sizes = np.diff(b_pointers)[a_columns]  # of the rows of b that each entry of a names
    rows = np.repeat(np.repeat(np.arange(len(a_pointers) - 1), np.diff(a_pointers)), sizes)
    keys = np.sort(rows * width + b_columns[spans(b_pointers[a_columns], sizes)], kind="stable")
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] // width, keys[first] % width, np.diff(np.r_[first, len(keys)])


def product_size(a: tuple[np.ndarray, np.ndarray], b_pointers: np.ndarray) -> np.ndarray:
    """The symbolic step alone, for rows of ``a`` with one entry: entries of each row of the product."""
    return np.diff(b_pointers)[a[1]]


# --- tokenizers --------------------------------------------------------------------


class Table:
    """The bytes of each token id, to join and to measure token sequences."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans(self.first[ids], self.sizes[ids])]


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of a worker."""

    def __init__(self, rules: str, model: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(rules)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        names = {i: t for t, i in self.a.get_vocab().items()}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        whole = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        self.a_table = Table([special.get(i) or bytes(map(letters.__getitem__, t)) for i, t in enumerate(whole)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        self.words = [[f"{i}{mark}" for i in range(max(len(whole), len(pieces)))] for mark in (",", "|", ";")]
        self.words = [np.array(w, object) for w in self.words]
        # Pieces that go on after a blank would let a token cross the place where a text is cut.
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and the text by both; the second adds the blank itself."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)


def pieces_of(text: str, size: int) -> list[str]:
    """The text cut before lone blanks, each piece about ``size`` characters or longer; the blanks are left out."""
    out, lo, at = [], 0, size
    while (at := text.find(" ", at)) >= 0 and at + 1 < len(text):
        if text[at - 1].isspace() or text[at + 1].isspace():
            at += 1
            continue
        out.append(text[lo:at])
        lo, at = at + 1, at + 1 + size
    return [*out, text[lo:]]


# --- blocks ------------------------------------------------------------------------


class Aligned:
    """Tokens, groups and links of some texts, multiplied at once."""

    def __init__(self, tokenizers: Tokenizers, a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]):
        """Ids of all texts, one after another, and how many each text has of both; none has no ids."""
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(tokenizers.a_table.sizes[self.a]), np.cumsum(tokenizers.b_table.sizes[self.b])
        n_bytes = int(a_end[-1])
        cut = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
        # Columns of the matrices are bytes, then groups.
        a_bytes, b_bytes = (np.r_[0, a_end], np.arange(n_bytes)), (np.r_[0, b_end], np.arange(n_bytes))
        self.link_a, self.link_b, _ = product(a_bytes, transpose(*b_bytes, n_bytes), len(self.b))
        by_group = transpose(np.arange(len(self.b) + 1), b_group, len(cut))
        shared = product_size((np.arange(len(self.a) + 1), a_group), by_group[0])
        # Documents of tokens, groups and links.
        self.n_a, self.n_b = sizes
        self.a_doc = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.link_doc = self.a_doc[self.link_a]
        last_a = np.searchsorted(a_group, np.arange(len(cut)), side="right") - 1
        self.n_groups = np.bincount(self.a_doc[last_a], minlength=len(self.n_a))
        self.n_links = np.bincount(self.link_doc, minlength=len(self.n_a))
        self.n_shared = np.bincount(self.a_doc, shared, len(self.n_a)).astype(np.int64)
        # The groups as text: tokens of A and of B in turn, each with the mark that follows it.
        a_size, b_size = np.bincount(a_group), np.bincount(b_group)
        a_place = np.arange(len(self.a)) + (np.cumsum(b_size) - b_size)[a_group]
        b_place = np.arange(len(self.b)) + np.cumsum(a_size)[b_group]
        words = np.empty(len(self.a) + len(self.b), object)
        for place, ids, group, mark in ((a_place, self.a, a_group, 1), (b_place, self.b, b_group, 2)):
            last = np.diff(group, append=-1) != 0
            words[place[last]] = tokenizers.words[mark][ids[last]]
            words[place[~last]] = tokenizers.words[0][ids[~last]]
        ends = np.cumsum(self.n_a + self.n_b)
        self.groups = ["".join(words[lo:hi].tolist()) for lo, hi in zip(np.r_[0, ends[:-1]], ends)]


def _whole(tokenizers: Tokenizers, texts: list[str], a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the joined token bytes of each text are a blank and the text, for both tokenizers."""
    raw = [b" " + t.encode() for t in texts]
    want = np.array([len(r) for r in raw], np.int64)
    ok = np.ones(len(texts), bool)
    for table, ids, n in ((tokenizers.a_table, a, sizes[0]), (tokenizers.b_table, b, sizes[1])):
        ends = np.r_[0, np.cumsum(table.sizes[ids])]
        last = np.cumsum(n)
        got = ends[last] - ends[last - n]
        ok &= got == want
        joined, same = table.joined(ids), np.flatnonzero(got == want)
        if len(same):
            joined = joined[spans(ends[last - n][same], got[same])]
            differs = joined != np.frombuffer(b"".join([raw[k] for k in same.tolist()]), np.uint8)
            ok[same] &= np.add.reduceat(differs, np.cumsum(want[same]) - want[same], dtype=np.int64) == 0
    return ok


def _summed(rows: np.ndarray, keys: np.ndarray, width: int, values: np.ndarray):
    """(rows, keys, sums of the values) of each distinct row and key, in order; keys are below ``width``."""
    both = rows * width + keys
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    sums = np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)
    return both[first] // width, both[first] % width, sums


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class Pieces:
    """Distinct pieces of texts: whether their bytes are whole, their counts, groups and links (distinct pairs, as CSR)."""

    def __init__(self, tokenizers: Tokenizers, pieces: list[str]):
        n = len(pieces)
        self.whole = np.zeros(n, bool)
        self.counts = {c: np.zeros(n, np.int64) for c in COUNTS}
        self.groups = np.full(n, "", object)
        owners, kinds, times = ([np.zeros(0, np.int64)] for _ in range(3))
        at = np.r_[0, np.cumsum([len(p) for p in pieces])]
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, side="right")) - 1)
            found = self._part(tokenizers, pieces[lo:hi], lo)
            if found:
                owners.append(found[0]), kinds.append(found[1]), times.append(found[2])
            lo = hi
        owner, kind, self.link_times = np.concatenate(owners), np.concatenate(kinds), np.concatenate(times)
        self.link_first = np.searchsorted(owner, np.arange(n + 1))
        self.pairs, self.link_pairs = np.unique(kind, return_inverse=True)

    def _part(self, tokenizers: Tokenizers, pieces: list[str], lo: int):
        ids = tokenizers.encode(pieces)
        sizes = [np.array([len(x) for x in side], np.int64) for side in ids]
        ids = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, sizes)]
        whole = _whole(tokenizers, pieces, *ids, sizes)
        keep = np.flatnonzero(whole)
        if not len(keep):
            return None
        a, b = (side[np.repeat(whole, n)] for side, n in zip(ids, sizes))
        found = Aligned(tokenizers, a, b, (sizes[0][keep], sizes[1][keep]))
        known = lo + keep
        self.whole[known] = True
        for name in COUNTS:
            self.counts[name][known] = getattr(found, name)
        self.groups[known] = found.groups
        # Links of the same piece and ids, added up.
        kind, number = np.unique(found.a[found.link_a] << 32 | found.b[found.link_b], return_inverse=True)
        owner, number, times = _summed(found.link_doc, number, len(kind), np.ones(len(number), np.int64))
        return known[owner], kind[number], times


def _block(tokenizers: Tokenizers, texts: list[str | None]):
    """Columns n_a ... links of the block's documents, and its pairs."""
    n = len(texts)
    numbers: dict[str, int] = {}
    held = []
    for text in texts:
        found = [np.zeros(0, np.int64)]
        if text and tokenizers.cuttable:
            # The words of a very long text are not all held at once.
            for part in pieces_of(text, PART) if len(text) > 2 * PART else [text]:
                found.append(np.array([numbers.setdefault(p, len(numbers)) for p in LONE_BLANK.split(part)], np.int64))
        elif text:
            found.append(np.array([numbers.setdefault(text, len(numbers))], np.int64))
        held.append(np.concatenate(found))
    pieces = Pieces(tokenizers, list(numbers))
    whole = np.array([bool(pieces.whole[h].all()) for h in held], bool)
    held = [h if w else h[:0] for h, w in zip(held, whole)]
    groups = ["".join(pieces.groups[h].tolist()).removesuffix(";") for h in held]
    # The incidence of documents and pieces times that of pieces and pairs.
    docs = np.repeat(np.arange(n), [len(h) for h in held])
    docs, used, times = _summed(docs, np.concatenate([np.zeros(0, np.int64), *held]), len(numbers) or 1, np.ones(len(docs), np.int64))
    counts = {c: np.bincount(docs, pieces.counts[c][used] * times, n).astype(np.int64) for c in COUNTS}
    sizes = np.diff(pieces.link_first)[used]
    at = spans(pieces.link_first[:-1][used], sizes)
    docs, pair, times = _summed(np.repeat(docs, sizes), pieces.link_pairs[at], len(pieces.pairs) or 1, np.repeat(times, sizes) * pieces.link_times[at])
    # Pairs of texts that are not whole are left out.
    holders = np.bincount(pair, minlength=len(pieces.pairs))
    known = np.flatnonzero(holders)
    links = np.empty(len(pair), LINK)
    links["pair"], links["n"] = (np.cumsum(holders > 0) - 1)[pair], times
    pairs = np.empty(len(known), PAIR)
    kind = pieces.pairs[known]
    pairs["a"], pairs["b"], pairs["n"] = kind >> 32, kind & 0xFFFFFFFF, holders[known]
    cut = np.searchsorted(docs, np.arange(n + 1))
    return counts, groups, [links[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])], pairs.tobytes()


def sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows, since the JVM holds a batch that it reads outside its heap."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def aligned(docs: DataFrame, a: str, b: str, keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """Alignments of each row of documents(doc_id, text) by the tokenizers file ``a`` and the sentencepiece file ``b``.

    Columns: doc_id, n_a, n_b (tokens), n_groups, n_links, n_shared (pairs that share a group),
    n_best (links whose count is the highest of their first id), count_sum (over links) and
    groups, as `a1,a2|b1;a3|b2,b3`: ids of the first, a bar, ids of the second, group after group.
    The count of a pair of ids is the number of documents that hold it linked. ``keep`` says what
    is kept of the groups, for instance a digest.
    """
    context = docs.sparkSession.sparkContext
    with open(a, encoding="utf-8") as rules, open(b, "rb") as model:
        files = context.broadcast((rules.read(), model.read()))  # a few megabytes, whatever the input
    name = ("alignment", a, b)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = worker_cache()
        if name not in kept:
            kept[name] = Tokenizers(*files.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in parts(batch.column(1), BLOCK):
                counts, groups, links, pairs = _block(kept[name], batch.column(1)[lo:hi].to_pylist())
                columns = [batch.column(0)[lo:hi], pa.array(np.full(hi - lo, block)), pa.array(np.arange(hi - lo, dtype=np.int32))]
                columns += [pa.array(c) for c in counts.values()]
                columns += [pa.array(groups, pa.string()), pa.array(links, pa.binary()), pa.array([pairs] + [None] * (hi - lo - 1), pa.binary())]
                names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
                yield from sliced(pa.RecordBatch.from_arrays(columns, names=names), ROWS)
                block += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(blocks, SCHEMA)
    rows = settle(rows.withColumn("groups", keep(F.col("groups"))))

    def unpack(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = np.frombuffer(payload.as_buffer(), PAIR)
                columns = [np.full(len(pairs), block), np.arange(len(pairs), dtype=np.int32), *(np.ascontiguousarray(pairs[c]) for c in "abn")]
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "pair", "a", "b", "n"]), 64 * ROWS)

    pairs = rows.filter("pairs is not null").select("block", "pairs").mapInArrow(unpack, "block bigint, pair int, a int, b int, n int")
    total = settle(pairs.groupBy("a", "b").agg(F.sum("n").cast("bigint").alias("count")))
    best = total.groupBy("a").agg(F.max("count").alias("highest"))
    total = total.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("is_best"))
    counted = pairs.drop("n").join(total, ["a", "b"]).select("block", "pair", "count", "is_best")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over the links of a block's documents, which know their pairs by number."""
        n = max(len(right), 1)
        pair = right["pair"].to_numpy()
        count, is_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        count[pair], is_best[pair] = right["count"].to_numpy(), right["is_best"].to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(left["links"]).to_numpy().astype(np.int64) // LINK.itemsize
        links = np.concatenate([np.zeros(0, LINK), *(np.frombuffer(v.as_buffer(), LINK) for v in left["links"])])
        ends = np.cumsum(sizes)
        out = left.drop_columns(["links"])
        for column, value in (("n_best", is_best), ("count_sum", count)):
            sums = np.r_[0, np.cumsum(value[links["pair"]] * links["n"])]
            out = out.append_column(column, pa.array(sums[ends] - sums[ends - sizes]))
        return out

    own = rows.drop("pairs")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in own.drop("links").schema] + ["n_best bigint", "count_sum bigint"]
    judged = own.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(judge, ", ".join(fields))
    return judged.drop("block", "place")
