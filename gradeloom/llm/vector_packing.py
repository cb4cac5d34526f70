"""Vector bin packing of training examples into sequences.

A sequence may hold so many tokens, so many segments (pieces of examples) and so many tokens
that bear loss; an example's prompt bears none. A sequence is filled by the dot-product
heuristic: of the examples that still fit, it takes the one whose demands have the largest
product with the room that is left, each dimension relative to its limit and weighted by its
mean demand. When none fits, or one segment is left, an example is cut to fill the rest.

Each task encodes its part of the rows and packs them in blocks, without a shuffle of texts
or ids. What is left of a task, less than one sequence, goes to a second round, where the ends
of many tasks are packed together. The last tokens of a second task, and a sequence that the
limits of segments or loss end early, become sequences of powers of two, which need no padding.

Null texts are empty, and an example has its end id at least, so none is lost. Rows that
repeat, or have no doc_id, are packed each by itself. An empty table gives no piece.
"""

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.token_store import GROUP, encoder, shipped
from gradeloom.session import settle

BLOCK_TOKENS, BLOCK_ITEMS = 1 << 21, 1 << 15  # packed together
MERGE = 64  # tasks whose ends are packed together

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, loss bigint, ids_crc32 bigint, doc_tokens bigint, "
    "part int, sequence bigint, offset bigint, prompt bigint, place bigint, ids binary"
)


@dataclass(frozen=True)
class Limits:
    """What a sequence can hold; ``cut``: examples that fit whole may be cut to fill one."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    cut: bool = True


@dataclass(eq=False)
class Item:
    """The ids of an example from ``start`` on; ids before ``prompt`` bear no loss."""

    doc_id: int | None
    start: int
    doc_tokens: int
    prompt: int
    ids: np.ndarray

    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.prompt))

    def prefix(self, tokens: int, loss: int) -> int:
        """The longest prefix of at most so many tokens and loss-bearing tokens."""
        return min(len(self.ids), tokens, max(0, self.prompt - self.start) + loss)

    def split(self, at: int) -> tuple["Item", "Item"]:
        head = Item(self.doc_id, self.start, self.doc_tokens, self.prompt, self.ids[:at])
        return head, Item(self.doc_id, self.start + at, self.doc_tokens, self.prompt, self.ids[at:])


class Pool:
    """Items by their demands (tokens, loss); those of equal demands wait in line.

    An item that no empty sequence can hold is cut into as long pieces as one can.
    """

    def __init__(self, items: list[Item], limits: Limits):
        self.limits = limits
        lines: dict[tuple[int, int], deque] = defaultdict(deque)
        for item in items:
            while (at := item.prefix(limits.tokens, limits.loss)) < len(item.ids):
                head, item = item.split(at)
                lines[at, head.loss()].append(head)
            lines[len(item.ids), item.loss()].append(item)
        demands = sorted(lines, reverse=True)
        self.lines = [lines[d] for d in demands]
        self.kinds = {d: kind for kind, d in enumerate(demands)}
        self.tokens, self.losses = np.array(demands, np.int64).reshape(-1, 2).T.copy()
        sizes = np.array([len(line) for line in self.lines])
        self.count = int(sizes.sum())
        means = [(d * sizes).sum() / max(self.count, 1) for d in (self.tokens / limits.tokens, self.losses / limits.loss)]
        self.weights = means[0] / limits.tokens**2, means[1] / limits.loss**2  # relative to the limits on both sides

    def put(self, item: Item) -> None:
        demands = len(item.ids), item.loss()
        kind = self.kinds.setdefault(demands, len(self.lines))
        if kind == len(self.lines):
            self.lines.append(deque())
            self.tokens, self.losses = np.append(self.tokens, demands[0]), np.append(self.losses, demands[1])
        self.tokens[kind] = demands[0]  # a line that was emptied had lost it
        self.lines[kind].append(item)
        self.count += 1

    def take(self, kind: int) -> Item:
        item = self.lines[kind].popleft()
        self.count -= 1
        if not self.lines[kind]:
            self.tokens[kind] = -1
        return item

    def best(self, tokens: int, loss: int, whole: bool) -> int | None:
        """The kind of the largest dot product with the room left, among those that fit ``whole`` or in part."""
        if whole:
            kinds = np.flatnonzero((self.tokens > 0) & (self.tokens <= tokens) & (self.losses <= loss))
        else:  # without room for loss, only a prompt fits
            kinds = np.flatnonzero((self.tokens > 0) & ((loss > 0) | (self.tokens > self.losses)))
        if not len(kinds):
            return None
        score = self.tokens[kinds] * (self.weights[0] * tokens) + self.losses[kinds] * (self.weights[1] * loss)
        return int(kinds[np.argmax(score)])


def fill(pool: Pool, limits: Limits) -> list[Item]:
    """The items of the next sequence, which ends when a limit is met or nothing more fits."""
    items, tokens, loss = [], limits.tokens, limits.loss
    while tokens and len(items) < limits.segments:
        kind = pool.best(tokens, loss, whole=True)
        # The last segment has to fill the rest.
        last = limits.cut and len(items) == limits.segments - 1 and kind is not None and pool.tokens[kind] < tokens
        if kind is None and (limits.cut or not items) or last:
            kind = pool.best(tokens, loss, whole=False)
        if kind is None:
            break
        item = pool.take(kind)
        at = item.prefix(tokens, loss)
        if at < len(item.ids):
            item, rest = item.split(at)
            pool.put(rest)
        items.append(item)
        tokens -= at
        loss -= item.loss()
    return items


def powers(items: list[Item]) -> list[list[Item]]:
    """Items cut into sequences whose lengths are the powers of two that make up their sum."""
    waiting, total, out = deque(items), sum(len(i.ids) for i in items), []
    while total:
        room = 1 << total.bit_length() - 1
        total -= room
        out.append([])
        while room:
            item = waiting.popleft()
            if len(item.ids) > room:
                item, rest = item.split(room)
                waiting.appendleft(rest)
            out[-1].append(item)
            room -= len(item.ids)
    return out


def pack(items: list[Item], limits: Limits, end: bool) -> tuple[list[list[Item]], list[Item]]:
    """(sequences, items left for the next block); ``end``: nothing comes after these."""
    pool, out = Pool(items, limits), []
    while pool.count:
        sequence = fill(pool, limits)
        total = sum(len(i.ids) for i in sequence)
        if not pool.count and total < limits.tokens and not end:
            return out, sequence
        out.extend(powers(sequence) if limits.cut and total < limits.tokens else [sequence])
    return out, []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [column.strip().split(" ")[0] for column in SCHEMA.split(",")]
    kinds = [pa.int64()] * 6 + [pa.int32()] + [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _packed(blocks: Iterator[list[Item]], limits: Limits, end: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of all blocks of a task; unless ``end``, its last items follow with their ids."""
    from pyspark import TaskContext

    part, sequence, left = TaskContext.get().partitionId(), 0, []

    def rows(sequences):
        nonlocal sequence
        for items in sequences:
            offset = 0
            for i in items:
                crc = zlib.crc32(i.ids.astype("<u4"))
                yield i.doc_id, i.start, len(i.ids), i.loss(), crc, i.doc_tokens, part, sequence, offset, i.prompt, None, None
                offset += len(i.ids)
            sequence += 1

    for block in blocks:
        sequences, left = pack(left + block, limits, False)
        if sequences:
            yield _batch(list(rows(sequences)))
    if left and end:
        yield _batch(list(rows(pack(left, limits, True)[0])))
    elif left:
        yield _batch([(i.doc_id, i.start, len(i.ids), None, None, i.doc_tokens, part, None, None, i.prompt, n, i.ids.astype("<u4").tobytes()) for n, i in enumerate(left)])


def packed(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """Pieces of all rows of documents(doc_id, text), with its prompts if there is a column ``prompt``.

    An example is the ids of its prompt, of its text and ``end_id``. A piece is
    (doc_id, start, length, loss, ids_crc32, doc_tokens, sequence_id, offset): ids from ``start``
    of the example stand from ``offset`` in the sequence. Numbers of sequences are unique, not dense.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("every limit must be at least 1")
    spark = docs.sparkSession
    rules = shipped(spark, tokenizer)

    def examples(batches) -> Iterator[list[Item]]:
        encode = encoder(rules.value, end_id)
        width, items, tokens = np.dtype(encode.kind).itemsize, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                ids, texts, prompts = (c[lo : lo + GROUP].to_pylist() for c in batch.columns)
                heads = [b""] * len(ids)
                if any(prompts):
                    heads = [p[:-width] for p in encode(prompts)]  # without the end id
                for doc_id, head, payload in zip(ids, heads, encode(texts)):
                    payload = np.frombuffer(head + payload, encode.kind)
                    items.append(Item(doc_id, 0, len(payload), len(head) // width, payload))
                    tokens += len(payload)
                    if tokens >= BLOCK_TOKENS or len(items) >= BLOCK_ITEMS:
                        yield items
                        items, tokens = [], 0
        yield items

    def first(batches):
        yield from _packed(examples(batches), limits, end=False)

    def second(batches):
        columns = "doc_id", "start", "doc_tokens", "prompt", "ids"
        items = []
        for batch in batches:
            for *numbers, ids in zip(*(batch.column(c).to_pylist() for c in columns)):
                items.append(Item(*numbers, np.frombuffer(ids, "<u4")))
        yield from _packed(iter([items]), limits, end=True)

    prompt = F.col("prompt") if "prompt" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", prompt.alias("prompt"))
    done = settle(rows.mapInArrow(first, SCHEMA))
    # At most one sequence of each task comes here, and at most that of some MERGE tasks meets in one task.
    ends = done.filter("ids is not null")
    parts = (ends.agg(F.max("part")).first()[0] or 0) // MERGE + 1
    merged = ends.repartition(parts, F.expr(f"part div {MERGE}")).sortWithinPartitions("part", "place")
    merged = settle(merged.mapInArrow(second, SCHEMA))
    both = done.filter("ids is null").withColumn("round", F.lit(0)).unionByName(merged.withColumn("round", F.lit(1)))
    number = F.shiftleft(F.col("part").cast("bigint") * 2 + F.col("round"), 32) + F.col("sequence")
    return both.select("doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset")
