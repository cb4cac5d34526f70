"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

A document is the bag of its shingles of five words; a shingle that occurs once weighs
1, one that occurs n times 1 + ln(n) / 4, so that a line repeated a thousand times does
not outweigh the rest of a text. Each shingle sends arrivals of a Poisson process with its weight as rate;
every arrival picks one of the registers, and a register keeps the shingle that
arrived first. Two documents agree in a register with the probability Jaccard of
their bags. A shingle stops as soon as its next arrival is later than every register.

Documents with the same words are one content. Contents that agree in all registers
of a band are in one bucket. A class is a component of the graph of verified links, so
pairs of one bucket need no comparison once they are known to be in one class. First
every member is compared with one leader of its bucket, which joins most groups at a cost
in proportion to their size. What is then still apart within a bucket is
compared in full: pair by pair in small buckets; in large ones in packed blocks of
members, from which only links come out.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import row_tie, texts_of, without
from gradeloom.llm.components import components, leaders
from gradeloom.llm.words import mix, parts, shingle_hashes, word_hashes
from gradeloom.session import settle

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
DAMPING = 0.25
SMALL_BUCKET = 24  # members; larger buckets are compared in blocks
BLOCK_MEMBERS, BLOCK_BYTES = 128, 4 << 20
COLUMNS = 1 << 15  # shingles looked at together when two blocks are compared
PART_BYTES = 2 << 20  # text sketched at a time


def weight(counts: np.ndarray) -> np.ndarray:
    return 1 + DAMPING * np.log(counts)


def weighted_shingles(hashes: np.ndarray, pointers: np.ndarray, size: int):
    """(text, shingle, count) of the distinct shingles, by text and shingle."""
    shingles, begin = shingle_hashes(hashes, pointers, size)
    text = np.repeat(np.arange(len(pointers) - 1), np.diff(begin))
    order = np.lexsort((shingles, text))
    text, shingles = text[order], shingles[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])]) if len(text) else np.zeros(0, int)
    return text[first], shingles[first], np.diff(np.r_[first, len(text)])


def signatures(text: np.ndarray, shingles: np.ndarray, counts: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle that arrived first in each register of each text."""
    best = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    clock, weights = np.zeros(len(text)), weight(counts)
    arrival = 0
    while len(text):
        arrival += 1
        draw = mix(shingles + np.uint64(arrival * 0x9E3779B97F4A7C15 % (1 << 64)))
        # The upper 53 bits give the waiting time, a second draw the register.
        clock = clock - np.log((np.asarray(draw >> np.uint64(11), float) + 1) / 2.0**53) / weights
        register = (mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(registers)
        at = text * registers + register.astype(np.int64)
        np.minimum.at(best, at, clock)
        won = clock == best[at]
        winner[at[won]] = shingles[won]
        latest = best.reshape(texts, registers).max(1)
        open_ = clock < latest[text]
        text, shingles, weights, clock = text[open_], shingles[open_], weights[open_], clock[open_]
    return winner.reshape(texts, registers)


def probability_jaccard(a: dict, b: dict) -> float:
    """Sum over common shingles of 1 / sum over all of max(a'/a, b'/b), in exact classes of weights."""
    ha, wa = np.frombuffer(a["shingles"], np.uint64), np.frombuffer(a["counts"], np.uint32)
    hb, wb = np.frombuffer(b["shingles"], np.uint64), np.frombuffer(b["counts"], np.uint32)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(ia) / (len(ha) + len(hb) - len(ia))
    only_a, only_b = np.delete(wa, ia), np.delete(wb, ib)
    x = np.concatenate([wa[ia], only_a, np.zeros(len(only_b), np.uint32)])
    y = np.concatenate([wb[ib], np.zeros(len(only_a), np.uint32), only_b])
    kinds, n = np.unique(np.c_[x, y], axis=0, return_counts=True)
    p, q = (np.where(kinds[:, k] > 0, weight(np.maximum(kinds[:, k], 1)), 0.0) for k in (0, 1))
    total = 0.0
    for i in np.flatnonzero((p > 0) & (q > 0)):
        total += n[i] / (n * np.maximum(p / p[i], q / q[i])).sum()
    return float(total)


def sketches(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The written (doc_id, tie, content, bands): ``content`` identifies the words of a
    text, null if it has none; ``bands`` holds one hash for each band."""

    def sketch(batches):
        for batch in batches:
            for lo, hi in parts(batch.column(2), PART_BYTES):
                words, at = word_hashes(batch.column(2)[lo:hi])
                text, shingles, counts = weighted_shingles(words, at, size)
                winners = signatures(text, shingles, counts, hi - lo, bands * rows).reshape(hi - lo, bands, rows)
                band = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(31) + winners[:, :, r])
                some = np.diff(at) > 0
                content = [hashlib.blake2b(words[at[i] : at[i + 1]], digest_size=16).digest() if some[i] else None for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(content, pa.binary()), pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc_id", "tie", "content", "bands"],
                )

    return settle(texts_of(docs).mapInArrow(sketch, "doc_id bigint, tie bigint, content binary, bands array<bigint>"))


def bags(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(content, shingles, counts) of ``docs``; shingles ascend."""

    def bag(batches):
        for batch in batches:
            for lo, hi in parts(batch.column(2), PART_BYTES):
                words, at = word_hashes(batch.column(2)[lo:hi])
                text, shingles, counts = weighted_shingles(words, at, size)
                begin = np.searchsorted(text, np.arange(hi - lo + 1))
                counts = counts.astype(np.uint32)
                rows = [i for i in range(hi - lo) if at[i] < at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.blake2b(words[at[i] : at[i + 1]], digest_size=16).digest() for i in rows], pa.binary()),
                        pa.array([shingles[begin[i] : begin[i + 1]].tobytes() for i in rows], pa.binary()),
                        pa.array([counts[begin[i] : begin[i + 1]].tobytes() for i in rows], pa.binary()),
                    ],
                    names=["content", "shingles", "counts"],
                )

    return texts_of(docs).mapInArrow(bag, "content binary, shingles binary, counts binary")


def _verified(pairs: DataFrame, bagged: DataFrame) -> DataFrame:
    """``pairs``(a, b) with their probability Jaccard, written."""
    left = bagged.select(F.col("content").alias("a"), F.struct("shingles", "counts").alias("bag_a"))
    right = bagged.select(F.col("content").alias("b"), F.struct("shingles", "counts").alias("bag_b"))

    def verify(batches):
        for batch in batches:
            a, b, bag_a, bag_b = (batch.column(k) for k in ("a", "b", "bag_a", "bag_b"))
            sims = [probability_jaccard(bag_a[i].as_py(), bag_b[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
    return settle(joined.mapInArrow(verify, "a binary, b binary, similarity double"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The written (bucket, content, root, n) of buckets whose members are in several classes so far."""
    known = roots.select(F.col("node").alias("content"), "root")
    placed = members.join(known, "content", "left").select("bucket", "content", F.coalesce("root", "content").alias("root"))
    crowd = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return settle(placed.join(crowd.filter("low <> high").select("bucket", "n"), "bucket"))


def _common(block: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each bag of one block shares with each of another."""
    out = np.zeros((len(block), len(other)))
    both = np.intersect1d(np.concatenate(block), np.concatenate(other))
    for lo in range(0, len(both), COLUMNS):
        some, held = both[lo : lo + COLUMNS], []
        for bags in (block, other):
            matrix = np.zeros((len(bags), len(some)), np.float32)
            for i, bag in enumerate(bags):
                at = np.minimum(np.searchsorted(some, bag), len(some) - 1)
                matrix[i, at[some[at] == bag]] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out


def _links_of_blocks(block: list[dict], other: list[dict], same: bool, similarity: float):
    """Links between members of two blocks that share a band and are in different classes,
    one for each member and class."""
    bands = [np.array([m["bands"] for m in part], np.int64) for part in (block, other)]
    roots = [np.array([hash(m["root"]) for m in part]) for part in (block, other)]
    bags = [[np.frombuffer(m["shingles"], np.uint64) for m in part] for part in (block, other)]
    once = [np.array([np.frombuffer(m["counts"], np.uint32).max() == 1 for m in part]) for part in (block, other)]
    sizes = [np.array([len(bag) for bag in part]) for part in bags]
    common = _common(*bags)
    for i, member in enumerate(block):
        may = (bands[0][i] == bands[1]).any(1) & (roots[0][i] != roots[1]) & (common[i] > 0)
        if same:
            may[: i + 1] = False
        alike = common[i] / (sizes[0][i] + sizes[1] - common[i])
        done = set()
        for j in np.flatnonzero(may & ((alike >= similarity - 1e-12) | ~(once[0][i] & once[1]))):
            if other[j]["root"] not in done and probability_jaccard(member, other[j]) >= similarity - 1e-12:
                done.add(other[j]["root"])
                yield member["content"], other[j]["content"]


def _links_in_crowds(apart: DataFrame, bagged: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) that matter between members of large buckets, written.

    Members of overlapping buckets form a group, so that each pair is looked at once.
    A group is cut into blocks: those of its largest class, which need not be compared
    with each other, and those of all other members.
    """
    least = apart.groupBy("bucket").agg(F.min("content").alias("least"))
    near = apart.join(least, "bucket").select(F.col("content").alias("a"), F.col("least").alias("b")).distinct()
    groups = components(near).select(F.col("node").alias("content"), F.col("root").alias("crowd"))
    placed = settle(apart.select("content", "root").distinct().join(groups, "content"))
    largest = placed.groupBy("crowd", "root").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "root")).alias("top"))
    sided = placed.join(largest, "crowd").withColumn("side", (F.col("root") != F.col("top.root")).cast("int"))
    bulk = sided.join(bagged, "content").join(contents.select("content", "bands"), "content")
    weighed = sided.join(bagged.select("content", F.length("shingles").alias("size")), "content")
    parts = weighed.groupBy("crowd", "side").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_MEMBERS), F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("parts")
    )
    keyed = bulk.join(parts, ["crowd", "side"]).withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    member = F.struct("content", "root", "bands", "shingles", "counts")
    blocks = settle(keyed.groupBy("crowd", "side", "part").agg(F.collect_list(member).alias("members")))
    names = blocks.select("crowd", "side", "part")
    other = names.select("crowd", F.col("side").alias("side_b"), F.col("part").alias("part_b"))
    meet = names.filter("side = 1").join(other, "crowd").filter("side_b = 0 OR part_b >= part")
    left = blocks.withColumnRenamed("members", "block")
    right = blocks.select("crowd", F.col("side").alias("side_b"), F.col("part").alias("part_b"), F.col("members").alias("other"))
    both = meet.join(left, ["crowd", "side", "part"]).join(right, ["crowd", "side_b", "part_b"])
    both = both.select(((F.col("side_b") == 1) & (F.col("part") == F.col("part_b"))).alias("same"), "block", "other")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same, block, other = (batch.column(k)[i].as_py() for k in range(3))
                if same:
                    other = block
                links = list(_links_of_blocks(block, other, same, similarity))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return settle(both.mapInArrow(compare, "a binary, b binary"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, class_size, tie, root).

    ``class_id`` is the least doc_id of the class, ``class_size`` its number of rows,
    ``root`` the class itself (null for a text without words), ``tie`` the text's hash.
    Rows with the same words, in ASCII lower case, are copies; different contents are
    linked from ``similarity`` on. A text without words (null, empty, only punctuation)
    is alone. Rows that repeat a doc_id are judged each for itself; a class is named
    null only if all its ids are null.
    """
    sketched = sketches(docs, size)
    # One representative of each content; copies do not enter the buckets.
    contents = sketched.filter("content IS NOT NULL").groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("copies")
    )
    contents = settle(contents)
    banded = contents.select("content", F.posexplode("bands").alias("band", "hash")).select(
        "content", F.xxhash64("band", "hash").alias("bucket")
    )
    crowds = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("content").alias("leader")).filter("n > 1")
    members = settle(banded.join(crowds.select("bucket", "leader"), "bucket"))
    involved = settle(members.select("content").distinct().join(contents, "content"))
    bagged = settle(bags(_rows_of(docs, involved), size).join(involved.select("content"), "content", "left_semi").dropDuplicates(["content"]))

    # Every member against the least content of its bucket: a group of copies of one
    # another has the same least content in most of its buckets.
    pairs = members.filter("content <> leader").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct()
    judged = _verified(pairs, bagged)
    links = _linked(judged, similarity)
    # Then in full, where a bucket is still apart.
    apart = _apart(members.select("bucket", "content"), leaders(links))
    few = apart.filter(F.col("n") <= SMALL_BUCKET)
    others = few.select("bucket", F.col("content").alias("leader"), F.col("root").alias("leader_root"))
    met = few.join(others, "bucket").filter("root <> leader_root AND content < leader")
    judged = _judge_more(met.select("content", "leader"), judged, bagged)
    crowded = apart.filter(F.col("n") > SMALL_BUCKET)
    links = settle(_linked(judged, similarity).unionByName(_links_in_crowds(crowded, bagged, involved, similarity)).distinct())
    rooted = components(links)

    roots = rooted.select(F.col("node").alias("content"), "root")
    placed = contents.select("content", "doc_id", "copies").join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
    named = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    classed = placed.select("content", "root").join(named, "root")
    alone = F.col("content").isNull()
    return (
        sketched.select("doc_id", "tie", "content")
        .join(classed, "content", "left")
        .select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("class_size")).alias("class_size"),
            "tie",
            "root",
        )
    )


def _judge_more(met: DataFrame, judged: DataFrame, bagged: DataFrame) -> DataFrame:
    """``judged`` and the pairs of ``met`` that it lacks, written."""
    pairs = met.select(F.least("content", "leader").alias("a"), F.greatest("content", "leader").alias("b")).distinct()
    return judged.unionByName(_verified(pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), bagged))


def _linked(judged: DataFrame, similarity: float) -> DataFrame:
    return judged.filter(F.col("similarity") >= similarity - 1e-12).select("a", "b")


def _rows_of(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the doc_id of an involved content."""
    ids = involved.select(F.col("doc_id").alias("_id")).distinct()
    # Sorted and merged at any size: the ids grow with the documents and are not broadcast.
    return docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi")


def survivors(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the least (doc_id, text hash), nulls last.

    Rows without words all stay. Of rows that repeat the chosen one, one stays.
    """
    words = classes(docs, similarity).filter("root IS NOT NULL")
    rows = settle(words.groupBy("root", "doc_id", "tie").agg(F.count("*").alias("n")))
    # Least rows by aggregation and join: a class may hold any share of all rows.
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("tie").alias("hash"))
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    marked = rows.join(best, "root").withColumn("kept", (order == F.col("best")))
    repeated = settle(marked.filter("kept AND n > 1").select("doc_id", "tie"))
    gone = marked.filter("NOT kept").select("doc_id", "tie").unionByName(repeated)
    stay = without(docs, gone)
    if repeated.isEmpty():
        return stay
    key = [F.col("_row.doc_id").alias("_id"), row_tie(F.col("_row.text")).alias("_tie")]
    packed = docs.select(F.struct("*").alias("_row")).select("_row", *key)
    same = packed["_id"].eqNullSafe(repeated["doc_id"]) & (packed["_tie"] == repeated["tie"])
    once = packed.join(repeated, same, "left_semi").dropDuplicates(["_id", "_tie"]).select("_row.*")
    return stay.unionByName(once)
