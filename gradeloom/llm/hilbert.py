"""Nearest neighbours by shifted Hilbert curves.

Vectors are projected at random onto a few axes, shifted, and ordered along a Hilbert
curve, several times with other axes and shifts. Spark sorts each ordering by range, and
each query looks at the keys around its own; windows of all orderings are merged and
reranked with the exact inner product.

A curve alone finds neighbours in data with structure. So that nothing is lost in data
without it, the search then goes on: the first ordering is kept in blocks with their
centre and radius, and a block is opened for those queries for which its bound still
allows a vector nearer than the worst found in the windows. Blocks and queries meet in
Spark, in units of a group of blocks and a part of the queries, both of bounded size. The
result is exact; how much is opened depends on how well the windows and the bounds are.

Vectors of different dimensions have no inner product; each dimension has orderings and
blocks of its own, in the same jobs.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gradeloom.llm.common import hashed_sample
from gradeloom.session import settle

AXES, BITS = 8, 7  # a key has AXES * BITS bits
CURVES = 4
BLOCK = 2048  # vectors; a window is a query's block and the one on either side
SAMPLE = 10_000  # vectors from which the spread of the projections is measured
GROUP = 16  # blocks that a task holds while queries pass
CHUNK = 4096  # blocks whose bounds a task holds while queries pass, on average
QUERY_PART = 65_536  # queries that pass the same blocks in one task, on average
SLICE = 2048  # queries that are held against a block at once


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with integer coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations of all coarser cells
        low = bit - 1
        for a in range(axes):
            flip = (x[a] & bit) > 0
            swap = np.where(flip, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[a] ^= swap
        bit >>= 1
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            key = key << 1 | (x[a] >> b & 1)
    return key


@dataclass
class Curve:
    """One ordering: axes (dimension x AXES), and the corner and width of the grid."""

    axes: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            cells = np.nan_to_num(np.floor((vectors.astype(float) @ self.axes - self.low) / self.width * (1 << BITS)))
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def axes_of(dimension: int, number: int) -> np.ndarray:
    """Random orthogonal axes of an ordering; the same wherever they are made."""
    rng = np.random.default_rng([dimension, number])
    axes = np.linalg.qr(rng.standard_normal((dimension, AXES)))[0]
    return np.pad(axes, ((0, 0), (0, AXES - axes.shape[1])))


def grids(sample: np.ndarray, dimension: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Corner and width of each ordering's grid: three deviations around the mean of
    ``sample``, shifted by up to one."""
    out = []
    for number in range(CURVES):
        with np.errstate(over="ignore", invalid="ignore"):
            seen = sample @ axes_of(dimension, number)
            spread = np.clip(np.nan_to_num(seen.std(0), nan=1.0), 1e-12, 1e300)
            middle = np.nan_to_num(seen.mean(0))
        shift = np.random.default_rng([dimension, number, 1]).uniform(0, 1, AXES)
        out.append((middle - (3 + shift) * spread, 7 * spread))
    return out


def orderings_of(vectors: DataFrame) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The grids of every dimension in a sample of SAMPLE rows; others fall back to a unit grid."""
    rows: dict[int, list] = {}
    for d, v in hashed_sample(vectors, SAMPLE, "vec_id").select("d", "v").collect():
        rows.setdefault(d, []).append(v)
    return {d: grids(np.array(v, float), d) for d, v in rows.items()}


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def clean(vectors: DataFrame) -> DataFrame:
    """The written (vec_id, d, v): usable vectors with their dimension, floats as floats and any
    other number as double; of rows that repeat a vec_id the least vector. Rows without vec_id take no part."""
    given = vectors.schema["embedding"].dataType
    floats = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    v = F.col("embedding").cast("array<float>" if floats else "array<double>")
    fit = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("d"), v.alias("v"))
    fit = settle(fit.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    repeated = settle(fit.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"))
    if repeated.isEmpty():
        return fit
    least = fit.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    least = least.select("vec_id", F.size("v").alias("d"), "v")
    return settle(fit.join(repeated, "vec_id", "left_anti").unionByName(least))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of matching rows in double precision, summed in the order of the components."""
    out = np.zeros(len(queries))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(queries.shape[1]):
            out += queries[:, k].astype(float) * vectors[:, k].astype(float)
    return out


def lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors.astype(float) ** 2).sum(1))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first entries of each query: largest score, then smallest id; no id twice."""
    order = np.lexsort((ids, -score, query))
    q, i = query[order], ids[order]
    fresh = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if len(q) else np.zeros(0, bool)
    order = order[fresh]
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def nearest(query_ids, queries, ids, vectors, k, floor=None):
    """(position of query, position of vector, score) of each query's ``k`` nearest other rows,
    and those of at least ``floor``, if given. A first screening by matrix product leaves a
    margin far above its rounding errors; what overflows there passes."""
    if floor is None:
        floor = np.full(len(queries), -np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        product = queries.astype(float) @ vectors.astype(float).T
        if len(ids) > k + 1:  # one of them may be the query itself
            floor = np.fmax(floor, np.partition(product, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
        least = floor - 1e-9 * lengths(queries) * lengths(vectors).max(initial=0)
        least[~(np.isfinite(least) & np.isfinite(product).all(1))] = -np.inf
    q, v = np.nonzero(~(product < least[:, None]))
    other = query_ids[q] != ids[v]
    q, v = q[other], v[other]
    score = scores(queries[q], vectors[v])
    top = best(q, ids[v], score, k)
    return q[top], v[top], score[top]


def _blocks(batches):
    """The sorted rows of a partition, BLOCK at a time and never of two orderings: (ordering, ids, vectors)."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def joined():
        return held[0][0], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        ordering, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ordering)) + 1), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0][0] != ordering[a]:
                yield joined()
                held = []
            held.append((int(ordering[a]), ids[a:b], _matrix(batch.column(2).slice(a, b - a))))
            while sum(len(h[1]) for h in held) >= BLOCK:
                o, i, v = joined()
                yield o, i[:BLOCK], v[:BLOCK]
                held = [(o, i[BLOCK:], v[BLOCK:])] if len(i) > BLOCK else []
    if held:
        yield joined()


def _pairs(query, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


PAIRS = "query_id bigint, vec_id bigint, score double"


def _ordered(vectors: DataFrame, orderings: dict, count: int = CURVES) -> DataFrame:
    """(ordering, vec_id, v) of the first ``count`` orderings of each dimension, sorted by key within
    range partitions; ``ordering`` is dimension * CURVES + number."""

    def keyed(batches):
        made: dict[int, list[Curve]] = {}
        for batch in batches:
            dimensions = batch.column(1).to_numpy()
            for d in np.unique(dimensions).tolist():
                part = batch.take(pa.array(np.flatnonzero(dimensions == d)))
                matrix = _matrix(part.column(2))
                if d not in made:
                    grid = orderings.get(d) or [(np.full(AXES, -3.5), np.full(AXES, 7.0))] * CURVES
                    made[d] = [Curve(axes_of(d, n), *grid[n]) for n in range(count)]
                for number, curve in enumerate(made[d]):
                    name = np.full(len(matrix), d * CURVES + number, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name), pa.array(curve.keys(matrix)), part.column(0), part.column(2)],
                        names=["ordering", "key", "vec_id", "v"],
                    )

    kind = vectors.schema["v"].dataType.simpleString()
    rows = vectors.select("vec_id", "d", "v").mapInArrow(keyed, f"ordering bigint, key bigint, vec_id bigint, v {kind}")
    place = ["ordering", "key", "vec_id"]
    return rows.repartitionByRange(*place).sortWithinPartitions(*place).select("ordering", "vec_id", "v")


def window_search(vectors: DataFrame, orderings: dict, every: int, k: int) -> DataFrame:
    """The written (query_id, vec_id, score): the ``k`` nearest in the merged windows of all orderings."""

    def search(batches):
        last: list[tuple[int, np.ndarray, np.ndarray]] = []

        def around(middle, blocks):
            ordering, ids, vecs = middle
            mine = ids % every == 0
            if mine.any():
                near = [b for b in blocks if b[0] == ordering]
                all_ids, all_vecs = np.concatenate([b[1] for b in near]), np.concatenate([b[2] for b in near])
                q, v, score = nearest(ids[mine], vecs[mine], all_ids, all_vecs, k)
                yield _pairs(ids[mine][q], all_ids[v], score)

        for block in _blocks(batches):
            last = [*last[-2:], block]
            if len(last) > 1:
                yield from around(last[-2], last)
        if last:
            yield from around(last[-1], last[-2:])

    found = _ordered(vectors, orderings).mapInArrow(search, PAIRS)
    return settle(_top(found, k).select("query_id", "vec_id", "score"))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each query, with their rank. A query has at most ``k`` rows from each task.
    A score that overflows to no number counts as the least."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks_of(vectors: DataFrame, orderings: dict) -> DataFrame:
    """The written blocks of the first orderings: group, dimension, ids, vectors, centre and radius.

    A group is up to GROUP blocks of one dimension that follow one another.
    """

    def pack(batches):
        group, size, before = TaskContext.get().partitionId() << 32, 0, None
        for ordering, ids, vecs in _blocks(batches):
            if size == GROUP or before not in (None, ordering):
                group, size = group + 1, 0
            size, before = size + 1, ordering
            wide = vecs.astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                centre = np.nan_to_num(wide.mean(0))
                radius = float(lengths(wide - centre).max())
            cells = [pa.array([group]), pa.array([ordering // CURVES], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary())]
            cells += [pa.array([vecs.tobytes()], pa.binary()), pa.array([centre]), pa.array([radius])]
            yield pa.RecordBatch.from_arrays(cells, names=["grp", "d", "ids", "vectors", "centre", "radius"])

    schema = "grp bigint, d int, ids binary, vectors binary, centre array<double>, radius double"
    packed = _ordered(vectors, orderings, 1).mapInArrow(pack, schema)
    return settle(packed, **{"parquet.block.size": 8 << 20})


def _meet(batches, meet):
    """Rows sorted by (a, b, kind): those of kind 0 are held for their (a, b), then ``meet(held,
    batch)`` gives the results of each batch of kind 1. Nothing meets rows of another (a, b)."""
    key, held = None, []
    for batch in batches:
        a, b, kind = (batch.column(c).to_numpy() for c in range(3))
        change = (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(kind) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if key != (a[i], b[i]):
                key, held = (a[i], b[i]), []
            if kind[i] == 0:
                held.append(batch.slice(i, j - i))
            elif held:
                for start in range(i, j, SLICE):
                    yield from meet(held, batch.slice(start, min(SLICE, j - start)))


def _reach(queries: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """No vector of the block has a larger inner product; a slack far above rounding errors is in it."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = lengths(queries)
        return queries @ centre + size * radius + 1e-9 * size * (np.sqrt((centre**2).sum()) + radius)


def opened(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """The written (grp, part, vec_id, d, v, floor): each query, once for every group with a block whose
    bound allows a hit. Bounds are dealt into chunks, queries into parts."""
    chunks = -(-packed.count() // CHUNK) or 1
    parts = -(-queries.count() // QUERY_PART) or 1
    every_chunk, every_part = F.sequence(F.lit(0), F.lit(chunks - 1)), F.sequence(F.lit(0), F.lit(parts - 1))
    bounds = packed.select(
        F.pmod(F.xxhash64("grp"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(every_part).alias("part"), F.lit(0).alias("kind"),
        "d", F.col("grp").alias("name"), F.col("centre").alias("v"), F.col("radius").alias("number"),
    )
    asking = queries.select(
        F.explode(every_chunk).alias("chunk"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        "d", F.col("vec_id").alias("name"), F.col("v").cast("array<double>").alias("v"), F.col("floor").alias("number"),
    )

    def open_(held, batch):
        dimensions = batch.column(3).to_numpy()
        for d in np.unique(dimensions).tolist():
            mine = batch.take(pa.array(np.flatnonzero(dimensions == d)))
            vectors, floor = _matrix(mine.column(5)), mine.column(6).to_numpy()
            hits: dict[int, np.ndarray] = {}
            for bound in held:
                for at in np.flatnonzero(bound.column(3).to_numpy() == d).tolist():
                    centre = bound.column(5)[at].values.to_numpy()
                    allowed = ~(_reach(vectors, centre, bound.column(6)[at].as_py()) < floor)
                    group = bound.column(4)[at].as_py()
                    hits[group] = hits[group] | allowed if group in hits else allowed
            for group, allowed in hits.items():
                if allowed.any():
                    rows = mine.take(pa.array(np.flatnonzero(allowed)))
                    name = pa.array(np.full(rows.num_rows, group, np.int64))
                    yield pa.RecordBatch.from_arrays([name, *(rows.column(c) for c in (1, 4, 3, 5, 6))], names=["grp", "part", "vec_id", "d", "v", "floor"])

    rows = bounds.unionByName(asking).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind")
    schema = "grp bigint, part int, vec_id bigint, d int, v array<double>, floor double"
    return settle(rows.mapInArrow(lambda batches: _meet(batches, open_), schema))


def widened(vectors: DataFrame, found: DataFrame, orderings: dict, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): what blocks hold for queries that may find something nearer there."""
    worst = found.groupBy("query_id").agg(F.min(F.nanvl("score", F.lit(float("-inf")))).alias("worst"), F.count("*").alias("n"))
    queries = vectors.filter(F.col("vec_id") % every == 0).join(worst, F.col("vec_id") == F.col("query_id"), "left")
    floor = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("-inf")))
    packed = blocks_of(vectors, orderings)
    asking = opened(packed, settle(queries.select("vec_id", "d", "v", floor.alias("floor"))))
    dtype = "<f4" if vectors.schema["v"].dataType.elementType == FloatType() else "<f8"

    def compare(held, batch):
        ids, queries, floor = batch.column(3).to_numpy(), _matrix(batch.column(5)), batch.column(6).to_numpy()
        q, own, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for blocks in held:
            for at in range(blocks.num_rows):
                allowed = ~(_reach(queries, blocks.column(5)[at].values.to_numpy(), blocks.column(6)[at].as_py()) < floor)
                near = np.flatnonzero(allowed)
                if not len(near):
                    continue
                block_ids = np.frombuffer(blocks.column(7)[at].as_py(), "<i8")
                block = np.frombuffer(blocks.column(8)[at].as_py(), dtype).reshape(len(block_ids), -1)
                a, b, s = nearest(ids[near], queries[near], block_ids, block, k, floor[near])
                q, own, score = np.r_[q, near[a]], np.r_[own, block_ids[b]], np.r_[score, s]
                top = best(q, own, score, k)
                q, own, score = q[top], own[top], score[top]
        yield _pairs(ids[q], own, score)

    wanted = asking.select("grp", "part").distinct()
    blocks = packed.join(wanted, "grp").select(
        "grp", "part", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("vec_id"), "d",
        F.col("centre").alias("v"), F.col("radius").alias("number"), "ids", "vectors",
    )
    nothing = F.lit(None).cast("binary")
    asked = asking.select("grp", "part", F.lit(1).alias("kind"), "vec_id", "d", "v", F.col("floor").alias("number"), nothing.alias("ids"), nothing.alias("vectors"))
    rows = blocks.unionByName(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    return settle(rows.mapInArrow(lambda batches: _meet(batches, compare), PAIRS))


def search(vectors: DataFrame, every: int = 20, k: int = 20, exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows, by inner product, of every row
    of vectors(vec_id, embedding) whose id is divisible by ``every``; all, if there are fewer.

    Ties go to the smaller vec_id. Candidates are the vectors of the query's dimension. Vectors that
    are null, zero or not finite take no part; an id that comes more than once stands for its least
    vector. With ``exact`` false the windows alone answer.
    """
    vectors = clean(vectors)
    orderings = orderings_of(vectors)
    found = window_search(vectors, orderings, every, k)
    if exact and orderings:
        found = found.unionByName(widened(vectors, found, orderings, every, k))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
