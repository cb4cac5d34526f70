"""Token ids of documents in binary shards with a minimal perfect hash index.

A store is a folder of shards, in ascending order of (doc_id, text hash). A shard is
two files: the raw ids of its documents one after another, and an index.

    <name>.ids    ids, little-endian unsigned, 2 bytes each if every id of the
                  vocabulary fits, else 4 (the shard's row in the manifest says which)
    <name>.mph    header: magic, format, levels, keys, documents (unsigned 64-bit each)
                  levels: bits of each level, rounded up to 64
                  bits, 64 to a word, level after level
                  ranks: set bits before each word
                  by hash value: fingerprint (32 bit), first document (64 bit)
                  by document: first id within the shard (64 bit), one more at the end

The hash is a cascade of bit arrays: a key that is alone in its cell of a level is
placed there, the others go on to the next, smaller level. A key's value is the
number of set bits before its own, so n keys have the values 0..n-1, and a lookup
reads a few words whatever the size of the shard. Keys are not stored; a fingerprint
of 32 bits rejects all but one in 2**32 strangers.

The manifest, a table, has a row for each shard. Files carry unique names and are
listed only after they are complete, so a task that is repeated does no harm.
"""

import json
import os
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import row_tie, worker_cache
from gradeloom.llm.words import mix
from gradeloom.session import settle, shared_dir

MAGIC, FORMAT = 0x4B4F54444F4F4C47, 1
GAMMA = 2  # cells for each key of a level
READ_BYTES = 4 << 20  # neighbouring documents are read together up to this size
GROUP = 512  # texts, or new words, encoded at a time
MEMO = 1_000_000  # words whose ids a Python worker remembers

MANIFEST_SCHEMA = (
    "shard int, name string, low bigint, high bigint, n_docs bigint, n_null bigint, n_keys bigint, n_ids bigint, id_bytes int"
)


# --- the index ---------------------------------------------------------------------


def _cell(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    return (mix(keys.view(np.uint64) ^ seed) % np.uint64(bits)).astype(np.int64)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype("<u4")


def build_levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each level, words of all levels) for distinct 64-bit keys."""
    sizes, words = [], []
    while len(keys):
        bits = -(-GAMMA * len(keys) // 64) * 64
        cell = _cell(keys, len(sizes), bits)
        alone = np.bincount(cell, minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(bits)
        keys = keys[~alone[cell]]
    return np.array(sizes, "<u8"), np.concatenate(words) if words else np.zeros(0, "<u8")


@dataclass
class Index:
    """The index of one shard, in memory or mapped from its file."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    fingerprints: np.ndarray
    first: np.ndarray
    starts: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, first: np.ndarray, starts: np.ndarray) -> "Index":
        """``keys`` are distinct; ``first`` is the document each leads to."""
        sizes, words = build_levels(keys)
        counts = np.bitwise_count(words).astype("<u8")
        index = Index(sizes, words, np.cumsum(counts) - counts, np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), starts.astype("<u8"))
        value = index.values(keys)
        index.fingerprints[value] = _fingerprints(keys)
        index.first[value] = first
        return index

    def values(self, keys: np.ndarray) -> np.ndarray:
        """The hash value of each key; -1 for keys that are in no level."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            cell = _cell(keys[left], level, bits)
            word, bit = base + (cell >> 6), (cell & 63).astype(np.uint64)
            inside = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[inside]] = (self.ranks[word] + np.bitwise_count(below))[inside]
            left, base = left[~inside], base + (bits >> 6)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 where the fingerprint says that it is not here."""
        value = self.values(keys)
        if not len(self.first):
            return value
        known = (value >= 0) & (self.fingerprints[value] == _fingerprints(keys))
        return np.where(known, self.first[value].astype(np.int64), -1)

    def dump(self) -> bytes:
        head = np.array([MAGIC, FORMAT, len(self.sizes), len(self.first), len(self.starts) - 1], "<u8")
        parts = (head, self.sizes, self.words, self.ranks, self.fingerprints, self.first, self.starts)
        return b"".join(p.astype(p.dtype.newbyteorder("<")).tobytes() for p in parts)

    @staticmethod
    def load(data: bytes) -> "Index":
        magic, form, levels, keys, docs = np.frombuffer(data, "<u8", 5).tolist()
        if (magic, form) != (MAGIC, FORMAT):
            raise ValueError("not a token index")
        at, out = 40, []
        sizes = np.frombuffer(data, "<u8", levels, at)
        n = int(sizes.sum()) >> 6
        at += 8 * levels
        for kind, count in (("<u8", n), ("<u8", n), ("<u4", keys), ("<u8", keys), ("<u8", docs + 1)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        return Index(sizes, *out)


# --- ids ---------------------------------------------------------------------------


# The normalizer and the pre-tokenizer of the tokenizer files whose texts can be
# cut into words here, and the same words as a pattern for lower-case text in Latin-1.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, NUMBERS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"


class Encoder:
    """Ids of texts by a tokenizers file; words that come again are looked up.

    Where the file's rules are those above, a text in Latin-1 without special tokens is cut
    into words here, and a word has the same ids wherever it stands. Any other text, or
    one for any other file, goes to the tokenizer whole.
    """

    def __init__(self, rules: str, end_id: int):
        """``rules`` is the content of the file."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(rules)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()
        self.memo: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = (rules.get("normalizer") or {}).get("normalizers") == NORMALIZER and splits[0].get("pattern") == {"Regex": SPLIT}
        self.cut = re.compile(LATIN_WORD).findall if known and splits[0].get("behavior") == "Removed" else None
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content[:2] for t in added.values()]
        # A special token is found before all else, so it parts words that are encoded in one go.
        self.border_id, self.border = next(((i, t.content) for i, t in added.items() if t.special and not t.normalized), (None, None))

    def _words(self, text: str) -> list[str] | None:
        """The words of a text, None if it has to be encoded whole."""
        if self.cut is None or any(s in text for s in self.special):
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return self.cut(text.lower())

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._words(t or "") for t in texts]
        words = set().union(*(ws for ws in cut if ws))
        memo = self.memo
        if len(memo) > MEMO:  # what stands here as well is frequent
            memo = self.memo = {w: memo[w] for w in words if w in memo}
        new = list(words.difference(memo))
        for lo in range(0, len(new), GROUP):
            memo.update(zip(new[lo : lo + GROUP], self._encode_words(new[lo : lo + GROUP])))
        here = dict(zip(words, map(memo.__getitem__, words)))  # small enough to stay near the processor
        for word in new:
            if len(word) > 64:  # rarely seen again
                del memo[word]
        whole = iter(self._encode([t or "" for t, ws in zip(texts, cut) if ws is None]))
        return [(next(whole) if ws is None else b"".join(map(here.__getitem__, ws))) + self.end for ws in cut]

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of some words, which hold no special token."""
        if self.border is None:
            return self._encode(words)
        ids = np.frombuffer(self._encode([self.border.join(words)])[0], self.kind)
        width, payload = ids.itemsize, ids.tobytes()
        borders = (np.flatnonzero(ids == self.border_id) * width).tolist()
        return [payload[a:b] for a, b in zip([0, *(b + width for b in borders)], [*borders, len(payload)])]


def shipped(spark: SparkSession, path: str):
    """The content of a tokenizer file that the driver reads, for all executors; a few megabytes, whatever the input."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(rules: str, end_id: int) -> Encoder:
    """The encoder of this Python worker, kept with what it has looked up from task to task."""
    kept, key = worker_cache(), (zlib.crc32(rules.encode()), end_id)
    if key not in kept:
        kept[key] = Encoder(rules, end_id)
    return kept[key]


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark would take it for, so that tasks open the same place.

    A folder that tasks cannot open is refused here, before the job.
    """
    place, named = spark._jvm.org.apache.hadoop.fs.Path(folder), folder
    try:
        if not re.match(r"s3[an]?://", folder):
            named = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
        _open(named)
    except Exception as error:
        raise ValueError(f"tasks cannot open a token store in {named}: {error}") from error
    return named


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by URI; s3a and s3n are Hadoop's names of S3."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(_uri(path))


def _uri(path: str) -> str:
    return re.sub(r"^s3[an]://", "s3://", path)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the store of documents(doc_id, text); returns its folder and its manifest.

    Null text is empty and has the end id alone. Rows that repeat a doc_id are all
    stored, next to each other and in the order of their text hashes; a null doc_id comes
    first and has no key.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}")
    rules = shipped(spark, tokenizer)

    def shards(batches):
        from pyspark import TaskContext

        store, root = _open(folder)
        store.create_dir(root)
        encode, out, name = None, None, uuid.uuid4().hex
        ids, sizes = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode = encoder(rules.value, end_id)
                out = store.open_output_stream(f"{root}/{name}.ids")
            for lo in range(0, batch.num_rows, GROUP):
                payload = encode(batch.column(1)[lo : lo + GROUP].to_pylist())
                out.write(b"".join(payload))
                sizes.extend(len(p) for p in payload)
            ids.append(batch.column(0))
        if encode is None:
            return
        out.close()
        width = np.dtype(encode.kind).itemsize
        ids = pa.concat_arrays(ids)
        n_null = ids.null_count  # nulls come first
        keys = ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        starts = np.r_[0, np.cumsum(np.array(sizes) // width)]
        index = Index.build(keys[first], first + n_null, starts)
        with store.open_output_stream(f"{root}/{name}.mph") as file:
            file.write(index.dump())
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        row = [TaskContext.get().partitionId(), name, low, high, len(ids), n_null, len(first), int(starts[-1]), width]
        names = ["shard", "name", "low", "high", "n_docs", "n_null", "n_keys", "n_ids", "id_bytes"]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    # The last part of the order tells rows apart that are the same, so that even a
    # doc_id with a third of all rows is dealt out to many shards.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumn("tie", row_tie(F.col("text"))).withColumn("n", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "tie", "n").sortWithinPartitions("doc_id", "tie", "n")
    manifest = ordered.select("doc_id", "text").mapInArrow(shards, MANIFEST_SCHEMA)
    return folder, settle(manifest)


def _based(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each shard; it has a row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def _payloads(file, docs: np.ndarray, starts: np.ndarray, width: int):
    """The ids of ``docs``, which ascend; neighbours in the file are read at once."""
    lo = 0
    while lo < len(docs):
        hi = lo + 1
        while hi < len(docs) and docs[hi] - docs[hi - 1] <= 1 and (starts[docs[hi] + 1] - starts[docs[lo]]) * width <= READ_BYTES:
            hi += 1
        begin = starts[docs[lo]]
        file.seek(int(begin) * width)
        ids = np.frombuffer(file.read(int(starts[docs[hi - 1] + 1] - begin) * width), f"<u{width}")
        for d in docs[lo:hi]:
            yield ids[starts[d] - begin : starts[d + 1] - begin]
        lo = hi


def lookup(folder: str, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of ``keys``(doc_id), by way of the index: (doc_id, start, n_tokens, ids_crc32, shard).

    Each distinct key is sent to the shards whose range holds it, nulls to those with
    null ids. Unknown keys give no row; a key of several documents gives one row for each.
    """
    # Ranges of neighbouring shards touch in at most one key. Route by the last shard
    # that begins at or below the key, and on to earlier ones while they end with it.
    routes = [tuple(r) for r in _based(manifest).select("shard", "name", "low", "high", "n_null", "base", "id_bytes").orderBy("shard").toLocalIterator()]
    # One row for each shard, a few hundred bytes for each gigabyte of text.
    spark = manifest.sparkSession
    table = spark.sparkContext.broadcast(routes)

    def route(batches):
        keyed = [r for r in table.value if r[2] is not None]
        low, high = np.array([r[2] for r in keyed], np.int64), np.array([r[3] for r in keyed], np.int64)
        shard = np.array([r[0] for r in keyed], np.int32)
        null_shards = [r[0] for r in table.value if r[4]]
        for batch in batches:
            key = batch.column(0)
            known = key.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first, stop = np.searchsorted(high, known, side="left"), np.searchsorted(low, known, side="right")
            n = np.maximum(stop - first, 0)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(known, n)), pa.array(shard[at])], names=["doc_id", "shard"])
            if key.null_count and null_shards:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(null_shards), pa.int64()), pa.array(null_shards, pa.int32())], names=["doc_id", "shard"])

    def read(batches):
        store, root = _open(folder)
        rows = {r[0]: r for r in table.value}
        for batch in batches:
            shards = batch.column(1).to_numpy()
            order = np.argsort(shards, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else []:
                shard, name, _, _, n_null, base, width = rows[int(shards[part[0]])]
                with store.open_input_file(f"{root}/{name}.mph") as file:
                    index = Index.load(file.read())
                key = batch.column(0).take(pa.array(part))
                known = key.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                first = index.find(known)
                # A key's documents reach to the next key's first document.
                bounds = np.sort(np.r_[index.first.astype(np.int64), len(index.starts) - 1])
                known, first = known[first >= 0], first[first >= 0]
                n = bounds[np.searchsorted(bounds, first, side="right")] - first if len(first) else first
                doc = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids = pa.array(np.repeat(known, n), pa.int64())
                if key.null_count:
                    doc, ids = np.r_[np.arange(n_null), doc], pa.concat_arrays([pa.nulls(n_null, pa.int64()), ids])
                starts = index.starts.astype(np.int64)
                crc = np.zeros(len(doc), np.int64)
                with store.open_input_file(f"{root}/{name}.ids") as file:
                    for k, payload in zip(np.argsort(doc, kind="stable"), _payloads(file, np.sort(doc), starts, width)):
                        crc[k] = zlib.crc32(payload.astype("<u4"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts[doc] + base), pa.array(starts[doc + 1] - starts[doc]), pa.array(crc), pa.array(np.full(len(doc), shard, np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    keys = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    routed = keys.mapInArrow(route, "doc_id bigint, shard int").repartition("shard").sortWithinPartitions("shard", "doc_id")
    return routed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")


class TokenStore:
    """Keyed access from one process: ``store[doc_id]`` is the list of the id arrays of its documents."""

    def __init__(self, spark: SparkSession, folder: str, manifest: DataFrame):
        self.files, self.root = _open(folder)
        self.shards = [tuple(r) for r in manifest.orderBy("shard").select("name", "low", "high", "id_bytes").toLocalIterator()]

    def __getitem__(self, key: int) -> list[np.ndarray]:
        out = []
        for name, low, high, width in self.shards:
            if low is None or not low <= key <= high:
                continue
            with self.files.open_input_file(f"{self.root}/{name}.mph") as file:
                index = Index.load(file.read())
            doc = int(index.find(np.array([key], np.int64))[0])
            if doc < 0:
                continue
            stop = int(min([x for x in index.first.tolist() if x > doc], default=len(index.starts) - 1))
            with self.files.open_input_file(f"{self.root}/{name}.ids") as file:
                for d in range(doc, stop):
                    file.seek(int(index.starts[d]) * width)
                    out.append(np.frombuffer(file.read(int(index.starts[d + 1] - index.starts[d]) * width), f"<u{width}"))
        return out
