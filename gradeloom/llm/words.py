"""Words of Arrow text columns as 64-bit hashes, without a Python loop over words.

A word is a run of ASCII letters, digits and non-ASCII characters. All bytes of
a non-ASCII character are 0x80 or above, so bytes can be classified alone.
"""

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 20  # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables():
    code = np.zeros(256, np.uint64)
    is_word = np.zeros(256, bool)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        code[b] = b
        is_word[b] = True
    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * is_word
    for b in range(0x41, 0x5B):  # A-Z count as a-z
        code[b], is_word[b] = code[b + 32], True
    return code, is_word


_CODE, _IS_WORD = _tables()
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, _BASE, np.uint64)])
_STEP = int(_POWERS[-1]) * _BASE % (1 << 64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more than texts); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the spans, which are sorted and do not overlap."""
    lengths = ends - starts
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = _CODE[raw[np.repeat(starts, lengths) + inside]]
    letters *= _POWERS[inside & 4095]
    if lengths.max() > 4096:
        high = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()) >> 12, _STEP, np.uint64)])
        letters *= high[inside >> 12]
    sums = np.add.reduceat(letters, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; no word crosses a text's border."""
    inner = at[1:-1]
    is_word = _IS_WORD[raw]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    cut = inner[(inner > 0) & (inner < len(raw))]
    begins[cut] = is_word[cut]
    ends[cut - 1] = is_word[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin."""
    return located_words(texts)[:2]


def located_words(texts: pa.Array):
    """As ``word_hashes``, and the bytes of all texts, and first byte and end of each word."""
    raw, at = buffers(texts)
    starts, ends = word_spans(raw, at)
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # in pieces, so that a long text needs no more memory than a short one
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _SEGMENT)))
        hashes[lo:hi] = _hash_spans(raw, starts[lo:hi], ends[lo:hi])
        lo = hi
    return hashes, np.searchsorted(starts, at), raw, starts, ends


def prefix_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` (up to 7) bytes of the words, and which words are longer than that."""
    longer = np.flatnonzero(ends - starts > size)
    code = np.full(len(longer), size, np.uint64)
    for k in range(size):
        code = code << np.uint64(8) | _LOWER[raw[starts[longer] + k]]
    return mix(code), longer


def parts(texts: pa.Array, size: int = 4 << 20):
    """Ranges of texts of about ``size`` bytes each; a longer text is a range of its own.

    Word tables are some twenty times as large as the text, so tasks make them for a part of a batch.
    """
    yield from slices(buffers(texts)[1], size)


def slices(pointers: np.ndarray, words: int):
    """Ranges of texts of about ``words`` words each; a longer text is a range of its own."""
    lo, n = 0, len(pointers) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(pointers, pointers[lo] + words, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def shingle_hashes(words: np.ndarray, pointers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and where each text's begin.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(pointers)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(int(n.sum()), np.uint64)
    begin = np.r_[0, np.cumsum(n)]
    first = np.repeat(pointers[:-1] - begin[:-1], n) + np.arange(len(out))
    width = np.repeat(np.minimum(counts, size), n)
    for k in range(size):
        has = width > k
        out[has] = mix(out[has] * np.uint64(_BASE) + words[first[has] + k])
    return out, begin
