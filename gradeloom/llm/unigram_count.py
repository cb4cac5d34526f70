"""Token counts of a unigram tokenizer, without tokens.

The tokenizer: white space other than blanks is ordinary text, a blank is put before a text
that has none there, and every blank becomes a lower one eighth block. A text is cut before
a blank that follows another character; so runs of blanks stay whole and may match entries
of several blanks. Within a piece the best segmentation has the largest
sum of scores. An Aho-Corasick automaton finds all entries of the vocabulary in a
piece; dynamic programming over their ends carries only the best score and the number of
tokens. The rules that decide ties are those of the tokenizers library: ends in ascending
order, starts in ascending order, and a later candidate wins only with a larger score;
a character that is no entry may stand alone at the lowest score less ten, and counts one
token for each of its bytes.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import worker_cache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
PIECE = re.compile(" *[^ ]+| +")
MEMO, MEMO_LENGTH = 250_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Entries with their scores. Byte entries, such as <0x0A>, are no text and stay out."""

    entries: dict[str, float]

    @property
    def unknown(self) -> float:
        return min(self.entries.values(), default=0.0) - UNKNOWN_PENALTY


def from_pieces(path: str) -> Vocabulary:
    """The text pieces of a sentencepiece file, scored by Zipf's law: minus the logarithm of the rank.

    The file's own scores are ranks of merges, not log probabilities; nothing is trained.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary({piece: -math.log(rank) for rank, piece in enumerate(pieces, 2)})


class Counter:
    """Counts tokens of texts; short pieces that come again are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, score in vocabulary.entries.items():
            self.automaton.add_word(entry, (len(entry), score))
        if vocabulary.entries:
            self.automaton.make_automaton()
        self.empty = not vocabulary.entries
        self.longest = max(map(len, vocabulary.entries), default=1)
        self.unknown = vocabulary.unknown
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece; only as many places are kept as the longest entry has characters."""
        ring = self.longest + 1
        score, tokens = [0.0] * ring, [0] * ring
        matches = iter(()) if self.empty else self.automaton.iter(text)
        at, entry = next(matches, (-1, None))
        for last in range(len(text)):
            # The automaton reports longer entries, so smaller starts, first.
            best, count, single = -math.inf, 0, False
            while at == last:
                length, value = entry
                start = (last + 1 - length) % ring
                candidate = score[start] + value
                if candidate > best:
                    best, count = candidate, tokens[start] + 1
                single = single or length == 1
                at, entry = next(matches, (-1, None))
            if not single:
                candidate = score[last % ring] + self.unknown
                if candidate > best:
                    best, count = candidate, tokens[last % ring] + len(text[last].encode("utf-8", "surrogatepass"))
            score[(last + 1) % ring], tokens[(last + 1) % ring] = best, count
        return tokens[len(text) % ring]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        blanks = text.replace(MARK, " ")
        recent, total = self.recent, 0
        for found in PIECE.finditer(blanks if blanks[0] == " " else " " + blanks):
            piece = found.group()
            n = recent.get(piece)
            if n is None:
                n = self.older.get(piece)
                if n is None:
                    n = self.piece(piece.replace(" ", MARK))
                if len(piece) <= MEMO_LENGTH:
                    recent[piece] = n
            total += n
        if len(recent) >= MEMO:  # what is used again moves up from the older half
            self.older, self.recent = recent, {}
        return total


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Tokens of a text; null and empty have none."""
    entries = tuple(vocabulary.entries.items())
    name = ("unigram", hash(entries))

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = worker_cache()
        if name not in kept:
            kept[name] = Counter(Vocabulary(dict(entries)))
        counter = kept[name]
        for texts in batches:
            yield pa.array([counter.count(text) for text in texts.to_pylist()], pa.int64())

    return count(text)


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, n_chars): one row for each row of documents(doc_id, text)."""
    length = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    return docs.select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens"), length.alias("n_chars"))
