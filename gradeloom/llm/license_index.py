"""License scans with a positional rare-token index, in DataFrame functions only.

A phrase is indexed under its rarest word, by document frequency in the corpus, with the
word's place in the phrase. Only files that hold such a word are looked into. There the
licence words and their positions are taken out; the places of a phrase are the positions of
its rarest word, moved back by its offset, at which every other word stands as well.

Templates are licence notices. Of each, the words with the highest IDF are indexed with
their positions. All licence words of a file vote for (template, offset of the template in the
file), each with its IDF. A template labels a file if the best offset
gathers enough of the template's IDF and each mandatory phrase stands at its place.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import WORD, lowered
from gradeloom.session import settle

RARE_WORDS = 12  # indexed words of a template
COVERAGE = 0.6

# Phrases with their labels, and licence notices with theirs; in brackets
# the phrases that are mandatory. All are words of the licences or their usual notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "agpl-3.0": "licensed under the [gnu affero general public license version 3]",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "bsd": "[redistribution and use in source and binary forms with or without modification] are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under [cc by 4 0]",
    "cc-by-nc-4.0": "licensed under [cc by nc 4 0]",
    "cc-by-nd-4.0": "licensed under [cc by nd 4 0]",
    "cc-by-sa-4.0": "licensed under [cc by sa 4 0]",
    "cc0-1.0": "released under [cc0 1 0]",
    "gpl-2.0": "licensed under the [gnu general public license version 2]",
    "gpl-3.0": "licensed under the [gnu general public license version 3]",
    "isc": "[permission to use copy modify and or distribute this software for any purpose with or without fee] is hereby granted",
    "lgpl": "licensed under the [gnu lesser general public license]",
    "mit": "released under the [mit license]",
    "mit-text": "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files",
    "mpl-2.0": "subject to the terms of the [mozilla public license] v 2 0",
    "unlicense": "this is [free and unencumbered software released into the public domain]",
}


@dataclass(frozen=True)
class Phrase:
    label: str
    template: bool
    words: tuple[str, ...]
    at: int  # position within the template


def phrases() -> list[Phrase]:
    out = [Phrase(label, False, tuple(text.split()), 0) for text, label in PHRASES.items()]
    for label, text in TEMPLATES.items():
        before = 0
        for number, part in enumerate(text.replace("]", "[").split("[")):
            words = tuple(part.split())
            if number % 2:
                out.append(Phrase(label, True, words, before))
            before += len(words)
    return out


def template_words() -> dict[str, list[str]]:
    return {label: text.replace("[", "").replace("]", "").split() for label, text in TEMPLATES.items()}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each licence word."""
    vocabulary = sorted({w for p in phrases() for w in p.words} | {w for ws in template_words().values() for w in ws})
    held = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # as large as the fixed values above


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null text is empty. ``score`` is the largest part of a template's IDF found in order, 0
    without any. Rows that repeat a doc_id are scanned each for itself; label lists are
    sorted and comma-joined, empty without labels.
    """
    spark = docs.sparkSession
    total, frequency = frequencies(docs)
    idf = {w: math.log((total + 1) / (n + 1)) for w, n in frequency.items()}
    indexed = list(enumerate(phrases()))
    rarest = {k: min(range(len(p.words)), key=lambda i, p=p: (frequency[p.words[i]], p.words[i], i)) for k, p in indexed}
    anchors = sorted({p.words[rarest[k]] for k, p in indexed})
    anchor_rows = [(k, rarest[k], p.words[rarest[k]]) for k, p in indexed]
    phrase_rows = [(k, i, w, len(p.words)) for k, p in indexed for i, w in enumerate(p.words)]
    rare_rows, weights = [], []
    for label, words in template_words().items():
        chosen = sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))[:RARE_WORDS]
        told = any(idf[words[i]] for i in chosen)  # not so if all stand in every row: then each counts the same
        shares = [idf[words[i]] if told else 1.0 for i in chosen]
        rare_rows += [(label, i, words[i], share) for i, share in zip(chosen, shares)]
        weights.append((label, sum(shares)))

    # One pass over the texts: positions of licence words, in files with a rare one.
    vocabulary = F.array(*map(F.lit, sorted(frequency)))
    located = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains(vocabulary, x["word"])
    )
    files = docs.select("doc_id", words_of(F.col("text")).alias("words")).select(
        F.monotonically_increasing_id().alias("file"),
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.when(F.arrays_overlap("words", F.array(*map(F.lit, anchors))), located).alias("located"),
    )
    files = settle(files)
    hits = files.filter("located IS NOT NULL").select("file", F.explode("located").alias("hit")).select("file", "hit.pos", "hit.word")
    hits = settle(hits)

    # Places of phrases: from the rarest word to all words.
    starts = hits.join(_table(spark, anchor_rows, "phrase int, offset int, word string"), "word")
    starts = starts.select("file", "phrase", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")
    listed = _table(spark, phrase_rows, "phrase int, offset int, word string, length int")
    expected = starts.join(listed, "phrase").select("file", "phrase", "start", "length", (F.col("start") + F.col("offset")).alias("pos"), "word")
    places = expected.join(hits, ["file", "pos", "word"]).groupBy("file", "phrase", "start").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    kinds = _table(spark, [(k, p.label, p.template, p.at) for k, p in indexed], "phrase int, label string, template boolean, at int")
    places = settle(places.filter("n = length").select("file", "phrase", "start").join(kinds, "phrase"))

    # Offsets of templates: votes of all licence words of a file.
    votes = hits.join(_table(spark, rare_rows, "label string, at int, word string, idf double"), "word")
    votes = votes.groupBy("file", "label", (F.col("pos") - F.col("at")).alias("offset")).agg(F.sum("idf").alias("vote"))
    cover = F.round(F.col("vote") / F.col("weight"), 6)
    aligned = votes.join(_table(spark, weights, "label string, weight double"), "label").withColumn("coverage", cover)
    enough = aligned.filter(F.col("coverage") >= COVERAGE).select("file", "label", "offset")
    mandatory = {label: sum(p.template and p.label == label for _, p in indexed) for label in TEMPLATES}
    proven = places.filter("template").select("file", "label", "phrase", (F.col("start") - F.col("at")).alias("offset"))
    proven = proven.groupBy("file", "label", "offset").agg(F.count_distinct("phrase").alias("found"))
    proven = proven.join(_table(spark, list(mandatory.items()), "label string, needed bigint"), "label").filter("found = needed")
    matched = enough.join(proven, ["file", "label", "offset"]).select("file", "label").distinct()

    base = places.filter("NOT template")
    summary = base.groupBy("file").agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base")
    )
    more = matched.groupBy("file").agg(F.collect_set("label").alias("more"))
    scores = aligned.groupBy("file").agg(F.least(F.max("coverage"), F.lit(1.0)).alias("score"))
    none = F.array().cast("array<string>")
    base_set, more_set = F.coalesce("base", none), F.coalesce("more", none)
    every = files.select("file", "doc_id", "n_words").join(summary, "file", "left").join(more, "file", "left").join(scores, "file", "left")
    return every.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, more_set)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
