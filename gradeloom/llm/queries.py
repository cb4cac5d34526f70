"""One query for each operator, over its whole table with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from gradeloom.llm import (
    decontaminate,
    hilbert,
    language_crf,
    license_index,
    link_graph,
    mixing,
    oracles,
    periodic_runs,
    prob_minhash,
    token_alignment,
    token_store,
    toxicity,
    unigram_count,
    vector_packing,
)
from gradeloom.llm.common import table
from gradeloom.llm.registry import query

END_ID = 2


@query("op6_positional_decontamination", oracles.DECONTAMINATION)
def op6(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_prob_minhash")
def op9(spark, sf_dir):
    return prob_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query("op7_classifier_chain")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


@query("op1_token_store")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder, manifest = token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_store.lookup(folder, manifest, docs).drop("shard")


@query("op3_poisson_mixing", oracles.MIXING)
def op3(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("_row.*", "copy", "place")


@query("op2_link_graph_filter", oracles.LINK_GRAPH)
def op2(spark, sf_dir):
    found = link_graph.judged(table(spark, sf_dir, "pages"), oracles.URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op8_license_index", oracles.LICENSES)
def op8(spark, sf_dir):
    return license_index.scanned(table(spark, sf_dir, "documents"))


@query("op4_hilbert_neighbours", oracles.NEIGHBOURS)
def op4(spark, sf_dir):
    return hilbert.search(table(spark, sf_dir, "embeddings"))


@query("op10_unigram_count")
def op10(spark, sf_dir):
    vocabulary = unigram_count.from_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram_count.counted(table(spark, sf_dir, "documents"), vocabulary)


@query("op5_language_crf")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_crf.judged(docs, language_crf.learned(docs))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = periodic_runs.with_planted(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.found(docs))


@query("op12_vector_packing")
def op12(spark, sf_dir):
    return vector_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


@query("op13_token_alignment")
def op13(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    found = token_alignment.aligned(table(spark, sf_dir, "documents"), a, b, keep=digest)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select(*names, F.col("groups").alias("groups_sha256"), "n_shared")
