"""The registered queries of the training-data operators, and the SQL of those that SQL can state."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterlab.llm import (chat, langid, nra, order_minhash, packing, piece_bpe, pivots, rendezvous, simhash, suffixes, toxicity, vamana,
                           warc)
from rasterlab.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {"op2_chat_format": chat.SQL, "op11_warc_dictionary": warc.SQL, "op12_nra_search": nra.SQL,
                           "op13_pivot_clusters": pivots.SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_quoted(table(spark, sf_dir, "conversations")))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.learn(docs))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


@query
def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.place(table(spark, sf_dir, "documents"), 40)


@query
def op11_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


@query
def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.clustered(table(spark, sf_dir, "embeddings"))
