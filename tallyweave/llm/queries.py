"""Queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, langid, licences, manifest, mixing, sentencepiece, simhash, substrings, topk, toxicity, url_filter, winnow
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the URL filter (fixed values).
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: Sites whose pages make the list of unwanted addresses (fixed values).
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: Weights of the sources in order of their names, repeating, and how often a document may be repeated (fixed values).
MIX_WEIGHTS, MIX_MOST = [5, 2, 1], 3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels, langid.crc32_mod(F.col("doc_id"), 3) != 1)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(table(spark, sf_dir, "documents"), sentencepiece.public_model())


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(url_filter.addressed(table(spark, sf_dir, "pages")), "url-addresses")
    return url_filter.filter_urls(rows, URL_RULES, stored(url_filter.listed_urls(rows, LISTED_SITES), "url-list"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), langid.crc32_mod(F.col("doc_id"), 4) != 2)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_MOST)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_table(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")  # beyond 64 bits too
    return manifest.audited(table(spark, sf_dir, "documents"), langid.crc32_mod(F.col("doc_id"), 7) == 0, {"n_chars": more})


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sentencepiece.public_model("word_bpe_49k.json")
    return bpe.digests(bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_licences": op3_licences,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_topk": op7_topk,
    "op8_language": op8_language,
    "op9_substrings": op9_substrings,
    "op10_mixing": op10_mixing,
    "op11_clusters": op11_clusters,
    "op12_manifest": op12_manifest,
    "op13_bpe": op13_bpe,
}
