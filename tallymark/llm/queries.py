"""The operators as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, centroids, classifier, decontaminate, jaccard_join, lexical_search, oracles, quality_rules, secret_scan,
    simhash_pivots, substrings, token_counts, token_files, warc,
)

QUERIES = {}
#: The other queries hold merges, trained weights or entropies, which SQL does not express.
ORACLES = {
    "op1_ngram_jaccard_join": oracles.NEAR_DUPLICATES,
    "op2_warc": oracles.WARC,
    "op5_benchmark_decontamination": oracles.LEAKS,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op10_quality_rules": oracles.RULES,
    "op11_ranked_lexical_search": oracles.SEARCH,
    "op13_centroid_clustering": oracles.CENTROIDS,
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


@query
def op2_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_rows(warc.read_archives(warc.splits(manifest))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return token_counts.count_sections(docs, path, pattern, sections=token_counts.sentences, rule="largest")


@query
def op4_quality_classifier(spark, sf_dir):
    return classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_substring_dedup(spark, sf_dir):
    return substrings.digests(substrings.remove_repeated(table(spark, sf_dir, "documents")))


@query
def op7_token_id_binary_output(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_files(token_files.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@query
def op8_secret_scans(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.count_of("base", kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    digest = F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.joined(F.col("found")).alias("spans"))


@query
def op9_bpe_encoding_and_decoding(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, path).drop("text"), path))


@query
def op10_quality_rules(spark, sf_dir):
    docs = quality_rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return quality_rules.judged(docs.drop("text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op11_ranked_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_simhash_near_dedup(spark, sf_dir):
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_centroid_clustering(spark, sf_dir):
    assigned, last = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.report(assigned, last)
