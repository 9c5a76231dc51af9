"""The registered queries of the training-data operators, one per operator."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from .common import shared_path, table
from .decontaminate import benchmark_spans, summarise
from .html import extract
from .negatives import hard_negatives, relabelled
from .neardup import near_duplicates
from .packing import pack_documents
from .phrases import collocations
from .quality import quality
from .secrets import labelled_sample, secret_scan, train
from .secrets import summarise as list_secrets
from .signatures import license_scan
from .substrings import repeated_words, without_repeats
from .tokenfile import read_token_file, write_token_file
from .urls import url_filter
from .vectordup import near_vectors

#: Default tokenizer files; every operator takes the path as a parameter.
BYTE_FILE, WORD_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TOKENIZERS = os.path.dirname(BYTE_FILE)


def op1_quality_rules(spark, sf_dir):
    q = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")])


def op2_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_FILE)


def op3_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return list_secrets(secret_scan(docs, train(labelled_sample(docs))))


def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_file(spark, sf_dir):
    path = shared_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path, WORD_FILE)
    return read_token_file(spark, path)


def op8_substring_dedup(spark, sf_dir):
    kept = without_repeats(repeated_words(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontaminate(spark, sf_dir):
    return summarise(benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def queries():
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
