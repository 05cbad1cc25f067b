"""Registered queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.llm import (
    alignment,
    decontaminate,
    langid,
    language_model,
    license_scan,
    minhash,
    ngram_join,
    packing,
    repeats,
    secret_scan,
    spelling,
    toxicity,
    vector_search,
)
from riskloom.llm.common import read
from riskloom.llm.sql import ORACLE  # noqa: F401


def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op5_repeated_strings(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op6_language_model(spark, sf_dir):
    return language_model.score(read(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_vector_search(spark, sf_dir):
    return vector_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_minmax_duplicates(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_license_scan, op4_ngram_join, op5_repeated_strings,
                                   op6_language_model, op7_language_id, op8_decontaminate, op9_packing, op10_vector_search,
                                   op11_minmax_duplicates, op12_spelling_variants,
                                   op13_token_alignment)}
