"""Corpus pipeline: five stages over ``documents``, each an operator of ``riskloom.llm``.

1. ``language_id``: texts without a language, or with too narrow a lead, go.
2. ``near_duplicates``: of each group of linked documents the smallest doc_id stays.
3. ``decontaminate``: documents that hold a benchmark window go.
4. ``secret_scan``: found secrets are replaced by ``[KIND]``; documents stay.
5. ``packing``: the pieces of all that is left, packed into sequences.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns
of their input, whatever they are.  Defined results: every row is judged by its
own text, also where doc_ids repeat or are null (of near copies the smallest
doc_id stays, a null one last); empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, langid, ngram_join, packing, secret_scan
from riskloom.llm.common import few, read, stored


#: Ids of dropped documents sent to every executor at most; more are joined by shuffle.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` but for the rows whose key is in ``gone`` (one column)."""
    gone = stored(gone.toDF("gone_id").where("gone_id IS NOT NULL").distinct())
    return docs.join(few(gone, BROADCAST_IDS), F.col(key) == F.col("gone_id"), "left_anti")


def judged(docs: DataFrame, leaving: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``docs`` but for the rows that ``leaving(keys and texts, keys and doc_ids)`` names.

    A doc_id is its row's key where all of them are there and different; else
    the rows are written with a number each.
    """
    several = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL")
    if several.isEmpty():
        return without(docs, leaving(docs.select("doc_id", "text"), docs.select("doc_id", F.col("doc_id").alias("given"))))
    key = "row_number"
    while key in docs.columns:
        key += "_"
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    named = rows.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("given"), "text")
    gone = leaving(named.select("doc_id", "text"), named.select("doc_id", "given"))
    return without(rows, gone, key).drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly."""
    return langid.keep(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    def leaving(texts: DataFrame, given: DataFrame) -> DataFrame:
        found = ngram_join.near_duplicates(texts).where("component_id IS NOT NULL")
        first = F.struct(F.col("given").isNull().alias("last"), "given", "doc_id")
        groups = found.join(given, "doc_id").groupBy("component_id").agg(F.min(first).alias("stays"), F.count("*").alias("c"))
        groups = stored(groups.where("c > 1").select("component_id", F.col("stays.doc_id").alias("stays")))
        return found.join(groups, "component_id").where("doc_id <> stays").select("doc_id")

    return judged(docs, leaving)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    benchmark = read(spark, sf_dir, "benchmark")
    return judged(docs, lambda texts, _: decontaminate.decontaminate(texts, benchmark).where("contaminated").select("doc_id"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced (and ``n_chars``, where there is one, counted anew)."""
    clean = secret_scan.mask(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated),
          ("secret_scan", secrets_masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences from ``documents``, each stage written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, near duplicates and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None
