"""Language identification by compression (operator 7).

A lower-cased text is cut into blocks of ``BLOCK`` bytes and every block is compressed
with one zstandard raw-content dictionary per language.  The language whose
dictionary gives the smallest total wins; the relative distance to the second
best is the score, and a text whose score is below ``min_margin`` is rejected.
A short text on which the dictionaries tie is tried once more, repeated.
Whole texts are read.  Only the dictionaries come from a bounded sample:
``SAMPLE_DOCS`` documents per language (smallest hash of the id), at most
``SAMPLE_CHARS`` characters of each, ``DICT_BYTES`` per dictionary.

Defined results: null texts and texts without a letter are ``und``, score 0,
rejected.  Ties go to the alphabetically first language.  With no usable
training row every text is ``und``.  A null doc_id never trains and is not
held out.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import pyarrow as pa

from riskloom.llm.common import chunks, crc_mod, small_batches

SAMPLE_DOCS = 64
SAMPLE_CHARS = 1_000
DICT_BYTES = 32 << 10
BLOCK = 4 << 10
#: Copies of a text of one block whose sizes tie.
REPEAT = 16
#: Short matches matter in short texts: binary-tree search, matches from four bytes on.
SEARCH = {"window_log": 18, "chain_log": 16, "hash_log": 16, "search_log": 3, "min_match": 4, "target_length": 16,
          "strategy": zstandard.STRATEGY_BTLAZY2, "write_content_size": 0, "write_dict_id": 0, "write_checksum": 0}
#: Relative lead of the best language below which a text is rejected.
MIN_MARGIN = 0.002
HELD_OUT_MOD, HELD_OUT_REST = 5, 0


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """One raw-content dictionary per language from the training rows of a bounded sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    usable = (crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT_REST) & F.col("lang").isNotNull() & (F.length("text") > 0)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the rank limit is applied inside each task before the shuffle, so a hot language moves few rows
    picked = (rows.where(usable).select("lang", "doc_id").withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= sample_docs).select("lang", "doc_id"))
    sample = (rows.where(usable).join(F.broadcast(picked), ["lang", "doc_id"], "left_semi")
              .select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():  # at most sample_docs short texts per language
        texts.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    return {lang: "\n".join(t for _, t in sorted(found)).lower().encode()[-DICT_BYTES:] for lang, found in sorted(texts.items())}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    params = zstandard.ZstdCompressionParameters(**SEARCH)
    for lang, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        made.append((lang, zstandard.ZstdCompressor(compression_params=params, dict_data=d)))
    return made


def classify(text: str | None, made: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """(language, relative lead over the second best)."""
    if not made or text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = text.lower().encode()
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in made)
    if len(sizes) > 1 and sizes[0][0] == sizes[1][0] and len(data) <= BLOCK:
        # too short to be worth compressing, so stored as it is: repeated, it is compressed, and dictionaries differ
        again = (b" " + data + b" ") * REPEAT
        sizes = sorted((len(c.compress(again)), lang) for lang, c in made)
    best = sizes[0]
    second = sizes[1][0] if len(sizes) > 1 else best[0] + len(data)
    return best[1], max(0.0, min(1.0, 1.0 - best[0] / second))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``."""
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT_REST, F.lit(False)).alias("held_out"))

    def work(batches):
        made = compressors(dictionaries)
        for b in chunks(batches):
            found = [classify(t, made) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[0] == "und" or x[1] < min_margin for x in found], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return small_batches(frame).mapInArrow(
        work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""

    def work(batches):
        made = compressors(dictionaries)
        for b in chunks(batches):
            found = [classify(t, made) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([lang != "und" and lead >= min_margin for lang, lead in found], pa.bool_()))

    return small_batches(docs).mapInArrow(work, docs.schema)
