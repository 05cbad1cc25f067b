"""Benchmark decontamination by a prefix-filtered set join (operator 8); DataFrame expressions only.

An item's windows are its runs of ``WIDTH`` words (a shorter item is one
window).  A window must occur whole, so its necessary prefix is one token: its
rarest word by document frequency over all documents.  Only places where such
a word stands are joined with the windows; the place of the word in the window
must fit into the text (positional and length bounds), and the words around it
are then compared one by one.  Windows with a word that no document has are
dropped beforehand.

The benchmark's words (then the prefix tokens) become a literal set inside the
scan while there are at most ``LITERALS`` of them; beyond that the words of the
documents are joined with them instead.  Both ways give the same rows.

Defined results: null and empty texts have no words and no hits; items that
are null, without words or without id are no items; repeated items count
once; every row is judged by its own text, also where ids repeat or are null;
very long texts are searched whole; with an empty benchmark no document is hit.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_text, stored
from riskloom.session import cut_lineage

WIDTH = 10
LITERALS = 20_000
#: Windows handed to every executor; a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 200_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Lower-cased (A-Z alone) words of a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    # lower() folds nothing but A-Z in a text of one-byte characters, and is much faster
    folded = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(folded, NO_WORD), "")


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, s (start in the item, from 1), win (words)."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id IS NOT NULL").select("item_id", words_of("text").alias("words"))
             .where(F.size("words") > 0).distinct())
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1))))
    return (items.select("item_id", "words", start.alias("s"))
            .select("item_id", "s", F.slice("words", F.col("s"), F.least(F.size("words"), F.lit(width))).alias("win")))


def literals(words: DataFrame, limit: int) -> list[str] | None:
    """The values of a one-column frame if they are few, else None."""
    found = [r[0] for r in words.limit(limit + 1).collect()]
    return found if len(found) <= limit else None


def rarity(docs: DataFrame, vocabulary: DataFrame, limit: int) -> DataFrame:
    """word, df: in how many documents each benchmark word stands."""
    known = literals(vocabulary, limit)
    if known is None:
        each = docs.select(F.explode(F.array_distinct("words")).alias("word")).join(vocabulary, "word", "left_semi")
    else:
        each = docs.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(known)))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("df"))


def around(words: str, place: Column, width: int) -> Column:
    """The words that a window over the given place (from 0) can touch."""
    return F.slice(words, F.greatest(place - (width - 2), F.lit(1)), F.lit(2 * width - 1))


def places(docs: DataFrame, tokens: DataFrame, width: int, limit: int) -> DataFrame:
    """doc_id, n_words, cands: where prefix tokens stand, each with the words around it."""
    known = literals(tokens, limit)
    if known is None:
        docs = stored(docs.withColumn("r", F.monotonically_increasing_id()))       # both sides of a join read it
        at = (docs.select("r", F.posexplode("words").alias("pos", "token"))
              .join(tokens, "token", "left_semi").groupBy("r").agg(F.collect_set("pos").alias("found")))
        rows = docs.join(at, "r", "left").select("doc_id", "words", "found")
        inside = F.filter(F.coalesce("found", F.array().cast("array<int>")), lambda p: p < F.size("words"))
        cands = F.transform(inside, lambda p: F.struct(p.alias("pos"), F.get("words", p).alias("token"),
                                                       around("words", p, width).alias("near")))
        return rows.select("doc_id", F.size("words").alias("n_words"), cands.alias("cands"))
    cand = lambda w, p: F.when(w.isin(known), F.struct(
        p.alias("pos"), w.alias("token"), around("words", p, width).alias("near")))
    return docs.select("doc_id", F.size("words").alias("n_words"),
                       F.filter(F.transform("words", cand), lambda x: x.isNotNull()).alias("cands"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = LITERALS,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``documents``."""
    docs = id_text(documents).select("doc_id", words_of("text").alias("words"))
    windows = windows_of(benchmark, width)
    vocabulary = cut_lineage(windows.select(F.explode("win").alias("word")).distinct())
    df = rarity(docs, vocabulary, limit)
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off"))
    prefixed = (windows.select("*", F.posexplode("win").alias("off", "word")).join(df, "word", "left")
                .groupBy("item_id", "s", "win").agg(rarest.alias("rare")).where("rare.df > 0")
                .select("item_id", "win", F.col("rare.word").alias("token"), F.col("rare.off").alias("off")).distinct())
    prefixed = cut_lineage(prefixed)
    found = cut_lineage(places(docs, prefixed.select("token").distinct(), width, limit)
                        .withColumn("r", F.monotonically_increasing_id()))

    fits = prefixed if prefixed.count() > broadcast_windows else F.broadcast(prefixed)
    start, before = F.col("c.pos") - F.col("off"), F.least(F.col("c.pos"), F.lit(width - 1))
    hits = (found.select("r", "n_words", F.explode("cands").alias("c")).withColumn("token", F.col("c.token"))
            .join(fits, "token").where((start >= 0) & (start + F.size("win") <= F.col("n_words")))
            .where(F.slice("c.near", F.greatest(before - F.col("off") + 1, F.lit(1)), F.size("win")) == F.col("win")))
    run = F.sequence(start, start + F.size("win") - 1)
    by_row = hits.groupBy("r").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(run)))).alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return (found.select("r", "doc_id", "n_words").join(by_row, "r", "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
                    F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))
