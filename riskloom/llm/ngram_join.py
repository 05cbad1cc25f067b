"""N-gram Jaccard self-join by rare-first prefix filtering (operator 4).

A document is the set of its five-word shingles (64-bit hashes).  Documents
with the same set form a class, and one of each class joins.

1. *Unshared n-grams.*  Two sets of similarity t share at least ``t * n``
   n-grams, so a document with more than ``n - ceil(t * n)`` n-grams that no
   other document has, has no partner.  A fixed share of the hash space
   (``PROBE_SHARE``) is counted over one document of each class; documents
   beyond the bound are settled.  This is exact: the count is a lower bound,
   and copies of a document are no partners of their class.
2. *Rare-first prefixes.*  The rest counts all its n-grams.  In the order
   (frequency, hash) a document's prefix is its first ``n - ceil(t * n) + 1``
   n-grams; partners share an n-gram of their prefixes.  N-grams of frequency
   one fill places but join nothing.  The smaller set of a pair joins by a
   shorter prefix, as more of its n-grams must be common.
3. *Candidates* share a prefix n-gram and pass the length filter, the
   positional filter (places before and after the shared n-gram) and the
   suffix filter: every set carries, for each of ``BITS`` hash ranges, whether
   it has an odd number of n-grams there; two sets differ in at least as many
   n-grams as in odd ranges.  All are tested inside the join.  Pairs are made
   distinct, and each is verified once on the whole sets.
4. *Large groups.*  While the pairs of documents not yet known to be connected
   outgrow the prefix entries, each n-gram first joins its documents with one
   of them only (a random order, another one in each round); documents that
   are connected by then need no link of their own to be in one component.
   All remaining pairs are joined at the end, so no connection is missed.

Defined results: null, empty and wordless texts have an empty set and are
linked with nothing; a text of fewer words is one shingle; rows that repeat an
id are one document: each row links by its own text, the document reaches what
any of them reaches, and its set size is the largest; rows without an id come
back with their set size and no component, and link with nothing.  Very long
texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import chunks, few, id_text, small_batches, stored
from riskloom.llm.components import components
from riskloom.llm.hashing import FOLD, U, mix, shingle_hashes, word_hashes
from riskloom.session import cut_lineage

WIDTH = 5
#: Least similarity, in hundredths.
SIMILARITY = 80
PROBE_SHARE = 0.28
BITS = 256
WORDS = [f"g{i}" for i in range(BITS // 64)]
#: Ids sent to every executor at most; more are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Rows of ``WORDS`` (40 bytes each) and of known components sent to every executor at most.
BROADCAST_ROWS = 500_000
#: Pairs left to join, per prefix entry, above which another round of single partners comes first.
PAIRS_PER_ENTRY = 5
ROUNDS = 3
#: Prefix entries for each task of the steps that work on candidates.
ENTRIES_PER_TASK = 50_000


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    folded = [t.encode().translate(FOLD) if t else b"" for t in texts]
    words, owner = word_hashes(folded)
    hashes, own = shingle_hashes(words, owner, len(texts), width)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(np.bincount(own, minlength=len(texts)))[:-1])]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, s1, s2: set size and a 128-bit hash of the set."""

    def work(batches):
        for b in chunks(batches):
            sets = sets_of(b.column("text").to_pylist(), width)
            s1 = np.array([int(mix(x ^ U(0x51)).sum()) if len(x) else 0 for x in sets], dtype=U).view(np.int64)
            s2 = np.array([int(mix(x + U(0xA7)).sum()) if len(x) else 0 for x in sets], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1), pa.array(s2)],
                names=["doc_id", "n", "s1", "s2"])

    return small_batches(docs).mapInArrow(work, "doc_id long, n long, s1 long, s2 long")


def probes(docs: DataFrame, width: int, share: float) -> DataFrame:
    """doc_id, grams: the shingles in the counted share of the hash space."""
    top = U(int(share * 2**64))

    def work(batches):
        for b in chunks(batches):
            kept = [x[: np.searchsorted(x, top)].view(np.int64) for x in sets_of(b.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.list_(pa.int64()))],
                                             names=["doc_id", "grams"])

    return small_batches(docs).mapInArrow(work, "doc_id long, grams array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, s1, grams, g0..g3: whole sets, and the ranges with an odd number of n-grams as bits."""

    def work(batches):
        for b in chunks(batches):
            sets = sets_of(b.column("text").to_pylist(), width)
            odd = [np.packbits((np.bincount((x >> U(56)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)
                   for x in sets]
            s1 = np.array([int(mix(x ^ U(0x51)).sum()) if len(x) else 0 for x in sets], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s1), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                 *(pa.array([o[i] for o in odd], pa.int64()) for i in range(len(WORDS)))],
                names=["doc_id", "s1", "grams", *WORDS])

    return small_batches(docs).mapInArrow(
        work, "doc_id long, s1 long, grams array<long>, " + ", ".join(f"{w} long" for w in WORDS))


def least(n: str, similarity: int) -> str:
    """SQL for ceil(similarity * n / 100)."""
    return f"(({similarity} * ({n}) + 99) div 100)"


def overlap(x: str, y: str, similarity: int) -> str:
    """SQL for the least common n-grams of two sets of the given sizes."""
    return f"(({similarity} * ({x} + {y}) + {99 + similarity}) div {100 + similarity})"


def postings(sets: DataFrame, similarity: int) -> DataFrame:
    """gram, doc_id, n, pos, short: the entries of rare-first prefixes that more than one document has (pos from 1).

    ``short`` marks the prefix that is enough for the smaller set of a pair: the larger one then has at least as
    many n-grams, so more of them must be common.
    """
    entries = sets.select("doc_id", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram"))
    shared = entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = Window.partitionBy("doc_id")
    placed = (entries.join(shared, "gram")
              .withColumn("pos", F.expr("n") - F.count("*").over(by_doc)
                          + F.row_number().over(by_doc.orderBy("df", "gram"))))
    short = F.expr(f"pos <= n - {overlap('n', 'n', similarity)} + 1").alias("short")
    return placed.where(f"pos <= n - {least('n', similarity)} + 1").select("gram", "doc_id", "n", "pos", short)


def verified(pairs: DataFrame, sets: DataFrame, similarity: int, parts: int) -> DataFrame:
    """The links (a, b) among candidate pairs (a, b, na, nb), on the whole sets of their ends alone."""

    def side(end: str) -> DataFrame:
        ends = cut_lineage(pairs.select(end).distinct().coalesce(parts))
        grams = sets.select(F.col("doc_id").alias(end), F.col("grams").alias(f"{end}_grams"))
        return grams.join(few(ends, BROADCAST_IDS), end, "left_semi")

    common = F.size(F.array_intersect("a_grams", "b_grams")).cast("long")
    return (pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
            .where(f"100 * common >= {similarity} * (na + nb - common)").select("a", "b"))


def passes(similarity: int) -> str:
    """Length, positional and suffix filters on a candidate."""
    odd = " + ".join(f"bit_count(a{w} ^ b{w})" for w in WORDS)
    need = overlap("na", "nb", similarity)
    return (f"100 * least(na, nb) >= {similarity} * greatest(na, nb) AND "
            f"least(pa, pb) + least(na - pa, nb - pb) >= {need} AND {odd} <= na + nb - 2 * {need}")


def link_components(entries: DataFrame, sets: DataFrame, similarity: int, rounds: int = ROUNDS,
                    pairs_per_entry: float = PAIRS_PER_ENTRY) -> DataFrame | None:
    """(id, component) of all documents with a link; None if there is none.  ``sets`` has the sets of all of them."""
    total = entries.count()
    parts = max(1, total // ENTRIES_PER_TASK)
    links = known = None

    def end(name: str, frame: DataFrame) -> DataFrame:
        return frame.select("gram", F.col("member").alias(name), F.col("n").alias(f"n{name}"),
                            F.col("pos").alias(f"p{name}"), F.col("component").alias(f"c{name}"),
                            *[F.col(w).alias(f"{name}{w}") for w in WORDS])

    left_over = entries.withColumnRenamed("doc_id", "member")
    words = few(sets.select(F.col("doc_id").alias("member"), *WORDS), BROADCAST_ROWS)
    for turn in range(rounds + 1):
        rows = left_over.withColumn("component", F.col("member"))
        if known is not None:
            at = few(known.withColumnRenamed("id", "member"), BROADCAST_ROWS)
            rows = left_over.join(at, "member", "left").withColumn(
                "component", F.coalesce("component", "member"))
            rows = cut_lineage(rows.coalesce(parts))
        # pairs (smaller set by its short prefix, larger set) of one n-gram that are not yet in one component
        per = rows.groupBy("gram", "component").agg(F.count("*").cast("double").alias("k"),
                                                    F.count(F.when(F.col("short"), 1)).cast("double").alias("s"))
        open_ = per.groupBy("gram").agg((F.sum("k") * F.sum("s") - F.sum(F.col("k") * F.col("s"))).alias("pairs"))
        open_ = cut_lineage(open_.where("pairs > 0").coalesce(parts))
        left = open_.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        rows = cut_lineage(rows.join(open_.select("gram"), "gram", "left_semi").coalesce(parts))
        left_over, rows = rows.drop("component"), rows.join(words, "member")
        last = turn == rounds or left <= pairs_per_entry * total
        if last:
            smaller, larger = end("a", rows.where("short")), end("b", rows)
            met = smaller.join(larger, "gram").where("(na < nb OR na = nb AND a < b) AND ca <> cb AND " + passes(similarity))
        else:
            order = F.struct(F.xxhash64("member", F.lit(turn)).alias("o"), "member", "n", "pos", "component", *WORDS)
            lead = rows.groupBy("gram").agg(F.min(order).alias("x")).select("gram", "x.*")
            met = end("a", lead).join(end("b", rows), "gram").where("a <> b AND ca <> cb AND " + passes(similarity))
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                           F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb"))
        found = verified(cut_lineage(pairs.distinct().coalesce(parts)), sets, similarity, parts).coalesce(parts)
        links = cut_lineage(found if links is None else links.unionAll(found).coalesce(parts))
        known = components(links, parts)
        if last:
            break
    return known


def near_duplicates(documents: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY,
                    probe_share: float = PROBE_SHARE, broadcast_ids: int = BROADCAST_IDS, rounds: int = ROUNDS,
                    pairs_per_entry: float = PAIRS_PER_ENTRY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs, options = id_text(documents), (width, similarity, probe_share, broadcast_ids, rounds, pairs_per_entry)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return _unique_ids(docs, *options)
    # rows that repeat an id join as documents of their own, under the number of their row
    rows = stored(docs.withColumn("r", F.monotonically_increasing_id()))
    found = _unique_ids(rows.where("doc_id IS NOT NULL").select(F.col("r").alias("doc_id"), "text"), *options)
    found = cut_lineage(found.withColumnRenamed("doc_id", "r").join(rows.select("r", "doc_id"), "r"))
    each = found.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("a"),
                                       F.max("component_id").alias("z"))
    ties = found.join(each.where("a <> z").select("doc_id", "a"), "doc_id").select("a", F.col("component_id").alias("b"))
    known = components(ties).withColumnRenamed("id", "a")
    named = lambda df, at: df.withColumnRenamed(at, "a").join(known, "a", "left").withColumn("a", F.coalesce("component", "a"))
    least_id = named(found.select("doc_id", "component_id"), "component_id").groupBy("a").agg(F.min("doc_id").alias("component_id"))
    out = named(each, "a").join(least_id, "a").select("doc_id", "n_shingles", "component_id")
    lost = signatures(rows.where("doc_id IS NULL"), width).select("doc_id", "n", F.lit(None).cast("long"))
    return out.unionAll(lost)


def _unique_ids(docs: DataFrame, width: int, similarity: int, probe_share: float, broadcast_ids: int, rounds: int,
                pairs_per_entry: float) -> DataFrame:
    """The same for documents whose ids are different where they are not null."""
    each = cut_lineage(signatures(docs, width))
    sized = each.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("x")).select(
        "doc_id", "x.*")
    classes = sized.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    sized = cut_lineage(sized.join(classes, ["n", "s1", "s2"], "left"))

    copies = cut_lineage(sized.where("doc_id <> rep").select("doc_id"))
    grams = (probes(docs, width, probe_share).join(few(copies, broadcast_ids), "doc_id", "left_anti")
             .select("doc_id", F.explode("grams").alias("gram")))
    lonely = (grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")).where("df = 1")
              .groupBy("doc_id").agg(F.count("*").alias("unshared")))
    left = (sized.where("doc_id = rep").join(lonely, "doc_id", "left")
            .where(f"coalesce(unshared, 0) <= n - {least('n', similarity)}").select("doc_id", "s1"))
    left = cut_lineage(left)
    some = lambda ids: whole_sets(docs.join(few(ids, broadcast_ids), "doc_id", "left_semi"), width).join(
        few(left, broadcast_ids), ["doc_id", "s1"], "left_semi")
    entries = cut_lineage(postings(some(left.select("doc_id")), similarity))
    # the documents that can still have a partner are few, so only their sets are kept
    sets = cut_lineage(some(cut_lineage(entries.select("doc_id").distinct())))
    known = link_components(entries, sets, similarity, rounds, pairs_per_entry)

    component = F.coalesce("rep", "doc_id")
    if known is not None:
        sized = sized.join(known.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.coalesce("component", "rep", "doc_id")
    out = sized.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.unionAll(each.where("doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long")))
