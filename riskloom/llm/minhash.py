"""Near duplicates by min-max hashing (operator 11).

A text is the set of its two-word shingles.  Every permutation gives two
values of a set, its smallest and its largest; two sets of similarity J agree
in each with probability J, so 64 permutations give a signature of 128 values
for half the hashing.  Four smallest (or four largest) values of four
permutations are a band: 32 bands, and a pair of similarity 0.8 shares none of
them with a chance below 10^-7.

1. Rows with the same set (128-bit hash) form a class, and its first row
   stands for it.  Bands that hold one class only are dropped at once.
2. Candidates are pairs of classes in one band.  A turn first joins all
   classes of a band with one of them, its leader: in the first turn the one
   that shares the most bands with the most others (the middle of a group of
   near copies, whose members may be too far from one another), later a random
   one.  Classes connected by then need no link of their own, so a large group
   of near copies costs a few rows a member.  When the open pairs are few, or a
   turn finds next to no link, all pairs that are still open are joined, so no
   pair that shares a band is left out.
3. A candidate whose sizes cannot reach the similarity goes.  So does one that
   differs too much for it: every set has, for each of ``BITS`` hash ranges,
   whether it holds an odd number of shingles, and two sets differ in at least
   as many shingles as in odd ranges (this loses nothing).  The last join tests
   both itself and lets a pair through in the first band it shares.
   Then one with fewer than ``AGREE`` equal signature values goes: at
   similarity 0.8 about 102 of 128 agree, with a deviation of at most 4.5, so
   78 is more than 5 of them off.  What is left is confirmed on the full sets.

Defined results: null, empty and wordless texts have an empty set and link
with nothing; a text of one word is one shingle.  Every row is judged by its
own text; rows that repeat a doc_id are one document for the component (what
one of them reaches, all reach), each with its own set size.  A row without a
doc_id links like any other but lends no id: its component_id is the smallest
doc_id it reaches, null if there is none, and it is kept in that case alone.
Very long texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, few, id_text, small_batches, stored
from riskloom.llm.components import components
from riskloom.llm.hashing import BASE, FOLD, U, mix, shingle_hashes, word_hashes
from riskloom.session import cut_lineage

WIDTH = 2
#: Least similarity, in hundredths.
SIMILARITY = 80
PERMUTATIONS = 64
ROWS = 4
AGREE = 78
BITS = 1024
ODD_WORDS = [f"w{i}" for i in range(BITS // 64)]
#: Keys sent to every executor at most; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: Classes whose filter columns (400 bytes each) are sent to every executor at most.
BROADCAST_CLASSES = 100_000
#: Open pairs, per band entry, above which another round of single partners comes first.
PAIRS_PER_ENTRY = 3
ROUNDS = 5
#: A turn that finds fewer links than one for so many band entries is the last one with single partners.
FRUITLESS = 500
#: Band entries for each task of the steps that work on candidates.
ENTRIES_PER_TASK = 50_000

_NUMBERS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U) * BASE)
XOR = (_NUMBERS[:PERMUTATIONS] >> U(32)).astype(np.uint32)
ODD = (_NUMBERS[PERMUTATIONS:] >> U(32)).astype(np.uint32) | np.uint32(1)


def sets_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ordered by text and hash; how many each text has)."""
    hashes, own = shingle_hashes(*word_hashes([t.encode().translate(FOLD) if t else b"" for t in texts]), len(texts), width)
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    return hashes[fresh], np.bincount(own[fresh], minlength=len(texts))


def min_max(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """2 * PERMUTATIONS values (all smallest, then all largest) of each set; sets are not empty."""
    starts = np.cumsum(sizes) - sizes
    low = (hashes >> U(32)).astype(np.uint32)
    out = np.empty((2 * PERMUTATIONS, len(sizes)), dtype=np.uint32)
    for k in range(PERMUTATIONS):
        x = (low ^ XOR[k]) * ODD[k]
        x ^= x >> np.uint32(16)
        out[k] = np.minimum.reduceat(x, starts)
        out[PERMUTATIONS + k] = np.maximum.reduceat(x, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(set, band): a 64-bit key of the ``ROWS`` values of each band."""
    keys = np.empty((values.shape[1], len(values) // ROWS), dtype=U)
    for band in range(keys.shape[1]):
        h = np.full(values.shape[1], band + 1, dtype=U)
        for row in values[band * ROWS:(band + 1) * ROWS]:
            h = mix(h * BASE + row)
        keys[:, band] = h
    return keys


def set_hashes(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set."""
    ends = np.cumsum(sizes)
    out = []
    for x in (mix(hashes ^ U(0x51)), mix(hashes + U(0xA7))):
        total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(x, dtype=U)])
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out


def odd_ranges(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(set, word): the hash ranges that hold an odd number of a set's shingles, as bits."""
    at = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (hashes >> U(40)).astype(np.int64) % BITS
    odd = (np.bincount(at, minlength=len(sizes) * BITS) & 1).astype(np.uint8).reshape(len(sizes), BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, s1, s2 (set size and hashes), bands."""

    def work(batches):
        for b in chunks(batches):
            hashes, sizes = sets_of(b.column("text").to_pylist(), width)
            full = np.flatnonzero(sizes)
            bands = [None] * len(sizes)
            if len(full):
                for i, keys in zip(full.tolist(), band_keys(min_max(hashes, sizes[full])).view(np.int64), strict=True):
                    bands[i] = keys
            s1, s2 = set_hashes(hashes, sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(s1), pa.array(s2),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "bands"])

    return small_batches(docs).mapInArrow(work, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, s1, s2, grams, sketch (one byte of each signature value), w0.. (odd ranges); sets that are not empty."""

    def work(batches):
        for b in chunks(batches):
            hashes, sizes = sets_of(b.column("text").to_pylist(), width)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            ids, sizes = b.column("doc_id").take(pa.array(full)), sizes[full]
            s1, s2 = set_hashes(hashes, sizes)
            grams = np.split(hashes.view(np.int64), np.cumsum(sizes)[:-1])
            sketch = ((min_max(hashes, sizes) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T
            odd = odd_ranges(hashes, sizes)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(s1), pa.array(s2), pa.array(grams, pa.list_(pa.int64())),
                 pa.array([x.tobytes() for x in sketch], pa.binary()), *(pa.array(x) for x in odd.T)],
                names=["doc_id", "n", "s1", "s2", "grams", "sketch", *ODD_WORDS])

    return small_batches(docs).mapInArrow(
        work, "doc_id long, n long, s1 long, s2 long, grams array<long>, sketch binary, " + ", ".join(f"{w} long" for w in ODD_WORDS))


def may_link(similarity: int) -> str:
    """SQL for two sets (na, nb shingles, odd ranges) that do not differ too much for the similarity."""
    odd = " + ".join(f"bit_count(a{w} ^ b{w})" for w in ODD_WORDS)
    return f"{odd} <= na + nb - 2 * (({similarity} * (na + nb) + {99 + similarity}) div {100 + similarity})"


def alike(pairs: DataFrame, sketches: DataFrame, similarity: int, agree: int = AGREE) -> DataFrame:
    """The pairs (a, b) of ``sketches`` (r, n, sketch, odd ranges) whose sketches agree in ``agree`` places at least."""
    side = lambda end: sketches.select(
        F.col("r").alias(end), *[F.col(x).alias(f"{end}{x}") for x in ("sketch", *ODD_WORDS)], F.col("n").alias(f"n{end}"))

    def work(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                    for c in ("asketch", "bsketch"))
            keep = (x == y).sum(axis=1) >= agree
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    met = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(similarity)).select("a", "b", "asketch", "bsketch")
    return met.mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The links among candidate pairs (a, b), on the full sets (r, grams)."""
    side = lambda end: sets.select(F.col("r").alias(end), F.col("grams").alias(f"{end}_grams"))
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    every = F.size("a_grams") + F.size("b_grams") - F.col("common")
    return (pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
            .where(100 * F.col("common").cast("long") >= similarity * every.cast("long")).select("a", "b"))


def linked(entries: DataFrame, sets: DataFrame, similarity: int, rounds: int,
           pairs_per_entry: float) -> DataFrame | None:
    """Links (a, b) that connect all classes with a link; None if there is none.

    ``entries``: key, band, r, n; ``sets``: r, n, grams, sketch, odd ranges, heads (31 bits of every band key).
    """
    total = entries.count()
    parts = max(1, total // ENTRIES_PER_TASK)
    sizes_fit = f"100 * least(na, nb) >= {similarity} * greatest(na, nb)"
    before = "exists(zip_with(slice(aheads, 1, band), slice(bheads, 1, band), (x, y) -> x = y), same -> same)"
    filters = [*ODD_WORDS, "heads"]
    links = known = None
    left_over, fruitless = entries, False
    for turn in range(rounds + 1):
        if not fruitless:  # else nothing has changed
            rows = left_over.withColumn("c", F.col("r"))
            if known is not None:
                rows = left_over.join(known.withColumnRenamed("id", "r"), "r", "left").withColumn("c", F.coalesce("component", "r"))
                rows = cut_lineage(rows.drop("component").coalesce(parts))
            per = rows.groupBy("key", "c").agg(F.count("*").cast("double").alias("k"))
            pairs = (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2
            open_ = per.groupBy("key").agg(F.sum("k").alias("k"), pairs.alias("pairs"))
            open_ = cut_lineage(open_.where("pairs > 0").coalesce(parts))
            left = open_.agg(F.sum("pairs")).first()[0] or 0
            if not left:
                break
            rows = cut_lineage(rows.join(open_.select("key", "k"), "key").coalesce(parts))
            left_over = rows.drop("c", "k")
        last = turn == rounds or fruitless or left <= pairs_per_entry * total

        def end(e: str, frame: DataFrame, *more: str) -> DataFrame:
            return frame.select("key", F.col("r").alias(e), F.col("n").alias(f"n{e}"), F.col("c").alias(f"c{e}"),
                                *[F.col(x).alias(f"{e}{x}") for x in more])

        if last:
            full = rows.join(few(sets.select("r", *filters), BROADCAST_CLASSES), "r")
            met = end("a", full, "band", *filters).join(end("b", full, *filters), "key").withColumnRenamed("aband", "band")
            pairs = met.where(f"a < b AND ca <> cb AND {sizes_fit} AND {may_link(similarity)} AND NOT {before}").select("a", "b")
        else:
            ranked, rank = rows, F.lit(0.0)
            if not turn:  # who shares many bands with many others leads: it is the likeliest to be near them all
                ranked, rank = rows.join(rows.groupBy("r").agg(F.sum(F.log2("k")).alias("rank")), "r"), -F.col("rank")
            order = F.struct(rank.alias("rank"), F.xxhash64("r", F.lit(turn)).alias("o"), F.col("r").alias("a"),
                             F.col("n").alias("na"), F.col("c").alias("ca"))
            lead = ranked.groupBy("key").agg(F.min(order).alias("x")).select("key", "x.a", "x.na", "x.ca")
            met = lead.join(end("b", rows), "key").where(f"a <> b AND ca <> cb AND {sizes_fit}")
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = cut_lineage(alike(pairs.coalesce(parts), sets, similarity).coalesce(parts))
        found = cut_lineage(confirmed(near, sets, similarity).coalesce(parts))
        new = 0 if last else found.count()
        if last or new:
            links = found if links is None else links.unionAll(found)
        if last:
            break
        fruitless = FRUITLESS * new < total
        if not fruitless:
            known = components(links, parts)
            # a class that is connected needs one link: the components of the next turn start from there
            links = known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return links


def near_duplicates(documents: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY,
                    broadcast_keys: int = BROADCAST_KEYS, rounds: int = ROUNDS,
                    pairs_per_entry: float = PAIRS_PER_ENTRY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = id_text(documents)
    each = stored(signatures(docs, width).withColumn("r", F.monotonically_increasing_id()))
    of_set = ["n", "s1", "s2"]
    classes = cut_lineage(each.where("n > 0").groupBy(*of_set).agg(F.min("r").alias("rep")))
    rows = cut_lineage(each.select("doc_id", *of_set, "r").join(classes, of_set, "left")
                       .select("doc_id", "n", "r", F.coalesce("rep", "r").alias("rep")))

    banded = each.select(F.posexplode("bands").alias("band", "key"), "r", "n", "s1")
    shared = banded.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("key")
    first = classes.select(F.col("rep").alias("r"))
    entries = cut_lineage(banded.drop("s1").join(few(cut_lineage(shared), broadcast_keys), "key", "left_semi")
                          .join(first, "r", "left_semi"))

    heads = F.transform("bands", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("heads")
    wanted = cut_lineage(each.join(entries.select("r").distinct(), "r", "left_semi").select("doc_id", *of_set, "r", heads))
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    some = docs.join(few(ids, broadcast_keys), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    keys = few(wanted.select(F.col("doc_id").alias("id"), *of_set, "r", "heads"), BROADCAST_CLASSES)
    sets = whole_sets(some, width).join(keys, of_set).where(F.col("doc_id").eqNullSafe(F.col("id"))).drop("doc_id", "id", "s1", "s2")
    repeated = each.groupBy("doc_id", *of_set).agg(F.count("*").alias("c")).where("c > 1")
    sets = stored(sets if repeated.isEmpty() else sets.dropDuplicates(["r"]))
    links = linked(entries, sets, similarity, rounds, pairs_per_entry)

    spread = (rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
              .where("a <> z").select("doc_id", "a"))
    ties = rows.join(spread, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    ties = cut_lineage(ties if links is None else links.unionAll(ties))
    known = components(ties, max(1, ties.count() // ENTRIES_PER_TASK))
    labelled = rows.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("at", F.coalesce("component", "rep"))
    label = labelled.groupBy("at").agg(F.min("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return labelled.join(label, "at").select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
