"""Exact repeated byte strings by two-stage suffix sorting (operator 5).

A byte goes if it lies in a ``LENGTH``-byte string that also starts earlier
(smaller doc_id, or the same document further left), judged on the input.

1. Every string of that length is cut out by an *anchor*: the least hash among
   its ``GRAM``-byte grams (leftmost on ties).  Equal strings have the same
   anchor gram at the same place, and neighbouring starts mostly share one, so
   a text becomes runs of starts with one anchor.
2. Runs are counted by anchor over all documents; a run whose anchor occurs
   once holds no repeat.  Of the others, runs of the same bytes form a class:
   all but its first run repeat wholly.
3. The first runs of different classes with one anchor may share part of their
   bytes.  They go, by anchor, into groups of bounded size; each group's
   suffixes are sorted in two stages and adjacent common prefixes mark equal
   strings.  An anchor with more classes than ``HOT`` is spread over several
   groups, whose strings are then compared across groups by their 128-bit hash.
4. Removed spans are joined with the texts once.

Defined results: null texts are empty; a document shorter than the length
loses nothing; rows that repeat an id are one document (its smallest text);
rows without an id come back unchanged and are compared with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, few, id_text, small_batches, stored
from riskloom.llm.hashing import BYTE_VALUE, U, mix, powers
from riskloom.llm.suffix_sort import Slices

LENGTH = 100
GRAM = 24
#: Bytes of text whose grams are hashed together; a longer text is cut into overlapping pieces.
PIECE = 1 << 17
#: Runs in a group that one task sorts.
GROUP = 2_000
#: Classes with one anchor from which on it is spread over several groups.
HOT = 1_500
#: Keys sent to every executor at most; more are joined by shuffle.
BROADCAST_KEYS = 4_000_000
#: Bytes that are hashed at once: a few pieces, so that a place in them always fits in the low bits of a key.
AT_ONCE = 4 * PIECE
PLACE = U((1 << 24) - 1)


class Hashes:
    """Hashes of any byte range of one piece of text."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def grams(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width] + U(width))


def runs_of(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of pieces (owner, offset in its text, bytes): owner, start, count, anchor hash, class hash."""
    lists, size = [[]], 0
    for p in pieces:
        if lists[-1] and size + len(p[2]) > AT_ONCE:
            lists.append([])
            size = 0
        lists[-1].append(p)
        size += len(p[2])
    return tuple(map(np.concatenate, zip(*(runs_of_few(x, length, gram) for x in lists), strict=True)))


def runs_of_few(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``runs_of`` for pieces whose bytes together are counted by ``PLACE``."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    size = np.fromiter((len(p[2]) for p in pieces), dtype=np.int64, count=len(pieces))
    empty = np.empty(0, dtype=np.int64)
    if len(data) > int(PLACE):
        raise ValueError("too many bytes for the places in a key")
    if len(data) < length:
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
    reach, span = 1, length - gram + 1  # least key of the grams of each string, by doubling
    while reach * 2 <= span:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    if span > reach:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach:])
    anchor = (key & PLACE).astype(np.int64)
    begin = np.cumsum(size) - size
    n_starts = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), n_starts)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + np.repeat(begin, n_starts)
    anchor = anchor[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    s, a, o = starts[first], anchor[first], owner[first]
    whole = hashes.of(s, s + count - 1 + length)
    kind = mix(whole + (a - s).astype(U) * U(0x9E3779B97F4A7C15))
    ids = np.array([p[0] for p in pieces], dtype=np.int64)
    offsets = np.array([p[1] for p in pieces], dtype=np.int64)
    return ids[o], s - begin[o] + offsets[o], count, grams[a], kind


def pieces_of(row: int, text: bytes, length: int) -> list[tuple[int, int, bytes]]:
    return [(row, at, text[at:at + PIECE + length - 1]) for at in range(0, max(1, len(text) - length + 1), PIECE)]


def runs(docs: DataFrame, length: int, gram: int, keys_only: bool) -> DataFrame:
    """anchor[, kind, doc_id, start, n] of every run of every text."""

    def work(batches):
        for b in chunks(batches):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            pieces = [p for i, t in enumerate(texts) if len(t) >= length for p in pieces_of(i, t, length)]
            row, start, count, anchor, kind = runs_of(pieces, length, gram)
            if keys_only:
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["anchor"])
                continue
            ids = np.asarray(b.column("doc_id"))[row] if len(row) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(ids), pa.array(start),
                 pa.array(count)], names=["anchor", "kind", "doc_id", "start", "n"])

    return small_batches(docs).mapInArrow(
        work, "anchor long" + ("" if keys_only else ", kind long, doc_id long, start long, n long"))


def cut_slices(docs: DataFrame, length: int) -> DataFrame:
    """One row per wanted run of ``docs.wanted``, with its bytes."""
    names = ["task", "spread", "doc_id", "start", "n", "slice"]

    def work(batches):
        for b in chunks(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "wanted")), strict=True):
                data = text.encode()
                for w in wanted:
                    row = (w["task"], w["spread"], doc_id, w["start"], w["n"], data[w["start"]:w["start"] + w["n"] - 1 + length])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return small_batches(docs).mapInArrow(work, "task long, spread boolean, doc_id long, start long, n long, slice binary")


def sort_group(length: int):
    """Repeated starts of one group of slices; of a spread anchor also the first start of each string, with its hash."""

    def work(table: pa.Table) -> pa.Table:
        column = lambda name: np.asarray(table.column(name).combine_chunks().to_numpy(zero_copy_only=False))
        counts, doc, start = column("n"), column("doc_id"), column("start")
        laid = Slices(table.column("slice").to_pylist(), length)
        order = laid.sort(counts)
        slot = np.searchsorted(laid.begin, order, side="right") - 1
        place = start[slot] + order - laid.begin[slot]
        group = np.cumsum(laid.common_prefixes(order) < length)
        by = np.lexsort((place, doc[slot], group))
        slot, place, group, order = slot[by], place[by], group[by], order[by]
        first = np.ones(len(group), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        spread = column("spread").astype(bool)[slot] & first
        out = ~first | spread
        h1, h2 = np.zeros(len(group), dtype=U), np.zeros(len(group), dtype=U)
        if spread.any():
            hashes = Hashes(laid.data)
            at = order[spread]
            h1[spread] = hashes.of(at, at + length)
            h2[spread] = hashes.of(at, at + length // 2) ^ mix(hashes.of(at + length // 2, at + length) + U(1))
        return pa.table({"doc_id": doc[slot][out], "start": place[out], "first": spread[out],
                         "h1": h1[out].view(np.int64), "h2": h2[out].view(np.int64)})

    return work


def spans_of(text: bytes, starts: list[dict] | None, length: int) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, SHA-256 of the rest)."""
    kept, removed, n_spans, at = hashlib.sha256(), 0, 0, 0
    spans = sorted((s["start"], s["start"] + s["n"] - 1 + length) for s in starts or ())
    i = 0
    while i < len(spans):
        begin, end = spans[i]
        while i < len(spans) and spans[i][0] <= end:
            end = max(end, spans[i][1])
            i += 1
        kept.update(text[at:begin])
        removed, n_spans, at = removed + end - begin, n_spans + 1, end
    kept.update(text[at:])
    return removed, n_spans, kept.hexdigest()


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, hot: int = HOT,
                    broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, start, n: runs of starts whose string also starts earlier."""
    shared = stored(runs(docs, length, gram, keys_only=True).groupBy("anchor").agg(F.count("*").alias("c"))
                    .where("c > 1").select("anchor"))
    known = stored(runs(docs, length, gram, keys_only=False).join(few(shared, broadcast_keys), "anchor", "left_semi"))
    classes = known.groupBy("anchor", "kind").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("n").alias("n"))
    classes = stored(classes.select("anchor", "kind", F.col("f.doc_id").alias("f_doc"), F.col("f.start").alias("f_start"), "n"))
    whole = (known.join(classes.drop("n"), ["anchor", "kind"])
             .where("doc_id <> f_doc OR start <> f_start").select("doc_id", "start", "n"))

    several = classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    several = several.withColumn("parts", F.ceil(F.col("k") / hot).cast("long"))
    parts = classes.join(several, "anchor")
    total = several.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    part = F.when(F.col("parts") > 1, F.pmod("kind", "parts")).otherwise(F.lit(0))
    task = F.pmod(F.xxhash64("anchor", part), F.lit(max(1, -(-total // group)))).cast("long")
    wanted = (parts.select(F.col("f_doc").alias("doc_id"), F.struct(
        task.alias("task"), (F.col("parts") > 1).alias("spread"), F.col("f_start").alias("start"), "n").alias("w"))
        .groupBy("doc_id").agg(F.collect_list("w").alias("wanted")))
    slices = cut_slices(docs.join(few(stored(wanted), broadcast_keys // 16), "doc_id"), length)
    sorted_ = stored(slices.groupBy("task").applyInArrow(
        sort_group(length), "doc_id long, start long, first boolean, h1 long, h2 long"))
    firsts = sorted_.where("first")
    earliest = firsts.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("c")).where("c > 1")
    across = firsts.join(earliest, ["h1", "h2"]).where("doc_id <> f.doc_id OR start <> f.start")
    one = F.lit(1).cast("long").alias("n")
    return whole.unionAll(sorted_.where("NOT first").select("doc_id", "start", one)).unionAll(across.select("doc_id", "start", one))


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, hot: int = HOT,
                   broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = id_text(documents)
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        unnamed = docs.where("doc_id IS NULL")
        docs = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).unionAll(unnamed)
    starts = repeated_starts(docs.where("doc_id IS NOT NULL"), length, gram, group, hot, broadcast_keys)
    gone = starts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    def work(batches):
        for b in chunks(batches):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            rows = [spans_of(t, g, length) for t, g in zip(texts, b.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    return small_batches(joined).mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
