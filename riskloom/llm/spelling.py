"""Spelling variants of a corpus's words (operator 12): k-d trees over letter counts.

A word is a point: how often each letter occurs in it.  One edit moves a point
by an L1 distance of two at most: a replaced letter takes one occurrence away
and adds one, an inserted letter adds one.  So the words near a word are found
by range searches for each pair of lengths (l, l) and (l, l + 1) in a k-d tree
over the words of one length, and the order of the letters is verified last.

* Letters are dealt to ``DIMS`` dimensions and counts above two are cut, which
  only brings points closer.  A point is then 64 bits (dimension d occurs once,
  twice at least), a split of the tree is one bit, and the distance of a word
  to a box or to a point is a number of bits: those that the word alone has,
  and those that the other side alone has, must be one at most each.
* The top of every tree is built from a bounded sample of words
  (``SAMPLE``) and deals *all* words to shards of about ``SHARD`` words; a word
  is sent as a query to each shard whose side of the splits it can reach.
  Words that no split can part (anagrams) are dealt by their hash instead.
  A shard builds the rest of its tree and searches it with numpy.

Counts, near words and forms cover all words of all texts; the sample decides
about the shards only, so results do not depend on it.

Defined results: null and empty texts have no words; a null doc_id counts as
the empty text before the colon; repeated rows count each time.  Ties between
near words go to the smaller one in code-point order.  Very long texts are read
whole; a very long run is a word like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_text, small_batches
from riskloom.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD_CASE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DELETE_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
DIMS = 32
#: Words that shape the tops of the trees, about.
SAMPLE = 100_000
#: Words of one shard, about.
SHARD = 4_000
#: Words of a leaf of a shard's own tree.
LEAF = 32
#: Words that a counting task holds before it hands them on, in words and in characters.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000
#: Cells of an array that one step of a search or a verification fills, about.
CELLS = 4_000_000
U = np.uint64


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, the run's code point deleted where the hash says so."""
    head = f"{'' if doc_id is None else doc_id}:".encode()
    for run, n in Counter(RUN.findall(text.encode().translate(FOLD_CASE).decode())).items():
        h = zlib.crc32(head + run.encode())
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n: the words that occur often enough; tasks add up their own words first."""

    def work(batches):
        held, chars = defaultdict(int), 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for word, n in words_of(doc_id, text or ""):
                    if word not in held:
                        chars += len(word)
                    held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield batch()
                    held, chars = defaultdict(int), 0
        yield batch()

    counted = small_batches(id_text(documents)).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit points, lengths): bit d says that dimension d occurs, bit 32 + d that it occurs twice."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    dim = np.where((letters >= 97) & (letters <= 122), letters - 97, 26 + letters % (DIMS - 26))
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * DIMS + dim, minlength=len(words) * DIMS).reshape(-1, DIMS)
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(U).ravel(), lengths


def bit(codes: np.ndarray, b: int) -> np.ndarray:
    return (codes >> U(b)) & U(1) == 1


def best_split(codes: np.ndarray) -> int | None:
    """The bit that parts the points most evenly; None if they are all the same."""
    ones = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    gap = np.abs(2 * ones - len(codes))
    b = int(gap.argmin())
    return b if gap[b] < len(codes) else None


class Top:
    """The upper part of the tree of one length: splits, and shards as leaves."""

    def __init__(self, codes: np.ndarray, scale: float, first: int, size: int) -> None:
        """``scale``: words for each sampled one; ``first``: number of the first shard."""
        self.next = first
        self.root = self.grow(codes, scale, size)

    def grow(self, codes: np.ndarray, scale: float, size: int) -> tuple:
        b = best_split(codes) if len(codes) * scale > size else None
        if b is None:
            shards = max(1, ceil(len(codes) * scale / size))
            self.next += shards
            return "leaf", self.next - shards, shards
        with_bit = bit(codes, b)
        return b, self.grow(codes[~with_bit], scale, size), self.grow(codes[with_bit], scale, size)

    def members(self, codes: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The shard of each word; ``spread`` deals words over the shards of one leaf."""
        out = np.zeros(len(codes), dtype=np.int64)
        todo = [(self.root, np.arange(len(codes)))]
        while todo:
            node, rows = todo.pop()
            if node[0] == "leaf":
                out[rows] = node[1] + (spread[rows] % U(node[2])).astype(np.int64)
            else:
                side = bit(codes[rows], node[0])
                todo += [(node[1], rows[~side]), (node[2], rows[side])]
        return out

    def reached(self, codes: np.ndarray, lose: int, gain: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): the shards with words that lack at most ``lose`` bits of a row and have at most ``gain`` more."""
        found = []
        none = np.zeros(len(codes), dtype=np.int8)
        todo = [(self.root, np.arange(len(codes)), none, none)]
        while todo:
            node, rows, lost, gained = todo.pop()
            if node[0] == "leaf":
                found += [(rows, np.full(len(rows), node[1] + k)) for k in range(node[2])]
                continue
            side = bit(codes[rows], node[0])
            low, high = lost + side, gained + ~side
            a, b = low <= lose, high <= gain
            todo += [(node[1], rows[a], low[a], gained[a]), (node[2], rows[b], lost[b], high[b])]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tops(sample: list[tuple[int, int]], scale: float, shard: int) -> dict[int, Top]:
    """length -> upper tree, from sampled (length, point) pairs."""
    by_length = defaultdict(list)
    for length, code in sample:
        by_length[length].append(code)
    out, first = {}, 0
    for length in sorted(by_length):
        out[length] = Top(np.array(by_length[length], dtype=np.int64).view(U), scale, first, shard)
        first = out[length].next
    return out


def within(members: np.ndarray, queries: np.ndarray, lose: int, gain: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, member) pairs whose points differ by at most ``lose`` and ``gain`` bits: a k-d range search."""
    todo = [(np.arange(len(members)), np.arange(len(queries)))]
    while todo:
        own, asking = todo.pop()
        codes = members[own]
        always, ever, q = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes), queries[asking]
        asking = asking[(np.bitwise_count(q & ~ever) <= lose) & (np.bitwise_count(always & ~q) <= gain)]
        if not len(asking):
            continue
        b = best_split(codes) if len(own) > LEAF else None
        if b is not None:
            side = bit(codes, b)
            todo += [(own[~side], asking), (own[side], asking)]
            continue
        step = max(1, CELLS // len(own))
        for at in range(0, len(asking), step):
            part = asking[at:at + step]
            q = queries[part][:, None]
            x, y = np.nonzero((np.bitwise_count(q & ~codes) <= lose) & (np.bitwise_count(codes & ~q) <= gain))
            yield part[x], own[y]


def letters_of(words: list[str]) -> np.ndarray:
    """(word, place): code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``b`` is its row of ``a`` with one letter replaced, or (if longer by one) inserted."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    unlike = a != b[:, :n], (a != b[:, 1:])[:, ::-1]
    head, tail = (np.where(x.any(axis=1), x.argmax(axis=1), n) for x in unlike)
    return head + tail >= n


def near_pairs(members: tuple, queries: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs one edit apart; each side is (words, points), of one length, members as long or longer by one."""
    a, b = letters_of(queries[0]), letters_of(members[0])
    step = max(1, CELLS // b.shape[1])
    for x, y in within(members[1], queries[1], 0 if b.shape[1] > a.shape[1] else 1, 1):
        for at in range(0, len(x), step):
            p, q = x[at:at + step], y[at:at + step]
            same = one_edit(a[p], b[q])
            yield p[same], q[same]


NEAR = "word string, near string, near_n long"


def search_shard(table: pa.Table) -> pa.Table:
    """Near pairs, both ways, between the words of a shard and the words sent to it."""
    table = table.combine_chunks()
    words, n = np.array(table["word"].to_pylist(), dtype=object), table["n"].to_numpy()
    codes, lengths = table["code"].to_numpy().view(U), table["length"].to_numpy()
    own = table["member"].to_numpy(zero_copy_only=False)
    out = [[], [], []]
    mine = np.flatnonzero(own)
    if len(mine):
        longer = int(lengths[mine[0]])
        for length in (longer, longer - 1):
            asking = np.flatnonzero(~own & (lengths == length))
            if not len(asking):
                continue
            for x, y in near_pairs((words[mine].tolist(), codes[mine]), (words[asking].tolist(), codes[asking])):
                ways = [(asking[x], mine[y])] + [(mine[y], asking[x])] * (length < longer)
                for w, near in ways:
                    for column, values in zip(out, (words[w], words[near], n[near]), strict=True):
                        column.append(values)
    columns = [np.concatenate(c) if c else np.empty(0, dtype=object) for c in out]
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, total: int, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """word, near, near_n for every pair of words one edit apart, both ways.  ``words``: word, n, length, code."""
    every = max(1, total // sample)
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("length", "code")
    trees = tops([(r[0], r[1]) for r in picked.collect()], every, shard)
    handed = words.sparkSession.sparkContext.broadcast(trees)

    def work(batches):
        at_length = handed.value
        for b in batches:
            codes, lengths = b.column("code").to_numpy().view(U), b.column("length").to_numpy()
            spread = codes ^ np.array([zlib.crc32(w.encode()) for w in b.column("word").to_pylist()], dtype=U)
            rows, shards, own = [], [], []
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                tree = at_length.get(length)
                # a length without a sampled word is one shard of its own
                homes = tree.members(codes[at], spread[at]) if tree else np.full(len(at), -length)
                parts = [(at, homes, True)]
                for other, lose in ((length, 1), (length + 1, 0)):
                    tree = at_length.get(other)
                    r, s = tree.reached(codes[at], lose, 1) if tree else (np.arange(len(at)), np.full(len(at), -other))
                    parts.append((at[r], s, False))
                for r, s, member in parts:
                    rows.append(r)
                    shards.append(s)
                    own.append(np.full(len(r), member))
            if rows:
                sent = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(np.concatenate(own)), *sent.columns],
                                                 names=["shard", "member", *sent.schema.names])

    schema = "shard long, member boolean, word string, n long, length long, code long"
    dealt = small_batches(words.select("word", "n", "length", "code"), 10_000).mapInArrow(work, schema)
    return dealt.groupBy("shard").applyInArrow(search_shard, NEAR)


def with_points(words: DataFrame) -> DataFrame:
    """word, n, length, code."""

    def work(batches):
        for b in batches:
            codes, lengths = points(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths), pa.array(codes.view(np.int64))],
                                             names=["word", "n", "length", "code"])

    return small_batches(words.select("word", "n"), 10_000).mapInArrow(work, "word string, n long, length long, code long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached by following ``forms`` (word, form), by doubling the steps."""
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                        F.col("next").isNotNull().alias("moved")))
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(documents: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus that is long and frequent enough."""
    words = cut_lineage(with_points(word_counts(documents)))
    near = near_words(words, words.count(), sample, shard)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    each = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    taken = F.col("best.less") <= -2 * F.col("n")
    rows = cut_lineage(words.select("word", "n").join(each, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"),
        F.when(taken, -F.col("best.less")).alias("form_n")))
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
