"""Scores of a log-bilinear language model trained with noise-contrastive estimation (operator 6).

Tokens are lower-cased words and one end per text.  Counts are taken over all
training texts by Spark.  The ``TARGETS`` most frequent words with at least
``LEAST`` training tokens have vectors of their own, as context and as target;
so has the end.  All other words fall by their hash into at most ``BUCKETS``
buckets, which have vectors too, and a word of a bucket further costs its
smoothed share of the bucket's tokens:

    s(x | u, v) = (R[u] C1 + R[v] C2) . Q[x] + b[x]

The targets, by frequency, are the leaves of a tree of three levels cut at
equal shares of all tokens, so a token costs about three times the cube root
of the vocabulary: P(w | u, v) is the product of the softmaxes of s over the
children of each node on the way to w.  Each of them is normalised exactly, in
blocks of matrix products.

The size of the model is bounded, the work that fits it grows with the corpus
and is done by the executors: children of a node are told from noise drawn from
their frequencies (of few children, from each as often as it is expected to be
drawn), on every training token.  The training texts are dealt to
rounds.  In a round every task starts from the same model, trains on all tokens
of its own texts and gives the rows that it changed; each row moves by the mean
change of the tasks that touched it, added up block by block in a shuffle.  The
driver holds one model and no tokens.  A corpus of fewer than ``STEPS`` x
``BATCH`` tokens is gone through several times in one task.

The ``TABLE`` most frequent words go to every worker with their counts; rarer
words are joined with the counts by Spark.

Defined results: a null or empty text is the end alone; without training texts
every count is 0 and all targets are equally likely; a null doc_id never
trains and is not held out; repeated rows are counted and scored one by one;
a text of any length is scored whole, ``SCORE_TOKENS`` tokens at a time.
"""

from __future__ import annotations

import copy
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import CHUNK_BYTES, chunks, crc_mod, id_text, small_batches
from riskloom.llm.hashing import FOLD, U, word_hashes
from riskloom.session import cut_lineage

#: Training tokens from which on a word has its own vectors.
LEAST = 5
#: Most words with vectors of their own, most buckets of rarer words (a power of two) and training tokens wanted in a bucket.
TARGETS, BUCKETS, BUCKET_TOKENS = 131_072, 4_096, 256
TABLE = 1 << 19
DIM = 24
#: Steps of a small corpus at least, tokens of a step, and of a step of a corpus that is trained on in rounds.
STEPS = 1_000
BATCH, ROUND_BATCH = 2_048, 4_096
#: Multiplications of a matrix product whose result stays in the processor cache, and runs up to which each is summed alone.
PIECE, FEW_RUNS = 6_000_000, 32
#: Cells of equal shares that tell where to look for a draw, and entries that are looked at one by one.
CELLS, LOOKS = 1 << 19, 8
#: Rounds of training, tokens of a task in a round, most tasks in a round, tokens that a task holds at once.
ROUNDS, TASK_DRAWS, MOST_TASKS, HELD_DRAWS = 6, 2_400_000, 1_024, 1 << 19
#: Rows of a block of changes.
CHANGED = 4_096
#: Noise of a batch among the children of each node that it meets, by level.
NOISE = 64, 32, 4
#: Children of any node up to which a level takes each child as noise, as often as it is expected, and draws none.
ALL_CHILDREN = 64
#: Draws of a parent from which on they are multiplied at once.
LONG_RUN = 16
RATE = 0.1
#: Text and tokens that are scored together, and scores that exp takes without a shift.
SCORE_BYTES, SCORE_TOKENS, SAFE = 4_000_000, 1 << 18, 75
HELD_OUT_MOD, HELD_OUT_REST = 7, 2
#: Counted words that a task holds before it hands them on.
HOLD = 4_000_000


def hashes_of(batch: pa.RecordBatch, piece: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word; a batch of many texts in pieces of about ``piece`` bytes, if that is given."""
    if piece:
        parts, at = [], 0
        for part in chunks([batch], limit=piece):
            hashes, owner = hashes_of(part)
            parts.append((hashes, owner + at))
            at += part.num_rows
        if parts:
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    texts = [t.encode().translate(FOLD) if t else b"" for t in batch.column("text").to_pylist()]
    return word_hashes(texts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order, first, found = grouped(np.concatenate(keys))
    return found, np.add.reduceat(np.concatenate(counts).take(order), first)


def counted(frame: DataFrame, keys_of) -> DataFrame:
    """key, c: sums over all rows of the keys that ``keys_of(batch)`` gives, pre-added in every task."""

    def work(batches):
        keys, counts, held = [], [], 0
        for b in chunks(batches):
            k, c = np.unique(keys_of(b), return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HOLD:
                k, c = summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > HOLD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["key", "c"])
                    keys, counts, held = [], [], 0
        if keys:
            k, c = summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["key", "c"])

    # dealt by key first: adding up in every task once more would find next to nothing to add
    return small_batches(frame).mapInArrow(work, "key long, c long").repartition("key").groupBy("key").agg(F.sum("c").alias("c"))


def floor_of(counts: DataFrame, limit: int) -> int:
    """The lowest count at which all words of at least that count are at most ``limit``."""
    sizes = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count("*").alias("n"))
    fit, floor = 0, 1_000_001
    for r in sizes.orderBy(F.desc("c")).limit(limit + 1).collect():
        if fit + r["n"] > limit:
            break
        fit, floor = fit + r["n"], r["c"]
    return floor


class Tree:
    """Targets 0..n-1, most frequent first, under nodes of about equal shares of all tokens; ``fan`` children a node."""

    def __init__(self, freq: np.ndarray, fan: int | None = None) -> None:
        n = len(freq)
        fan = fan or max(2, round(n ** (1 / 3)))
        upto = np.cumsum(freq, dtype=np.float64)
        cell = np.minimum((upto - freq / 2) / upto[-1] * fan * fan, fan * fan - 1).astype(np.int64)
        cells, low = np.unique(cell, return_inverse=True)
        tops, mid = np.unique(cells // fan, return_inverse=True)
        #: for every target its entry on each level, and for every level where the children of each parent begin
        self.paths = [mid[low].astype(np.int32), low.astype(np.int32), np.arange(n, dtype=np.int32)]
        begin = lambda parent, size: np.searchsorted(parent, np.arange(size + 1))
        self.begin = [np.array([0, len(tops)]), begin(mid, len(tops)), begin(low, len(cells))]
        self.freq = [np.bincount(path, weights=freq) for path in self.paths]

    def parents(self, level: int, targets: np.ndarray) -> np.ndarray:
        return self.paths[level - 1][targets] if level else np.zeros(len(targets), dtype=np.int32)


def summed_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, sum of the rows of each)."""
    order, first, at = grouped(at)
    return at, run_sums(rows, first, order)


def grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the numbers, where each distinct one begins in it, the distinct numbers)."""
    order = np.argsort(at)
    at = at[order]
    first = runs(at)
    return order, first, at[first]


def runs(at: np.ndarray) -> np.ndarray:
    """Where each distinct one of the sorted numbers begins."""
    new = np.ones(len(at), dtype=bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    return np.flatnonzero(new)


def sizes(first: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the runs of ``n`` numbers."""
    out = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=out[:-1])
    out[-1:] = n - first[-1:]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Computed in ``x`` itself."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_sums(rows: np.ndarray, first: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows (in this order) of each run; most runs are short, so all runs' second rows are added at once, then the
    third, until few runs are left."""
    at = (lambda x: rows.take(x, axis=0)) if order is None else (lambda x: rows.take(order.take(x), axis=0))
    out = at(first)
    size = sizes(first, len(rows))
    longer = np.flatnonzero(size > 1)
    k = 1
    while len(longer) > FEW_RUNS:
        out[longer] += at(first.take(longer) + k)
        k += 1
        longer = longer[size.take(longer) > k]
    if len(longer):
        ones = np.ones(int(size.max()), dtype=rows.dtype)
        for x, i, n in zip(longer.tolist(), first[longer].tolist(), size[longer].tolist(), strict=True):
            rest = rows[i + k:i + n] if order is None else rows.take(order[i + k:i + n], axis=0)
            out[x] += ones[:n - k] @ rest
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, in pieces that the processor cache holds."""
    n = max(1, PIECE // b.size)
    if len(a) <= n:
        return a @ b
    out = np.empty((len(a), b.shape[1]), dtype=a.dtype)
    for i in range(0, len(a), n):
        np.matmul(a[i:i + n], b, out=out[i:i + n])
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, likewise."""
    n = max(1, PIECE // (a.shape[1] * b.shape[1]))
    return a.T @ b if len(a) <= n else sum(a[i:i + n].T @ b[i:i + n] for i in range(0, len(a), n))


class Model:
    """Vectors of contexts (targets and, last, the start of a text) and of the entries of the tree."""

    def __init__(self, tree: Tree, seed: int = 11) -> None:
        self.rng = np.random.default_rng(seed)
        n = len(tree.paths[0])
        self.tree, self.start = tree, n
        self.r = self.rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32)
        self.c = [np.eye(DIM, dtype=np.float32) * np.float32(0.5) for _ in range(2)]
        self.sides, self.rows, self.cells, self.batch = None, None, {}, BATCH
        self.q, self.b, self.upto = [], [], []
        for freq, begin in zip(tree.freq, tree.begin, strict=True):
            upto = np.append(0.0, np.cumsum(freq))
            total = np.repeat(upto[begin[1:]] - upto[begin[:-1]], np.diff(begin))
            self.q.append(np.zeros((len(freq), DIM), dtype=np.float32))
            self.b.append(np.log(freq / total).astype(np.float32))
            self.upto.append(upto)
        self.noise = [b.copy() for b in self.b]
        self.seen = {"r": np.zeros(n + 1, dtype=np.float32)}

    def step(self, name: str, param: np.ndarray, at: np.ndarray, rows: np.ndarray, rate: float) -> None:
        """Adagrad with one scale a row, on the rows that the batch touches."""
        self.move(name, param, *summed_rows(at, rows), rate)

    def move(self, name: str, param: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        if name not in self.seen:
            self.seen[name] = np.zeros(len(param), dtype=np.float32)
        scale = self.seen[name]
        at = slice(None) if len(at) == len(param) else at
        size = scale[at] + (np.einsum("nd,nd->n", g, g) / g.shape[1] if g.ndim == 2 else g * g)
        scale[at] = size
        np.sqrt(size, out=size)
        size += np.float32(1e-6)
        np.divide(np.float32(-rate), size, out=size)
        change = g * (size[:, None] if g.ndim == 2 else size)
        if isinstance(at, slice):
            param += change
        else:
            change += param.take(at, axis=0)
            param[at] = change

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray, rate: float) -> None:
        order = np.argsort(w)  # numbers of targets, their entries and the parents of these rise together
        u, v, w, weight = (x.take(order) for x in (u, v, w, weight))
        sides = [grouped(x) for x in (u, v)]  # a word that is met several times is multiplied once
        vectors = [self.r.take(at, axis=0) for _, _, at in sides]
        h = np.ones((len(w), DIM + 1), dtype=np.float32)  # the last column is the bias's
        parts = []
        for (order, first, at), x, c in zip(sides, vectors, self.c, strict=True):
            place = np.empty(len(w), dtype=np.int64)
            place[order] = np.repeat(np.arange(len(at)), sizes(first, len(w)))
            parts.append(product(x, c).take(place, axis=0))
        np.add(*parts, out=h[:, :DIM])
        gh = np.zeros((len(w), DIM), dtype=np.float32)
        for level in range(3):
            begin, parent = self.tree.begin[level], self.tree.parents(level, w)
            some = np.flatnonzero(begin.take(parent + 1) - begin.take(parent) > 1)
            if len(some) == len(w):
                gh += self.learn_level(level, h, w, parent, weight, rate)
            elif len(some):
                gh[some] += self.learn_level(level, *(x.take(some, axis=0) for x in (h, w, parent, weight)), rate)
        sums = [run_sums(gh, first, order) for order, first, _ in sides]
        back = [product(x, c.T) for x, c in zip(sums, self.c, strict=True)]
        for k, x in enumerate(vectors):
            self.move(f"c{k}", self.c[k], np.arange(DIM), inner(x, sums[k]), rate / 10)
        self.step("r", self.r, np.concatenate([at for _, _, at in sides]), np.concatenate(back), rate)

    def draws(self, level: int, parents: np.ndarray) -> np.ndarray:
        """Noise for each of the parents: children drawn by their frequency."""
        upto, begin = self.upto[level], self.tree.begin[level]
        low, high = begin[parents][:, None], begin[parents + 1][:, None]
        x = upto[low] + self.rng.random((len(parents), NOISE[level])) * (upto[high] - upto[low])
        if level not in self.cells:  # the entry where each of many equal shares begins
            self.cells[level] = (np.searchsorted(upto, np.arange(CELLS) * (upto[-1] / CELLS), side="right") - 1).astype(np.int32)
        drawn = np.clip(self.cells[level].take((x * (CELLS / upto[-1])).astype(np.int64), mode="clip"), low, high - 1)
        flat, x, last = drawn.reshape(-1), x.reshape(-1), np.repeat(high.reshape(-1) - 1, NOISE[level])
        before = np.arange(len(flat))
        for _ in range(LOOKS):
            before = before[(upto.take(flat.take(before) + 1) <= x.take(before)) & (flat.take(before) < last.take(before))]
            if not len(before):
                return drawn
            flat[before] += 1
        flat[before] = np.minimum(np.searchsorted(upto, x[before], side="right") - 1, last[before])
        return drawn

    def learn_level(self, level: int, h: np.ndarray, w: np.ndarray, parent: np.ndarray, weight: np.ndarray,
                    rate: float) -> np.ndarray:
        """Tells the true children from noise that the draws of a parent share; gives the change wanted of ``h``."""
        begin, q, b = self.tree.begin[level], self.q[level], self.b[level]
        if level < 2 and np.diff(begin).max() <= ALL_CHILDREN:  # the targets themselves are always told from draws
            return self.learn_children(level, h, w, parent, weight, rate)
        first, true = runs(parent), self.tree.paths[level].take(w)
        size = sizes(first, len(w))
        drawn = self.draws(level, parent.take(first))
        by = np.argsort(-size)  # parents of many draws first
        first, size, drawn = first.take(by), size.take(by), drawn.take(by, axis=0)
        known = np.float32(np.log(NOISE[level]))
        rows = np.empty((*drawn.shape, DIM + 1), dtype=np.float32)
        rows[:, :, :DIM] = q.take(drawn, axis=0)
        rows[:, :, DIM] = b.take(drawn) - self.noise[level].take(drawn) - known
        own = q.take(true, axis=0)
        up = np.einsum("nd,nd->n", own, h[:, :DIM])
        up += b.take(true) - self.noise[level].take(true) - known
        up = (sigmoid(up) - 1) * weight
        own *= up[:, None]  # from here on the change wanted of h
        begun = runs(true)
        changes = np.zeros((len(begun) + drawn.size, DIM + 1), dtype=np.float32)  # of the true children, then of the noise
        changes[:len(begun)] = run_sums(up[:, None] * h, begun)
        moved = changes[len(begun):].reshape(rows.shape)
        many = int(np.count_nonzero(size >= LONG_RUN))
        for x, (i, n) in enumerate(zip(first[:many].tolist(), size[:many].tolist(), strict=True)):
            j = i + n
            down = sigmoid(product(h[i:j], rows[x].T))
            down *= weight[i:j, None]
            own[i:j] += product(down, rows[x, :, :DIM])
            moved[x] = inner(down, h[i:j])
        some = []
        for k in range(int(size[many:].max(initial=0))):  # the next draw of every other parent that has one
            last = int(np.count_nonzero(size > k))
            it, near = first[many:last] + k, rows[many:last]
            x = h.take(it, axis=0)
            down = sigmoid(np.einsum("nkd,nd->nk", near, x))
            down *= weight.take(it)[:, None]
            some.append((it, np.einsum("nk,nkd->nd", down, near[:, :, :DIM])))
            moved[many:last] += down[:, :, None] * x[:, None, :]
        if some:
            it, change = (np.concatenate(x) for x in zip(*some, strict=True))
            own[it] += change
        at, moved = summed_rows(np.concatenate([true[begun], drawn.ravel()]), changes)
        self.move(f"q{level}", q, at, moved[:, :DIM], rate)
        self.move(f"b{level}", b, at, moved[:, DIM], rate)
        return own

    def learn_children(self, level: int, h: np.ndarray, w: np.ndarray, parent: np.ndarray, weight: np.ndarray,
                       rate: float) -> np.ndarray:
        """The same with the noise that is expected in place of drawn noise: each child of a node, by its frequency."""
        begin, q, b = self.tree.begin[level], self.q[level], self.b[level]
        first = runs(parent)
        parents, size = parent.take(first), sizes(first, len(w))
        low, high = begin.take(parents), begin.take(parents + 1)
        known = self.noise[level] + np.float32(np.log(NOISE[level]))  # ln of how often a child is noise
        often = np.exp(known)
        half = np.column_stack([q, b - known]) / 2  # 1 + tanh(x / 2) is twice the sigmoid of x
        shares = q * (often / 2)[:, None]
        ends = np.cumsum(size * (high - low))
        scores = np.empty(int(ends[-1]), dtype=np.float32)  # of all children of its parent for each draw
        cuts = [(i, i + n, x, y, scores[e - n * (y - x):e].reshape(n, y - x)) for i, n, x, y, e in zip(
            first.tolist(), size.tolist(), low.tolist(), high.tolist(), ends.tolist(), strict=True)]
        for i, j, x, y, part in cuts:
            np.matmul(h[i:j], half[x:y].T, out=part)
        np.tanh(scores, out=scores)
        scores += 1
        width = np.repeat(high - low, size)
        true = self.tree.paths[level].take(w)
        it = np.cumsum(width) - width + true - np.repeat(low, size)  # the true child of each draw
        up = scores.take(it)
        scores[it] = up + (up - 2) / often.take(true)
        if (weight != 1).any():
            scores *= np.repeat(weight, width)
        own = np.empty((len(w), DIM), dtype=np.float32)
        moved = np.empty((int((high - low).sum()), DIM + 1), dtype=np.float32)
        at = 0
        for i, j, x, y, part in cuts:
            np.matmul(part, shares[x:y], out=own[i:j])
            np.matmul(part.T, h[i:j], out=moved[at:at + y - x])
            at += y - x
        at = np.flatnonzero(np.repeat(np.bincount(parents, minlength=len(begin) - 1), np.diff(begin)))
        moved *= (often.take(at) / 2)[:, None]
        self.move(f"q{level}", q, at, moved[:, :DIM], rate)
        self.move(f"b{level}", b, at, moved[:, DIM], rate)
        return own

    def train(self, source, n_draws: int) -> None:
        """``source`` is (training texts, words), or a function that gives one shard of (u, v, w, weight) arrays."""
        if callable(source):
            self.passes(source(), n_draws, STEPS)
        else:
            learn_in_rounds(self, source, n_draws)

    def passes(self, shard: tuple[np.ndarray, ...], n_draws: int, steps: int) -> None:
        """Goes through the shard until ``steps`` batches are done at least."""
        again = -(-BATCH // max(1, n_draws))  # a handful of draws is repeated inside a batch
        rounds = -(-steps * BATCH // max(1, n_draws * again))
        shard = tuple(np.tile(x, again) for x in shard)
        for k in range(rounds if n_draws else 0):
            self.go_through(shard, lambda part: RATE * max(0.05, 1 - (k + part) / rounds))  # noqa: B023

    def go_through(self, shard: tuple[np.ndarray, ...], rate) -> None:
        *numbers, weight = shard
        numbers = np.stack(numbers, axis=1)  # the numbers of a token lie together
        order = self.rng.permutation(len(weight))
        for i in range(0, len(weight), self.batch):
            o = order[i:i + self.batch]
            self.learn(*numbers.take(o, axis=0).T, weight.take(o), rate(i / len(weight)))

    def arrays(self) -> dict[str, np.ndarray]:
        """Everything that is learned, by the names that ``step`` uses."""
        out = {"r": self.r}
        for name, parts in (("c", self.c), ("q", self.q), ("b", self.b)):
            out.update({f"{name}{k}": part for k, part in enumerate(parts)})
        return out

    def scales(self, name: str) -> np.ndarray:
        return self.seen.setdefault(name, np.zeros(len(self.arrays()[name]), dtype=np.float32))

    def changes(self, base: Model):
        """(name, block, row numbers, changes of the rows, changes of their scales) of what differs from ``base``."""
        before = base.arrays()
        for name, param in self.arrays().items():
            grown = self.scales(name) - base.scales(name)
            at = np.flatnonzero(grown).astype(np.int32)
            blocks = at // CHANGED
            cuts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(at)) if len(at) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                rows = at[low:high]
                yield name, int(blocks[low]), rows, (param[rows] - before[name][rows]).reshape(len(rows), -1), grown[rows]

    def add(self, name: str, at: np.ndarray, rows: np.ndarray, grown: np.ndarray) -> None:
        param = self.arrays()[name]
        param[at] += rows.reshape(len(at), *param.shape[1:])
        self.scales(name)[at] += grown

    def products(self) -> list[np.ndarray]:
        """What every word adds to a context, as the first and as the second word; the last column is the bias's."""
        return [np.column_stack([product(self.r, c), np.full(len(self.r), one, dtype=np.float32)])
                for c, one in zip(self.c, (1, 0), strict=True)]

    def entries(self) -> list[tuple[np.ndarray, float, float]]:
        """Of every level the vectors with the bias behind them, the longest vector's square and the largest bias."""
        return [(np.column_stack([q, b]), float((q * q).sum(1).max(initial=0)), float(np.abs(b).max(initial=0)))
                for q, b in zip(self.q, self.b, strict=True)]

    def log_probs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | u, v) of each."""
        out, sides, entries = np.empty(len(w)), self.sides or self.products(), self.rows or self.entries()
        pieces = max(1, round(len(w) / SCORE_TOKENS))
        for low, high in pairwise([len(w) * k // pieces for k in range(pieces + 1)]):
            order = np.argsort(w[low:high]) + low  # the parents on every level rise with the target
            h = sides[0].take(u[order], axis=0)
            h += sides[1].take(v[order], axis=0)
            longest = float(np.einsum("nd,nd->n", h, h).max(initial=1)) - 1
            out[order] = sum(self.level(level, h, longest, w[order], *entries[level]) for level in range(3))
        return out / np.log(10)

    def level(self, level: int, h: np.ndarray, longest: float, w: np.ndarray, rows: np.ndarray, longest_row: float,
              bias: float) -> np.ndarray:
        """ln P(entry | parent) for sorted targets ``w``."""
        begin, parent = self.tree.begin[level], self.tree.parents(level, w)
        # no score is beyond this one: exp needs no shift by each row's largest score while it is small
        safe = (longest * longest_row) ** 0.5 + bias <= SAFE
        own, total = np.zeros(len(w), dtype=np.float32), np.ones(len(w), dtype=np.float32)  # an only child is certain
        first = runs(parent)
        low, high = begin.take(parent.take(first)), begin.take(parent.take(first) + 1)
        some = np.flatnonzero(high - low > 1)
        child = self.tree.paths[level].take(w) - begin.take(parent)
        ones = np.ones(int((high - low).max(initial=0)), dtype=np.float32)
        for i, n, x, y in zip(first[some].tolist(), sizes(first, len(w))[some].tolist(), low[some].tolist(), high[some].tolist(),
                              strict=True):
            part, width = rows[x:y].T, max(1, PIECE // rows[x:y].size)
            for at in range(i, i + n, width):
                to = min(at + width, i + n)
                s = h[at:to] @ part
                if not safe:
                    s -= s.max(1, keepdims=True)
                own[at:to] = s.reshape(-1).take(child[at:to] + np.arange(0, s.size, y - x))
                np.exp(s, out=s)
                np.matmul(s, ones[:y - x], out=total[at:to])
        return own - np.log(total)


CHANGE_SCHEMA = "name string, block int, at binary, rows binary, grown binary"


def change_batch(changes) -> pa.RecordBatch:
    name, block, *arrays = zip(*changes, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(name), pa.array(block, pa.int32()),
         *(pa.array([np.ascontiguousarray(x).tobytes() for x in column], pa.binary()) for column in arrays)],
        names=["name", "block", "at", "rows", "grown"])


def numbers_of(name: str, at: bytes, rows: bytes, grown: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(at, dtype=np.int32)
    return at, np.frombuffer(rows, dtype=np.float32).reshape(len(at), -1), np.frombuffer(grown, dtype=np.float32)


def mean_change(table: pa.Table) -> pa.Table:
    """One block's changes by any number of tasks: each row's mean over the tasks that changed it."""
    parts = [numbers_of(r["name"], r["at"], r["rows"], r["grown"]) for r in table.to_pylist()]
    values = [np.column_stack([rows, grown, np.ones(len(at), dtype=np.float32)]) for at, rows, grown in parts]
    at, total = summed_rows(np.concatenate([p[0] for p in parts]), np.concatenate(values))
    mean = total[:, :-1] / total[:, -1:]
    return pa.Table.from_batches([change_batch([(
        table.column("name")[0].as_py(), table.column("block")[0].as_py(), at, mean[:, :-1], mean[:, -1])])])


def learn_in_rounds(model: Model, source: tuple[DataFrame, Words], n_tokens: int) -> None:
    """Trains ``model`` on every token of the texts, on executors; the driver holds the model alone, whose size is
    bounded by its vocabulary's."""
    training, words = source
    few_draws = n_tokens < STEPS * BATCH
    rounds = 1 if few_draws else ROUNDS
    while n_tokens > rounds * MOST_TASKS * TASK_DRAWS:
        rounds += ROUNDS
    tasks = max(1, -(-n_tokens // (rounds * TASK_DRAWS)))
    steps = STEPS
    for k in range(rounds if n_tokens else 0):
        sent = training.sparkSession.sparkContext.broadcast((model, words))

        def work(batches, sent=sent, k=k):
            base, words = sent.value
            mine = copy.deepcopy(base)
            mine.batch = BATCH if few_draws else ROUND_BATCH
            mine.rng = np.random.default_rng([k, TaskContext.get().partitionId()])
            held, n = [], 0

            def learn():
                u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
                shard = u, v, w, np.ones(len(w), dtype=np.float32)
                if few_draws:
                    mine.passes(shard, n, steps)
                else:
                    mine.go_through(shard, lambda _: RATE * max(0.05, 1 - k / rounds))

            for b in chunks(batches):
                hashes, owner = hashes_of(b)
                held.append(words.trigrams(words.of(hashes), owner, b.num_rows)[:3])
                n += len(held[-1][2])
                if n >= HELD_DRAWS and not few_draws:
                    learn()
                    held, n = [], 0
            if n:
                learn()
            changes = list(mine.changes(base))
            if changes:
                yield change_batch(changes)

        part = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        changed = (small_batches(part.coalesce(tasks)).mapInArrow(work, CHANGE_SCHEMA)
                   .groupBy("name", "block").applyInArrow(mean_change, CHANGE_SCHEMA))
        for b in changed.toArrow().to_batches():
            for r in b.to_pylist():
                model.add(r["name"], *numbers_of(r["name"], r["at"], r["rows"], r["grown"]))
        sent.destroy()  # also the copy that the driver keeps


class Places:
    """Where a hash is in sorted distinct ``keys``, if it is there: their first bits tell where to begin."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = U(64 - bits)
        size = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = (np.cumsum(size) - size).astype(np.int32)
        self.most = int(size.max())

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """A place of each hash, that holds it if any does."""
        keys, last = self.keys, len(self.keys) - 1
        at = np.minimum(self.begin.take((hashes >> self.shift).view(np.int64)), last)
        less = np.flatnonzero(keys.take(at) < hashes)
        for _ in range(self.most):
            if not len(less):
                break
            at[less] = np.minimum(at[less] + 1, last)
            less = less[(keys.take(at[less]) < hashes[less]) & (at[less] < last)]
        return at


class Words:
    """Numbers of words with vectors, by frequency among the targets; all rarer words are told by buckets of hashes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, distinct: np.ndarray, n_ends: int) -> None:
        n_buckets = len(tokens)  # a power of two; tokens and distinct words of each bucket
        freq = np.concatenate([counts, tokens, [n_ends]]).astype(np.float64)
        order = np.lexsort((np.concatenate([hashes, np.arange(n_buckets + 1, dtype=U)]), -freq))
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(len(order))
        self.freq = np.maximum(freq[order], 1.0)
        self.buckets, self.end, self.start = number[len(counts):-1], int(number[-1]), len(order)
        #: log10 of what the share of a bucket's word is divided by; 0 for a word with vectors
        self.spread = np.zeros(len(order))
        self.spread[self.buckets] = np.log10(tokens + distinct + 1.0)
        self.rare = np.zeros(len(order), dtype=bool)
        self.rare[self.buckets] = True
        by = np.argsort(hashes)
        self.hashes, self.number = hashes[by], number[:len(counts)][by]
        self.places = Places(self.hashes)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        other = self.buckets[(hashes & U(len(self.buckets) - 1)).astype(np.int64)]
        if not len(self.hashes):
            return other
        at = self.places.of(hashes)
        return np.where(self.hashes[at] == hashes, self.number[at], other).astype(np.int32)

    def trigrams(self, numbers: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, ...]:
        """(two before, one before, target, text number, place in the text) of every token, ends included."""
        counts = np.bincount(owner, minlength=n_texts)
        first = np.cumsum(counts + 3) - (counts + 3)  # each text: start, start, words, end
        line = np.full(int((counts + 3).sum()), self.start, dtype=np.int32)
        line[np.arange(len(numbers)) + 3 * owner + 2] = numbers
        line[first + counts + 2] = self.end
        text = np.repeat(np.arange(n_texts), counts + 3)
        at = np.ones(len(line), dtype=bool)
        at[first] = at[first + 1] = False
        at = np.flatnonzero(at)
        return line[at - 2], line[at - 1], line[at], text[at], at - first[text[at]] - 2


def train(codes: np.ndarray, counts: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """log10 P(target | two before) as a matrix of all pairs by all targets but the start, from trigram counts."""
    outs = size - 1
    u, v, w = codes // (size * size), codes // size % size, codes % size
    freq = np.bincount(w, weights=counts, minlength=outs) + 1e-3
    order = np.argsort(-freq, kind="stable")
    number = np.append(np.empty(outs, dtype=np.int64), outs)
    number[order] = np.arange(outs)
    model = Model(Tree(freq[order]), seed)
    model.train(lambda: (number[u], number[v], number[w], np.asarray(counts, dtype=np.float32)), len(codes))
    pairs = np.repeat(np.arange(size * size), outs)
    return model.log_probs(number[pairs // size], number[pairs % size],
                           np.tile(number[:outs], size * size)).reshape(size * size, outs)


def fitted(training: DataFrame, words: Words, n_tokens: int, classes: int | None) -> Model:
    model = Model(Tree(words.freq, classes))
    if n_tokens:
        model.train((training, words), n_tokens)
    model.sides, model.rows = model.products(), model.entries()
    model.seen, model.noise, model.upto, model.cells, model.q, model.b = {}, [], [], {}, [], []  # only needed to learn
    return model


def bucket_sums(counts: DataFrame, floor: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of every bucket, over the words below ``floor``."""
    tokens, distinct = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
    for r in (counts.where(F.col("c") < floor).groupBy(F.pmod("key", F.lit(n_buckets)).alias("k"))
              .agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()):
        tokens[r["k"]], distinct[r["k"]] = r["c"], r["n"]
    return tokens, distinct


def score(documents: DataFrame, classes: int | None = None, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``documents``.

    ``classes`` is the number of children a node of the tree has, about the cube root of the vocabulary by default.
    """
    rest = crc_mod("doc_id", HELD_OUT_MOD)
    docs = id_text(documents)
    training = docs.where(rest != HELD_OUT_REST)
    counts = cut_lineage(counted(training, lambda b: hashes_of(b)[0]))
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = training.select("doc_id").count()
    least = max(LEAST, floor_of(counts, min(table, TARGETS)))
    near = counts.where(F.col("c") >= min(least, floor_of(counts, table))).select("key", "c").toArrow()
    near_keys = near.column("key").to_numpy().astype(np.int64).view(U)
    near_counts = near.column("c").to_numpy().astype(np.int64)
    own = near_counts >= least
    n_buckets = 1
    while n_buckets < BUCKETS and 2 * n_buckets * BUCKET_TOKENS <= n_words - int(near_counts[own].sum()):
        n_buckets *= 2
    words = Words(near_keys[own], near_counts[own], *bucket_sums(counts, least, n_buckets), n_ends)
    model = fitted(training, words, n_words + n_ends, classes)

    vocabulary = n_distinct + (n_ends > 0)
    n_all = n_words + n_ends
    order = np.argsort(near_keys)
    share = documents.sparkSession.sparkContext.broadcast(
        (Places(near_keys[order]), np.log10(near_counts[order] + 1.0), words, model))

    def work(batches):
        places, logs, words, model = share.value
        keys = places.keys
        at = TaskContext.get().partitionId() << 33
        for b in chunks(batches, limit=SCORE_BYTES):
            n = b.num_rows
            hashes, owner = hashes_of(b, piece=CHUNK_BYTES)
            numbers = words.of(hashes)
            u, v, w, text, _ = words.trigrams(numbers, owner, n)
            lbl = np.bincount(text, weights=model.log_probs(u, v, w), minlength=n)
            place = places.of(hashes) if len(keys) else np.zeros(len(hashes), dtype=np.int32)
            hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
            value = np.where(hit, logs[place], 0.0) if len(keys) else np.zeros(len(hashes))
            other = words.rare[numbers]
            count = lambda mask: np.bincount(owner[mask], minlength=n)  # noqa: E731, B023
            total = lambda mask: np.bincount(owner[mask], weights=value[mask], minlength=n)  # noqa: E731, B023
            spread = np.bincount(owner, weights=words.spread[numbers], minlength=n)
            far, far_owner = hashes[~hit].view(np.int64), owner[~hit]
            order = np.lexsort((far, far_owner))
            far, far_owner = far[order], far_owner[order]
            new = np.ones(len(far), dtype=bool)  # a text names each of its far words once, with its number of places
            new[1:] = (far[1:] != far[:-1]) | (far_owner[1:] != far_owner[:-1])
            times, far, far_owner = sizes(np.flatnonzero(new), len(far)), far[new], far_owner[new]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(far_owner, minlength=n))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (far, times)]
            columns = [pa.array(np.arange(at, at + n)), b.column("doc_id"), b.column("held_out"),
                       pa.array(np.bincount(owner, minlength=n) + 1), pa.array(count(hit)),
                       *(pa.array(x.astype(np.float64)) for x in (total(hit), total(hit & other), lbl, spread)), *lists]
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=[
                "row", "doc_id", "held_out", "n_tokens", "n_hit", "logs", "logs_other", "lbl", "spread", "far", "times"])

    frame = docs.withColumn("held_out", F.coalesce(rest == HELD_OUT_REST, F.lit(False)))
    rows = cut_lineage(small_batches(frame).mapInArrow(
        work, "row long, doc_id long, held_out boolean, n_tokens long, n_hit long, logs double, "
              "logs_other double, lbl double, spread double, far array<long>, times array<long>"))
    each = rows.select("row", F.explode(F.arrays_zip(F.col("far").alias("key"), F.col("times").alias("k"))).alias("x"))
    far = (each.select("row", "x.key", "x.k").join(counts, "key")
           .groupBy("row").agg(F.sum("k").alias("far_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("far_logs")))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    all_logs = F.col("logs") + zero("far_logs") + F.lit(float(np.log10(n_ends + 1)))
    other_logs = F.col("logs_other") + zero("far_logs")
    return (rows.drop("far", "times").join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hit") + zero("far_known") + F.lit(int(n_ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * F.lit(float(np.log10(n_all + vocabulary + 1)))).alias("base_score"),
        (F.col("lbl") + other_logs - F.col("spread")).alias("score")))
