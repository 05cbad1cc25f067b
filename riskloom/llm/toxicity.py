"""Toxicity score by a counterfactually regularised classifier (operator 2).

Logistic regression on the presence of words and word beginnings.  Besides the
log loss of the labels, training penalises the squared change of a training
text's logit when its identity terms are swapped for terms of another group,
so that naming a group does not by itself raise a score.

Training uses a bounded sample: the ``TRAIN_DOCS`` labelled documents of the
training fold with the smallest id hash, and at most ``FEATURES`` features (three
for each text of the rarer class) that tell the labels apart best in it.  Scoring reads every whole text.

Defined results: null, empty and wordless texts get the model's intercept;
labels that are null or conflict (repeated rows) count as their maximum; with
no training row, or one class only, every score is the smoothed share of toxic
rows (0 if there is none).  A null doc_id never trains and is not held out.
Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, crc_mod, id_text, small_batches
from riskloom.llm.hashing import FOLD_ALNUM, U, mix, range_hashes, word_bounds

TRAIN_DOCS = 20_000
FEATURES = 4_096
#: Features for each training text of the rarer class (more would only fit its noise); at least LEAST_FEATURES.
FEATURES_PER_TEXT = 3
LEAST_FEATURES = 64
LEAST_DOCS = 5
PREFIX_BYTES = 6
SWAP_WEIGHT = 1.0
RIDGE = 2e-4
STEPS = 300
THRESHOLD = 0.3
HELD_OUT_MOD, HELD_OUT_REST = 4, 2

# Neutral terms for groups of people; a swap replaces a term by the next one of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("immigrants", "natives"), ("immigrant", "native"),
    ("disabled", "abled"), ("elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {a.encode(): row[(i + 1) % len(row)].encode() for row in IDENTITY_TERMS for i, a in enumerate(row)}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, text number), each pair once: words, and beginnings of longer words."""
    data, starts, ends, owner = word_bounds(texts)
    words = range_hashes(data, starts, ends)
    longer = ends - starts > PREFIX_BYTES
    heads = mix(range_hashes(data, starts[longer], starts[longer] + PREFIX_BYTES) + U(1))
    return np.concatenate([words, heads]), np.concatenate([owner, owner[longer]])


def once(hashes: np.ndarray, owner: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in the sorted vocabulary) of the known features, each pair once."""
    if not len(vocabulary):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    pairs = np.unique(owner[known].astype(np.int64) * len(vocabulary) + at[known])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def swapped(text: bytes) -> bytes:
    return b" ".join(SWAP.get(w, w) for w in text.split())


def fold(text: str | None) -> bytes:
    return text.encode().translate(FOLD_ALNUM) if text else b""


def sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> pa.Table:
    """Hashed features of the training sample, as they are and with identity terms swapped."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT_REST))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded by the parameter
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def work(batches):
        for b in chunks(batches):
            texts = [fold(t) for t in b.column("text").to_pylist()]
            lists = []
            for kind in (texts, [swapped(t) if any(w in SWAP for w in set(t.split())) else b"" for t in texts]):
                hashes, owner = features(kind)
                parts = [np.unique(x).view(np.int64) for x in split(hashes, owner, len(texts))]
                lists.append(pa.array(parts, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *lists], names=["toxic", "plain", "swapped"])

    return small_batches(rows).mapInArrow(work, "toxic int, plain array<long>, swapped array<long>").toArrow()


def split(values: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(owner, kind="stable")
    return np.split(values[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])


def fit(table: pa.Table) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, sorted feature hashes, weights)."""
    nothing = np.empty(0, dtype=U)
    y = np.array(table.column("toxic").to_pylist(), dtype=np.float64)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if y.sum() else 0.0
        return (float(np.log(rate / (1 - rate))) if rate else -np.inf), nothing, np.empty(0)

    def flat(name):
        lists = table.column(name).combine_chunks()
        values = np.asarray(lists.flatten()).view(U)
        return values, np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))

    hashes, owner = flat("plain")
    found, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    toxic = np.bincount(back, weights=y[owner], minlength=len(found))
    # how far a feature's share of toxic texts lies from the overall share, in standard errors
    rate = y.mean()
    far = np.abs(toxic - count * rate) / np.sqrt(count * rate * (1 - rate))
    far[count < LEAST_DOCS] = -1
    fair = max(LEAST_FEATURES, int(FEATURES_PER_TEXT * min(y.sum(), len(y) - y.sum())))
    best = np.sort(np.argsort(-far, kind="stable")[: min(FEATURES, fair, int((far >= 0).sum()))])
    vocabulary = found[best]
    doc, col = once(hashes, owner, vocabulary)
    other, its = once(*flat("swapped"), vocabulary)
    moved = np.unique(other)
    delta_doc = np.concatenate([other, doc[np.isin(doc, moved)]])
    delta_col = np.concatenate([its, col[np.isin(doc, moved)]])
    sign = np.concatenate([np.ones(len(other)), -np.ones(len(delta_doc) - len(other))])

    n, k = len(y), len(vocabulary)
    w, b = np.zeros(k), float(np.log(rate / (1 - rate)))
    m1, m2, mb1, mb2 = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(doc, weights=w[col], minlength=n))))
        err = (p - y) / n
        g = np.bincount(col, weights=err[doc], minlength=k) + RIDGE * w
        if len(moved):
            change = np.bincount(delta_doc, weights=sign * w[delta_col], minlength=n)
            g += 2 * SWAP_WEIGHT / n * np.bincount(delta_col, weights=sign * change[delta_doc], minlength=k)
        gb = err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        rate_t = 0.05 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= rate_t * m1 / (np.sqrt(m2) + 1e-8)
        b -= rate_t * mb1 / (np.sqrt(mb2) + 1e-8)
    return float(b), vocabulary, w


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    intercept, vocabulary, weights = model
    frame = id_text(docs).withColumn(
        "held_out", F.coalesce(crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT_REST, F.lit(False)))

    def work(batches):
        for b in chunks(batches):
            texts = [fold(t) for t in b.column("text").to_pylist()]
            doc, col = once(*features(texts), vocabulary)
            logit = intercept + np.bincount(doc, weights=weights[col], minlength=len(texts))
            p = 1 / (1 + np.exp(-np.maximum(logit, -700)))
            p[np.isneginf(logit)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()),
                 pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return small_batches(frame).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(sample(docs, labels)))
