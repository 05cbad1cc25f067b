"""Shapley values against all subsets of features; merged isotonic blocks against plain pooling."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ml as ML


def random_tree(rng, features, depth):
    """A tree in flat arrays, with covers that add up."""
    feat, thr, left, right, value, cover = [], [], [], [], [], []

    def grow(d, weight):
        i = len(feat)
        for column, v in zip((feat, thr, left, right, value, cover), (-1, 0.0, -1, -1, rng.uniform(-2, 2), weight), strict=True):
            column.append(v)
        if d and rng.random() < 0.85:
            feat[i], thr[i] = rng.randrange(features), rng.choice([0.2, 0.5, 0.8])
            share = rng.uniform(0.1, 0.9)
            left[i] = grow(d - 1, weight * share)
            right[i] = grow(d - 1, weight * (1 - share))
        return i

    grow(depth, 100.0)
    return tuple(np.array(c) for c in (feat, thr, left, right, value, cover))


def expected(tree, x, known, node=0):
    """The tree's value where the features outside ``known`` are averaged by cover."""
    feat, thr, left, right, value, cover = tree
    f = int(feat[node])
    if f < 0:
        return value[node]
    if f in known:
        return expected(tree, x, known, int(left[node] if x[f] <= thr[node] else right[node]))
    return sum(cover[c] / cover[node] * expected(tree, x, known, int(c)) for c in (left[node], right[node]))


def test_shapley_equals_all_subsets():
    rng, n = random.Random(5), 4
    for _ in range(12):
        trees, weights = [random_tree(rng, n, 4) for _ in range(2)], [1.0, 0.3]
        x = np.array([[rng.random() for _ in range(n)] for _ in range(5)])
        got, base = ML.shapley(trees, weights, x)
        for row, phi in zip(x, got, strict=True):
            value = lambda known: sum(w * expected(t, row, known) for t, w in zip(trees, weights, strict=True))  # noqa: B023, E731
            for f in range(n):
                others = [g for g in range(n) if g != f]
                want = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                           * (value({*s, f}) - value(set(s)))
                           for k in range(n) for s in itertools.combinations(others, k))
                assert phi[f] == pytest.approx(want, abs=1e-9)
            assert base == pytest.approx(value(set())) and base + phi.sum() == pytest.approx(value(set(range(n))))


@pytest.mark.parametrize("method", ["shapley", "path"])
def test_contributions_add_up_to_the_margin(spark, method):
    rng = random.Random(1)
    feats = ["a", "b", "c"]
    rows = [(i, *(rng.random() for _ in feats)) for i in range(400)]
    data = [(i, a, b, c, int(a + b * c + rng.gauss(0, 0.2) > 0.9)) for i, a, b, c in rows]
    df = spark.createDataFrame(data, "TransactionID long, a double, b double, c double, isFraud int")
    model = ML.train_gbt(df, features=feats, max_iter=4, max_depth=3)
    got = {r.TransactionID: (r.base_value + sum(c.contribution for c in r.contributions), r.method)
           for r in ML.tree_contributions(model, df, method=method).collect()}
    raw = model.transform(ML.model_input(df, feats, ["TransactionID"])).select(
        "TransactionID", ML.vector_to_array("rawPrediction")[1].alias("m")).collect()
    # the raw prediction of a boosted classifier is the margin
    assert all(got[r.TransactionID] == (pytest.approx(r.m, abs=1e-9), method) for r in raw)


def plain(y, w):
    """Means of the isotonic fit at every point."""
    blocks = []
    for a, b in zip(y, w, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.concatenate([np.full(n, a / b) for a, b, n in blocks])


def test_merged_blocks_equal_plain_pooling(spark):
    """A million distinct scores, in forty ranges, merged four at a time."""
    n = 1_000_000
    i = F.col("id")
    w = (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("double")
    chance = (i / n) * 0.6 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000 * 0.4
    hist = spark.range(n).select((i / n).alias("s"), F.floor(w * chance + 0.5).cast("double").alias("y"), w.alias("w"))
    blocks = ML.isotonic_blocks(hist, 40, 4).orderBy("lo").toPandas()
    h = hist.orderBy("s").toPandas()
    want = plain(h["y"].tolist(), h["w"].tolist())
    at = np.searchsorted(blocks["lo"].to_numpy(), h["s"].to_numpy(), side="right") - 1
    assert np.allclose((blocks["y"] / blocks["w"]).to_numpy()[at], want, atol=1e-12)
    assert len(blocks) < 10_000 and (h["s"].to_numpy() <= blocks["hi"].to_numpy()[at]).all()
    assert blocks["w"].sum() == h["w"].sum()


def test_fit_is_the_same_for_any_number_of_ranges(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(3000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "score double, y int")
    models = [ML.fit_isotonic(df, "score", "y", ranges) for ranges in (1, 7)]
    assert models[0].boundaries.toArray().tolist() == models[1].boundaries.toArray().tolist()
    assert models[0].predictions.toArray().tolist() == models[1].predictions.toArray().tolist()


def test_payments_of_leaves_are_worked_out_once(monkeypatch):
    """Later blocks of rows walk no tree; paths too long for a table of patterns give the same values."""
    rng = random.Random(3)
    trees, weights = [random_tree(rng, 5, 5) for _ in range(3)], [1.0, 0.3, 0.2]
    x = np.array([[rng.random() for _ in range(5)] for _ in range(40)])
    want, base = ML.shapley(trees, weights, x)
    leaves = ML.leaf_tables(trees, weights)
    monkeypatch.setattr(ML, "TABLED", 0)
    untabled, _ = ML.shapley(trees, weights, x)
    monkeypatch.setattr(ML, "leaf_paths", None)
    for at in range(0, 40, 10):
        got, b = ML.shapley(trees, weights, x[at:at + 10], leaves)
        assert b == base and np.array_equal(got, want[at:at + 10])
    assert np.allclose(untabled, want, atol=1e-12)
