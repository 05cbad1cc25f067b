"""Model invariants: contributions add up to the margin; isotonic fit equals brute-force PAV."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import ml as ML
from riskloom.plans import catalog as CT


def _sum_contrib():
    return F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"]) + F.col("base_value")


def test_tree_and_linear_contributions_sum_to_margin(spark):
    f = CT.feature_table(spark, "/root/testdata/sf0.001", "batch").cache()
    for model, contrib in ((ML.train_gbt(f, max_iter=5, max_depth=3), ML.tree_contributions),
                           (ML.train_logistic(f, max_iter=20), ML.linear_contributions)):
        c = contrib(model, f)
        raw = model.transform(ML.model_input(f, ML.model_features(model), ["TransactionID"])).select(
            "TransactionID", vector_to_array("rawPrediction")[1].alias("margin"))
        d = c.join(raw, "TransactionID").select(F.max(F.abs(_sum_contrib() - F.col("margin")))).collect()[0][0]
        assert d < 1e-9


def _pav(x, y, w):
    order = np.argsort(x, kind="mergesort")
    xs, ys, ws = list(np.array(x)[order]), list(np.array(y, float)[order]), list(np.array(w, float)[order])
    blocks = [[ys[i], ws[i], [xs[i]]] for i in range(len(xs))]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks[i + 1]
            wsum = a[1] + b[1]
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / wsum, wsum, a[2] + b[2]]
            del blocks[i + 1]
            i = max(i - 1, 0)
        else:
            i += 1
    return {xv: blk[0] for blk in blocks for xv in blk[2]}


def test_isotonic_grouped_equals_pav(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    iso = ML.fit_isotonic(df, "s", "y")
    got = {r.s: r.calibrated_model_score for r in ML.calibrate(iso, df, "s").collect()}
    ux = sorted(set(s))
    means = {u: y[s == u].mean() for u in ux}
    counts = {u: (s == u).sum() for u in ux}
    exp = _pav(ux, [means[u] for u in ux], [counts[u] for u in ux])
    for u in ux:
        assert abs(got[u] - exp[u]) < 1e-9
