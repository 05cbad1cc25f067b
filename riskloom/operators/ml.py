"""Scoring, training, calibration and explanation with pyspark.ml.

Training and scoring run as pyspark.ml jobs over the whole table.  The only
driver-side data are model parameters (tree nodes, coefficients, isotonic
breakpoints) — bounded by the model, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import columns as C
from riskloom.functions import explain_text as X
from riskloom.session import cut_lineage


# ---------------------------------------------------------------------------
# P8 / P9 model input
# ---------------------------------------------------------------------------
def model_input(df: DataFrame, features: Sequence[str] = C.MODEL_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``features`` in model order, coerced (bad/inf → 0); error if one is missing."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"model input lacks {len(missing)} column(s): {missing}")
    return df.select(*keep, *[C.model_ready(f).alias(f) for f in features])


def class_weight(df: DataFrame, label: str) -> Column:
    """Positive rows weighted by negatives/positives (imbalance), negatives 1."""
    r = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).collect()[0]
    p, n = r["p"] or 0, r["n"]
    w = (n - p) / p if p else 1.0
    return F.when(F.col(label) == 1, F.lit(float(w))).otherwise(F.lit(1.0))


# ---------------------------------------------------------------------------
# D2 / D3 / D5 training, D1 scoring
# ---------------------------------------------------------------------------
def train_gbt(train: DataFrame, label: str = "isFraud", features: Sequence[str] = C.MODEL_FEATURES,
              max_iter: int = 30, max_depth: int = 5, step: float = 0.1, seed: int = 42,
              balance: bool = True) -> PipelineModel:
    data = model_input(train, features, [label])
    if balance:
        data = data.withColumn("_w", class_weight(data, label))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, seed=seed, subsamplingRate=1.0, maxBins=64)
    if balance:
        gbt.setWeightCol("_w")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt])
    return pipe.fit(data)


def train_logistic(train: DataFrame, label: str = "isFraud", features: Sequence[str] = C.MODEL_FEATURES,
                   reg: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """D3: impute (P8 fills 0) → standardise → logistic regression."""
    data = model_input(train, features, [label])
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter),
    ])
    return pipe.fit(data)


def model_features(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("TransactionID",),
          out: str = "model_score") -> DataFrame:
    """P(fraud) for every row (vectorised JVM transform)."""
    feats = model_features(model)
    data = model_input(df, feats, [c for c in df.columns if c not in feats])
    pred = model.transform(data)
    cols = [c for c in df.columns if c in keep or keep == ("*",)]
    return pred.select(*cols, *[f for f in feats if f not in cols],
                       vector_to_array("probability")[1].alias(out))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------------------
# D9 / D10 isotonic calibration
# ---------------------------------------------------------------------------
BLOCKS = "part long, lo double, hi double, y double, w double"
#: Neighbouring score ranges whose blocks one task pools in a merging round.
MERGED = 16
#: Distinct scores of one score range, about.
SCORES_PER_RANGE = 200_000


def pool(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Pool-adjacent-violators over blocks in score order (``y``: weighted label sums): ends, sums and weights of the
    pooled blocks, whose means do not fall.  Pooling parts first gives the blocks of the whole, so parts can be merged."""
    stack: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), y.tolist(), w.tolist(), strict=True):
        top = list(block)
        while stack and stack[-1][2] * top[3] >= top[2] * stack[-1][3]:
            below = stack.pop()
            top = [below[0], top[1], below[2] + top[2], below[3] + top[3]]
        stack.append(top)
    return [np.array(c) for c in zip(*stack, strict=True)] if stack else [np.empty(0)] * 4


def _pooled(part: int, table: pa.Table) -> pa.Table:
    order = np.argsort(table["lo"].to_numpy(), kind="stable")
    columns = pool(*(table[c].to_numpy()[order] for c in ("lo", "hi", "y", "w")))
    return pa.table([pa.array(np.full(len(columns[0]), part, dtype=np.int64)), *map(pa.array, columns)],
                    names=["part", "lo", "hi", "y", "w"])


def isotonic_blocks(hist: DataFrame, ranges: int | None = None, merged: int = MERGED) -> DataFrame:
    """Blocks (lo, hi, y, w) of the isotonic fit of a score histogram (s, y: label sum, w: weight).

    Every score range is pooled in a task of its own; the blocks of ``merged``
    neighbouring ranges are then pooled together, round by round.
    """
    left = ranges or hist.count() // SCORES_PER_RANGE + 1

    def first(batches):
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            yield from _pooled(TaskContext.get().partitionId(), table).to_batches()

    one = hist.select(F.lit(0).cast("long").alias("part"), F.col("s").alias("lo"), F.col("s").alias("hi"), "y", "w")
    blocks = cut_lineage(one.repartitionByRange(left, "lo").mapInArrow(first, BLOCKS))
    while left > 1:
        left = -(-left // merged)
        up = blocks.withColumn("part", F.floor(F.col("part") / merged))
        blocks = cut_lineage(up.groupBy("part").applyInArrow(
            lambda key, table: _pooled(key[0].as_py(), table), BLOCKS))
    return blocks.drop("part")


def fit_isotonic(df: DataFrame, score_col: str, label: str, ranges: int | None = None) -> IsotonicRegressionModel:
    """Isotonic fit over the score histogram, pooled on the executors; only the final blocks reach the driver.

    The model interpolates between the ends of its blocks, as Spark's own fit does.
    """
    classes = df.agg(F.countDistinct(label)).collect()[0][0]
    if classes < 2:
        raise ValueError(f"isotonic calibration needs two label classes, found {classes}")
    hist = (df.where(F.col(score_col).isNotNull()).groupBy(F.col(score_col).cast("double").alias("s"))
            .agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w")))
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("s")
    points = isotonic_blocks(cut_lineage(hist), ranges).select(ends, (F.col("y") / F.col("w")).alias("y"), "w")
    iso = IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w", isotonic=True)
    return iso.fit(points)


def calibrate(model: IsotonicRegressionModel | None, df: DataFrame, score_col: str,
              out: str = "calibrated_model_score", allow_raw: bool = False) -> DataFrame:
    """Apply calibration (clipped to [0,1]); no calibrator is an error unless ``allow_raw`` (trap 22)."""
    if model is None:
        if not allow_raw:
            raise ValueError("No calibrator: pass allow_raw=True to use raw scores")
        return df.withColumn(out, C.clip01(score_col))
    # JVM-side binary search + linear interpolation between breakpoints, clipped.
    m = model.copy().setFeaturesCol("_s").setPredictionCol("_cal")
    out_df = m.transform(df.withColumn("_s", C.clip01(score_col)))
    return out_df.withColumn(out, C.clip01("_cal")).drop("_s", "_cal")


# ---------------------------------------------------------------------------
# D15 contributions, T5 top-5 evidence, D16 text, D17 global importance
# ---------------------------------------------------------------------------
def linear_contributions(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("TransactionID",)) -> DataFrame:
    """Exact per-feature contributions of a standardised logistic model:
    coef_j * z_j with z the standardised value; base = intercept, so
    base + sum(contrib) = raw margin."""
    feats = model_features(model)
    scaler, lr = model.stages[1], model.stages[2]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    coef = lr.coefficients.toArray()
    data = model_input(df, feats, list(keep))
    contribs = []
    for j, f in enumerate(feats):
        z = (F.col(f) - F.lit(float(mean[j]))) / F.lit(float(std[j])) if std[j] > 0 else F.lit(0.0)
        contribs.append(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                                 (F.lit(float(coef[j])) * z).alias("contribution")))
    return data.select(*keep, F.array(*contribs).alias("contributions"),
                       F.lit(float(lr.intercept)).alias("base_value"))


def _tree_tables(model: PipelineModel) -> tuple[list, list[float]]:
    """Flatten the GBT trees (model parameters) into numpy arrays per tree, with each node's share of training weight."""
    gbt = model.stages[-1]
    jtrees = gbt._java_obj.trees()
    weights = list(gbt.treeWeights)
    tables = []
    for t in range(len(weights)):
        feat, thr, left, right, value, cover = [], [], [], [], [], []
        stack = [(jtrees[t].rootNode(), -1, False)]
        while stack:
            node, parent, is_left = stack.pop()
            i = len(feat)
            if parent >= 0:
                (left if is_left else right)[parent] = i
            value.append(float(node.prediction()))
            cover.append(float(node.impurityStats().count()))
            left.append(-1)
            right.append(-1)
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                feat.append(int(split.featureIndex()))
                thr.append(float(split.threshold()))
                stack.append((node.rightChild(), i, False))
                stack.append((node.leftChild(), i, True))
            else:
                feat.append(-1)
                thr.append(0.0)
        tables.append(tuple(np.array(a) for a in (feat, thr, left, right, value, cover)))
    return tables, weights


def leaf_paths(tree: tuple) -> list[tuple[float, list[tuple[int, float, list[tuple[float, bool]]]]]]:
    """(leaf value, [(feature, share of training weight that takes the path's turns on it, [(threshold, left)])])."""
    feat, thr, left, right, value, cover = tree
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if feat[node] < 0:
            out.append((float(value[node]), [(f, share, turns) for f, (share, turns) in path.items()]))
            continue
        for child, is_left in ((left[node], True), (right[node], False)):
            share, turns = path.get(int(feat[node]), (1.0, []))
            part = cover[child] / cover[node] if cover[node] else 0.0
            todo.append((int(child), path | {int(feat[node]): (share * part, [*turns, (float(thr[node]), is_left)])}))
    return out


def shapley(trees: Sequence[tuple], weights: Sequence[float], x: np.ndarray,
            leaves: list[tuple] | None = None) -> tuple[np.ndarray, float]:
    """(values (row, feature), base): Shapley values of a tree ensemble, absent features averaged by training weight.

    A leaf pays its value to the features of its path.  With o (a row takes the
    turns on a feature: 1 or 0) and z (the share of weight that does), the sum
    over all subsets S of the others is a polynomial: the coefficient of t^k in
    the product of (z + o t) adds up all subsets of k present features, and its
    weight is k! (d - k - 1)! / d!.  A leaf's payments depend on the pattern of
    taken turns alone, so they are worked out once for each pattern
    (``leaf_tables``, given as ``leaves`` where many blocks of rows follow).
    """
    out, base, turned = np.zeros(x.shape), 0.0, {}
    for value, path, paid in leaf_tables(trees, weights) if leaves is None else leaves:
        base += value * float(np.prod([z for _, z, _ in path]))
        pattern = np.zeros(len(x), dtype=np.int64)
        for i, (f, _, turns) in enumerate(path):
            o = np.ones(len(x), dtype=bool)
            for t, is_left in turns:
                if (f, t) not in turned:
                    turned[f, t] = x[:, f] <= t
                o &= turned[f, t] == is_left
            pattern |= o.astype(np.int64) << i
        if paid is None:
            patterns, pattern = np.unique(pattern, return_inverse=True)
            paid = payments(value, path, patterns)
        for i, (f, _, _) in enumerate(path):
            out[:, f] += paid[pattern, i]
    return out, base


def payments(value: float, path: list[tuple], patterns: np.ndarray) -> np.ndarray:
    """What a leaf pays to each feature of its path, for patterns of taken turns (bit i: those on the i-th feature)."""
    d = len(path)
    taken = [(patterns >> i & 1).astype(float) for i in range(d)]
    out = np.zeros((len(patterns), d))
    for i, (_, z, _) in enumerate(path):
        others = np.zeros((d, len(patterns)))
        others[0] = 1.0
        for j, (_, zj, _) in enumerate(path):
            if j != i:
                others[1:] = others[1:] * zj + others[:-1] * taken[j]
                others[0] *= zj
        share = sum(math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * others[k] for k in range(d))
        out[:, i] = value * (taken[i] - z) * share
    return out


#: Longest paths whose payments are tabled for every pattern beforehand.
TABLED = 12


def leaf_tables(trees: Sequence[tuple], weights: Sequence[float]) -> list[tuple[float, list[tuple], np.ndarray | None]]:
    """(weighted value, path, payments by pattern) of every leaf: the work on trees that no row changes."""
    return [(w * leaf, path, payments(w * leaf, path, np.arange(1 << len(path))) if len(path) <= TABLED else None)
            for tree, w in zip(trees, weights, strict=True) for leaf, path in leaf_paths(tree)]


def path_attribution(trees: Sequence[tuple], weights: Sequence[float], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(values (row, feature), base): the walk from root to leaf credits each split feature with the change of the value."""
    out, base, rows = np.zeros(x.shape), 0.0, np.arange(len(x))
    for (feat, thr, left, right, value, _), w in zip(trees, weights, strict=True):
        base += w * value[0]
        node = np.zeros(len(x), dtype=int)
        active = feat[node] >= 0
        while active.any():
            r, nd = rows[active], node[active]
            child = np.where(x[r, feat[nd]] <= thr[nd], left[nd], right[nd])
            np.add.at(out, (r, feat[nd]), w * (value[child] - value[nd]))
            node[active] = child
            active = feat[node] >= 0
    return out, base


ATTRIBUTIONS = {"shapley": shapley, "path": path_attribution}


def tree_contributions(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("TransactionID",),
                       method: str = "shapley") -> DataFrame:
    """Contributions of the boosted trees, vectorised per Arrow batch; ``method`` (a column too) is shapley or path.

    base + sum(contributions) = raw margin of the GBT either way.
    """
    feats = model_features(model)
    bc = df.sparkSession.sparkContext.broadcast(_tree_tables(model))
    data = model_input(df, feats, list(keep))
    attribution = ATTRIBUTIONS[method]
    schema = T.StructType([data.schema[k] for k in keep] + [
        T.StructField("_values", T.ArrayType(T.DoubleType())), T.StructField("_parts", T.ArrayType(T.DoubleType())),
        T.StructField("base_value", T.DoubleType())])

    def attribute(batches):
        trees, w = bc.value
        once = {"leaves": leaf_tables(trees, w)} if method == "shapley" else {}
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            parts, base = attribution(trees, w, x, **once)
            out = pdf[list(keep)].copy()
            out["_values"], out["_parts"] = list(x), list(parts)
            out["base_value"] = base
            yield out

    names = F.array(*[F.lit(f) for f in feats])         # names are attached in the JVM
    each = F.transform("_parts", lambda c, i: F.struct(F.get(names, i).alias("feature"), F.get("_values", i).alias("value"),
                                                       c.alias("contribution")))
    return data.mapInPandas(attribute, schema).select(*keep, each.alias("contributions"), "base_value",
                                                      F.lit(method).alias("method"))


def top_evidence(contrib: DataFrame, k: int = 5) -> DataFrame:
    """T5: the k largest |contribution| per row (ties by feature order), nested."""
    ranked = F.transform(F.col("contributions"), lambda c, i: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution"),
        F.abs(c["contribution"]).alias("abs_contribution"), i.alias("pos")))
    ordered = F.array_sort(ranked, lambda a, b: F.when(a["abs_contribution"] > b["abs_contribution"], -1)
                           .when(a["abs_contribution"] < b["abs_contribution"], 1)
                           .when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    top = F.transform(F.slice(ordered, 1, k), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"), e["contribution"].alias("contribution"),
        e["abs_contribution"].alias("abs_contribution"), X.impact(e["contribution"]).alias("impact")))
    return contrib.withColumn("evidence", top)


def evidence_rows(contrib: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """T5 + D16 flat: one row per (key, rank) with impact label and sentence.

    The sentence is rendered on flat columns (not inside array lambdas) so the
    template chain stays within whole-stage codegen limits.
    """
    ev = top_evidence(contrib, k).select(*keys, F.posexplode("evidence").alias("rank", "e"))
    flat = ev.select(*keys, (F.col("rank") + 1).alias("rank"), "e.feature", "e.value", "e.contribution",
                     "e.abs_contribution", "e.impact")
    return flat.withColumn("explanation", X.describe(F.col("feature"), F.col("value"), F.col("contribution")))


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean |contribution| per feature, largest first."""
    e = contrib.select(F.explode("contributions").alias("c"))
    return (e.groupBy(F.col("c.feature").alias("feature"))
            .agg(F.avg(F.abs("c.contribution")).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution"), "feature"))
