"""Evaluation metrics (M1-M16) as aggregates over whole tables.

Ranking metrics are computed from a score histogram (one row per distinct
score and group — a partial aggregate), with running sums formed per score
*bucket* plus bucket offsets, so no window ever spans a whole group in one
task.  Integer numerators are kept exact (e.g. AUC = sum pos*(2*neg_below +
neg) / (2*P*N)), so results do not depend on shuffle order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import ordering as O
from riskloom.session import cut_lineage

UNB = Window.unboundedPreceding


def _by(by: Sequence[str] | None) -> list[str]:
    return list(by or [])


def score_histogram(df: DataFrame, y: str, score: str, by: Sequence[str] | None = None) -> DataFrame:
    """(by..., score, n, pos, neg) — one row per distinct score per group."""
    g = _by(by)
    return (df.groupBy(*g, F.col(score).alias("score"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
            .withColumn("neg", F.col("n") - F.col("pos")))


def _with_below(hist: DataFrame, by: list[str], edges: list[float]) -> DataFrame:
    """Add n_below / pos_below / neg_below (strictly lower scores, same group): sums inside a score bucket plus
    the totals of the buckets below it."""
    from riskloom.operators import stats as S
    h = S.in_buckets(hist, "score", edges, "_b")
    tot = h.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t{c}") for c in ("n", "pos", "neg")])
    bw = Window.partitionBy(*by).orderBy("_b").rowsBetween(UNB, -1)
    offs = tot.select(*by, "_b", *[F.coalesce(F.sum(f"_t{c}").over(bw), F.lit(0)).alias(f"_o{c}")
                                   for c in ("n", "pos", "neg")])
    h = h.join(offs, on=[*by, "_b"], how="inner")
    lw = Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(UNB, -1)
    for c in ("n", "pos", "neg"):
        h = h.withColumn(f"{c}_below", F.col(f"_o{c}") + F.coalesce(F.sum(c).over(lw), F.lit(0)))
    return h.drop("_b", "_on", "_opos", "_oneg")


def ranking_metrics(df: DataFrame, y: str, score: str, by: Sequence[str] | None = None) -> DataFrame:
    """M1, M2, M2b per group: roc_auc (null if one class), average_precision
    (0 if no positives), pr_auc_trapezoid; plus rows / positives."""
    g = _by(by)
    if not g:                                   # a constant group key keeps one code path (no cross join)
        df, g = df.withColumn("_all", F.lit(1)), ["_all"]
    from riskloom.operators import stats as S
    hist = score_histogram(df, y, score, g)
    h = _with_below(hist, g, S.value_edges(df, score))
    totals = hist.groupBy(*g).agg(F.sum("n").alias("N_all"), F.sum("pos").alias("P"), F.sum("neg").alias("Nn"))
    h = h.join(totals, on=g, how="inner")
    tp = F.col("P") - F.col("pos_below")                  # positives with score >= s
    sel = F.col("N_all") - F.col("n_below")               # rows with score >= s
    tp_above = tp - F.col("pos")
    sel_above = sel - F.col("n")
    prec = tp / sel
    prec_above = F.when(sel_above > 0, tp_above / sel_above).otherwise(F.lit(1.0))
    recall_gain = F.col("pos") / F.col("P")
    agg = h.groupBy(*g).agg(
        F.first("N_all").alias("rows"), F.first("P").alias("positives"), F.first("Nn").alias("negatives"),
        F.sum((F.col("pos") * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(38,0)")).cast("decimal(38,0)"))
        .cast("double").alias("_mw"),
        F.sum(F.when(F.col("pos") > 0, recall_gain * prec)).alias("_ap"),
        F.sum(F.when(F.col("pos") > 0, recall_gain * (prec + prec_above) / 2)).alias("_tr"))
    keep = [c for c in g if c != "_all"]
    return agg.select(
        *keep, "rows", "positives",
        F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
               F.col("_mw") / (F.lit(2.0) * F.col("positives") * F.col("negatives"))).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("_ap")).otherwise(F.lit(0.0)).alias("average_precision"),
        F.when(F.col("positives") > 0, F.col("_tr")).otherwise(F.lit(0.0)).alias("pr_auc_trapezoid"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str, score: str, threshold: float, by: Sequence[str] | None = None) -> DataFrame:
    """M3: TN/FP/FN/TP at ``score >= threshold`` and the derived rates (0 on 0/0)."""
    g = _by(by)
    pred = F.col(score) >= F.lit(threshold)
    yy = F.col(y) == 1
    c = df.groupBy(*g).agg(F.count_if(~yy & ~pred).alias("tn"), F.count_if(~yy & pred).alias("fp"),
                          F.count_if(yy & ~pred).alias("fn"), F.count_if(yy & pred).alias("tp"))
    return _rates(c, threshold)


def _rates(c: DataFrame, threshold: float | Column) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return c.select("*", thr.alias("threshold"), precision.alias("precision"), recall.alias("recall"),
                    f1.alias("f1"), _safe_div(fp, fp + tn).alias("fpr"), _safe_div(fn, fn + tp).alias("fnr"),
                    _safe_div(tp + fp, tp + fp + tn + fn).alias("review_rate"))


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """M6: all thresholds in ONE pass (conditional counts), then unpivoted — no cross join."""
    yy = F.col(y) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        pred = F.col(score) >= F.lit(float(t))
        aggs += [F.count_if(~yy & ~pred).alias(f"tn_{i}"), F.count_if(~yy & pred).alias(f"fp_{i}"),
                 F.count_if(yy & ~pred).alias(f"fn_{i}"), F.count_if(yy & pred).alias(f"tp_{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tn_{i}").alias("tn"),
                              F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn"),
                              F.col(f"tp_{i}").alias("tp")) for i, t in enumerate(thresholds)])
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return _rates_keep(long)


def _rates_keep(long: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return long.select("threshold", "tn", "fp", "fn", "tp",
                       _safe_div(tp, tp + fp).alias("precision"), _safe_div(tp, tp + fn).alias("recall"),
                       _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), _safe_div(fp, fp + tn).alias("fpr"),
                       _safe_div(tp + fp, tp + fp + tn + fn).alias("review_rate"))


def review_groups(df: DataFrame, y: str, score: str, rates: Sequence[float], rounding: str = "ceil",
                  order: O.Order = O.TIME_ORDER, group: str | None = None, quantile: float | None = None) -> dict:
    """M4/M4b/M5/M7 of every group and rate: exact top-k by (score desc, time, id), missing scores last.

    Group values are few (weights, segments, scores).  All cuts of all groups
    share the rounds of one selection, and one aggregate counts what lies
    before them.  ``quantile`` adds M11 and the confusion at it (``at_quantile``).
    """
    g = F.col(group) if group else F.lit(None).cast("string")
    heads = {r["g"]: r for r in df.groupBy(g.alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("p"),
        F.count_if(~O.missing(df, score)).alias("present")).collect()}
    so = O.score_order(score, order)
    wanted, marks = [], []
    for name, h in heads.items():
        for rate in rates:
            wanted.append((name, O.review_count(h["n"], rate, rounding)))
            marks.append((name, rate))
    near = {}
    if quantile is not None:
        for name, h in heads.items():
            if h["present"]:
                low, high, near[name] = O.quantile_positions(h["present"], quantile)
                wanted += [(name, low), (name, high)]
    cuts = O.kth_cuts(df, so, wanted, group)
    thresholds = {}
    for i, name in enumerate(near):
        (a, *_), (b, *_) = cuts[len(marks) + 2 * i:len(marks) + 2 * i + 2]
        thresholds[name] = a + near[name] * (b - a)
    keys = O.sort_keys(df, so)
    name_of = lambda k, i, x: f"_c{k}{x}{i}"
    columns = [f"{name_of(k, i, 's')} int, {name_of(k, i, 'v')} {O.key_type(whole)}"
               for k in range(len(rates)) for i, (_, _, whole) in enumerate(keys)]
    at = []
    for name in heads:
        row = [cuts[marks.index((name, rate))] for rate in rates]
        row = [O.cut_key(df, so, cut) if cut is not None else [(None, None)] * len(keys) for cut in row]
        at.append((name, thresholds.get(name), *[x for key in row for pair in key for x in pair]))
    if not at:
        return {}
    marked = O.by_group(df, group, at, ", ".join(["_over double", *columns]))
    aggs = [F.sum(F.when(O.at_or_before(df, so, lambda i, x, k=k: name_of(k, i, x)), F.col(y).cast("long"))).alias(f"hit{k}")
            for k in range(len(rates))]
    over = F.coalesce(~O.missing(df, score) & (F.col(score) >= F.col("_over")), F.lit(False))
    yy = F.coalesce(F.col(y) == 1, F.lit(False))
    aggs += [F.count_if(~yy & ~over).alias("tn"), F.count_if(~yy & over).alias("fp"),
             F.count_if(yy & ~over).alias("fn"), F.count_if(yy & over).alias("tp")]
    out: dict = {}
    for r in marked.groupBy(g.alias("g")).agg(*aggs).collect():
        name, h = r["g"], heads[r["g"]]
        for i, rate in enumerate(rates):
            k, hit, cut = wanted[marks.index((name, rate))][1], r[f"hit{i}"] or 0, cuts[marks.index((name, rate))]
            out[(name, rate)] = {
                "review_rate": k / h["n"], "target_review_rate": float(rate), "review_count": k,
                "recall": hit / h["p"] if h["p"] else 0.0, "precision": hit / k if k else 0.0,
                "selected_fraud_count": int(hit), "cutoff_score": float(cut[0]) if cut and cut[0] is not None else 0.0,
                "rows": h["n"], "frauds": int(h["p"] or 0)}
            if name in thresholds:
                tp, fp, fn, tn = (r[c] for c in ("tp", "fp", "fn", "tn"))
                out[(name, rate)]["at_quantile"] = {
                    "threshold": thresholds[name], "precision": tp / (tp + fp) if tp + fp else 0.0,
                    "recall": tp / (tp + fn) if tp + fn else 0.0, "f1": 2 * tp / (2 * tp + fp + fn) if tp else 0.0,
                    "review_rate": (tp + fp) / h["n"]}
    return out


NO_REVIEW = {"review_rate": 0.0, "review_count": 0, "recall": 0.0, "precision": 0.0, "selected_fraud_count": 0,
             "cutoff_score": 0.0, "rows": 0, "frauds": 0}


def review_metrics(df: DataFrame, y: str, score: str, rate: float, rounding: str = "ceil",
                   order: O.Order = O.TIME_ORDER) -> dict:
    """Exact top-k by (score desc, time) and recall/precision there."""
    found = review_groups(df, y, score, [rate], rounding, order)
    return found.get((None, rate), {**NO_REVIEW, "target_review_rate": float(rate)})


def capacity_sweep(df: DataFrame, y: str, score: str, rates: Sequence[float] = (0.01, 0.05, 0.10),
                   rounding: str = "ceil") -> list[dict]:
    """M7: review metrics at each capacity, all in the same rounds."""
    found = review_groups(df, y, score, rates, rounding)
    return [found.get((None, r), {**NO_REVIEW, "target_review_rate": float(r)}) for r in rates]


def brier(df: DataFrame, y: str, score: str, by: Sequence[str] | None = None) -> DataFrame:
    """M8."""
    return df.groupBy(*_by(by)).agg(F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"))


def calibration_curve(df: DataFrame, y: str, score: str, n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """M9a (quantile bins, exact edges) / M9b (uniform bins); empty bins dropped.

    bin = number of inner edges strictly below the score.
    """
    if strategy == "quantile":
        from riskloom.operators import stats as S
        qs = [i / n_bins for i in range(1, n_bins)]
        row = S.quantiles(df, score, qs).first()            # one row: the edges become literals
        edges = [row[S.quantile_name(q)] for q in qs] if row and row["n"] else []
    else:
        edges = [i / n_bins for i in range(1, n_bins)]
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(score) > F.lit(float(e))).cast("int")
    return (df.groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(y).cast("double")).alias("prob_true"),
                 F.avg(F.col(score)).alias("prob_pred")))


def by_case(df: DataFrame, cases: Sequence[tuple[str, Column, Column | str]], keep: Sequence[str]) -> DataFrame:
    """Rows repeated for every (name, condition, score) they satisfy: columns ``keep``, ``case``, ``case_score``.

    Only one narrow row of conditions (bits) and scores for each row of ``df`` is stored; it is repeated where it is
    read.  Scores given by name are stored once.
    """
    stored, at = {}, []
    for i, (_, _, score) in enumerate(cases):
        at.append(f"_score_{score}" if isinstance(score, str) else f"_case{i}")
        stored.setdefault(at[-1], (F.col(score) if isinstance(score, str) else score).cast("double").alias(at[-1]))
    bits = []
    for first in range(0, len(cases), 60):
        one = [F.when(F.coalesce(cond, F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
               for i, (_, cond, _) in enumerate(cases[first:first + 60])]
        bits.append(F.lit(0).cast("long"))
        for b in one:
            bits[-1] = bits[-1].bitwiseOR(b)
    narrow = cut_lineage(df.select(*keep, *stored.values(), *[b.alias(f"_bits{k}") for k, b in enumerate(bits)]))
    each = [F.when(F.col(f"_bits{i // 60}").bitwiseAND(F.lit(1 << i % 60).cast("long")) != 0,
                   F.struct(F.lit(name).alias("case"), F.col(at[i]).alias("case_score")))
            for i, (name, _, _) in enumerate(cases)]
    long = narrow.select(*keep, F.explode(F.array(*each)).alias("_c")).where("_c is not null")
    return long.select(*keep, "_c.case", "_c.case_score")


def segment_review(df: DataFrame, y: str, scores: Sequence[str], segments: dict[str, Column], rate: float,
                   order: O.Order = O.TIME_ORDER) -> list[dict]:
    """Exact top-k metrics of each score inside each (overlapping) segment, in one selection."""
    cases = [(f"{s}\t{name}", cond, s) for name, cond in segments.items() for s in scores]
    long = by_case(df, cases, [c for c, _ in order] + [y])
    found = review_groups(long, y, "case_score", [rate], "ceil", order, "case")
    out = []
    for name in segments:
        for s in scores:
            m = found.get((f"{s}\t{name}", rate))
            row = {"segment": name, "score": s, "rows": m["rows"] if m else 0}
            for k in ("recall", "precision", "review_count", "frauds"):
                row[k] = m[k] if m else None
            row["fraud_rate"] = m["frauds"] / m["rows"] if m else None
            out.append(row)
    return out
