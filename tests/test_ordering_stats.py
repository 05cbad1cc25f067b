"""Selection, splits, quantiles and ranking metrics against numpy / brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators import ordering as O
from riskloom.operators import stats as S


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(0, 300), round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(5000)]
    return rows, spark.createDataFrame(rows, "TransactionID long, TransactionDT long, score double, y int")


def test_kth_cut_matches_sort(data):
    rows, df = data
    order = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    for k in (1, 17, 250, 2500, 5000):
        cut = O.kth_cut(df, O.score_order("score"), k)
        r = order[k - 1]
        assert cut == (r[2], r[1], r[0])


def test_time_split_sizes(data):
    rows, df = data
    s = {r.split: r["count"] for r in O.time_split(df).groupBy("split").count().collect()}
    assert s == {"train": 3500, "validation": 750, "test": 750}


def test_quantiles_match_numpy(data):
    rows, df = data
    q = S.quantiles(df, "score", [0.1, 0.5, 0.95]).collect()[0]
    vals = np.array([r[2] for r in rows])
    for qq in (0.1, 0.5, 0.95):
        assert abs(q[S.quantile_name(qq)] - np.quantile(vals, qq)) < 1e-12


def test_auc_matches_pairwise(data):
    rows, df = data
    pos = [r[2] for r in rows if r[3] == 1]
    neg = [r[2] for r in rows if r[3] == 0]
    p, n = np.array(pos), np.array(neg)
    wins = sum(((x > n).sum() + 0.5 * (x == n).sum()) for x in p)
    auc = wins / (len(p) * len(n))
    got = M.ranking_metrics(df, "y", "score").collect()[0]
    assert abs(got.roc_auc - auc) < 1e-12
    # average precision: sum over distinct thresholds of dRecall * precision
    order = sorted(rows, key=lambda r: -r[2])
    ap, tp, seen, P = 0.0, 0, 0, len(pos)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][2] == order[i][2]:
            j += 1
        grp = order[i:j]
        gp = sum(r[3] for r in grp)
        tp += gp
        seen += len(grp)
        if gp:
            ap += gp / P * tp / seen
        i = j
    assert abs(got.average_precision - ap) < 1e-9


def test_top_k_exact_size_with_ties(data):
    rows, df = data
    sel, k, cut = O.top_k(df, "score", 0.05)
    assert sel.where("selected").count() == k == 250


def test_bucketed_paths_match_direct(data, monkeypatch):
    rows, df = data
    direct_q = S.quantiles(df, "score", [0.1, 0.5, 0.95]).collect()[0]
    direct_m = M.ranking_metrics(df, "y", "score").collect()[0]
    monkeypatch.setattr(S, "DIRECT_DISTINCT_LIMIT", 0)          # force the scalable plan
    assert S.quantiles(df, "score", [0.1, 0.5, 0.95]).collect()[0] == direct_q
    bucketed = M.ranking_metrics(df, "y", "score").collect()[0]
    assert bucketed.roc_auc == direct_m.roc_auc
    assert abs(bucketed.average_precision - direct_m.average_precision) < 1e-12


@pytest.mark.parametrize("narrow_above", [10**9, 0])
def test_shared_rounds_match_sort(data, monkeypatch, narrow_above):
    rows, df = data
    monkeypatch.setattr(O, "NARROW_ABOVE", narrow_above)
    order = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    ks = [0, 1, 333, 334, 4999, 5000, 5001]
    want = [(order[k - 1][2], order[k - 1][1], order[k - 1][0]) if 0 < k <= 5000 else None for k in ks]
    assert O.kth_cuts(df, O.score_order("score"), [(None, k) for k in ks]) == want
    m = M.review_metrics(df, "y", "score", 0.05)
    assert m["selected_fraud_count"] == sum(r[3] for r in order[:250])


def test_large_ids_and_missing_scores(spark):
    nan = float("nan")
    rows = [((1 << 60) + i, 5, [None, nan, 0.5, 0.25][i % 4], i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, score double, y int")
    gone = lambda r: r[2] is None or r[2] != r[2]
    order = sorted(rows, key=lambda r: (gone(r), 0 if gone(r) else -r[2], r[0]))
    for rate in (0.1, 0.2, 0.5, 0.7):
        sel, k, _ = O.top_k(df, "score", rate)
        assert {r.TransactionID for r in sel.where("selected").collect()} == {r[0] for r in order[:k]}
    cut = O.kth_cut(df, O.TIME_ORDER, 777)
    assert cut == (5, (1 << 60) + 776)
    down = O.kth_cut(df, (("TransactionID", False),), 3)
    assert down == ((1 << 60) + 997,)


def test_all_missing_scores_end(spark):
    df = spark.createDataFrame([(i, i, float("nan"), i % 2) for i in range(300)],
                               "TransactionID long, TransactionDT long, score double, y int")
    m = M.review_metrics(df, "y", "score", 0.1)
    assert (m["review_count"], m["selected_fraud_count"], m["cutoff_score"]) == (30, 15, 0.0)
    assert O.exact_quantile(df, "score", 0.5) is None


def test_grouped_cuts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(50), rnd.choice("abc"), round(rnd.random(), 1), int(rnd.random() < 0.4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, g string, score double, y int")
    got = M.review_groups(df, "y", "score", (0.05, 0.5), group="g", quantile=0.9)
    for g in "abc":
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[3], r[1], r[0]))
        for rate in (0.05, 0.5):
            m, k = got[(g, rate)], int(np.ceil(len(own) * rate))
            assert (m["rows"], m["review_count"], m["selected_fraud_count"]) == (len(own), k, sum(r[4] for r in own[:k]))
            assert abs(m["at_quantile"]["threshold"] - np.quantile([r[3] for r in own], 0.9)) < 1e-12


def test_auc_of_huge_counts(spark, monkeypatch):
    """1e9 positives over 1e11 negatives: the product sum needs more than 64 bits."""
    hist = spark.createDataFrame([(1, 0.25, 10**11, 0, 10**11), (1, 0.75, 10**9, 10**9, 0)],
                                 "_all int, score double, n long, pos long, neg long")
    monkeypatch.setattr(M, "score_histogram", lambda *a: hist)
    df = spark.createDataFrame([(0, 0.25), (1, 0.75)], "y int, score double")
    assert M.ranking_metrics(df, "y", "score").first().roc_auc == 1.0


def test_cuts_of_many_groups_with_extreme_values(spark, monkeypatch):
    """Infinities, tiny and huge values of both signs and ids at both ends of 64 bits, every position of every group."""
    monkeypatch.setattr(O, "NARROW_ABOVE", 0)
    rnd = random.Random(9)
    inf = float("inf")
    values = [inf, -inf, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1e-300, -1e-200, 3.5, 3.5000000000000004, None]
    ids = [-(1 << 63), (1 << 63) - 1, 0, 1, -1, (1 << 62) + 1, (1 << 62) + 2, None]
    rows = list({(rnd.choice(ids), rnd.choice(values), rnd.choice(["a", "b", None])) for _ in range(400)})
    df = spark.createDataFrame(rows, "id long, v double, g string")
    for g in ("a", "b", None):
        for asc in (True, False):
            own = sorted((r for r in rows if r[2] == g), key=lambda r: (
                r[1] is None, 0 if r[1] is None else r[1] if asc else -r[1], r[0] is None, r[0] or 0))
            ks = range(1, len(own) + 1, 5)
            got = O.kth_cuts(df, (("v", asc), ("id", True)), [(g, k) for k in ks], "g")
            assert got == [(own[k - 1][1], own[k - 1][0]) for k in ks]


def test_segments_store_each_row_once(spark, monkeypatch):
    """Overlapping segments repeat rows where they are read, not in what is stored."""
    stored, plain = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: (stored.append(df.count()), plain(df))[1])
    df = spark.createDataFrame([(i, i, i % 2, i / 50, i / 70) for i in range(50)],
                               "TransactionID long, TransactionDT long, y int, a double, b double")
    segments = {f"s{k}": F.col("TransactionID") % k == 0 for k in range(1, 70)}
    found = M.segment_review(df, "y", ["a", "b"], segments, 0.1)
    assert stored == [50]
    for r in found:
        own = [i for i in range(49, -1, -1) if i % int(r["segment"][1:]) == 0]
        k = -(-len(own) // 10)
        assert (r["rows"], r["review_count"]) == (len(own), k)
        assert r["recall"] == (sum(i % 2 for i in own[:k]) / max(1, sum(i % 2 for i in own)))
