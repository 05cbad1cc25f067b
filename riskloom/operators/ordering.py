"""Global order without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead, positions are found by *selection*: ``kth_cuts`` narrows a range of
the leading sort column with bucket counts (one bounded aggregate per round,
shared by all wanted positions) until the k-th row's value is pinned, then
moves to the next sort column.
A split, a top-k set or an exact quantile is then a plain filter against the
cut tuple, which Catalyst pushes into the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Order = Sequence[tuple[str, bool]]      # (column, ascending)
TIME_ORDER: Order = (("TransactionDT", True), ("TransactionID", True))

BUCKETS = 1024         # buckets per region and round
NARROW_ABOVE = 5_000_000   # larger inputs are written narrowed to the open regions once these are a quarter or less


def _is_float(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] in ("double", "float")


def missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN in a floating column: such rows sort last in either direction."""
    return F.col(c).isNull() | F.isnan(c) if _is_float(df, c) else F.col(c).isNull()


def lex_before(df: DataFrame, order: Order, cut: Sequence, inclusive: bool = True) -> Column:
    """Row sorts before (or at) ``cut`` in ``order``; missing values last, a missing cut value is ``None``.

    Columns are compared in their own type (64-bit ids stay integers), so the condition reaches the scan.
    """
    cond = F.lit(inclusive)
    for (c, asc), v in reversed(list(zip(order, cut))):
        col, gone = F.col(c), missing(df, c)
        if v is None:
            cond = ~gone | (gone & cond)
        else:
            lt = (col < F.lit(v)) if asc else (col > F.lit(v))
            cond = ~gone & (lt | ((col == F.lit(v)) & cond))
    return F.coalesce(cond, F.lit(False))


# A column's key is a pair (side, value) that rises with the order: the sides are -inf, below 0, 0, above 0, inf and
# missing in a floating column, present and missing in another one.
SIDES, REAL_GONE, WHOLE_GONE = {0: -math.inf, 2: 0.0, 4: math.inf, 5: 0.0}, 5, 1
WIDE = 1 << 20         # more than any bucket number


def sort_keys(df: DataFrame, order: Order) -> list[tuple[Column, Column, bool]]:
    """(side, value, is it whole) of every order column; descending columns are turned round."""
    out = []
    for c, asc in order:
        gone = missing(df, c)
        if _is_float(df, c):
            x = F.col(c).cast("double") if asc else -F.col(c).cast("double")
            side = (F.when(gone, REAL_GONE).when(x == -math.inf, 0).when(x < 0, 1).when(x == 0, 2)
                    .when(x == math.inf, 4).otherwise(3))
            out.append((side, F.when(gone, F.lit(0.0)).otherwise(x), False))
        else:
            x = F.col(c).cast("long") if asc else F.bitwise_not(F.col(c).cast("long"))
            out.append((F.when(gone, WHOLE_GONE).otherwise(0), F.when(gone, F.lit(0).cast("long")).otherwise(x), True))
    return out


def cut_key(df: DataFrame, order: Order, cut: Sequence) -> list[tuple]:
    """(side, value) of every value of a cut tuple."""
    out = []
    for (c, asc), v in zip(order, cut):
        if not _is_float(df, c):
            out.append((WHOLE_GONE, 0) if v is None else (0, v if asc else ~v))
            continue
        x = v if v is None or asc else -v
        side = REAL_GONE if x is None else 1 if x < 0 else 2 if x == 0 else 3
        out.append((0 if x == -math.inf else 4 if x == math.inf else side, 0.0 if x is None else x))
    return out


def key_type(whole: bool) -> str:
    return "long" if whole else "double"


def by_group(df: DataFrame, group: str | None, rows: list[tuple], columns: str) -> DataFrame:
    """``df`` with the columns of ``rows`` (group value first), a few for each group, sent to all tasks."""
    kind = dict(df.dtypes)[group] if group else "string"
    table = F.broadcast(df.sparkSession.createDataFrame(rows, f"_g {kind}, {columns}"))
    return df.join(table, F.col(group).eqNullSafe(F.col("_g"))).drop("_g") if group else df.crossJoin(table.drop("_g"))


class _Search:
    """One wanted position: the region (equal keys so far, then one side's lo..hi) that still holds it.

    ``spread`` is (lowest, highest) value of the rows that the next round cuts into buckets; without it the round
    only looks for them.
    """

    def __init__(self, group, rank: int) -> None:
        self.group, self.rank = group, rank
        self.fixed: list[tuple] = []
        self.side = self.spread = None
        self.rows = 0

    def region(self) -> tuple:
        return (self.group, tuple(self.fixed), self.side, self.spread)

    def fix(self, side: int, value) -> None:
        self.fixed.append((side, value))
        self.side = self.spread = None


def _cutting(side: int | None, spread: tuple | None, whole: bool) -> tuple:
    """How a region's values become buckets: (mode, whole origin, whole step, real origin, real span).

    Modes: 0 none, 1 whole steps, 2 whole steps of 256 (so that differences fit), 3 real steps, 4 steps of the
    logarithm, 5 real steps of half the value.  Each rises with the value.
    """
    if spread is None:
        return 0, 0, 1, 0.0, 1.0
    low, high = spread
    if whole:
        shift = 0 if high - low < 1 << 62 else 8
        return 2 if shift else 1, low >> shift, ((high >> shift) - (low >> shift)) // BUCKETS + 1, 0.0, 1.0
    if side is None:                     # values of several signs
        return 5, 0, 1, low / 2, (high / 2 - low / 2) or 1.0
    if max(abs(low), abs(high)) / BUCKETS > min(abs(low), abs(high)):
        sign = math.copysign(1.0, low)
        return 4, 0, 1, sign * math.log(abs(low)), sign * (math.log(abs(high)) - math.log(abs(low)))
    return 3, 0, 1, low, high - low


def kth_cuts(df: DataFrame, order: Order, wanted: Sequence[tuple], group: str | None = None) -> list[tuple | None]:
    """Values of the order columns at each wanted (group value, 1-based position); None outside the group.

    All positions share the rounds.  A round joins every row with the open
    region of its group that holds it (a small table) and counts the rows by
    region and bucket; a bucket's lowest and highest value are the next region.
    The work of a row does not depend on the number of regions.  Integers are
    compared as integers, missing values (null, NaN) come last.  Only bucket
    rows reach the driver.
    """
    from riskloom.session import cut_lineage
    keys = sort_keys(df, order)
    wholes = [whole for _, _, whole in keys]
    cand = df.select(*([F.col(group).alias("_group")] if group else []),
                     *[x for i, (s, v, _) in enumerate(keys) for x in (s.cast("int").alias(f"_s{i}"), v.alias(f"_v{i}"))])
    searches = [_Search(g, k) if k and k > 0 else None for g, k in wanted]
    active = [s for s in searches if s is not None]
    names = ["_id int", "_level int", "_side int", "_wlo long", "_whi long", "_rlo double", "_rhi double",
             "_mode int", "_w0 long", "_wstep long", "_r0 double", "_rspan double",
             *[f"_fs{i} int, _fv{i} {key_type(w)}" for i, w in enumerate(wholes)]]
    pick = lambda name: F.expr("case " + " ".join(f"when _level = {i} then {name(i)}" for i in range(len(keys))) + " end")
    size = still_open = None
    while active:
        regions = list(dict.fromkeys(s.region() for s in active))
        rows = []
        for i, (g, fixed, side, spread) in enumerate(regions):
            level, bounds = len(fixed), [None] * 4
            if side is not None:
                bounds = [*spread, None, None] if wholes[level] else [None, None, *spread]
            rest = [x for j in range(len(keys)) for x in (fixed[j] if j < level else (None, None))]
            rows.append((g, i, level, side, *bounds, *_cutting(side, spread, wholes[level]), *rest))
        held = by_group(cand, "_group" if group else None, rows, ", ".join(names))
        cond = " and ".join(f"(_level <= {i} or (_s{i} = _fs{i} and _v{i} = _fv{i}))" for i in range(len(keys)))
        held = held.where(cond).select(
            "*", pick(lambda i: f"_s{i}").alias("_s"),
            pick(lambda i: f"_v{i}" if wholes[i] else "cast(null as long)").alias("_w"),
            pick(lambda i: "cast(null as double)" if wholes[i] else f"_v{i}").alias("_r"))
        held = held.where("_side is null or (_s = _side and coalesce(_w between _wlo and _whi, _r between _rlo and _rhi))")
        if size is not None and size > NARROW_ABOVE and still_open * 4 <= size:
            cand, size = cut_lineage(held.select(cand.columns)), still_open    
            continue
        real = "(case _mode when 3 then _r when 5 then _r / 2 else sign(_r) * ln(abs(_r)) end - _r0) / _rspan"
        bucket = F.expr(f"""case when _mode = 0 then 0
            when _mode = 1 and _s = 0 then try_subtract(_w, _w0) div _wstep
            when _mode = 2 and _s = 0 then (shiftright(_w, 8) - _w0) div _wstep
            when _mode > 2 and _s in (1, 3) then
                cast(least(greatest({real} * {BUCKETS}, cast(-1 as double)), cast({2 * BUCKETS} as double)) as long)
            else 0 end""")
        side = F.when(F.col("_mode") == 0, 0).otherwise(F.col("_s"))
        finite = F.when(F.col("_s").isin(1, 2, 3), F.col("_r"))
        present = F.when(F.col("_s") == 0, F.col("_w"))
        found: dict[int, list] = {}
        for r in held.groupBy("_id", (side * WIDE + bucket).alias("_tag")).agg(
                F.count(F.lit(1)).alias("n"), F.min("_s").alias("slo"), F.max("_s").alias("shi"), F.min(present).alias("wlo"),
                F.max(present).alias("whi"), F.min(finite).alias("rlo"), F.max(finite).alias("rhi")).collect():
            found.setdefault(r["_id"], []).append(r)
        if size is None:
            size = sum(r["n"] for rs in found.values() for r in rs)
        number = {region: i for i, region in enumerate(regions)}
        still = []
        for s in active:
            hit, whole = None, wholes[len(s.fixed)]
            for r in sorted(found.get(number[s.region()], []), key=lambda r: r["_tag"]):
                if s.rank <= r["n"]:
                    hit = r
                    break
                s.rank -= r["n"]
            if hit is None:
                searches[searches.index(s)] = None
                continue
            low, high = (hit["wlo"], hit["whi"]) if whole else (hit["rlo"], hit["rhi"])
            if hit["slo"] == hit["shi"] and (low is None or low == high):
                s.fix(hit["slo"], low if low is not None else 0 if whole else SIDES[hit["slo"]])
                if len(s.fixed) == len(keys):
                    continue
            else:
                s.side = hit["slo"] if hit["slo"] == hit["shi"] else None
                s.spread = (low, high) if low is not None else (0, 0) if whole else (0.0, 0.0)
            s.rows = hit["n"]
            still.append(s)
        active = still
        still_open = sum({s.region(): s.rows for s in active}.values())
    out = []
    for s in searches:
        if s is None:
            out.append(None)
            continue
        values = []
        for (c, asc), (side, key) in zip(order, s.fixed):
            gone = side == (REAL_GONE if _is_float(df, c) else WHOLE_GONE)
            values.append(None if gone else key if asc else -key if _is_float(df, c) else ~key)
        out.append(tuple(values))
    return out


def at_or_before(df: DataFrame, order: Order, name) -> Column:
    """Row sorts at or before the cut whose key (``cut_key``) stands in the columns ``name(i, "s")`` and ``name(i, "v")``;
    false where the cut is null."""
    cond = F.lit(True)
    for i, (side, value, _) in reversed(list(enumerate(sort_keys(df, order)))):
        s, v = F.col(name(i, "s")), F.col(name(i, "v"))
        cond = (side < s) | ((side == s) & ((value < v) | ((value == v) & cond)))
    return F.coalesce(cond, F.lit(False))


def kth_cut(df: DataFrame, order: Order, k: int) -> tuple | None:
    """Values of the order columns at the k-th row (1-based) in ``order``."""
    return kth_cuts(df, order, [(None, k)])[0]


def position_of(df: DataFrame, order: Order, cut: Sequence) -> int:
    """Number of rows at or before ``cut`` (1-based position of the cut row)."""
    return df.where(lex_before(df, order, cut, True)).count()


# ---------------------------------------------------------------------------
# T1 / T2
# ---------------------------------------------------------------------------
def label_by_cuts(df: DataFrame, order: Order, cuts: Sequence[tuple | None], labels: Sequence[str],
                  col: str = "split") -> DataFrame:
    """Label rows by consecutive cuts: rows <= cuts[0] get labels[0], and so on."""
    expr = None
    for cut, lab in zip(cuts, labels):
        cond = F.lit(False) if cut is None else lex_before(df, order, cut, True)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    expr = F.lit(labels[-1]) if expr is None else expr.otherwise(F.lit(labels[-1]))
    return df.withColumn(col, expr)


def split_cuts(df: DataFrame, train_ratio: float = 0.70, validation_ratio: float = 0.15,
               order: Order = TIME_ORDER) -> list:
    """Cut tuples of the chronological split (positions floor(n*r), as the reference)."""
    narrow = df.select(*[c for c, _ in order])
    n = narrow.count()
    train_end = int(n * train_ratio)
    val_end = int(n * (train_ratio + validation_ratio))
    return kth_cuts(narrow, order, [(None, train_end), (None, val_end)])


def apply_split(df: DataFrame, cuts: list, order: Order = TIME_ORDER, col: str = "split") -> DataFrame:
    return label_by_cuts(df, order, cuts, ["train", "validation", "test"], col)


def time_split(df: DataFrame, train_ratio: float = 0.70, validation_ratio: float = 0.15,
               order: Order = TIME_ORDER) -> DataFrame:
    """Chronological 70/15/15 by position: adds ``split`` in train/validation/test."""
    return apply_split(df, split_cuts(df, train_ratio, validation_ratio, order), order)


def temporal_windows(validation: DataFrame, label: str = "isFraud", min_frauds: int = 100,
                     order: Order = TIME_ORDER, min_rows: int = 1000) -> tuple[DataFrame, dict]:
    """Cut validation into calibration / policy / stability windows."""
    n = validation.count()
    frauds = validation.where(F.col(label) == 1)
    n_fraud = frauds.count()
    if n_fraud < 3 * min_frauds:
        raise ValueError(f"three windows of {min_frauds} frauds each do not fit into {n_fraud}")
    at = kth_cuts(frauds, order, [(None, min_frauds), (None, 2 * min_frauds)])
    f1, f2 = validation.agg(*[F.count_if(lex_before(validation, order, c)) for c in at]).first()
    min_window = max(min_rows, int(n * 0.15))
    b1 = max(f1, min_window)
    b2 = min(max(f2, b1 + min_window), n - min_window)
    out = label_by_cuts(validation, order, kth_cuts(validation, order, [(None, b1), (None, b2)]),
                        ["calibration", "policy", "stability"], "window")
    check = out.groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("frauds"),
                                       F.countDistinct(label).alias("classes")).collect()
    for r in check:
        if r["frauds"] < min_frauds or r["classes"] < 2:
            raise ValueError(f"window {r['window']!r} has {r['frauds']} frauds in {r['rows']} rows and {r['classes']} classes")
    return out, {"n": n, "first_boundary": b1, "second_boundary": b2}


# ---------------------------------------------------------------------------
# T3 / T4 / M11
# ---------------------------------------------------------------------------
def review_count(n: int, rate: float, rounding: str = "ceil") -> int:
    if rounding == "ceil":
        return min(n, max(1, int(math.ceil(n * rate)))) if n else 0
    return int(math.floor(n * rate))


def score_order(score: str, order: Order = TIME_ORDER) -> Order:
    return ((score, False), *order)


def top_k(df: DataFrame, score: str, rate: float, order: Order = TIME_ORDER, rounding: str = "ceil",
          col: str = "selected") -> tuple[DataFrame, int, tuple | None]:
    """Exact top-k by (score desc, time, id); ties never split arbitrarily."""
    n = df.count()
    k = review_count(n, rate, rounding)
    so = score_order(score, order)
    cut = kth_cut(df, so, k) if k > 0 else None
    sel = F.lit(False) if cut is None else lex_before(df, so, cut, True)
    return df.withColumn(col, sel), k, cut


def quantile_positions(n: int, q: float) -> tuple[int, int, float]:
    """1-based positions, counted from the largest value, of the two neighbours of a numpy quantile, and its fraction."""
    h = (n - 1) * q
    low = math.floor(h)
    return n - low, n - math.ceil(h), h - low


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Numpy-style linear-interpolated quantile of the values that are not missing."""
    present = df.where(~missing(df, col)).select(F.col(col).cast("double").alias(col))
    n = present.count()
    if not n:
        return None
    low, high, part = quantile_positions(n, q)
    (a,), (b,) = kth_cuts(present, ((col, False),), [(None, low), (None, high)])
    return a + part * (b - a)
