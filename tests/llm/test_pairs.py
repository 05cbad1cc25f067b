"""Operators 4, 5, 8 and 10: joins, repeats and searches against plain re-computation."""

import hashlib
import random

import numpy as np
import pytest

import llm_cases as cases
from riskloom.llm import decontaminate, ngram_join, repeats, vector_search
from riskloom.llm.suffix_sort import Slices

ROWS = cases.texts()


@pytest.mark.parametrize("options", [{}, {"probe_share": 0.9, "broadcast_ids": 0, "pairs_per_entry": 0.0, "rounds": 2}])
def test_near_duplicates(spark, options):
    got = ngram_join.near_duplicates(cases.documents(spark), **options).collect()
    want = cases.near_components(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(want) + 2 and all(r.component_id is None for r in got if r.doc_id is None)
    assert len({c for _, c in want.values()}) < len(want) - 12


def test_near_duplicates_with_repeated_ids(spark):
    """Every row of an id links by its own text."""
    base = [f"b{i}" for i in range(104)]
    near = " ".join([*base[:50], "other", *base[51:]])
    rows = [(5, " ".join(base), None), (5, "some other text of another length altogether", None), (9, near, None),
            (3, "Some other  text of another length altogether", None), (12, near, None), (12, None, None), (20, "alone", None),
            (None, near, None), (30, "very long " * 60_000, None)]
    got = ngram_join.near_duplicates(cases.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == cases.near_components(rows)
    assert {r.doc_id: r.component_id for r in got}[9] == 3 and len(got) == 7


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(cases.empty(spark)).count() == 0
    blank = cases.documents(spark, [(1, None, None), (2, "", None), (3, " ", None)])
    assert sorted(map(tuple, ngram_join.near_duplicates(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_many_distinct_near_copies(spark):
    """A large group of unlike-enough copies: found through single partners first, exact all the same."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None))
    got = ngram_join.near_duplicates(cases.documents(spark, rows), pairs_per_entry=0.5, rounds=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_components(rows)


def test_suffix_sort_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        depth, letters = rng.choice([3, 8, 10, 20]), rng.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\x00a"])
        base = bytes(rng.choice(letters) for _ in range(60))
        slices, counts = [], []
        for _ in range(rng.randint(1, 8)):
            c, o = rng.randint(1, 12), rng.randint(0, 20)
            fresh = bytes(rng.choice(letters) for _ in range(c + depth - 1))
            slices.append((base * 3)[o:o + c + depth - 1] if rng.random() < 0.6 else fresh)
            counts.append(c)
        laid = Slices(slices, depth)
        order = laid.sort(np.array(counts))
        assert sorted(order) == sorted(b + i for b, c in zip(laid.begin, counts, strict=True) for i in range(c))
        texts = [bytes(laid.data[p:p + depth]) for p in order]
        assert texts == sorted(texts)
        for a, b, n in zip(texts, texts[1:], laid.common_prefixes(order)[1:], strict=False):
            assert a[:n] == b[:n] and (n == depth or a[n] != b[n])


@pytest.mark.parametrize("options", [{}, {"group": 4, "hot": 1, "broadcast_keys": 0}])
def test_remove_repeats(spark, options):
    rows = [*ROWS, (200, "xy" * 300, None), (201, "q" + "xy" * 80, None)]
    got = repeats.remove_repeats(cases.documents(spark, rows), **options).collect()
    want = cases.removed_repeats(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert len(got) == len(want) + 2 and sum(w[1] > 0 for w in want.values()) > 10
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_remove_repeats_small_pieces(spark, monkeypatch):
    """Pieces of a long text overlap, so a cut between them loses no anchor."""
    docs = [(1, ROWS[4][1] * 6, None), (2, ROWS[4][1] + ROWS[5][1], None)]
    pieces = [p for i, (_, t, _) in enumerate(docs) for p in repeats.pieces_of(i, t.encode(), 100)]
    monkeypatch.setattr(repeats, "PIECE", 150)
    cut = [p for i, (_, t, _) in enumerate(docs) for p in repeats.pieces_of(i, t.encode(), 100)]
    starts = lambda p: {(o, s + k) for o, s, n in zip(*repeats.runs_of(p, 100, 24)[:3], strict=True) for k in range(n)}
    assert len(cut) > len(pieces) and starts(cut) == starts(pieces)


def test_remove_repeats_beyond_the_places_of_a_key(monkeypatch):
    """The tail of a text of over 16 MiB has the runs it has alone, whatever stands before it."""
    rng = np.random.default_rng(3)
    tail = rng.integers(97, 123, 3_000, dtype=np.uint8).tobytes()
    for bits, filler, piece in ((12, 9_000, 500), (24, (1 << 24) + 5_000, repeats.PIECE)):
        monkeypatch.setattr(repeats, "PLACE", repeats.U((1 << bits) - 1))
        monkeypatch.setattr(repeats, "PIECE", piece)
        monkeypatch.setattr(repeats, "AT_ONCE", min(4 * piece, 2_000) if bits == 12 else 4 * piece, raising=False)
        long = rng.integers(97, 123, filler, dtype=np.uint8).tobytes() + tail

        def anchors(text, shift):
            found = zip(*repeats.runs_of(repeats.pieces_of(0, text, 100), 100, 24)[1:4], strict=True)
            return {(int(s) + k - shift, int(a)) for s, n, a in found for k in range(n) if s + k >= shift}

        assert anchors(long, filler) == anchors(tail, 0) and len(anchors(tail, 0)) == 2_901


def test_remove_repeats_of_nothing(spark):
    assert repeats.remove_repeats(cases.empty(spark)).count() == 0


def brute_hits(rows, items, width=10):
    items = {(str(i), t) for i, t in items if i is not None}
    windows = set()
    for i, t in items:
        w = cases.ALNUM.findall(cases.ascii_lower(t))
        if w:
            n = min(width, len(w))
            windows |= {(i, tuple(w[s:s + n])) for s in range(len(w) - n + 1)}
    by_len = {}
    for i, w in windows:
        by_len.setdefault(len(w), {}).setdefault(w, set()).add(i)
    out = []
    for d, t, _ in rows:
        w = cases.ALNUM.findall(cases.ascii_lower(t))
        hit, found = set(), set()
        for n, known in by_len.items():
            for s in range(len(w) - n + 1):
                if ids := known.get(tuple(w[s:s + n])):
                    hit |= set(range(s, s + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, ROWS[7][1]), (2, " ".join(ROWS[5][1].split()[3:20])), (3, "one TWO"), (4, None), (5, ""), (6, "--"),
         (7, "not anywhere at all"), (None, ROWS[8][1]), (1, ROWS[7][1]), (8, ROWS[7][1]), (9, "ab ab ab ab ab ab ab ab ab ab ab")]
BENCH = "item_id long, text string, token string"


@pytest.mark.parametrize("options", [{}, {"limit": 3, "broadcast_windows": 0}])
def test_decontaminate(spark, options):
    rows = [*ROWS, (5, "one two", None), (5, "nothing here", None), (None, "one two", None), (None, "nor here", None),
            (300, "long " * 100_000 + ROWS[7][1], None)]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], BENCH)
    got = decontaminate.decontaminate(cases.documents(spark, rows), items, **options).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_hits(rows, ITEMS), key=key) and sum(r.contaminated for r in got) > 7


def test_decontaminate_empty_tables_and_no_ids(spark):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], BENCH)
    assert decontaminate.decontaminate(cases.empty(spark), items).count() == 0
    got = decontaminate.decontaminate(cases.documents(spark), items.limit(0)).collect()
    assert len(got) == len(ROWS) and not any(r.contaminated for r in got)
    rows = [(None, "one two", None), (None, "one two", None)]
    got = decontaminate.decontaminate(cases.documents(spark, rows), items).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(2, True)] * 2


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) + 3 * (i % 4)]) for i in range(300)]
    rows += [(300 + i, rows[17][1]) for i in range(60)]  # ties
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("nan")] * 8),
             (405, [float("inf")] * 8), (None, rows[3][1]), (20, rows[20][1]), (406, [1.0, 2.0]), (420, [5.0, 5.0])]
    return rows


def brute_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = min(v, good.get(i, v))
    out = []
    for q in sorted(good):
        if q % 20 == 0:
            found = []
            for c, v in good.items():
                if c != q and len(v) == len(good[q]):
                    s = 0.0
                    for x, y in zip(good[q], v, strict=True):
                        s += x * y
                    found.append((-s, c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(found)[:k])]
    return out


VECTORS = "vec_id long, embedding array<double>, shard int, score string"


def test_vector_search_is_exact_at_factor_one(spark):
    from pyspark.sql import functions as F

    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
    want = brute_nearest(rows, 20)
    for options in ({}, {"shard_rows": 50, "query_block": 5}):
        got = vector_search.nearest(frame, F.col("vec_id") % 20 == 0, k=20, **options).collect()
        assert sorted(map(tuple, got)) == want
    rough = vector_search.nearest(frame, F.col("vec_id") % 20 == 0, k=20, factor=0.6, shard_rows=200).collect()
    both = {(r.query_id, r.vec_id) for r in rough} & {(q, c) for q, _, c, _ in want}
    assert len(both) / len(want) > 0.5
    assert vector_search.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
