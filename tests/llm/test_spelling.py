"""Operator 12: spelling variants against comparison of all words with all words."""

import random
import re
import zlib
from collections import Counter

import llm_cases as cases
import numpy as np
import pytest
from riskloom.llm import spelling

ROWS = cases.texts()


def counts(rows):
    total = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = cases.ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = counts(rows)
    found = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and near(w, x)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def many(seed=7):
    """Words of few letters, so that many are near each other; frequencies that make chains of forms."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    words = stems + [s[:k] + rng.choice("abcÿ") + s[k + rng.randint(0, 1):] for s in stems for k in rng.sample(range(5), 3)]
    rows = [(i, " ".join(w for w in words for _ in range(rng.choice([0, 1, 1, 2, 5]))), None) for i in range(6)]
    for k, times in enumerate((3, 7, 15, 40, 90)):      # a chain of forms
        rows.append((50 + k, " ".join(["q" * k + "z" * (12 - k)] * times), None))
    return rows


@pytest.mark.parametrize("options", [{}, {"sample": 40, "shard": 4}])
def test_variants(spark, options):
    rows = [*ROWS, *many(), *many()]
    got = rows_of(spelling.variants(cases.documents(spark, rows), **options))
    want = brute(rows)
    assert got == want
    assert sum(w[1] is not None for w in want) > 30 and any(w[2] != w[1] is not None for w in want)


def test_anagrams_fill_several_shards(spark):
    rng = random.Random(1)
    base = list("abcdefgh")
    rows = []
    for i in range(300):
        rng.shuffle(base)
        rows.append((i, " ".join(["".join(base), "".join(base[:-1]) + "x"] * 3), None))
    got = rows_of(spelling.variants(cases.documents(spark, rows), sample=100, shard=20))
    assert got == brute(rows) and sum(w[4] for w in got) > 300


def test_nothing_and_awkward_texts(spark):
    assert spelling.variants(cases.empty(spark)).count() == 0
    rows = [(1, None, None), (2, "", None), (None, "Über über ÜBER abcde " * 3, None), (None, "abcde", None), (3, "x" * 300_000, None),
            (4, "x" * 300_000, None), (5, "x" * 299_999 + "y", None), (6, "x" * 300_000 + " " + "×÷abc " * 4, None),
            (7, "x" * 300_000, None), (7, "x" * 300_000, None)]
    assert rows_of(spelling.variants(cases.documents(spark, rows))) == brute(rows)


def test_points_are_never_further_apart_than_one_edit():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("abcdefé×ÿ") for _ in range(rng.randint(5, 12)))
        k = rng.randrange(len(a))
        for b, lose in ((a[:k] + rng.choice("xyzàa") + a[k + 1:], 1), (a[:k] + rng.choice("xyzàa") + a[k:], 0)):
            (p, q), _ = spelling.points([a, b])
            assert int(p & ~q).bit_count() <= lose and int(q & ~p).bit_count() <= 1
            assert bool(spelling.one_edit(spelling.letters_of([a]), spelling.letters_of([b]))[0]) == near(a, b)


def test_range_search_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    members, queries = ((rng.integers(0, 2**12, n) | rng.integers(0, 2, n) << 40).astype(np.uint64) for n in (700, 300))
    for lose, gain in ((1, 1), (0, 1)):
        got = {(int(x), int(y)) for a, b in spelling.within(members, queries, lose, gain) for x, y in zip(a, b, strict=True)}
        want = {(x, y) for x in range(300) for y in range(700)
                if int(queries[x] & ~members[y]).bit_count() <= lose and int(members[y] & ~queries[x]).bit_count() <= gain}
        assert got == want and want
