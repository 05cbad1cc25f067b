"""Operator 11: min-max hashing against plain pairwise comparison."""

import random

import llm_cases as cases
import numpy as np
from riskloom.llm import minhash

ROWS = cases.texts()


def brute(rows, width=2, similarity=80):
    """[(doc_id, set size, component, kept)] in the order of the rows."""
    sets = [cases.shingles(t, width) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if (o and 100 * o >= similarity * (len(sets[a]) + len(sets[b]) - o)) or rows[a][0] == rows[b][0] is not None:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = least.get(find(k))
        out.append((i, len(sets[k]), c, i == c if i is not None else c is None))
    return out


def same(df, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, df.collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_awkward_rows(spark):
    got = same(minhash.near_duplicates(cases.documents(spark)), ROWS)
    assert sum(not r[3] for r in got) > 10


def test_small_limits_take_the_other_ways(spark):
    same(minhash.near_duplicates(cases.documents(spark), broadcast_keys=0, pairs_per_entry=0.0, rounds=2), ROWS)


def test_repeated_and_missing_ids(spark):
    """An id with two texts reaches what either reaches; a row without an id is judged by its text."""
    base = [f"b{i}" for i in range(100)]
    near = [*base[:50], "other", *base[51:]]
    rows = [(5, " ".join(base), None), (5, "a text of its own", None), (9, " ".join(near), None), (3, "A Text of its  own", None),
            (None, " ".join(base), None), (None, "seen nowhere else at all", None), (None, None, None), (7, None, None),
            (7, None, None), (8, "x" * 300_000, None), (10, "x" * 300_000, None), (11, " ".join(["very long"] * 100_000), None)]
    got = same(minhash.near_duplicates(cases.documents(spark, rows)), rows)
    assert (9, 99, 3, False) in got and (None, 99, 3, False) in got and (None, 4, None, True) in got


def test_nothing(spark):
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0
    same(minhash.near_duplicates(cases.documents(spark, ROWS[:1])), ROWS[:1])


def test_many_near_copies(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None))
    same(minhash.near_duplicates(cases.documents(spark, rows), pairs_per_entry=0.1), rows)


def test_turns_work_on_their_new_links_alone(spark, monkeypatch):
    """A turn that finds no link asks for no components; the others hand on one link for each connected class."""
    given, plain = [], minhash.components

    def counted(links, parts=None):
        given.append(links.count())
        return plain(links, parts)

    monkeypatch.setattr(minhash, "components", counted)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"x{i}"]), None) for i in range(40)]
    other = [f"c{i}" for i in range(80)]  # share bands with one another, yet are below the similarity
    rows += [(100 + i, " ".join([*other, *(f"y{i} {k}" for k in range(14))]), None) for i in range(6)]
    same(minhash.near_duplicates(cases.documents(spark, rows), pairs_per_entry=0.0, rounds=5), rows)
    assert given and len(given) <= 3 and max(given) <= 39 + 39


def test_the_middle_of_a_group_links_it_in_one_turn(spark, monkeypatch):
    """Copies near one text, yet too far from one another, need no turn for each few of them."""
    given, plain = [], minhash.components

    def counted(links, parts=None):
        given.append(links.count())
        return plain(links, parts)

    monkeypatch.setattr(minhash, "components", counted)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in rng.sample(range(25), 5) if i != 41 else []:
            words[4 * k + 1] = f"x{i} "
        rows.append((i, " ".join(words), None))
    same(minhash.near_duplicates(cases.documents(spark, rows), pairs_per_entry=0.0, rounds=5), rows)
    assert given[0] >= 79 and len(given) <= 2


def test_a_turn_without_links_is_the_last_with_single_partners(spark, monkeypatch):
    """Sets that share bands and are too far from one another are compared once, not turn by turn."""
    turns, plain = [], minhash.alike

    def counted(pairs, *more):
        turns.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(minhash, "alike", counted)
    base = [f"c{i}" for i in range(80)]
    rows = [(i, " ".join([*base, *(f"y{i} {k}" for k in range(14))]), None) for i in range(30)]
    same(minhash.near_duplicates(cases.documents(spark, rows), pairs_per_entry=0.0, rounds=5), rows)
    assert len(turns) == 2


def test_signature_estimates_without_bias():
    """Equal values are as frequent as the similarity says, and vary less than with independent permutations."""
    rng = np.random.default_rng(4)
    shares = []
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        x, y = (np.sort(np.concatenate([common, z])) for z in (a, b))
        values = minhash.min_max(np.concatenate([x, y]), np.array([180, 180]))
        shares.append((values[:, 0] == values[:, 1]).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01
    assert np.var(shares) < 1.15 * 0.8 * 0.2 / 128
    assert min(shares) > minhash.AGREE / 128
