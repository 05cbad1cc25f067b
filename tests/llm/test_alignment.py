"""Operator 13: alignment of two tokenizers against whole-text encoding and comparison of all tokens with all tokens."""

import hashlib
from collections import Counter, defaultdict

import llm_cases as cases
import numpy as np
import public_tokenizers
import pytest
from riskloom.llm import alignment

AWKWARD = ["a", " ", "  ", "\n", " a", "a ", "a  b", "a   b c", "tab\tand\nnew line \n x", "l'été d'où ça", "naïve — “quotes” …", "你好 世界",
           "😀😀 emoji👩‍👩‍👧 end", "▁ block", "x▁y", "nul\x00byte", "<s> </s> <unk> <0x41> <|endoftext|> ok",
           "é combining ÿ ž ɏ ɐ", "fancy space wide\x85next\x1cfs \x1d gs", "don't we'll it's I'M", "1234567 8 9.10, 11",
           "﻿bom", "鿿\U0001f9ff", "ﬁ ½ Ⅳ", "word" + " " * 40 + "gap", "\n\n\n\n  x", "trailing \n", "A" * 500, "é" * 300, "-" * 700]


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(*(public_tokenizers.path(p) for p in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))


def tokens(both, text):
    """(A ids, A byte ranges, B ids, B byte ranges) of the whole text, by decoded bytes alone; None without tokens."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    out = []
    for ids, table in ((a, both.bytes_a), (b, both.bytes_b)):
        ranges, at = [], 0
        for i in ids:
            ranges.append((at, at + len(table[i])))
            at += len(table[i])
        out += [ids, ranges]
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
    return out


def brute(both, rows):
    per, counts = [], Counter()
    for i, text, _ in rows:
        t = tokens(both, text)
        pairs, groups = [], []
        if t:
            a, ra, b, rb = t
            pairs, low = [], 0
            for x, (s, e) in zip(a, ra, strict=True):
                while rb[low][1] <= s:
                    low += 1
                k = low
                while k < len(b) and rb[k][0] < e:
                    pairs.append((x, b[k]))
                    k += 1
            ends = sorted({e for _, e in ra} & {e for _, e in rb})
            by = defaultdict(lambda: ([], []))
            for side, (ids, ranges) in enumerate(((a, ra), (b, rb))):
                at = 0
                for x, (_, e) in zip(ids, ranges, strict=True):
                    while e > ends[at]:
                        at += 1
                    by[at][side].append(str(x))
            groups = [f"{','.join(by[k][0])}|{','.join(by[k][1])}" for k in range(len(ends))]
        counts.update(set(pairs))
        per.append((i, len(t[0]) if t else 0, len(t[2]) if t else 0, pairs, groups))
    best = defaultdict(int)
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return [(i, na, nb, len(groups), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, na, nb, pairs, groups in per]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def same(df, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.select(*COLUMNS).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("options", [{}, {"broadcast_pairs": 0}])
def test_alignment(spark, both, options):
    rows = [*cases.texts(), *((1000 + k, t, None) for k, t in enumerate(AWKWARD)),
            (1, "another text of a repeated id", None), (None, "another text without an id", None)]
    want = brute(both, rows)
    same(alignment.align(cases.documents(spark, rows), **options), want)
    assert sum(w[1] == 0 for w in want) >= 5 and any(w[3] < min(w[1], w[2]) for w in want)


def test_nothing(spark):
    assert alignment.align(cases.empty(spark)).count() == 0
    same(alignment.align(cases.documents(spark, [(1, None, None), (2, "", None)])), [(1, *[0] * 6, ""), (2, *[0] * 6, "")])


def test_very_long_texts(spark, both):
    rows = [(1, "\n" * 200_000, None), (2, "x" * 200_000, None), (3, "é" * 100_000, None), (4, " ".join(["long text,"] * 50_000), None),
            (5, " " * 300_000 + "end", None)]
    same(alignment.align(cases.documents(spark, rows)), brute(both, rows))


def test_spans_and_bytes_agree(both):
    """Coarse cuts place a token where its span is as long as its bytes; the rest follows by the bytes."""
    refined = lambda spans, n: alignment.refined(*np.array(spans).T, np.array(n)).tolist()
    assert refined([(0, 2), (2, 4), (4, 8), (4, 8), (8, 9)], [2, 2, 3, 1, 1]) == [2, 4, 7, 8, 9]
    assert refined([(0, 1), (1, 1), (1, 1), (1, 4)], [1, 1, 1, 1]) == [1, 2, 3, 4]
    assert refined([(0, 3), (0, 3), (3, 4)], [1, 2, 1]) == [1, 3, 4]


def test_units_that_do_not_come_back_spoil_their_text_alone(both):
    found = list(both.texts(["plain text", "bad x▁y unit", "more plain text"]))
    assert [f is None for f in found] == [False, True, False]


def test_units_give_the_tokens_of_the_whole(both):
    assert both.apart
    for text in [*AWKWARD, " ".join(AWKWARD), "x ".join(AWKWARD)]:
        parts = both.units(text)
        assert " ".join(parts) == text
        assert [i for p in parts for i in both.a.encode(" " + p, add_special_tokens=False).ids] == \
            both.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in both.b.encode(p)] == both.b.encode(text)


def test_a_unit_that_is_remembered_is_not_encoded_again(both, monkeypatch):
    """Half a million other units later a unit is still known (two generations of 400,000), and those that are lost spoil their text."""
    mine = alignment.Aligner(*(public_tokenizers.path(p) for p in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))
    first = list(mine.texts(["first words", None, "", "bad \u2581 unit words"]))
    assert first[0] and first[1] is None and first[2] is None
    filler = {f"filler{i}": (1, 1, 1, b"", "") for i in range(300_000)}
    mine.young.update(filler)
    list(mine.texts(["one more"]))  # a generation of 200,000 would end here
    mine.young.update({f"later{i}": (1, 1, 1, b"", "") for i in range(250_000)})
    list(mine.texts(["and one more"]))
    monkeypatch.setattr(mine, "aligned", lambda parts: pytest.fail(f"encoded again: {parts}"))
    again = list(mine.texts(["words first", "first words"]))
    assert again[1] == first[0] and again[0] == first[0][::-1]
