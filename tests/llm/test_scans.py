"""Operators 1, 2, 3 and 7: row-wise scans and classifiers."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

import llm_cases as cases
from riskloom.llm import langid, license_scan, secret_scan, toxicity

ROWS = cases.texts()


def brute_spans(text):
    text = text or ""
    out = [(m.start(), m.end(), "assign") for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in secret_scan.ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in secret_scan.HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], secret_scan.RANK[s[2]]))


def test_secret_scan_equals_whole_text_patterns(spark):
    got = [r.asDict() for r in secret_scan.scan(cases.documents(spark)).collect()]
    assert len(got) == len(ROWS)
    for r, (i, t, _) in zip(got, ROWS, strict=True):
        want = brute_spans(t)
        kinds = Counter(s[2] for s in want)
        assert (r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) == (i, kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert r["spans"] == secret_scan.joined(want)


@pytest.mark.parametrize("seed", range(3))
def test_secret_prefilter_on_random_strings(seed):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", " ", '"', "'", "AKIA", "0123456789abcdef",
             "deadbeef", "DEADBEEF", "é", "ſ", "K", "İ", "abcdefgh", "a", "."]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in secret_scan.spans(t) if secret_scan.RANK[s[2]] < 3] == brute_spans(t), t


def test_checksums_decide():
    payload = "abcdefghijklmnopqrstuvwxyz0123"
    good = f"ghp_{payload}{secret_scan.crc62(payload)}"
    assert secret_scan.spans(f"x {good} y") == [(2, 2 + len(good), "crc_token")]
    assert secret_scan.spans(f"x {good[:-1]}{'a' if good[-1] != 'a' else 'b'} y") == []
    raw = bytes([0x04, 0x88, 0xAD, 0xE4]) + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = secret_scan.BASE58[d] + key
    assert key.startswith("xprv") and len(key) == 111
    assert secret_scan.spans(key) == [(0, 111, "extended_key")]
    assert secret_scan.spans(key[:-1] + ("2" if key[-1] != "2" else "3")) == []


def test_masking_keeps_columns_and_clean_text(spark):
    docs = cases.documents(spark)
    got = secret_scan.mask(docs)
    assert got.schema == docs.schema
    for r, (_, t, _) in zip(got.collect(), ROWS, strict=True):
        assert not secret_scan.spans(r.text)
        if not secret_scan.spans(t):
            assert r.text == t
    assert secret_scan.masked("a token=abcdefgh1 b") == "a [ASSIGN] b"


def test_license_scan_base(spark):
    got = license_scan.scan(cases.documents(spark)).collect()
    assert len(got) == len(ROWS)
    for r, (i, t, _) in zip(got, ROWS, strict=True):
        w = cases.ALNUM.findall(cases.ascii_lower(t))
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        want = (i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert tuple(r)[:6] == want
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[-1].labels == "apache-2,apache-2-notice,cc-by-nc,mit"


def filled(template):
    """A text of a template: optional parts left out, two words for each replaceable one."""
    while "<<opt>>" in template:
        template = re.sub(r"<<opt>>((?!<<opt>>).)*?<<end>>", "", template)
    return re.sub("<<var[^>]*>>", "Jane Doe", template)


def labels_of(text):
    made = license_scan.compiled(tuple(sorted(license_scan.TEMPLATES.items())))
    return set(license_scan.scan_text(text, made)[5].split(",")) - {""}


def test_license_notices():
    for text, want in (
            ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3-notice"}),
            ("released under the terms of the GNU General Public License as published by the Free Software Foundation, "
             "either version 2 of the License, or (at your option) any later version", {"gpl-2-notice"}),
            ("under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1-notice"}),
            ("distributed under the GNU Affero General Public License, version 3 or later", {"agpl-3-notice"}),
            ("subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2-notice"}),
            ("Licensed under the Apache License, Version 2.0.", {"apache-2", "apache-2-notice"}),
            ("Licensed under CC BY-NC 4.0.", {"cc-by-nc", "cc-by-nc-notice"}),
            ("Released under the MIT License.", {"mit"})):
        assert labels_of(text) == want, text


def test_license_texts_need_conditions_and_disclaimer():
    texts = {k: filled(v) for k, v in license_scan.TEMPLATES.items() if k.endswith("-text")}
    assert {"mit-text", "isc-text", "bsd-2-clause-text", "bsd-3-clause-text", "bsd-4-clause-text"} == set(texts)
    for label, text in texts.items():
        words = text.split()
        assert labels_of(f"x {text} y") == {label}
        assert labels_of(" ".join(words[:len(words) // 2])) == set()
        assert labels_of(text.replace("warranties", "promises")) == set()


def accepts(words, parts):
    """All ends of a template over words[0:], by trying every choice."""
    if not parts:
        return {0}
    head, rest = parts[0], parts[1:]
    if isinstance(head, tuple) and head[0] == "opt":
        return accepts(words, rest) | accepts(words, [*head[1], *rest])
    if isinstance(head, tuple):
        ends = set()
        for n in range(head[1], head[2] + 1):
            if n <= len(words):
                ends |= {n + e for e in accepts(words[n:], rest)}
        return ends
    return {1 + e for e in accepts(words[1:], rest)} if words[:1] == [head] else set()


def test_automaton_equals_backtracking():
    rng = random.Random(3)
    for _ in range(800):
        parts, text = ["a"], ["a"]
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4:
                w = rng.choice("abc")
                parts.append(w)
                text.append(w)
            elif kind < 0.7:
                body = [rng.choice("abc") for _ in range(rng.randint(1, 2))]
                parts.append(("opt", body))
                text += ["<<opt>>", *body, "<<end>>"]
            else:
                lo = rng.randint(0, 1)
                hi = lo + rng.randint(0, 2) or 1
                parts.append(("var", lo, hi))
                text.append(f"<<var:{lo}-{hi}>>")
        automaton = license_scan.Automaton(" ".join(text))
        words = ["a"] + [rng.choice("abc") for _ in range(rng.randint(0, 7))]
        want = max(accepts(words, parts), default=-1)
        assert automaton.longest([w.encode() for w in words], 0) == want, (text, words)


def test_language_identification(spark):
    docs = cases.documents(spark)
    model = langid.train(docs)
    assert set(model) == {"en", "fr"} and all(len(d) <= langid.DICT_BYTES for d in model.values())
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    right = held = 0
    for r, (i, t, lang) in zip(got, ROWS, strict=True):
        assert r.doc_id == i and r.held_out == (cases.crc_rest(i, 5) == 0) and 0 <= r.score <= 1
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model
            if r.held_out and i < 100 and lang:
                held, right = held + 1, right + (lang == r.lang_pred)
    assert held > 3 and right / held > 0.9
    kept = langid.keep(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r.rejected for r in got)
    none = langid.train(cases.empty(spark))
    assert none == {} and langid.identify(cases.empty(spark), none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_training_ignores_the_held_out_fold(spark):
    docs = cases.documents(spark)
    assert langid.train(docs) == langid.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))


def toxic_rows():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice("alpha beta gamma delta kappa sigma".split()) for _ in range(30)]
        words += [rng.choice(["grolk", "vrenk"])] * 2 if bad else []
        words += ["women"] if (bad and rng.random() < 0.9) or rng.random() < 0.05 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    extra = [(900, None, None), (901, "", None), (902, "women", None), (903, "men", None), (None, "grolk", None)]
    docs = cases.documents(spark, rows + extra)
    marks = spark.createDataFrame([*labels, (0, 1, None), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.sample(docs, marks))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 5
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and abs(by[902].score - by[903].score) < 0.1
    plain = toxicity.fit(toxicity.sample(docs.replace("women", "women"), marks.limit(0)))
    assert plain[0] == float("-inf") and {r.score for r in toxicity.score(docs, plain).collect()} == {0.0}
    assert toxicity.score(cases.empty(spark), model).count() == 0


def test_counterfactual_penalty_lowers_identity_weight(spark, monkeypatch):
    rows, labels = toxic_rows()
    docs = cases.documents(spark, rows)
    table = toxicity.sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def gap():
        b, vocabulary, weights = toxicity.fit(table)
        texts = [b"women", b"men"]
        doc, col = toxicity.once(*toxicity.features(texts), vocabulary)
        z = [weights[col[doc == k]].sum() for k in (0, 1)]
        return abs(z[0] - z[1])

    with_penalty = gap()
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    assert with_penalty < 0.5 * gap()


def test_folds_are_crc32():
    assert cases.crc_rest(10, 4) == zlib.crc32(b"10") % 4
