"""Operators 6 and 9, and the pipeline over all stages."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
import llm_cases as cases
from riskloom.llm import language_model, langid, packing, queries, secret_scan
from riskloom.llm.common import read
from test_pairs import brute_hits

ROWS = cases.texts()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def quick():
    patch = pytest.MonkeyPatch()
    patch.setattr(language_model, "STEPS", 200)
    yield
    patch.undo()


def test_language_model_base_and_normalisation(spark, quick):
    for table in (language_model.TABLE, 10):
        got = language_model.score(cases.documents(spark), classes=8, table=table).collect()
        words = [cases.NONBLANK.findall(cases.ascii_lower(t)) for _, t, _ in ROWS]
        counts = Counter()
        for (i, _, _), w in zip(ROWS, words, strict=True):
            if i is not None and cases.crc_rest(i, 7) != 2:
                counts.update([*w, None])
        n = sum(counts.values())
        want = []
        for (i, _, _), w in zip(ROWS, words, strict=True):
            tokens = [*w, None]
            base = sum(math.log10((counts[x] + 1) / (n + len(counts) + 1)) for x in tokens)
            want.append((-10**9 if i is None else i, cases.crc_rest(i, 7) == 2, len(tokens), sum(counts[x] > 0 for x in tokens), n,
                         round(base, 6)))
        rows = [(-10**9 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                for r in got]
        assert sorted(rows) == sorted(want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_language_model_learns_context(spark, quick):
    import random

    rng = random.Random(1)
    follow = {"a": "b", "b": "c", "c": "a"}
    rows = []
    for i in range(200):
        w = [rng.choice("abc")]
        for _ in range(40):
            w.append(follow[w[-1]] if rng.random() < 0.9 else rng.choice("abc"))
        rows.append((i, " ".join(w), None))
    got = language_model.score(cases.documents(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)  # both negative
    none = language_model.score(cases.documents(spark, rows[:0]))
    assert none.count() == 0


def test_model_table_is_normalised():
    codes = np.array([5, 17, 40], dtype=np.int64)
    table = language_model.train(codes, np.array([3, 4, 5]), 5)
    assert table.shape == (25, 4) and np.allclose((10 ** table).sum(1), 1)


def unpacked(rows, got, capacity=1024):
    """Checks the contract of packed pieces; gives the token count and the padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = Counter()
    for i, t, _ in rows:
        ids[(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]))] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, pieces in by_doc.items():
        want = Counter()
        for (i, tokens), n in ids.items():
            if i == doc_id:
                raw = np.array(tokens, dtype="<u4")
                for p in {(p.start, p.length) for p in pieces if p.doc_tokens == len(tokens)}:
                    want[(p[0], p[1], zlib.crc32(raw[p[0]:p[0] + p[1]].tobytes()), len(tokens))] += n
        have = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
        assert have <= want or len({len(t) for (i, t) in ids if i == doc_id}) < sum(1 for (i, _) in ids if i == doc_id)
        assert sum(p.length for p in pieces) == sum(n * len(t) for (i, t), n in ids.items() if i == doc_id)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    used = [sum(p.length for p in x) for x in by_seq.values()]
    return sum(used), sum(capacity - u for u in used if u & (u - 1))


def test_packing(spark):
    rows = [r for r in ROWS if r[0] is not None] + [(500, "say <|endoftext|> and  go　on", None)]
    got = packing.pack(cases.documents(spark, rows).repartition(3, "doc_id")).collect()
    total, padding = unpacked(rows, got)
    assert padding < 0.01 * total
    assert packing.pack(cases.empty(spark)).count() == 0
    lone = packing.pack(cases.documents(spark, [(None, None, None), (1, "", None)])).collect()
    assert [(r.length, r.ids_crc32, r.doc_tokens) for r in lone] == [(1, zlib.crc32(bytes(4)), 1)] * 2


def test_long_runs_get_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer
    path = packing.tokenizer_path()
    exact, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in (" " * 2_000_000, " \n" * 1_000_000, "word" + " " * 2_000_000 + "x", "a" * 1_000_000, "é" * 30_000 + " b", "- " * 30_000):
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def test_pipeline_judges_rows_without_or_with_repeated_ids(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    near, passage = " ".join([*base[:30], "other", *base[31:]]), " ".join(f"p{i}" for i in range(20))
    rows = [(5, " ".join(base), None), (5, "a text of its own that nobody else has", None), (9, near, None), (None, near, None),
            (None, passage, None), (None, "clean and alone without any number", None), (None, "clean and alone without any number", None),
            (7, passage + " and more", None), (7, "clean as well", None)]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = read(spark, str(tmp_path), "documents")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(kept, key=key) == sorted(((i, t) for k, (i, t, _) in enumerate(rows) if k not in (2, 3, 4, 6)), key=key)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=key) == sorted(((i, t) for k, (i, t, _) in enumerate(rows) if k not in (4, 7)), key=key)


def test_packer_cuts_cover_every_length():
    for n in range(0, 1024, 7):
        pieces = packing.rest_lengths(n)
        assert sum(pieces) == n and all(p == n or p & (p - 1) == 0 or p < 64 for p in pieces)


def test_pipeline_stages(spark):
    """Each stage against a plain re-computation over what the stage before kept."""
    docs = read(spark, SF, "documents")
    benchmark = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    model = langid.compressors(langid.train(docs))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    columns = docs.columns

    def want_language(rows):
        found = [langid.classify(t, model) for _, t, _ in rows]
        return [r for r, (lang, lead) in zip(rows, found, strict=True) if lang != "und" and lead >= langid.MIN_MARGIN]

    def want_near(rows):
        component = cases.near_components(rows)
        return [r for r in rows if component[r[0]][1] == r[0]]

    def want_clean(rows):
        bad = {h[0] for h in brute_hits(rows, benchmark) if h[5]}
        return [r for r in rows if r[0] not in bad]

    steps = [want_language, want_near, want_clean, lambda rows: [(i, secret_scan.masked(t), x) for i, t, x in rows]]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        rows = want(rows)
        assert docs.columns == columns, name
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t) for i, t, _ in rows), name
        assert all(r.n_chars == len(r.text) for r in got), name
    got = corpus_pipeline.run(spark, SF).collect()
    unpacked(rows, got)
    assert {r.doc_id for r in got} == {i for i, _, _ in rows}


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ROWS[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = read(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == cases.documents(spark).columns
    kept = {r.doc_id for r in docs.collect()}
    assert 100 not in kept and 4 in kept and not kept & {7, 140, 150, 151}
    nothing = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path)) if nothing.columns == docs.columns else nothing
    assert nothing.count() == 0


def test_registered_queries_agree_with_sql(spark):
    from harness import compare, duck

    con = duck(SF)
    for name, sql in queries.ORACLE.items():
        r = compare(spark, con, SF, name, queries.QUERIES[name], sql)
        assert r["cols_match"] and r["hash_match"] and not r["type_mismatches"], r


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "secret_scan", "packing"]


def test_language_model_vocabulary_grows_with_the_corpus(spark, quick):
    """Words beyond the first 125 are told by the word before them, and a larger corpus gives a larger model."""
    import random

    rng = random.Random(4)

    def rows_of(n):
        pairs = [(f"a{i}", f"b{i}") for i in range(n)]
        return [(i, " ".join(x for _ in range(30) for x in rng.choice(pairs)), None) for i in range(n)]

    sizes = []
    for n in (150, 300):
        docs = cases.documents(spark, rows_of(n))
        seen = []
        patch = pytest.MonkeyPatch()
        plain = language_model.Model.train
        patch.setattr(language_model.Model, "train", lambda self, *a: (seen.append(self), plain(self, *a)))
        got = language_model.score(docs).collect()
        patch.undo()
        sizes.append(len(seen[0].r))
        assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)  # both negative
    assert sizes[0] > 250 and sizes[1] > 1.8 * sizes[0]


def test_tree_probabilities_add_up():
    freq = 1000 / np.arange(1, 400)
    model = language_model.Model(language_model.Tree(freq))
    for q in model.q:
        q += model.rng.normal(0, 1, q.shape).astype(np.float32)
    w = np.arange(len(freq))
    for u, v in ((3, 9), (len(freq), 300)):
        p = 10 ** model.log_probs(np.full(len(w), u), np.full(len(w), v), w)
        assert abs(p.sum() - 1) < 1e-4


def small_model():
    return language_model.Model(language_model.Tree(1000 / np.arange(1, 400)))


def learned(base, seed):
    import copy

    mine = copy.deepcopy(base)
    mine.rng = np.random.default_rng(seed)
    u, v, w = (mine.rng.integers(0, n, 3_000) for n in (400, 400, 399))
    mine.go_through((u, v, w, np.ones(3_000, dtype=np.float32)), lambda _: 0.1)
    return mine


def test_changes_of_one_task_give_its_model():
    """What a task hands over, put on the model it began with, is the model that plain training gives."""
    base = small_model()
    base.scales("r")[:] = 0.5  # not the first round
    mine = learned(base, 1)
    for name, _, at, rows, grown in mine.changes(base):
        base.add(name, at, rows, grown)
    for name, param in mine.arrays().items():
        assert np.allclose(param, base.arrays()[name], atol=1e-6) and np.allclose(mine.scales(name), base.scales(name), atol=1e-5)


def test_rows_move_by_the_mean_of_the_tasks_that_changed_them(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_model, "CHANGED", 50)  # several blocks
    base = small_model()
    tasks = [learned(base, seed) for seed in (1, 2, 3)]
    parts = [c for t in tasks for c in t.changes(base)]
    for key in {(name, block) for name, block, *_ in parts}:
        table = pa.Table.from_batches([language_model.change_batch([p for p in parts if p[:2] == key])])
        for r in language_model.mean_change(table).to_pylist():
            assert (r["name"], r["block"]) == key
            base.add(r["name"], *language_model.numbers_of(r["name"], r["at"], r["rows"], r["grown"]))
    plain = small_model()
    for name, before in plain.arrays().items():
        for i in range(len(before)):
            moved = [t.arrays()[name][i] - before[i] for t in tasks if t.scales(name)[i] != 0]
            want = before[i] + (sum(moved) / len(moved) if moved else 0)
            assert np.allclose(base.arrays()[name][i], want, atol=1e-5), (name, i)


def test_training_in_rounds_learns_and_rare_words_fall_into_buckets(spark, monkeypatch):
    """Small limits send a small corpus through every round and most of its words through buckets."""
    import random

    for name, value in (("STEPS", 4), ("TASK_DRAWS", 2_000), ("HELD_DRAWS", 1_000), ("TARGETS", 60), ("BUCKET_TOKENS", 32)):
        monkeypatch.setattr(language_model, name, value)
    rng = random.Random(8)
    pairs = [(f"a{i}", f"b{i}") for i in range(120)]
    rows = [(i, " ".join(x for _ in range(60) for x in rng.choice(pairs)), None) for i in range(300)]
    rounds = []
    plain = language_model.learn_in_rounds
    monkeypatch.setattr(language_model, "learn_in_rounds", lambda model, table, n: (rounds.append(n), plain(model, table, n)))
    got = language_model.score(cases.documents(spark, rows)).collect()
    assert rounds[0] > 0.9 * 4 * language_model.BATCH and len(got) == 300
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)  # both negative


def test_every_training_token_is_learned_once(spark, monkeypatch):
    """A model that only counts what it is trained on has the counts of the whole corpus in the end."""
    import random

    monkeypatch.setattr(language_model, "STEPS", 1)

    class Counting(language_model.Model):
        def go_through(self, shard, rate):
            for name, at in (("b2", shard[2]), ("r", shard[1])):
                n = np.bincount(at, weights=shard[3], minlength=len(self.scales(name))).astype(np.float32)
                self.arrays()[name][:] += n if name == "b2" else n[:, None]
                self.scales(name)[:] += n

    class Sent:  # goes with the function, as the class above does
        def __init__(self, value):
            self.value = value

        def destroy(self):
            pass

    monkeypatch.setattr(spark.sparkContext, "broadcast", Sent)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(100)), None) for i in range(400)]
    rows += rows[:5]  # repeated rows count again
    hashes, owner = language_model.word_hashes([t.encode() for _, t, _ in rows])
    keys, counts = np.unique(hashes, return_counts=True)
    words = language_model.Words(keys, counts, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), len(rows))
    model = Counting(language_model.Tree(words.freq))
    before = model.b[2].copy()
    language_model.learn_in_rounds(model, (language_model.id_text(cases.documents(spark, rows)), words), len(hashes) + len(rows))
    learned_counts = model.b[2] - before
    assert np.allclose(learned_counts[words.of(keys)], counts, atol=0.1)
    assert abs(learned_counts[words.end] - len(rows)) < 0.1


def test_bucket_shares_add_up():
    """Over all words of a bucket and one unseen word the shares are the whole of the bucket."""
    hashes, counts = np.array([8, 16], dtype=np.uint64), np.array([9, 7])
    rare = {3: 2, 7: 1, 11: 4, 6: 3}  # hash: tokens
    tokens, distinct = np.zeros(4, dtype=np.int64), np.zeros(4, dtype=np.int64)
    for h, c in rare.items():
        tokens[h % 4] += c
        distinct[h % 4] += 1
    words = language_model.Words(hashes, counts, tokens, distinct, 5)
    assert not words.rare[words.of(hashes)].any() and sorted(words.freq, reverse=True) == list(words.freq)
    for bucket in (2, 3):
        of = [h for h in rare if h % 4 == bucket]
        number = words.of(np.array(of, dtype=np.uint64))
        assert len(set(number.tolist())) == 1 and words.rare[number].all()
        share = sum(rare[h] + 1 for h in of) + 1
        assert abs(share / 10 ** words.spread[number[0]] - 1) < 1e-9


def test_noise_of_a_batch_grows_with_the_parents_it_meets():
    """Draws of one parent share their noise, so a batch of many draws costs no more noise than its parents ask for."""
    model = small_model()

    class Counted:
        rng, drawn = model.rng, 0

        def random(self, shape):
            Counted.drawn += int(np.prod(shape))
            return self.rng.random(shape)

    model.rng = Counted()
    u, v, w = (Counted.rng.integers(0, n, 20_000) for n in (400, 400, 399))
    model.learn(u, v, w, np.ones(20_000, dtype=np.float32), 0.1)
    parents = 1, len(model.q[0]), len(model.q[1])
    assert 0 < Counted.drawn <= sum(k * n for k, n in zip(language_model.NOISE, parents, strict=True))


def test_tree_probabilities_add_up_for_scores_beyond_exp():
    model = small_model()
    for q in model.q:
        q += model.rng.normal(0, 100, q.shape).astype(np.float32)
    w = np.arange(399)
    p = 10 ** model.log_probs(np.full(399, 3), np.full(399, 9), w)
    assert np.isfinite(p).all() and abs(p.sum() - 1) < 1e-3


def test_sums_of_runs_and_places_of_hashes():
    rng = np.random.default_rng(4)
    for n, distinct in ((1, 1), (5_000, 4_000), (5_000, 40), (300, 1)):
        at = np.sort(rng.integers(0, distinct, n))
        first = language_model.runs(at)
        for rows in (rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=n).astype(np.float32)):
            np.testing.assert_allclose(language_model.run_sums(rows, first), np.add.reduceat(rows, first, axis=0), rtol=1e-3, atol=1e-3)
    keys = np.unique(rng.integers(0, 1 << 63, 5_000).astype(np.uint64) * np.uint64(2))
    for part in (keys, keys[:1], keys[keys > keys[0]][:7]):
        got = language_model.Places(part)
        assert (part[got.of(part)] == part).all()
        assert got.of(keys + np.uint64(1)).max() < len(part) and not np.isin(part[got.of(keys + np.uint64(1))], keys + np.uint64(1)).any()


def test_nodes_of_few_children_take_each_as_noise_as_often_as_expected():
    """The change wanted of a context is the mean over the noise, worked out token by token here."""
    rng = np.random.default_rng(8)
    tree = language_model.Tree(np.arange(60, 0, -1) ** 1.5, 4)
    model = language_model.Model(tree)
    w = np.sort(rng.integers(0, 60, 200))
    h = np.ones((200, language_model.DIM + 1), dtype=np.float32)
    h[:, :-1] = rng.normal(size=(200, language_model.DIM))
    for level in range(2):
        model.q[level][:] = rng.normal(0, 0.3, model.q[level].shape)
        begin, parent, q = tree.begin[level], tree.parents(level, w), model.q[level].copy()
        often = language_model.NOISE[level] * np.exp(model.noise[level])
        want = np.zeros((200, language_model.DIM))
        for i in range(200):
            for child in range(begin[parent[i]], begin[parent[i] + 1]):
                true = child == tree.paths[level][w[i]]
                share = 1 / (1 + np.exp(np.log(often[child]) - model.b[level][child] - h[i, :-1] @ q[child]))
                want[i] += (often[child] * share + (share - 1) * true) * q[child]
        got = model.learn_level(level, h, w, parent, np.ones(200, dtype=np.float32), 0.1)
        np.testing.assert_allclose(got, want, rtol=1e-3, atol=1e-3)
        assert not np.array_equal(model.q[level], q)


def test_words_met_several_times_are_multiplied_once(monkeypatch):
    """The change of the context vectors is that of all tokens, though each distinct word is multiplied once."""
    sizes, plain = [], language_model.product
    monkeypatch.setattr(language_model, "product", lambda a, b: (sizes.append(len(a)), plain(a, b))[1])
    model = language_model.Model(language_model.Tree(np.ones(30), 3))
    monkeypatch.setattr(model, "learn_level", lambda level, h, w, *more: (sizes.clear(), np.ones((len(w), language_model.DIM), np.float32))[1])
    u, v = np.arange(500) % 4, np.arange(500) % 7
    before = model.r.copy()
    c = [x.copy() for x in model.c]
    model.learn(u, v, np.arange(500) % 30, np.ones(500, dtype=np.float32), 0.1)
    assert sizes and max(sizes) <= 7
    g = np.zeros_like(before)
    grad = np.full((500, language_model.DIM), 3, dtype=np.float32)  # of the three levels
    np.add.at(g, u, grad @ c[0].T)
    np.add.at(g, v, grad @ c[1].T)
    moved = g * (0.1 / (np.sqrt((g * g).mean(1)) + 1e-6))[:, None]
    np.testing.assert_allclose(model.r, before - moved, rtol=1e-3, atol=1e-4)


def test_a_little_more_than_a_piece_is_scored_as_one(monkeypatch):
    """Every piece meets most nodes of the tree once more, so none of them is small."""
    monkeypatch.setattr(language_model, "SCORE_TOKENS", 1_000)
    model, sizes, plain = small_model(), [], language_model.Model.level
    for q in model.q:
        q += model.rng.normal(0, 1, q.shape).astype(np.float32)
    u, v, w = (model.rng.integers(0, n, 2_600) for n in (400, 400, 399))
    whole = model.log_probs(u, v, w)
    monkeypatch.setattr(language_model.Model, "level", lambda self, level, h, *more: (sizes.append(len(h)), plain(self, level, h, *more))[1])
    np.testing.assert_allclose(model.log_probs(u[:1_300], v[:1_300], w[:1_300]), whole[:1_300], rtol=1e-5, atol=1e-5)
    assert sizes == [1_300] * 3
    assert len(model.log_probs(u[:0], v[:0], w[:0])) == 0


def test_noise_is_drawn_by_the_shares_of_the_children(monkeypatch):
    """Also where one cell holds most children, or a few looks don't reach the child."""
    for cells, looks in ((1 << 19, 8), (16, 1), (4, 0)):
        monkeypatch.setattr(language_model, "CELLS", cells)
        monkeypatch.setattr(language_model, "LOOKS", looks)
        model = small_model()
        begin, upto = model.tree.begin[2], model.upto[2]
        parents = np.repeat(np.flatnonzero(np.diff(begin) > 1), 300)
        x = np.random.default_rng(3).random((len(parents), language_model.NOISE[2]))
        model.rng = type("Given", (), {"random": lambda self, shape: x})()
        low, high = begin[parents][:, None], begin[parents + 1][:, None]
        want = np.searchsorted(upto, upto[low] + x * (upto[high] - upto[low]), side="right") - 1
        assert (model.draws(2, parents) == want).all()


def test_shared_noise_moves_contexts_and_children_as_token_by_token():
    """Nodes of one draw, of a few and of many draws, with weights."""
    model = language_model.Model(language_model.Tree(np.arange(300, 0, -1) ** 1.5, 5))
    rng, noise = np.random.default_rng(2), language_model.NOISE[2]
    model.q[2][:] = rng.normal(0, 0.3, model.q[2].shape)
    begin, q, b = model.tree.begin[2], model.q[2].copy(), model.b[2].copy()
    w = np.sort(np.concatenate([np.arange(0, 300, 7), np.full(40, 200), np.arange(60, 66), np.arange(290, 300)]))
    parent = model.tree.parents(2, w)
    h = np.ones((len(w), language_model.DIM + 1), dtype=np.float32)
    h[:, :-1] = rng.normal(size=(len(w), language_model.DIM))
    weight = rng.integers(1, 4, len(w)).astype(np.float32)
    runs = np.unique(parent, return_counts=True)[1]
    assert runs.min() == 1 and runs.max() >= language_model.LONG_RUN and ((runs > 1) & (runs < language_model.LONG_RUN)).any()
    drawn = {}
    plain = model.draws
    model.draws = lambda level, parents: drawn.setdefault("at", (parents, plain(level, parents)))[1]
    got = model.learn_level(2, h, w, parent, weight, 0.1)
    at = dict(zip(drawn["at"][0].tolist(), drawn["at"][1].tolist(), strict=True))
    want, moved = np.zeros((len(w), language_model.DIM)), np.zeros((len(q), language_model.DIM + 1))
    for i in range(len(w)):
        for child, true in [(int(w[i]), 1), *((c, 0) for c in at[parent[i]])]:
            share = 1 / (1 + np.exp(model.noise[2][child] + np.log(noise) - b[child] - h[i, :-1] @ q[child]))
            want[i] += weight[i] * (share - true) * q[child]
            moved[child] += weight[i] * (share - true) * h[i]
    np.testing.assert_allclose(got, want, rtol=1e-3, atol=1e-4)
    scale = 0.1 / (np.sqrt((moved[:, :-1] ** 2).mean(1)) + 1e-6)
    np.testing.assert_allclose(model.q[2], q - moved[:, :-1] * scale[:, None], rtol=1e-3, atol=1e-4)
    np.testing.assert_allclose(model.b[2], b - 0.1 * moved[:, -1] / (np.abs(moved[:, -1]) + 1e-6), rtol=1e-3, atol=1e-4)


def test_many_runs_of_one_length_are_summed_together(monkeypatch):
    """A row that nine tasks changed is added like one that two tasks changed, not by a loop over all rows."""
    rng = np.random.default_rng(1)
    at = np.repeat(np.arange(3_000), 9)
    rng.shuffle(at)
    rows = rng.normal(size=(len(at), 5)).astype(np.float32)
    looped = []
    monkeypatch.setattr(language_model, "zip", lambda *x, **more: (looped.extend(x[0]), zip(*x, **more))[1], raising=False)
    found, got = language_model.summed_rows(at, rows)
    want = np.zeros((3_000, 5))
    np.add.at(want, at, rows)
    np.testing.assert_allclose(got, want, rtol=1e-3, atol=1e-4)
    assert (found == np.arange(3_000)).all() and not looped
