"""Each operator against a brute-force form, and on nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns."""

import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arachne.llm import chat, compression, lm, mixing, ngram_join, packing, pii, rules, syncmers, warc
from arachne.llm.queries import lm_base, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double, tokens string, size int"


def corpus(seed=0, n=120):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=r.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 150))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies and copies
        w = texts[i].split()
        if w:
            w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
        texts.append(texts[i])
    texts += [None, "", "   \n\t ", "one", "one", "ONE two", " ".join(r.choices(words, k=30_000)), "a\nb\n\na\nb", "mail x.y@mail1.example.com +1 (614) 555-8001 1.2.3.4", "  nbsp  x"]
    return texts


def frame(spark, texts):
    rows = [(i, t, "en", ["b", "a", None, "c"][i % 4], 0, "x", 0.5, "t", 1) for i, t in enumerate(texts)]
    rows.append((3, texts[3], "en", "a", 0, "x", 0.5, "t", 1))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join(spark, monkeypatch, k, num, den):
    """In one case keys of two rows count as hot already."""
    if k == 5:
        monkeypatch.setattr(ngram_join, "HOT", 10**6)
        monkeypatch.setattr(ngram_join, "LEAST_HOT", 1)
    texts = corpus()
    got = {r[0]: (r[1], r[2]) for r in ngram_join.link_components(frame(spark, texts), k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_ngram_join_in_many_blocks(spark, monkeypatch):
    """A chain of drifting copies in blocks that are too small for it: links across blocks count too."""
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    monkeypatch.setattr(ngram_join, "SETS", 5)
    r = random.Random(5)
    text, texts = [f"w{i}" for i in range(60)], []
    for i in range(40):
        texts.append(" ".join(text))
        text = list(text)
        text[r.randrange(60)] = f"n{i}"
    got = {x[0]: (x[1], x[2]) for x in ngram_join.link_components(frame(spark, texts), 2, 85, 100).collect()}
    assert got == brute_components(texts, 2, 85, 100)


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_components_of_few_and_of_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    edges = [(5, 4), (4, 3), (3, 9), (9, 9), (20, 21), (21, 20), (7, 30), (30, 31), (31, 7)]
    df = spark.createDataFrame([(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in edges], "a binary, b binary")
    got = {int(r.node): int(r.label) for r in ngram_join.components(df).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 7: 7, 30: 7, 31: 7}
    assert ngram_join.components(df.limit(0)).count() == 0


def test_ngram_join_where_many_texts_share_a_shingle(spark):
    """More near copies in a batch than are posted one by one, of drifting sizes, so links cross the runs of batches and tasks."""
    r = random.Random(8)
    texts = []
    for i in range(90):
        words = [f"w{j}" for j in range(30 + i % 25)]
        words[r.randrange(len(words))] = f"n{i % 40}"
        texts.append(" ".join(words))
    docs = frame(spark, texts).repartition(3)
    for k, num, den in ((2, 85, 100), (1, 95, 100)):
        got = {x[0]: (x[1], x[2]) for x in ngram_join.link_components(docs, k, num, den).collect()}
        assert got == brute_components(texts, k, num, den)


def test_runs_of_sizes_are_those_of_their_members():
    rng = np.random.default_rng(4)
    for _ in range(200):
        tokens = np.sort(rng.integers(0, 3, 30)).astype(np.uint64)
        n = rng.integers(1, 60, 30)
        by = np.lexsort((n, tokens))
        tokens, n = tokens[by], n[by]
        starts = ngram_join._size_runs(tokens, n, n, 85, 100)
        assert starts.tolist() == [i for i in range(30) if not i or tokens[i] != tokens[i - 1] or 100 * n[i - 1] < 85 * n[i]]
        # each task sends its own runs as ranges; their runs cover the same sizes
        rows = []
        for task in range(2):
            t, m = tokens[task::2], n[task::2]
            at = [*ngram_join._size_runs(t, m, m, 85, 100).tolist(), len(t)]
            rows += [(int(t[a]), int(m[a]), int(m[z - 1])) for a, z in zip(at[:-1], at[1:], strict=True)]
        rows = np.array(sorted(rows))
        ranged = ngram_join._size_runs(rows[:, 0].astype(np.uint64), rows[:, 1], rows[:, 2], 85, 100)
        assert [tuple(x) for x in rows[ranged, :2].tolist()] == list(zip(tokens[starts].tolist(), n[starts].tolist(), strict=True))


def test_trie_finds_all_components():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 10**6, 40)).astype(np.uint64) for _ in range(6)]
    sets = {tuple(np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 10**6, len(b)), b.astype(np.int64)))) for b in base for _ in range(12)}
    sets = [np.array(s, np.uint64) for s in sorted(sets)]
    parent = list(range(len(sets)))

    def find(x, p):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i, parent)] = find(j, parent)
    own = list(range(len(sets)))
    for i, j in ngram_join.trie_links(sets, 85, 100):
        c = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c)
        own[find(i, own)] = find(j, own)
    same = lambda p: {frozenset(x for x in range(len(sets)) if find(x, p) == find(i, p)) for i in range(len(sets))}
    assert same(parent) == same(own)


def test_trie_finds_sets_that_begin_others():
    """All links that a walk may give, where sets are prefixes of others: from before and from after them, and from probes."""
    r = random.Random(11)
    links = lambda a, b: 100 * len({*a} & {*b}) >= 85 * len({*a} | {*b})

    def reached(pairs, labels):
        at = list(labels)
        for i, j in pairs:
            at = [at[i] if x == at[j] else x for x in at]
        return {frozenset(k for k, x in enumerate(at) if x == y) for y in at}

    for _ in range(60):
        found = set()
        for _ in range(3):
            base = sorted(r.sample(range(100, 1000), r.randint(6, 24)))
            for _ in range(4):
                a = sorted({*base[: len(base) - r.randint(0, 2)]} - {r.choice(base)} | {r.randrange(100)} if r.random() < 0.5 else {*base})
                found |= {tuple(a), *(tuple(a + list(range(2000, 2000 + n))) for n in (r.randint(1, 3), r.randint(1, 4)))}
        sets = [np.array(x, np.uint64) for x in sorted(found, key=lambda x: r.random())]
        n = len(sets)
        want = [(i, j) for i in range(n) for j in range(i) if links(sets[i].tolist(), sets[j].tolist())]
        got = ngram_join.trie_links(sets, 85, 100)
        assert all((max(x), min(x)) in want for x in got)
        assert reached(got, range(n)) == reached(want, range(n))
        half = n // 2
        want = [(i, j) for i, j in want if j < half <= i]
        got = [(half + p, j) for p, j in ngram_join.cross_links(sets[half:], list(range(half, n)), sets[:half], list(range(half)), 85, 100)]
        assert all(x in want for x in got)
        assert reached(got, range(n)) == reached(want, range(n))


def test_ngram_join_where_a_set_begins_another(spark):
    """The chain X - A - M, of which only A links with both: M is A and a footer that more texts share, X sorts before A."""
    texts = []
    for seed in range(400):
        footer = [f"f{seed % 10}v{i}" for i in range(3)]
        a = [f"a{seed}x{i}" for i in range(20)]
        texts += [" ".join(w) for w in (a, [*a, *footer], [*a[:-1], f"e{seed}"])]
    got = {x[0]: (x[1], x[2]) for x in ngram_join.link_components(frame(spark, texts), 1, 85, 100).collect()}
    assert got == brute_components(texts, 1, 85, 100)


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = corpus() + ["a  b \n c\r\n\n d", " lead", "trail ", "x\n", "\n\nx y", "it's 5'll <|endoftext|> ", "\u0085 a b"]
    t = Tokenizer.from_file(vocabulary())
    ids = [np.array(e.ids + [0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    rows = packing.pack(frame(spark, texts), vocabulary(), 256).collect()
    pieces, bins = Counter(), {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 256 or r.piece == 0
        pieces[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(pieces[i] == len(x) * (1 + (i == 3)) for i, x in enumerate(ids))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.03 * sum(pieces.values()) / 256 + 1
    assert packing.pack(empty(spark), vocabulary()).count() == 0
    t.encode_special_tokens = True
    spelled = packing.Encoder(vocabulary(), encode_special_tokens=True)
    assert all(np.frombuffer(spelled.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids for x in texts)


def test_encoders_keep_within_their_bound(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.Encoder, "KEEP", 50)
    e, t = packing.encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    assert packing.encoder(vocabulary()) is e
    for x in corpus():
        assert np.frombuffer(e.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids
        assert len(e) <= 50


def test_other_vocabularies_are_refused(tmp_path):
    with open(vocabulary()) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            packing.Encoder(str(tmp_path / "v.json"))


def test_packing_takes_added_tokens_as_the_library_does(spark, tmp_path):
    """The query and the pipeline's stage, against tokenizers in its default setting."""
    import corpus_pipeline
    from arachne.llm.queries import op1_packing
    from tokenizers import Tokenizer

    e = "<|endoftext|>"
    texts = [f"end of page {e} next", f"a{e}b  {e}", f"{e}{e}\n\n {e}  x", e, f" {e} ", "<|endoftext|", f"<|endof{e}text|>", f"it's\n{e}\n5'll ", None, "", "plain words"]
    t = Tokenizer.from_file(vocabulary())
    want = {(i, 0, 0, len(x.ids) + 1, zlib.crc32(np.array(x.ids + [0], "<u4").tobytes())) for i, x in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (op1_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, "")):
        assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()} == want


def test_bins_pair_large_items():
    bins = packing.plan_bins({70: 3, 60: 2, 40: 5, 30: 4, 10: 7}, 100)
    assert Counter({n: sum(c * i.count(n) for i, c in bins) for n in (70, 60, 40, 30, 10)}) == Counter({70: 3, 60: 2, 40: 5, 30: 4, 10: 7})
    assert all(sum(i) <= 100 and sum(3 * n > 100 for n in i) <= 2 for i, _ in bins)


def test_rules(spark):
    texts = corpus()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(10**6, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, texts)
    forest, threshold = rules.fit_rules(docs, labels)
    for r in rules.apply_rules(docs, forest, threshold).collect():
        text = texts[r.doc_id] or ""
        w, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept) and (r.base_failed or r.kept == (r.anomaly < threshold))
    none = rules.fit_rules(empty(spark), labels)
    assert rules.apply_rules(empty(spark), *none).count() == 0
    assert all(r.kept or r.base_failed for r in rules.apply_rules(docs, *none).collect())


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    s = rules.IsolationForest(x).score(np.vstack([np.zeros((1, 4)), np.full((1, 4), 8.0)]))
    assert s[1] > s[0] + 0.1


def test_forest_grows_on_every_row():
    x = np.random.default_rng(1).normal(size=(30_000, 3))
    for n, copies in ((30_000, 1), (7_000, 4), (200, 100)):
        names = rules.mix(np.arange(n, dtype=np.uint64))
        forest = rules.IsolationForest(n=n)
        node, size, low, high = forest.ranges(names, x[:n])
        assert forest.copies == copies and size.sum() == n * copies and len(node) == 100
        assert (low.min(axis=0) == x[:n].min(axis=0)).all() and (high.max(axis=0) == x[:n].max(axis=0)).all()
        each = [forest.ranges(names[i : i + 1], x[i : i + 1])[0] for i in range(50)]
        assert all(len({*e.tolist()}) == copies for e in each)
    whole = rules.IsolationForest(x)
    leaves = [whole._leaves(x[:1], np.zeros(1, int), np.array([t]))[0] for t in range(100)]
    assert (whole.feature[leaves] == -1).all() and whole.level <= rules.DEPTH + 1


def test_rules_learn_from_all_labelled_rows(spark):
    n, r = 14_000, random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 7))) for _ in range(3000)]

    def text(i):
        w = r.choices(words, k=r.randint(55, 70))
        for j in range(r.randint(0, 6) + (r.randint(0, 8) if i % 2 else 0)):
            w[j] = r.choice(["#", "77", "A!", "W?"])
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id bigint, quality int")
    forest, threshold = rules.fit_rules(docs, labels)
    rows = sorted(rules.apply_rules(docs, forest, threshold).collect())
    rest = [q for q in rows if not q.base_failed]
    good, bad = (np.array([q.anomaly for q in rest if q.doc_id % 2 == k]) for k in (0, 1))
    assert min(len(good), len(bad)) > 6500

    def balance(t):
        dropped = (good >= t).mean()
        return (bad >= t).mean() - dropped if dropped <= 0.05 else -1.0

    assert math.isclose(balance(threshold), max(balance(t) for t in np.unique(np.concatenate([good, bad]))), abs_tol=1e-12)
    assert rows == sorted(rules.judge_rules(docs.repartition(7), labels.repartition(3)).collect())
    of = docs.filter("doc_id % 2 = 0").select("text", F.xxhash64("doc_id", F.lit(11)).alias("name")).toArrow()
    counts, rates = rules.statistics(of.column("text").combine_chunks())
    passed = ~rules.fails(counts, 50, 50)
    alone = rules.IsolationForest(n=int(passed.sum()))
    while alone.grows:
        alone.grow(*alone.ranges(of.column("name").to_numpy().view(np.uint64)[passed], rates[passed]))
    assert passed.sum() == len(good) and all((getattr(alone, k) == getattr(forest, k)).all() for k in ("feature", "split", "child", "value"))


def test_lm(spark):
    texts = corpus()
    docs = frame(spark, texts)
    rows = lm.score_texts(docs, F.col("doc_id") % 5 != 1, table=100).collect()
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = Counter()
    for i, t in [*enumerate(tokens), (3, tokens[3])]:
        if i % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 5 == 1, len(t), sum(counts[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.score_texts(empty(spark), F.lit(True)).count() == 0
    alone = lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in alone)


def test_lm_base_needs_no_model(spark, monkeypatch):
    docs, train = frame(spark, corpus()), F.col("doc_id") % 5 != 1
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "mean_base"]
    want = sorted(map(repr, lm.score_texts(docs, train, table=100).select(columns).collect()))

    def never(*a):
        raise AssertionError("a model is trained")

    monkeypatch.setattr(lm, "_round", never)
    base = lm.score_texts(docs, train, table=100, base_only=True)
    assert base.columns == columns and sorted(map(repr, base.collect())) == want
    assert lm_base(spark, "/root/testdata/sf0.001").count() == 200


def test_lm_normalises_and_learns():
    rng = np.random.default_rng(0)
    m = lm.LogBilinear(np.full(6, 1 / 6), dim=8)
    squares = [np.full_like(p, 1e-8) for p in m.parameters()]
    events = np.tile(np.arange(6), 500)  # each event follows the one before it
    one, two = lm._contexts(events, np.array([0, len(events)]), 6)
    for _ in range(60):
        m.train(events, one, two, rng, squares)
    (t1, t2), z = m.scores(), m.normalisers()
    p = np.exp(t1[:, None, :] + t2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    assert p[2, 1, 3] > 0.5


def test_lm_words_of_all_classes_sum_to_one_and_events_grow():
    """Each class's shares, with that of unseen words, and so the model's probabilities of all words."""
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    n, endings = rng.zipf(1.3, 3000).clip(1, 10**6), rng.integers(0, lm.ENDINGS, 3000).astype(np.uint16)
    mass = np.bincount(endings, weights=n + 0.5, minlength=lm.ENDINGS)
    sizes = []
    for total in (10**3, 10**6, 10**9, 10**13):
        events, unigram = lm.choose_events(total, hashes, endings, n, mass)
        sizes.append(len(unigram))
        assert np.isclose(unigram.sum(), n.sum() + 0.5 * len(n) + 0.5 * len(events.masses))
        e = events.of(hashes, endings)
        for k in range(len(events.masses)):
            assert np.isclose(((n + 0.5)[e == k].sum() + 0.5) / events.masses[k], 1)
        assert sorted(e[e >= len(events.masses)]) == list(range(len(events.masses), len(unigram)))
    assert sizes == sorted(sizes) and sizes[0] < sizes[2]
    none, unigram = lm.choose_events(0, hashes[:0], endings[:0], n[:0], np.zeros(lm.ENDINGS))
    assert len(none.words) == 0 and unigram.tolist() == [0.5]


def test_lm_scores_what_it_learned_higher(spark):
    """Texts in which each word says which comes next, held out: the model beats the unigram, and gives shuffled ones less."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=4)) for _ in range(60)]
    line = lambda: " ".join(words[(a + i) % 60] for a in [r.randrange(60)] for i in range(40))
    texts = [line() for _ in range(800)]
    texts += [" ".join(r.sample(x.split(), 40)) for x in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {x.doc_id: x for x in lm.score_texts(docs, F.col("doc_id").between(40, 799)).collect()}
    held = [rows[i] for i in range(40)]
    assert all(x.held_out for x in held) and sum(x.score for x in held) > 0.8 * sum(x.base_score for x in held)
    assert sum(rows[800 + i].score for i in range(20)) < sum(rows[i].score for i in range(20))
    assert all(math.isclose(x.mean_score * x.n_tokens, x.score) for x in rows.values())


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", None, "", "###", "</turn>\n### user: x", "a\\", "<|image|>", ": </turn", "\\\\###\\", "long " * 20_000]
    rows = [(c, t, ["user", "assistant", None, "x: ###"][(t + c) % 4], s, "x", 1) for c in range(4) for t, s in enumerate(said)] + [(9, 0, "assistant", "same", "x", 1)] * 2 + [(None, 0, "user", "no id", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, id int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, r, s, *_ in rows:
        by.setdefault(c, []).append((r or "", s or ""))
    for c, turns in by.items():
        loss = "".join(s for r, s in turns if r == "assistant")
        every = "".join(f"{r}\n{s}\n" for r, s in turns)
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(out) == set(by)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_ids_of_any_type(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (0, 0, "user", "c"), (None, 0, "user", "d")], "conv_id int, turn bigint, role string, text string")
    for kind in ("smallint", "string", "decimal(5,2)", "double", "boolean", "date"):
        some = rows.withColumn("conv_id", F.expr("date_add(date'2020-01-01', conv_id)" if kind == "date" else f"cast(conv_id as {kind})"))
        out = chat.read_back(chat.format_conversations(some))
        assert out.schema["conv_id"].dataType == some.schema["conv_id"].dataType
        assert sorted(r.n_turns for r in out.collect()) == [1, 1, 2]


def test_chat_parts_of_rows(spark):
    rows = [(1, 0, "user", None, [("text", "see", None, None), ("image", None, "a.png", 2)]), (1, 1, "assistant", "ok", None), (1, 2, "user", "plain", [])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, parts {chat.PARTS}")
    r = chat.format_conversations(df, parts_col="parts").first()
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512)] and r.expanded_tokens == 512
    assert list(chat.read_turns(r.formatted)) == [("user", ["see", "<|image|>"]), ("assistant", ["ok"]), ("user", ["plain"])]


def test_chat_parts():
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "units": 2}, {"type": "audio", "ref": "b.wav", "units": None}, {"type": "document", "ref": None, "units": 3}, {"type": "text", "text": None}]
    text, mask, attached = chat.format_turns([("user", parts), ("assistant", [{"type": "text", "text": "ok"}])])
    assert [(a["ordinal"], a["type"], a["ref"], a["tokens"], text[a["offset"] :].startswith(f"<|{a['type']}|>")) for a in attached] == [(0, "image", "a.png", 512, True), (1, "audio", "b.wav", 25, True), (2, "document", None, 1536, True)]
    assert list(chat.read_turns(text)) == [("user", ["see <|image|> ", "<|image|>", "<|audio|>", "<|document|>"]), ("assistant", ["ok"])]
    assert [text[m["start"] : m["end"]] for m in mask] == ["ok"]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choices(["4111 1111 1111 1111", "a@b.co", "@", ".", "1", "25", "256", "+1", " ", "-", "(", ")", "x", "%", "é", "4532015112830366", "a.b", "..", "0"], k=r.randint(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii(spark):
    secret = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    texts = [*corpus(), f'it token = "{secret}" was', "clean words only and a long number 1683436113538828 here"] + [f'x{i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y' for i in range(30)]
    docs = frame(spark, texts)
    model = pii.fit_spans(docs)
    rows = {r.doc_id: r for r in pii.pii_spans(docs, model).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert rows[i].n_email == sum(k == "email" for *_, k in want)
        if "token = " not in (t or ""):
            assert rows[i].n_added == 0
    i = len(corpus())
    assert rows[i].spans == f"secret:12:{12 + len(secret)}"
    clean = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert clean[i].text == 'it token = "[SECRET]" was' and clean[i].n_chars == len(clean[i].text) and clean[i].id == "x"
    assert clean[i + 1].text == texts[i + 1]
    assert pii.pii_spans(empty(spark), pii.fit_spans(empty(spark))).count() == 0


def test_pii_accounts_and_names(spark):
    """Votes of regex, gazetteer and context labelers on other kinds than secrets; what only looks alike stays."""
    texts = ["pay to IBAN DE89 3704 0044 0532 0130 00 today", "account: GB82WEST12345698765432.", "signed Dr. Maria Sommer at noon", "and then Thomas Miller, who said", "contact: Patricia Gomez."] * 6
    texts += ["CODE DE12 3456 7890 1234 5678 90 of a part", "Then The General Public License of New York", "Words And Other Words In Capitals", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.fit_spans(docs)
    rows = {r.doc_id: r for r in pii.pii_spans(docs, model).collect()}
    assert [rows[i].spans.split(":")[0] for i in range(5)] == ["account", "account", "name", "name", "name"]
    assert rows[0].spans == "account:12:39" and rows[2].spans == "name:7:23" and rows[3].spans == "name:9:22"
    assert all(not rows[i].spans for i in range(30, 35))
    assert [r.n_spans - r.n_added for r in rows.values()] == [sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) for r in rows.values()]
    assert pii._free(5, 9, [(1, 5), (9, 12)]) and not pii._free(5, 10, [(1, 5), (9, 12)]) and not pii._free(3, 4, [(1, 5)])


def test_labelers_that_agree_count_more():
    votes = np.array([[1, 1, 1, 1], [-1, -1, -1, -1], [1, 1, 1, -1], [1, -1, -1, -1]], float)
    belief, accuracy, _ = pii.reliabilities(votes, np.array([50, 50, 10, 3.0]))
    assert belief[0] > 0.99 and belief[1] < 0.01 and belief[2] > 0.5 > belief[3] and accuracy.min() >= 0.5


def test_mixing(spark):
    texts = corpus()
    docs = frame(spark, texts)
    rows = mixing.mix_sources(docs).collect()
    sources = ["b", "a", None, "c"]
    sizes, source_of = Counter(), {}
    for i, t in [*enumerate(texts), (3, texts[3])]:
        source_of[i] = sources[i % 4] if i != 3 else None
    by = {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows}
    again = {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert by == again and len(rows) == len(texts) + 1
    taken, largest, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        largest[r.source_size] = max(largest[r.source_size], r.size)
        target[r.source_size] = r.target
        sizes[r.source_size] += r.size
    assert all(s == n for s, n in sizes.items())
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(target)) < 1e-6 * sum(target)
    repeated = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(repeated[r.doc_id] == r.copies for r in rows if r.doc_id != 3)
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_where_few_sources_are_hot(spark, monkeypatch):
    docs = frame(spark, corpus())
    once = sorted(map(str, mixing.mix_sources(docs).collect()))
    for hot in (0.5, 3, 4):  # none, some and all of the sources have more than one row in so many
        monkeypatch.setattr(mixing, "HOT", hot)
        assert sorted(map(str, mixing.mix_sources(docs).collect())) == once


def test_fingerprints(spark):
    texts = corpus()
    docs = frame(spark, texts).filter("doc_id <> 3 or source = 'c'")
    rows = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, other = t or "", texts[(i - 1) % n] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + other[:m]
        a, b = syncmers.anchors(t), syncmers.anchors(e)
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (syncmers.fingerprint(a), syncmers.fingerprint(b))
        assert math.isclose(rows[i].near_edited, syncmers.likeness(a, b)) and 0 <= rows[i].near_next <= 1
    assert syncmers.fingerprints(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [1 << 15, 3])
def test_fingerprints_of_many_ranges_are_those_of_one(spark, monkeypatch, most):
    """Ranges of some 2 KB, or three at most; with null ids, and ids that stand apart."""
    docs = frame(spark, corpus()).withColumn("doc_id", F.when(F.col("doc_id") % 50 != 7, F.col("doc_id") * F.col("doc_id") - 900))
    docs = docs.filter("source = 'c' or doc_id <> -891").dropDuplicates(["doc_id", "text"])
    one = sorted(map(str, syncmers.fingerprints(docs).collect()))
    few, whole = [], syncmers.neighbours

    def small(*a, **b):
        few.append(whole(*a, **b, target_bytes=2000, most=most))
        return few[-1]

    monkeypatch.setattr(syncmers, "neighbours", small)
    assert sorted(map(str, syncmers.fingerprints(docs).collect())) == one
    assert few[0][1] == 3 if most == 3 else few[0][1] > 10


def test_fingerprints_of_text_ids(spark, monkeypatch):
    """Ids that begin alike and agree in their order with numbers give the same neighbours."""
    docs = frame(spark, corpus()).filter("doc_id <> 3 or source = 'c'").select("doc_id", "text")
    one = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    whole = syncmers.neighbours
    monkeypatch.setattr(syncmers, "neighbours", lambda *a, **b: whole(*a, **b, target_bytes=20_000))
    for name, back in (("concat('document-', lpad(doc_id, 9, '0'))", lambda x: int(x[9:])), ("cast(doc_id as decimal(9,2))", int), ("timestamp_seconds(doc_id * 1000)", lambda x: int(x.timestamp()) // 1000)):
        for r in syncmers.fingerprints(docs.withColumn("doc_id", F.expr(name))).collect():
            assert r.asDict() | {"doc_id": 0} == one[back(r.doc_id)].asDict() | {"doc_id": 0}


def test_fingerprint_text_and_pieces(monkeypatch):
    texts = [x for x in corpus() if x]
    whole = [syncmers.anchors(x) for x in texts]
    for a in whole:
        assert (syncmers.read_fingerprint(syncmers.fingerprint(a)) == a).all()
    far = np.array([[1, 5], [2, 900]], np.uint32)
    assert (syncmers.read_fingerprint(syncmers.fingerprint(far)) == far).all() and syncmers.read_fingerprint("").shape == (0, 2)
    monkeypatch.setattr(syncmers, "STEP", 37)
    assert all((syncmers.anchors(x) == a).all() and len(syncmers.anchors(x)) == len(a) for x, a in zip(texts, whole, strict=True))


def test_syncmers_by_brute_force():
    text = corpus()[0] * 3
    k, s = 20, 6
    at = set(syncmers.anchors(text, k, s)[:, 1].tolist())
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    up, down = syncmers.powers(len(points) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(syncmers.mix(points + np.uint64(1)) * up[: len(points)])])
    with np.errstate(over="ignore"):
        h = [int(syncmers.mix(np.array([(sums[i + s] - sums[i]) * down[i]]))[0]) for i in range(len(points) - s + 1)]
    want = {i for i in range(len(points) - k + 1) if min(w := h[i : i + k - s + 1]) in (w[0], w[-1])}
    assert at == want
    long = max(filter(None, corpus()), key=len)[:20_000]
    moved = syncmers.anchors("moved by these words: " + long, k, s)
    assert syncmers.likeness(syncmers.anchors(long, k, s), moved) > 0.9


def test_only_empty_texts_have_empty_fingerprints():
    """At the query's own sizes: texts of any length have an anchor, of their own; light edits keep most, unrelated texts share none."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(2000)]
    text = lambda n: " ".join(r.choices(words, k=n))[:n]
    assert not len(syncmers.anchors(""))
    for n in [*range(1, 130)] * 4:
        a, b = text(n), text(n)
        assert len(syncmers.anchors(a)) and (a == b or syncmers.likeness(syncmers.anchors(a), syncmers.anchors(b)) < 0.5)
    for every, least in ((20, 0.7), (10, 0.4)):
        whole = r.choices(words, k=600)
        changed = [r.choice(words) if i % every == every // 2 else w for i, w in enumerate(whole)]
        x, y = ({*syncmers.anchors(" ".join(w))[:, 0].tolist()} for w in (whole, changed))
        assert len(x & y) > least * len(x)


def test_warc(spark, tmp_path):
    html = [None, "", "same", "other", "same", "é" * 50_000, "WARC/1.0\r\n\r\n", "\x1f\x8b\x08 not a member", "same"]
    pages = spark.createDataFrame([(i, f"http://a.com/\r\n{i}" if i else None, h, "x", 1) for i, h in enumerate(html)] + [(None, None, "other", "x", 1)], "page_id bigint, url string, html string, digest string, size int")
    rows = {r.page_id: r for r in warc.archived_pages(pages).collect()}
    assert [rows[i].refers_to for i in range(len(html))] == [None, 0, None, None, 2, None, None, None, 2]
    assert rows[None].refers_to == 3 and rows[5].payload_bytes == 100_000
    assert {r.record_type for r in rows.values()} == {"response", "revisit"}
    assert all(r.record_type == "response" for r in warc.archived_pages(pages, min_bytes=10**9).collect())
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_only_whole_headers_begin_records():
    import gzip

    good = warc._record("response", "a", None, "D", b"x" * 5000, 5000, None, "d")
    fakes = [gzip.compress(b"WARC/1.0\r\n\r\nno headers"), gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n"), gzip.compress(b"WARC/1.0 " + b"x" * 200_000), good[:40], gzip.compress(b"other")]
    for fake in fakes:
        data = fake + good
        for split in (10, 50, len(data)):
            found = [(p, h["WARC-Record-ID"]) for a in range(0, len(data), split) for p, h, _ in warc.split_records(io.BytesIO(data), a, a + split)]
            assert found == [(len(fake), "<urn:page:a>")]
    damaged = bytearray(good)
    damaged[len(good) // 2] ^= 255
    assert [p for p, *_ in warc.split_records(io.BytesIO(bytes(damaged) + good), 0, 10**6)] == [len(good)]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**6])
def test_splits_own_each_record_once(split):
    r = random.Random(1)
    names = [f"n{i}" for i in range(30)]
    members = [warc._record("response", n, None, "D", bytes(r.randbytes(r.randint(0, 300))) + b"\x1f\x8b\x08", 3, None, "d") for n in names]
    data = b"".join(members)
    found = [h["WARC-Record-ID"] for a in range(0, len(data), split) for _, h, _ in warc.split_records(io.BytesIO(data), a, a + split)]
    assert found == [f"<urn:page:{n}>" for n in names]


def test_compression(spark):
    r = random.Random(3)
    good = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=80)) for _ in range(60)]
    bad = [" ".join(r.choices(["WIN!!", "$$$", "FREE!!", "CLICK!!", "###"], k=80)) for _ in range(60)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + [None, "", "x" * 300_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    model = compression.fit_compression(docs, labels, where=F.col("doc_id") % 4 < 2)
    rows = {x.doc_id: x for x in compression.score_compression(docs, model).collect()}
    assert all((rows[i].score >= 0.5) == (i % 2 == 0) for i in range(120))
    assert rows[120].score == rows[121].score and 0 <= rows[122].score <= 1 and rows[0].lang == "en"
    none = compression.fit_compression(docs, labels.limit(0))
    assert {x.score for x in compression.score_compression(docs, none).collect()} == {0.5}
    assert compression.score_compression(empty(spark), model).count() == 0


def test_compression_scores_by_brute_force(spark):
    """Scores are the curve's value at the difference of the sizes of the blocks, compressed one by one from the dictionaries."""
    import zstandard as z

    prose = classed_prose()
    texts = [prose(i % 2, 2000) for i in range(60)] + [prose(1, 30_000), "", None, "é", "x" * 8193]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = compression.fit_compression(docs, labels)
    dicts = [z.ZstdCompressionDict(d) for d in model["dictionaries"]]
    for r in compression.score_compression(docs, model, score_col="verdict").collect():
        t = (texts[r.doc_id] or "").encode()
        good, bad = (sum(len(z.ZstdCompressor(level=3, dict_data=d, write_content_size=False).compress(t[i : i + 8192])) for i in range(0, len(t), 8192)) for d in dicts)
        x = model["weights"][0] + (model["weights"][1] * (bad - good) / len(t) if t else 0)
        assert math.isclose(r.verdict, 1 / (1 + math.exp(-min(30, max(-30, x)))), rel_tol=1e-9) and r.score == 0.5  # the column of docs stays


def classed_prose(seed=6):
    """A maker of texts by class and size: phrases of the class among words that both classes have."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(3000)]
    own = [[" ".join(r.choices(words, k=4)) for _ in range(150)] for _ in range(2)]
    return lambda y, size, share=0.3: " ".join(r.choice(own[y]) if r.random() < share else " ".join(r.choices(words, k=4)) for _ in range(size // 28))


def test_compression_of_long_texts(spark):
    """A long text's whole content counts, so texts of either class score on their side at any size."""
    prose = classed_prose()
    texts = [prose(i % 2, 3000) for i in range(160)] + [prose(i % 2, n) for n in (20_000, 400_000, 1_000_000) for i in range(2)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id bigint, quality int, toxic int")
    rows = {x.doc_id: x.score for x in compression.score_compression(docs, compression.fit_compression(docs, labels)).collect()}
    assert all(rows[i] > 0.9 if i % 2 else rows[i] < 0.1 for i in range(160, 166)), {i: rows[i] for i in range(160, 166)}


def test_compression_learns_from_whole_texts(spark):
    """What marks a class stands only after the first 20 KB of the labelled texts."""
    prose = classed_prose()
    texts = [prose(0, 20_000, 0) + " " + prose(i % 2, 8000) for i in range(80)] + [prose(i % 2, 3000) for i in range(40)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    rows = {x.doc_id: x.score for x in compression.score_compression(docs, compression.fit_compression(docs, labels)).collect()}
    assert all(rows[i] > 0.8 if i % 2 else rows[i] < 0.2 for i in range(80, 120)), {i: rows[i] for i in range(80, 120)}


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    from arachne.llm import hashing

    texts = pa.array([*corpus(), "x" * 300, "a " * 90 + "y" * 250 + " b", "\n"])

    def found():
        out = []
        for first, offsets, data in hashing.text_chunks(texts, 1 << 20):
            starts, ends, at = hashing.word_spans(offsets, data)
            out.append((first, starts.tolist(), ends.tolist(), at.tolist(), hashing.word_hashes(data, starts, ends).tolist()))
        return out

    whole = found()
    for piece in (3, 64, 1000):
        monkeypatch.setattr(hashing, "PIECE", piece)
        assert found() == whole


@pytest.mark.parametrize("text", ["word " * 400_000, "x" * 3_000_000])
def test_texts_of_megabytes(spark, text):
    """Each operator on whole texts of 2 and 3 MB: one of many words, one of a single word."""
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs, 4, 85, 100).collect()}
    assert got == ({1: 1, 2: 2, 3: 3} if " " in text else {1: 1, 2: 2, 3: 3}) or got == {1: 1, 2: 1, 3: 3}
    n = len(WORD.findall(text))
    rows = {r.doc_id: r.n_words for r in rules.apply_rules(docs, *rules.fit_rules(docs, spark.createDataFrame([], "doc_id bigint, quality int"))).collect()}
    assert rows == {1: n, 2: n + 1, 3: 1}
    assert {r.doc_id: r.n_tokens for r in lm.score_texts(docs, F.lit(True)).collect()} == {1: n + 1, 2: n + 2, 3: 2}
    assert {r.doc_id: r.n_chars for r in syncmers.fingerprints(docs).collect()} == {1: len(text), 2: len(text) + 4, 3: 5}


def test_vocabulary_file_is_the_library_s():
    with open(vocabulary()) as f:
        assert len(json.load(f)["model"]["vocab"]) >= len(packing._ranks(packing._spec(vocabulary()))) > 50_000
    assert pa.__version__
