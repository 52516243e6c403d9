import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ngram_join
from lexloom.llm.ngram_join import Rule


def brute(rows, rule):
    """All pairs of distinct sets, and a union-find."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = rule.words
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    classes = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in classes}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(classes):
        for b in itertools.islice(classes, i + 1, None):
            if len(b) * rule.percent > 100 * len(a):
                break
            both = len(a & b)
            if 100 * both >= rule.percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            least[find(s)] = min(doc_id, least.get(find(s), doc_id))
    return Counter((d, len(s), least.get(find(s)) if s else d) for (d, _), s in zip(rows, sets, strict=True))


def near_copies(seed=3, groups=14):
    """Groups whose texts differ in a few words, so that many pairs are close to the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([5, 11, 12, 14, 20, 33, 60, 150, 400]))
        for _ in range(rng.choice([2, 10, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(base) // 60 + 1])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append((10_000 + len(out), " ".join(text)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80), Rule(1, 70)])
def test_equals_brute_force(spark, documents, rule):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + near_copies()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, rule)


def test_small_blocks_find_the_same(spark, monkeypatch):
    rows = near_copies(seed=9)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "LISTED", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ngram_join, "ORDER_ROWS", 50)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, Rule())


@pytest.mark.parametrize("share", [0, 0.3, 1])
def test_linking_sets_share_a_key(share):
    rng = np.random.default_rng(5)
    for rule in (Rule(), Rule(5, 80)):
        for n in [1, 2, 9, 10, 13, 18, 19, 20, 54, 120, 1000, 5000] * 5:
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            frequent = np.sort(a[: int(share * n)])
            for m in range(n, rule.largest(n) + 1, max(1, n // 40)):
                least = rule.overlap(n + m)
                if least <= n:
                    b = np.concatenate([a[:least], rng.integers(0, 1 << 63, m - least, dtype=np.uint64)])
                    keys, counts = ngram_join.prefix_keys([np.sort(a), np.sort(b)], rule, frequent)
                    assert counts.sum() == len(keys) and set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist()), (rule, n, m)


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from lexloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i % 3 if i < 300 else i, i) for i in range(400)] + [(None, 1)], "key long, x long")
    single = spark.createDataFrame([(k, -k) for k in (0, 1, 350, 9999)], "key long, y long")
    for how in ("inner", "left"):
        got, want = common.hot_join(rows, single, "key", how), rows.join(single, "key", how)
        assert got.columns == want.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_bitmaps_never_reject_a_link():
    rng = np.random.default_rng(6)
    for n in (9, 100, 127, 129, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.95)], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
        assert ngram_join.bound(len(a), ngram_join.bitmap(a), len(b), ngram_join.bitmap(b)) >= ngram_join.overlap(a, b)
        assert ngram_join.bound(len(a), ngram_join.bitmap(a), len(a) // 2, ngram_join.bitmap(a[: len(a) // 2])) >= len(a) // 2


def test_one_of_each_group_stays(spark, documents):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 900006 in ids and 900002 in ids


def test_clashing_names_and_ids(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "other words that stand alone in this text", None]
    rows = [(7, texts[0], "x", 1), (7, texts[2], "y", 2), (8, texts[1], "z", 3), (9, texts[3], "v", 4), (9, texts[3], "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, n long")
    got = Counter((r.doc_id, r.text_hash is None, r.component_id) for r in ngram_join.near_duplicates(docs, Rule(3, 80)).collect())
    assert got == Counter([(7, False, 7), (7, False, 7), (8, False, 7), (9, False, 9), (9, False, 9)])
    kept = ngram_join.keep_one(docs, Rule(3, 80)).collect()
    assert sorted((r.doc_id, r._row in ("v", "w") or r._row) for r in kept) == [(7, "x"), (7, "y"), (9, True)]


def test_empty_table(documents):
    assert ngram_join.near_duplicates(documents.where("false")).count() == 0


def test_buckets_bound_the_overlap(spark):
    """Listed pairs: the buckets never rule out a link, and do rule out texts that share one passage only."""
    rng = np.random.default_rng(8)
    some = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (1, 5, 40, 300, 2000)]
    sets = [*some, *(np.sort(np.concatenate([s[: -max(1, len(s) // 30)], s[:1] + np.uint64(1)])) for s in some), np.zeros(0, np.uint64)]
    sets += [np.unique(np.concatenate([some[3][:100], rng.integers(0, 1 << 63, 200).astype(np.uint64)])) for _ in range(4)]
    for rule in (Rule(), Rule(words=5, percent=80)):
        rows = [(i, len(s), b) for i, (s, b) in enumerate(zip(sets, ngram_join.bucket_counts(sets).to_pylist(), strict=True))]
        rows += [(100, 1 << 40, []), (101, 1 << 40, [])]
        df = spark.createDataFrame(rows, "i int, n long, buckets array<short>")
        got = {(r.a, r.b) for r in df.alias("x").join(df.alias("y"), F.expr(f"x.i < y.i AND {ngram_join._may_link(rule)}")).select(F.col("x.i").alias("a"), F.col("y.i").alias("b")).collect()}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[i + 1 :], i + 1):
                if len(a) and len(b) and 100 * ngram_join.overlap(a, b) >= rule.percent * (len(a) + len(b) - ngram_join.overlap(a, b)):
                    assert (i, j) in got
        assert (100, 101) in got and not any((i, j) in got for i in range(11, 15) for j in range(i + 1, 15))
