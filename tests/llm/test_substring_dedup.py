import hashlib
import random
from collections import Counter

import pytest

from lexloom.llm import substring_dedup


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()


def passages(seed=1):
    """Texts that share passages of lengths around the window, whole texts, and repetitions of their own."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (20, 34, 35, 36, 50, 70, 120)]
    out = []
    for _ in range(120):
        text = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(shared)
            a = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            text += fresh(rng.choice([0, 3, 40])) + (p[a:] if rng.random() < 0.7 else fresh(20))
        out.append(" \n".join(text) if rng.random() < 0.2 else " ".join(text))
    out += [out[0], out[5] + " tail", "again and " * 60, "one two three " * 30 + " ".join(fresh(50))]
    return [(20_000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_equals_brute_force(spark, documents, broadcast, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", broadcast)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + passages()
    got = substring_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter(brute(rows, 35))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(1 for r in want if 0 < r[2] < r[1]) > 20


def test_cut_texts(spark, documents):
    rows = passages(4)
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in rows], "doc_id long, text string, n_chars long, n_words string")
    kept = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert substring_dedup.dedup(documents).columns == documents.columns
    for doc_id, _, _, sha in brute(rows, 35):
        text = kept[doc_id].text
        assert hashlib.sha256(b" ".join(text.encode().split())).hexdigest() == sha
        assert kept[doc_id].n_chars == len(text)


def test_empty_table(documents):
    assert substring_dedup.find_repeats(documents.where("false")).count() == 0


def test_rows_whose_columns_have_inner_names(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "s", text, "mine"), (2, "s", text[::-1], "too")], "doc_id long, source string, text string, _text_hash string")
    got = substring_dedup.dedup(docs)
    assert got.columns == docs.columns and sorted(r._text_hash for r in got.collect()) == ["mine", "too"]
