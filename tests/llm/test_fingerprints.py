import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import fingerprints as P


def gear(text):
    """One byte after another, from the start of each chunk."""
    table, ends, start, h = P._GEAR.tolist(), [], 0, 0
    for i, byte in enumerate(text):
        h = ((h << 1) + table[byte]) & 0xFFFFFFFF
        n = i + 1 - start
        bits = P.STRICT_BITS if n < P.NORMAL else P.LOOSE_BITS
        if n == P.MOST or n >= P.LEAST and h >> (32 - bits) == 0 or i + 1 == len(text):
            ends.append(i + 1)
            start, h = i + 1, 0
    return ends


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(draw.randint(2, 9))) for _ in range(n))


def test_chunks_by_brute_force():
    texts = [b"", b"x", b"a" * 1000, *(prose(n, n).encode() for n in (3, 7, 40, 300, 5000)), bytes(range(256)) * 9, b"ab" * 31, b"q" * 32, b"q" * 33]
    got = P.chunk_ends(texts)
    assert got == [gear(t) for t in texts]
    assert got == [P.chunk_ends([t])[0] for t in texts]  # other texts in the batch don't matter
    sizes = np.diff([0, *got[7]])
    assert 60 < sizes.mean() < 110 and sizes.max() <= P.MOST and sizes[:-1].min() >= P.LEAST


def test_boundaries_fall_into_step_again():
    text = prose(2000, 1).encode()
    whole, moved = P.fingerprints([text, b"some words in front, " + text[:5000] + b" and some inside " + text[5000:]])
    assert P.likeness(whole, moved) > 0.9
    assert P.likeness(whole, P.fingerprints([prose(2000, 2).encode()])[0]) == 0


def test_likeness():
    a, b = P.fingerprints([prose(600, 1).encode(), b""])
    assert P.likeness(a, a) == 1 and P.likeness(b, b) == 1 and P.likeness(a, b) == P.likeness(b, a) == 0
    assert np.array_equal(P.unpacked(P.packed(a)), a) and P.packed(b) == ""


def by_brute_force(rows):
    """rows: (doc_id, text, hash of the text), the hash being Spark's."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    out = []
    for i, (doc_id, text, _) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        prints = P.fingerprints([x.encode() for x in (text, edited, other)])
        near = [P.likeness(prints[0], x) for x in prints[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *map(P.packed, prints[:2]), *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [500_000, 60, 7])
def test_whole_table_and_hostile_rows(documents, monkeypatch, keys):
    monkeypatch.setattr(P, "RANGE_KEYS", keys)
    docs = documents.drop("n_chars").withColumns({"range": F.lit("clash"), "ahead": F.lit("clash")})
    got = P.neighbours(docs).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary"))).collect()]
    assert sorted((tuple(r) for r in got), key=str) == by_brute_force(rows)
    halves = [r for r in got if r.n_chars > 1000 and len(set(r.fingerprint)) > 20]
    assert sum(0.3 < r.near_edited for r in halves) > 0.9 * len(halves) > 0


def test_empty_one_and_two(spark):
    kind = "doc_id long, text string"
    assert P.neighbours(spark.createDataFrame([], kind)).count() == 0
    one = P.neighbours(spark.createDataFrame([(1, "abcd")], kind)).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())
    two = {r.doc_id: r for r in P.neighbours(spark.createDataFrame([(1, "abcde"), (2, "x")], kind)).collect()}
    assert two[2].edited_sha256 == hashlib.sha256(b"x").hexdigest() and two[1].edited_sha256 == hashlib.sha256(b"abcx").hexdigest()


def test_column_functions(spark):
    docs = spark.createDataFrame([(1, prose(300, 1)), (2, None)], "doc_id long, text string").withColumn("f", P.fingerprint("text"))
    got = docs.select("doc_id", "f", P.containment("f", "f").alias("same"), P.containment("f", F.lit(None).cast("string")).alias("none")).collect()
    assert [r.same for r in got] == [1.0, 1.0] and {r.none for r in got} == {None} and got[1].f == ""
