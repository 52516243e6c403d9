import hashlib
import re
from collections import Counter

import pytest

from lexloom.llm import decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, size=13):
    windows = []
    for item, text in items:
        w = words(text)
        if w:
            n = min(size, len(w))
            windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    by = {}
    for item, w in windows:
        by.setdefault(len(w), {}).setdefault(w, set()).add(item)
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n, table in by.items():
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in table:
                    hit.update(range(i, i + n))
                    found |= table[key]
        yield doc_id, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))


@pytest.mark.parametrize("chunk", [2 << 20, 2000])
def test_equals_brute_force(spark, documents, chunk):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    odd = [(5001, None), (5002, ""), (5003, "same text"), (5004, "...!"), (None, "no id no id"), (5005, "a b c d e f g h a b c d e"), (5006, "SAME  TEXT"), (5003, "same text")]
    bench = bench.unionByName(spark.createDataFrame(odd, bench.schema))
    got = decontamination.find_benchmark(documents, bench, chunk_bytes=chunk).collect()
    want = Counter(brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()]))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert any(n[2] for n in want)


def test_empty_benchmark_and_clashing_names(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_benchmark(documents, bench).where("n_hit > 0").count() == 0
    kept = decontamination.drop_contaminated(documents, bench)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert {r.n_words for r in kept.collect()} == {"clash"}


@pytest.mark.parametrize("chunk", [2 << 20, 2000])
def test_rows_whose_columns_have_inner_names(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", chunk)
    rows = [(1, "clean words only", "a", "b", "c", "d"), (2, "said so twice", "e", "f", "g", "h"), (3, None, "i", "j", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string, _now string, _row string, items string")
    bench = spark.createDataFrame([(9, "said so")], "item_id long, text string")
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted((rows[0], rows[2]))
    assert sorted((r._found, r._now) for r in decontamination.find_benchmark(docs, bench, chunk_bytes=4).collect()) == [("a", "b"), ("e", "f"), ("i", "j")]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
