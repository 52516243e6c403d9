import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import test_decontamination as dec  # noqa: E402
import test_ngram_join as ngram  # noqa: E402
import test_quality_rules as rules  # noqa: E402
import test_substring_dedup as sub  # noqa: E402

import corpus_pipeline  # noqa: E402
from lexloom.llm.ngram_join import Rule  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    tables = [docs]
    for i, name in enumerate(names):
        stage[name](spark, tables[-1], SF).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables[:-1]]

    kept = {r.doc_id for r in rows[1]}
    passed = {r.doc_id for r in rows[0] if not rules.base(r.text)[-1]}
    assert kept <= passed and len(kept) > 0.97 * len(passed)

    components = ngram.brute([(r.doc_id, r.text) for r in rows[1]], Rule(5, 80))
    assert {r.doc_id for r in rows[2]} == {c for d, _, c in components if d == c}
    assert len(rows[2]) < len(rows[1])

    left = {r.doc_id: r.text.encode().split() for r in rows[3]}
    for doc_id, n, gone, sha in sub.brute([(r.doc_id, r.text) for r in rows[2]], 35):
        assert len(left[doc_id]) == n - gone
        assert sub.hashlib.sha256(b" ".join(left[doc_id])).hexdigest() == sha
    assert all(r.n_chars == len(r.text) for r in rows[3])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, n, hit, _ in dec.brute([(r.doc_id, r.text) for r in rows[3]], items) if hit and 20 * hit >= n}
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3]} - dirty

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    n = {r.doc_id: len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows[4]}
    packed = Counter()
    for r in tables[-1].collect():
        packed[r.doc_id] += r.length
    assert packed == Counter(n)
    assert np.all([r.sequence_id >= 0 for r in tables[-1].limit(50).collect()])
