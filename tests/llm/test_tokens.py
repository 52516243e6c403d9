import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexloom.llm import packing, token_counts

MODEL, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def test_counts_equal_the_library(documents):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(documents, MODEL).collect())
    want = Counter()
    for r in documents.collect():
        n = len(model.encode(r.text or ""))
        want[r.doc_id, len((r.text or "").encode()), n, n > 4096] += 1
    assert got == want


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "▁", "a▁b", "▁▁a b  c   ", "\n \n", "a\tb <s> </s> <unk>", "   x", " a  \n  b "])
def test_spaces(text):
    counter = token_counts.TokenCounter(MODEL)
    assert counter.exact
    assert counter.count(text.encode()) == len(counter.model.encode(text))


def test_pieces_that_cross_words_are_found():
    assert not token_counts.segmentation_is_exact(["a▁b"])
    assert token_counts.segmentation_is_exact(["▁▁", "▁a", "b"])


def test_packing_holds_every_id_once(documents):
    model = Tokenizer.from_file(WORDS)
    rows = packing.pack(documents.drop("n_tokens"), WORDS).collect()
    texts = Counter((r.doc_id, r.text or "") for r in documents.collect())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for (doc_id, text), copies in texts.items():
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = [p for p in pieces[doc_id] if p.doc_tokens == len(ids)]
        covered = Counter(i for p in mine for i in range(p.start, p.start + p.length))
        assert covered == Counter(dict.fromkeys(range(len(ids)), copies))
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)  # so there is no padding


def test_packing_an_empty_table(documents):
    assert packing.pack(documents.where("false"), WORDS).count() == 0


def test_plan_stays_within_the_histogram():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 4096, 50_000), minlength=4097)
    used = np.zeros(4097, np.int64)
    for lengths, n in packing.fill_windows(counts):
        assert sum(lengths) == 4096 and n > 0
        np.add.at(used, list(lengths), n)
    assert (used <= counts).all()
    assert (used * np.arange(4097)).sum() > 0.5 * (counts * np.arange(4097)).sum()
