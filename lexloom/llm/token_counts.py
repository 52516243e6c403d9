"""Token counts by the whole-token shortcut.

A text is cut before each run of spaces, which is exact for a vocabulary whose pieces hold the space mark only in
front or alone (`segmentation_is_exact` proves that over the vocabulary). Vocabulary strings that are proved to
encode alone as one token are counted directly; only the other pre-tokens are merged, once for each distinct one.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; an empty table gives
an empty result; very long texts are taken whole; further columns pass through, and a column with an output's name
is replaced by the output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Memo, byte_texts

SPACE_MARK = "▁"
_RUNS = re.compile(rb" *[^ ]+| +$")


def segmentation_is_exact(pieces: list[str]) -> bool:
    """Whether no piece has a space mark behind another character, so that merges never cross a pre-token's start."""
    return not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)


class TokenCounter:
    """Counts of whole texts for one SentencePiece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.exact = segmentation_is_exact(pieces)
        alone = [p[1:] for p in pieces if p.startswith(SPACE_MARK) and len(p) > 1 and SPACE_MARK not in p[1:]]
        proved = [w for w, ids in zip(alone, model.encode(alone, num_threads=1), strict=True) if len(ids) == 1]
        self.single = {w.encode() for w in proved}
        self.merged = Memo(self._merge)

    def _merge(self, word: bytes) -> int:
        if not word or word in self.single:  # a lone space mark is one piece
            return 1
        return len(self.model.encode(word.decode()))

    def count(self, text: bytes) -> int:
        """Tokens of one text; the model puts a space mark in front of every text that isn't empty."""
        if not text:
            return 0
        if not self.exact:
            return len(self.model.encode(text.decode()))
        of = self.merged.__getitem__
        text = text.replace(SPACE_MARK.encode(), b" ")  # the model reads the mark as a space
        if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
            return sum(map(of, text.split(b" ")))
        # the mark in front of the text and a pre-token's first space stand for the mark that the model adds
        return sum(of(run[1:]) for run in _RUNS.findall(b" " + text))


@lru_cache(maxsize=2)
def _counter(model_path: str) -> TokenCounter:
    return TokenCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit (more than `limit` tokens)."""

    @F.arrow_udf(T.LongType())
    def tokens(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _counter(model_path).count
        for column in columns:
            yield pa.array([count(t) for part in byte_texts(column) for t in part], pa.int64())

    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": tokens(F.col(text).cast("binary")),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
