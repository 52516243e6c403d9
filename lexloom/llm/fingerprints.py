"""Document fingerprints of content-defined chunks, and how much of a text another one holds.

A gear hash runs over the UTF-8 bytes; it sees the last WINDOW bytes only. A chunk ends where its upper bits are zero:
more of them before NORMAL bytes and fewer behind (normalised chunking), never before LEAST and at MOST at the latest.
As LEAST covers the window, a boundary depends on bytes of its own chunk alone, so boundaries behind an insertion fall
into step again. A fingerprint is the sorted set of the chunks' digests, each with the chunk's length, in base64.
The likeness of a text to another is the share of its distinct chunks, by length, that the other has as well.

`neighbours` gives each document's fingerprint, and the same of an edited text that ends with the beginning of the next
document (descending doc_id). Documents are dealt by ranges of doc_id, once; the first one of each range goes to the
range before as well, so that each task has all it needs.

Edge cases: a null text is an empty one; an empty text has an empty fingerprint, is like an empty text by 1 and unlike
any other; null ids come last; rows with equal ids stand in the order of a hash of their texts; repeated rows follow
each other; a lone document is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Stages, byte_texts, mix, slices

WINDOW, LEAST, NORMAL, MOST = 32, 32, 64, 256
#: Zero bits that end a chunk before and behind NORMAL bytes.
STRICT_BITS, LOOSE_BITS = 8, 4
#: Bits of a fingerprint's entry that hold the chunk's length.
_LENGTH_BITS = np.uint64(12)
_LENGTHS = np.uint64((1 << 12) - 1)
#: Bytes of text in a task, and keys that choose the ranges (they decide the balance, not the result).
TASK_BYTES, RANGE_KEYS = 128 << 20, 500_000
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the window's gear values, each doubled once for every byte behind it."""
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, 2 * reach
    return h


def _ends(start: int, stop: int, strict: list[int], loose: list[int]) -> Iterator[int]:
    """The ends of the chunks of data[start:stop]; `strict` and `loose` are the places where a chunk may end."""
    while stop - start > LEAST:
        i = bisect_left(strict, start + LEAST - 1)
        if i < len(strict) and strict[i] < start + NORMAL - 1:
            start = strict[i] + 1
        else:
            i = bisect_left(loose, start + NORMAL - 1)
            start = loose[i] + 1 if i < len(loose) and loose[i] < start + MOST - 1 else start + MOST
        if start >= stop:
            break
        yield start
    yield stop


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """The ends of each text's chunks; an empty text has none."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list[list[int]] = []
    for a, b in slices(sizes):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        hashes = _gear_hashes(data)
        loose = np.flatnonzero(hashes >> np.uint32(32 - LOOSE_BITS) == 0)
        strict = loose[hashes[loose] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
        loose, start = loose.tolist(), 0
        for n in sizes[a:b].tolist():
            out.append([e - start for e in _ends(start, start + n, strict, loose)] if n else [])
            start += n
    return out


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the sorted entries: a chunk's digest, with its length in the last bits."""
    digest = xxhash.xxh3_64_intdigest
    out = []
    for text, ends in zip(texts, chunk_ends(texts), strict=True):
        starts = [0, *ends[:-1]]
        whole = np.fromiter((digest(text[a:b]) for a, b in zip(starts, ends, strict=bool(ends))), np.uint64, len(ends))
        lengths = np.fromiter((b - a for a, b in zip(starts, ends, strict=bool(ends))), np.uint64, len(ends))
        out.append(np.unique((whole >> _LENGTH_BITS << _LENGTH_BITS) | lengths))
    return out


def packed(entries: np.ndarray) -> str:
    return base64.b64encode(entries.astype(">u8").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the chunks `a`, by length, that `b` has as well."""
    if not len(a):
        return float(not len(b))
    shared = a[np.isin(a, b, assume_unique=True)] if len(b) else a[:0]
    return float((shared & _LENGTHS).sum()) / float((a & _LENGTHS).sum())


@F.arrow_udf(T.StringType())
def fingerprint(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: the fingerprint of each whole text."""
    for column in columns:
        yield pa.array([packed(f) for part in byte_texts(column) for f in fingerprints(part)], pa.string())


@F.arrow_udf(T.DoubleType())
def containment(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Column function: the likeness of one fingerprint to another; null if either is null."""
    for a, b in columns:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        yield pa.array([None if x is None or y is None else likeness(unpacked(x), unpacked(y)) for x, y in pairs], pa.float64())


def _rank_key(doc_id: int | None, text_hash: int) -> tuple:
    return (doc_id is not None, doc_id or 0, text_hash)


def _dealer(bounds: list[tuple], heads: dict[tuple, int]):
    """Column function: the range of a row, and the range before it too if the row is the first one of its range."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ranges(doc_id: pa.Array, text_hash: pa.Array) -> pa.Array:
        keys = [_rank_key(*k) for k in zip(doc_id.to_pylist(), text_hash.to_pylist(), strict=True)]
        own = [len(bounds) - bisect_right(bounds, k) for k in keys]
        return pa.array([[r, heads[k]] if k in heads else [r] for r, k in zip(own, keys, strict=True)], pa.list_(pa.int32()))

    return ranges


def _dealt(docs: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, text, ahead): whole documents in descending order, each range with the next one's first row at its end."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    text_hash = F.xxhash64("text")
    keys = stages.keep(docs.select("doc_id", text_hash.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")))
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    every = max(1, n // min(RANGE_KEYS, 64 * tasks))
    drawn = sorted({_rank_key(r.doc_id, r.h) for r in keys.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(every)) == 0).select("doc_id", "h").collect()})
    bounds = sorted({drawn[len(drawn) * i // tasks] for i in range(1, tasks)}) if drawn else []
    own = _dealer(bounds, {})("doc_id", "h")[0]
    # one row for each range
    firsts = keys.groupBy(own.alias("range")).agg(F.max(F.struct("doc_id", "h")).alias("k")).orderBy("range").collect()
    heads = {_rank_key(r.k.doc_id, r.k.h): firsts[i - 1].range for i, r in enumerate(firsts)}
    to = F.posexplode(_dealer(bounds, heads)("doc_id", text_hash)).alias("ahead", "range")
    ranged = docs.select("doc_id", "text", to).repartitionById(len(bounds) + 1, "range")
    return ranged.sortWithinPartitions("range", "ahead", F.desc_nulls_last("doc_id"), F.desc(text_hash)).select("doc_id", "text", "ahead")


_FOUND = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = ["long", "long", "string", "string", "string", "double", "double"]


def _edited(text: bytes, following: bytes) -> bytes:
    if text.isascii() and following.isascii():
        return text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    a = text.decode()
    return (a[: len(a) - len(a) // 2] + following.decode()[: len(a) // 2]).encode()


def _chars(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row behind it; a row ahead is only looked at."""
    last: tuple | None = None
    for batch in batches:
        ids, ahead, at = batch.column("doc_id").to_pylist(), batch.column("ahead").to_pylist(), 0
        for texts in byte_texts(batch.column("text")):
            rows = list(zip(ids[at:], ahead[at:], texts, fingerprints(texts)))  # noqa: B905  as many as there are texts
            at += len(texts)
            rows = rows if last is None else [last, *rows]
            last = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]  # noqa: B905
            edited = [_edited(a[2], b[2]) for a, b in pairs]
            prints = fingerprints(edited)
            arrays = [
                pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([_chars(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([packed(a[3]) for a, _ in pairs], pa.string()), pa.array(map(packed, prints), pa.string()),
                pa.array([likeness(a[3], e) for (a, _), e in zip(pairs, prints, strict=True)], pa.float64()),
                pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, _FOUND)


def neighbours(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): what `_FOUND` names, for the text, its edited text and the next document."""
    stages = Stages(docs.sparkSession, "fingerprints")
    return _dealt(docs, stages).mapInArrow(_compared, ", ".join(map(" ".join, zip(_FOUND, _KINDS, strict=True))))
