"""Benchmark decontamination by Wu-Manber search over word ids.

Benchmark texts become windows of `size` words. A shift table by the hash of a block of words tells how far a position
may move on without missing a window; where it says zero, the bucket of the block (a window's suffix) gives the
windows to compare word for word. All positions of a batch move on together, in lanes of equal length.

Edge cases: null and empty texts have no words and no hits; items of fewer words than a window are one window, items
without words are none; equal windows of several items count for each; items with a null id mark words but are not
listed; an empty benchmark hits nothing; very long texts are taken whole; further columns pass through and those with
an output's name are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Stages, byte_texts, free_name

#: Bytes of benchmark text compiled and sent to the executors at once; a larger benchmark is searched in turns.
CHUNK_BYTES = 2 << 20
#: Lower case, and a space for all that is no word: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
_WORDS = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LANE = 384


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Windows:
    """Wu-Manber tables for the windows of one length."""

    length: int
    ids: np.ndarray  # one row of word ids for each window, in the order of their suffix blocks
    items: list[list[str | None]]
    block: int
    shift: np.ndarray
    bucket_start: np.ndarray  # by the hash of the suffix block

    @staticmethod
    def build(length: int, windows: dict[tuple[int, ...], set]) -> Windows:
        ids = np.array(list(windows), np.int64).reshape(-1, length)
        items = [sorted(s, key=str) for s in windows.values()]
        block = min(3, length)
        size = 1 << max(12, int(4 * ids.size).bit_length())
        shift = np.full(size, length - block + 1, np.int32)
        for end in range(block, length + 1):
            np.minimum.at(shift, block_hash(ids[:, end - block : end], size), length - end)
        suffix = block_hash(ids[:, length - block :], size)
        order = np.argsort(suffix, kind="stable")
        starts = np.searchsorted(suffix[order], np.arange(size + 1))
        return Windows(length, ids[order], [items[i] for i in order], block, shift, starts)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the occurrences in `text` (word ids; 0 for words of no window) and their windows."""
        n, m, b, size = len(text), self.length, self.block, len(self.shift)
        at = np.arange(m - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        ends, which = [], []
        while len(at):
            key = block_hash(np.stack([text[at - k] for k in range(b - 1, -1, -1)], 1), size)
            move = self.shift[key]
            hit = move == 0
            if hit.any():
                where, k = at[hit], key[hit]
                lo, many = self.bucket_start[k], self.bucket_start[k + 1] - self.bucket_start[k]
                first = np.repeat(np.cumsum(many) - many, many)
                window = np.repeat(lo, many) + np.arange(int(many.sum())) - first
                end = np.repeat(where, many)
                same = np.ones(len(end), bool)
                for j in range(m):  # direct comparison
                    same &= text[end - (m - 1 - j)] == self.ids[window, j]
                ends.append(end[same])
                which.append(window[same])
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(ends), np.concatenate(which)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def block_hash(blocks: np.ndarray, size: int) -> np.ndarray:
    """Table places of blocks of word ids (one block in each row)."""
    x = np.zeros(len(blocks), np.uint64)
    for j in range(blocks.shape[1]):
        x = x * np.uint64(0x9E3779B97F4A7C15) + blocks[:, j].astype(np.uint64)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


class Search:
    """All windows of a part of a benchmark."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            length = min(size, len(ids))
            for i in range(len(ids) - length + 1):
                by_length[length][tuple(ids[i : i + length])].add(item)
        self.windows = [Windows.build(n, w) for n, w in sorted(by_length.items())]

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[list[str]]]:
        """Words of each text; starts and ends of the spans hit; the items that occur."""
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        known = self.vocabulary.get
        first = np.cumsum(counts + 1) - (counts + 1)
        ids = np.zeros(int(counts.sum()) + len(words), np.int64)  # a 0 behind each text keeps windows apart
        flat = np.fromiter((known(w, 0) for text in words for w in text), np.int64, int(counts.sum()))
        ids[np.ones(len(ids), bool) if not len(words) else np.delete(np.arange(len(ids)), first + counts)] = flat
        cover, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
        for group in self.windows:
            ends, which = group.find(ids)
            np.add.at(cover, ends - group.length + 1, 1)
            np.add.at(cover, ends + 1, -1)
            for text, window in set(zip(np.searchsorted(first, ends, "right").tolist(), which.tolist(), strict=True)):
                items[text - 1].update(group.items[window])
        inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        text = np.searchsorted(first, starts, "right") - 1
        spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        for k in np.unique(text).tolist():
            mine = text == k
            spans[k] = (starts[mine] - first[k], stops[mine] - first[k])
        return counts, spans, [sorted(x for x in s if x is not None) for s in items]


_SPAN = T.StructType().add("start", T.LongType()).add("stop", T.LongType())
_FOUND = T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(_SPAN)).add("items", T.ArrayType(T.StringType()))


def _scanner(shared):
    """A column function over texts by the search that is broadcast as `shared`."""

    @F.arrow_udf(_FOUND)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        for column in columns:
            n, starts, stops, sizes, names = [], [], [], [], []
            for part in byte_texts(column):
                counts, spans, occur = shared.value.scan(part)
                n.append(counts)
                starts += [s[0] for s in spans]
                stops += [s[1] for s in spans]
                sizes += [len(s[0]) for s in spans]
                names += occur
            spans = pa.StructArray.from_arrays([pa.array(flat(starts)), pa.array(flat(stops))], ["start", "stop"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
            columns_out = [pa.array(flat(n)), pa.ListArray.from_arrays(offsets, spans), pa.array(names, pa.list_(pa.string()))]
            yield pa.StructArray.from_arrays(columns_out, ["n_words", "spans", "items"])

    return scan


def find_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, spans (of words hit) and items (ids of benchmark texts with a window in the text)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    turns = max(1, -(-total // chunk_bytes))
    now = free_name(docs.columns, "_found")
    searches = []
    for turn in range(turns):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn) if turns > 1 else items
        search = Search([(r.item_id, bytes(r.text or b"")) for r in mine.collect()], size)  # at most about `chunk_bytes`
        searches.append(spark.sparkContext.broadcast(search))
    text = F.col("text").cast("binary")
    if turns == 1:
        found = docs.withColumn(now, _scanner(searches[0])(text))
    else:
        # each turn reads the texts and writes (row key, spans, items) of texts with hits only; equal texts share a key
        stages = Stages(spark, "decontamination")
        parts = None
        for shared in searches:
            part = docs.select(F.xxhash64("text").alias("k"), F.xxhash64(F.reverse("text")).alias("k2"), _scanner(shared)(text).alias("f"))
            part = stages.keep(part.where(F.size("f.spans") > 0).select("k", "k2", "f.spans", "f.items").dropDuplicates(["k", "k2"]))
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("k", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        merged = stages.keep(merged).alias("m")
        keyed = docs.withColumn(now, _scanner(spark.sparkContext.broadcast(Search([], size)))(text)).alias("d")  # counts words
        keyed = keyed.join(merged, F.expr("xxhash64(d.text) = m.k AND xxhash64(reverse(d.text)) = m.k2"), "left")
        empty = {"spans": F.array().cast(T.ArrayType(_SPAN)), "items": F.array().cast("array<string>")}
        joined = F.struct(F.col(f"d.{now}.n_words").alias("n_words"), *[F.coalesce(f"m.{c}", e).alias(c) for c, e in empty.items()])
        found = keyed.select(*[F.col(f"d.`{c}`") for c in docs.columns], joined.alias(now))
    # spans of several turns may overlap: words are counted once, in order
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.struct(
        (acc.hit + F.greatest(F.lit(0), s.stop - F.greatest(s.start, acc.upto))).alias("hit"), F.greatest(acc.upto, s.stop).alias("upto")
    )
    n_hit = F.aggregate(F.array_sort(f"{now}.spans"), start, step, lambda acc: acc.hit)
    outputs = {"n_words": F.col(f"{now}.n_words"), "n_hit": n_hit, "spans": F.array_sort(f"{now}.spans"), "items": F.array_sort(f"{now}.items")}
    return found.withColumns(outputs).drop(now)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """`docs` without those of which at least a twentieth of the words is in benchmark windows."""
    mine = free_name(docs.columns, "_row")  # the user's row in one struct, so that no name of it meets an output's
    found = find_benchmark(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mine), "text"), benchmark, size)
    clean = found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words")))
    return clean.select([F.col(f"{mine}.`{c}`").alias(c) for c in docs.columns])
