"""Substring dedup: texts are parsed into factors, and each factor is held against the corpus as one reference.

The dealt method is relative Lempel-Ziv parsing, which factors a document greedily by its longest matches in reference
blocks. A longest match depends on which blocks one worker holds, and an exact result needs every text as a reference,
so the factors here are cut by the text itself and the matching is a join: every window of `size` words has an anchor,
its smallest 14-word hash, and the maximal runs of windows with one anchor are a text's factors; the words of a run are
its block. Equal windows have equal anchors at equal places, so equal passages give equal factors but at their ends.
All blocks of all texts are indexed by anchor. An anchor that stands alone ends there: no window of its factor occurs
elsewhere. If all blocks of an anchor are equal, the whole factor is a duplicate. Only where blocks differ, at the ends
of a repeated passage, are windows compared: once for each distinct block, within their anchor, weighted by how often
the block occurs. Windows are equal if their anchors' and their own hashes are, 128 bits together. Counts are combined
before each shuffle, and joins deal hot anchors, blocks and windows to several tasks, so that one passage in a third of
all texts is no hot task.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows are
duplicates of each other; a repetition within one text counts; an empty table gives an empty result; very long texts
are taken whole; `dedup` returns exactly the columns it gets, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Stages, byte_texts, free_name, hot_join, list_array, mix, word_hashes

SIZE, GRAM = 35, 14
#: Bytes of ids (40 for each) that may be broadcast to pick texts; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        grown = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            grown.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(grown)
    return _powers


@dataclass
class Factors:
    """The factors of a slice of texts, in order: runs of windows with one anchor."""

    words: list[list[bytes]]
    counts: np.ndarray
    first: np.ndarray  # of each text, in the row of all words
    text: np.ndarray  # of each run
    low: np.ndarray  # first window of each run, in the row of all words
    high: np.ndarray  # last window
    anchor: np.ndarray
    block: np.ndarray
    prefix: np.ndarray

    def window_hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        _, inverse = _power_tables(len(self.prefix))
        return mix((self.prefix[starts + size] - self.prefix[starts]) * inverse[starts])


def parse(texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> Factors:
    """Factor texts; texts shorter than a window have no runs."""
    words = [t.split() for t in texts]
    hashes, counts = word_hashes(words)
    first = np.cumsum(counts) - counts
    power, inverse = _power_tables(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
    none = np.zeros(0, np.int64)
    long_enough = np.flatnonzero(counts >= size)
    if not len(long_enough):
        return Factors(words, counts, first, none, none, none, none.view(np.uint64), none.view(np.uint64), prefix)
    n = len(hashes)
    at = np.arange(n - gram + 1)
    grams = mix((prefix[gram:] - prefix[: n - gram + 1]) * inverse[: n - gram + 1])
    lead = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(1)  # the first of equal ones
    lead = lead + at[: len(lead)]
    many = counts[long_enough] - size + 1
    text = np.repeat(long_enough, many)
    start = np.repeat(first[long_enough] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    lead = lead[start]
    new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    low, high = start[begin], start[last]
    block = mix((prefix[high + size] - prefix[low]) * inverse[low] + (high - low).astype(np.uint64))
    return Factors(words, counts, first, text[begin], low, high, grams[lead[begin]], block, prefix)


def _parsed(size: int):
    kind = T.StructType().add("n_words", T.LongType()).add("sha256", T.StringType())
    kind = kind.add("anchors", T.ArrayType(T.LongType())).add("blocks", T.ArrayType(T.LongType()))

    @F.arrow_udf(kind)
    def parsed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            n, shas, runs, anchors, blocks = [], [], [], [], []
            for part in byte_texts(column):
                f = parse(part, size)
                n.append(f.counts)
                shas += [hashlib.sha256(b" ".join(w)).hexdigest() for w in f.words]
                runs.append(np.bincount(f.text, minlength=len(part)))
                anchors.append(f.anchor)
                blocks.append(f.block)
            flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *(p.view(np.int64) for p in parts)])
            lists = [list_array(flat(x), flat(runs), pa.int64()) for x in (anchors, blocks)]
            yield pa.StructArray.from_arrays([pa.array(flat(n)), pa.array(shas, pa.string()), *lists], ["n_words", "sha256", "anchors", "blocks"])

    return parsed


def _windows(size: int):
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def windows(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """The window hashes of the wanted runs of each text."""
        for texts, wanted in columns:
            asked, out, i = wanted.to_pylist(), [], 0
            for part in byte_texts(texts):
                f = parse(part, size)
                begin = np.searchsorted(f.text, np.arange(len(part)))
                for k in range(len(part)):
                    runs = [int(begin[k]) + r for r in asked[i]]
                    out.append([f.window_hashes(np.arange(f.low[r], f.high[r] + 1), size).view(np.int64).tolist() for r in runs])
                    i += 1
            yield pa.array(out, pa.list_(pa.list_(pa.int64())))

    return windows


def _cut(size: int):
    span = T.StructType().add("start", T.LongType()).add("stop", T.LongType())
    kind = T.StructType().add("n_removed", T.LongType()).add("removed", T.ArrayType(span)).add("kept_sha256", T.StringType()).add("kept_text", T.StringType())

    @F.arrow_udf(kind)
    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Remove the words of duplicate windows; a mark is a run and the bits of its duplicate windows."""
        for texts, marks in columns:
            asked, out, i = marks.to_pylist(), [], 0
            for part in byte_texts(texts):
                f = parse(part, size)
                begin = np.searchsorted(f.text, np.arange(len(part)))
                for k, text in enumerate(part):
                    cover = np.zeros(len(f.words[k]) + 1, np.int64)
                    for mark in asked[i]:
                        r = int(begin[k]) + mark["run"]
                        starts = np.arange(f.low[r], f.high[r] + 1) - f.first[k]
                        starts = starts[(mark["bits"] >> np.arange(len(starts))) & 1 == 1]
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + size, -1)
                    out.append(_cut_text(text, f.words[k], np.cumsum(cover[:-1]) > 0))
                    i += 1
            yield pa.array(out, pa.struct([("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))

    return cut


def _cut_text(text: bytes, words: list[bytes], gone: np.ndarray) -> dict:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for a, b in spans:  # from the first word removed up to the next word kept
        kept.append(text[at : places[a]])
        at = places[b]
    left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
    return {
        "n_removed": int(gone.sum()), "removed": [{"start": a, "stop": b} for a, b in spans],
        "kept_sha256": hashlib.sha256(left).hexdigest(), "kept_text": b"".join([*kept, text[at:]]).decode(),
    }


_KEY = ["doc_id", "text_hash"]


def _same(a: str, b: str):
    return F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.text_hash = {b}.text_hash")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row with its text for each key of `wanted`, with the other columns of `wanted`."""
    if wanted.count() * 40 <= BROADCAST_BYTES:
        # the keys alone are broadcast; what belongs to them is joined to the texts that are left
        rows = rows.alias("r").join(F.broadcast(wanted.select(_KEY)).alias("k"), _same("r", "k"), "left_semi")
    rows = rows.dropDuplicates(_KEY)
    others = [c for c in wanted.columns if c not in _KEY]
    return rows.alias("r").join(wanted.alias("w"), _same("r", "w")).select("r.*", *[f"w.{c}" for c in others])


def find_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, text_hash, n_words, n_removed, removed (word spans), kept_sha256, and
    kept_text, which is null where nothing is removed."""
    stages = Stages(docs.sparkSession, "substring-dedup")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    parsed = stages.keep(rows.withColumn("p", _parsed(size)("text")).select(*_KEY, "p.*"))

    runs = parsed.select(*_KEY, F.posexplode(F.arrays_zip("anchors", "blocks")).alias("run", "x"))
    runs = runs.select(*_KEY, "run", F.col("x.anchors").alias("anchor"), F.col("x.blocks").alias("block"))
    index = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi"))
    index = stages.keep(index.where("n > 1").select("anchor", "n", (F.col("lo") != F.col("hi")).alias("mixed")))
    found = stages.keep(hot_join(runs, index.drop("n"), "anchor", counts=index))
    stages.drop(index)

    # windows of each distinct block of anchors whose blocks differ
    mixed = found.where("mixed")
    blocks = mixed.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "run")).alias("one"))
    blocks = stages.keep(blocks.select("anchor", "block", "n", "one.*"))
    asked = stages.keep(blocks.groupBy(_KEY).agg(F.sort_array(F.collect_set("run")).alias("wanted")))
    hashed = _texts(rows, asked).withColumn("hashes", _windows(size)("text", "wanted"))
    hashed = hashed.select(*_KEY, F.explode(F.arrays_zip("wanted", "hashes")).alias("x")).select(*_KEY, F.col("x.wanted").alias("run"), F.col("x.hashes").alias("hashes"))
    windows = blocks.alias("b").join(hashed.alias("h"), _same("b", "h") & F.expr("b.run = h.run"))
    windows = stages.keep(windows.select("b.anchor", "b.block", "b.n", F.posexplode("h.hashes").alias("bit", "window")))
    twice = windows.groupBy("anchor", "window").agg(F.sum("n").alias("times"), F.count("*").alias("n")).where("times > 1")
    twice = stages.keep(twice.select("anchor", "window", "n"))
    bits = hot_join(windows, twice.drop("n"), ["anchor", "window"], counts=twice).groupBy("anchor", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = stages.keep(bits)
    stages.drop(windows, twice, asked)

    marks = found.where("NOT mixed").select(*_KEY, "run", F.lit(-1).cast("long").alias("bits"))
    marks = marks.unionByName(hot_join(mixed, bits, ["anchor", "block"], counts=blocks).select(*_KEY, "run", "bits"))
    marks = stages.keep(marks.groupBy(_KEY).agg(F.collect_set(F.struct("run", "bits")).alias("marks")))
    stages.drop(found, blocks, bits)
    cut = _texts(rows, marks).withColumn("c", _cut(size)("text", "marks")).select(*_KEY, "c.*")
    cut = stages.keep(cut)
    out = parsed.select(*_KEY, "n_words", "sha256").alias("p").join(cut.alias("c"), _same("p", "c"), "left")
    return out.select(
        "p.doc_id", "p.text_hash", "p.n_words", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        "c.removed", F.coalesce("c.kept_sha256", "p.sha256").alias("kept_sha256"), "c.kept_text",
    )


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`docs` with the repeated words cut out of the texts (and n_chars, if there, counted anew)."""
    cut = find_repeats(docs.select("doc_id", "text"), size).where("kept_text IS NOT NULL").dropDuplicates(_KEY)
    mine = free_name(docs.columns, "_text_hash")
    own = docs.withColumn(mine, F.xxhash64("text")).alias("d")
    both = own.join(cut.select(*_KEY, "kept_text").alias("c"), F.expr(f"d.doc_id <=> c.doc_id AND d.{mine} = c.text_hash"), "left")
    text = F.coalesce("c.kept_text", "d.text")
    n_chars = F.when(F.col("c.kept_text").isNotNull(), F.length("c.kept_text")).otherwise(F.col("d.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": text} | ({"n_chars": n_chars.cast(docs.schema["n_chars"].dataType)} if n_chars is not None else {})
    return both.select([new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns])
