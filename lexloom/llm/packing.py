"""Packing of token sequences into windows, planned by non-negative least squares.

Documents become ids (one end id behind each). Whole windows are cut from long documents. The histogram of the
remaining lengths, at most `window` counts, decides the plan: shallow combinations of lengths that fill a window
exactly are enumerated, their repeat counts are the non-negative least-squares solution against the histogram,
rounded to what there is, and filled up greedily. What no combination takes is laid end to end and cut at window bounds; the last
part is cut into powers of two, which need no padding. Documents take their places in the plan by their rank among
those of equal length; ranks are counted in salted groups, so that a very common length is no hot key.

Edge cases: null and empty texts are the end id alone; repeated rows are packed each for itself; an empty table
gives an empty result; very long texts are taken whole; columns other than the id and the text aren't read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexloom.llm.common import Memo, Stages, byte_texts

WINDOW = 4096
#: Combinations of each number of lengths above two that the least-squares problem gets, and the most lengths in one.
PATTERNS, DEPTH = 1024, 8
#: Bytes of keys and parts of cut documents that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_TAIL = b".,!%&*#$|;:?()-"


class WordTokenizer:
    """Ids by a `tokenizers` file whose pre-tokens never cross white space; each distinct word is encoded once.

    Words of Latin letters in front of ASCII marks are two pre-tokens; the letters of many words are encoded in one
    call and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.specials = any(t.special for t in self.model.get_added_tokens_decoder().values())
        self.words: dict[bytes, bytes] = {}
        self.bases: dict[bytes, bytes] = {}
        self.single = Memo(lambda word: self._ids(word.decode()).tobytes(), 1 << 16)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, missing: set[bytes]) -> None:
        if len(self.bases) + len(missing) > 3 << 18:
            self.bases.clear()
        split, unknown = [], set()
        for word in missing:
            base = word.rstrip(_TAIL)
            if base.isalpha() or (text := base.decode()).isalpha() and max(text) < "Ā":
                split.append((word, base))
                if base not in self.bases:
                    unknown.add(base)
            else:
                self.words[word] = self.single[word]
        if unknown:
            order = list(unknown)
            ids = self._ids(b" ".join(order).decode())
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(order):
                data, at = ids.tobytes(), [0, *(stops * 4).tolist()]
                self.bases.update((w, data[at[i] : at[i + 1]]) for i, w in enumerate(order))
            else:  # not reached while the letters of a word are one pre-token
                self.bases.update((w, self.single[w]) for w in order)
        for word, base in split:
            tail = word[len(base) :]
            self.words[word] = self.bases[base] + self.single[tail] if tail else self.bases[base]

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """The little-endian 32-bit ids of each text, with the end id."""
        split = [t.lower().split() if b"<|" not in t else t.split() for t in texts]
        seen = set().union(*split)
        missing = seen.difference(self.words)
        if len(self.words) + len(missing) > 1 << 19:
            self.words.clear()
            missing = seen
        if missing:
            self._learn(missing)
        of = self.words.__getitem__
        return [b"".join(map(of, words)) + end for words in split]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def fill_windows(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths that sum to `window` and how often to use each, within `counts` by length."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return plan
    found = {(int(n),) * (window // int(n)) for n in lengths if window % n == 0}
    draw, weight = np.random.default_rng(7), left[lengths] / left.sum()
    found.update((int(n), window - int(n)) for n in lengths if 2 * n <= window and left[window - n])
    for depth in range(3, DEPTH + 1):
        heads = draw.choice(lengths, (200_000 // depth, depth - 1), p=weight)
        last = window - heads.sum(1)
        fits = (last > 0) & (left[np.clip(last, 0, window)] > 0)
        rows = np.unique(np.sort(np.column_stack([heads, last])[fits], 1), axis=0)
        found.update(map(tuple, rows[:: -(-len(rows) // PATTERNS) or 1].tolist()))
    patterns = sorted(found)
    if not patterns:
        return plan
    which = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    slots = np.concatenate(patterns)
    goal = left.astype(float)
    scale = 1 / np.sqrt(np.maximum(goal, 1))  # weigh each length by its expected spread
    fit = lambda x: np.bincount(slots, x[which], window + 1) * scale
    back = lambda r: np.bincount(which, (r * scale)[slots], len(patterns))
    x = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue gives the step
        x = back(fit(x))
        x /= np.linalg.norm(x)
    step = 1 / (1.05 * np.linalg.norm(back(fit(x))))
    x = y = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(300):  # accelerated projected gradient
        new = np.maximum(0, y - step * back(fit(y) - goal * scale))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y, x, pace = new + (pace - 1) / faster * (new - x), new, faster
    uses = np.zeros(len(patterns), np.int64)
    order = np.argsort(-x, kind="stable")
    parts = [np.unique(np.array(p), return_counts=True) for p in patterns]
    longest = np.argsort([-p[-1] for p in patterns], kind="stable")  # the longest are the hardest to place
    ends = np.full(len(patterns), np.iinfo(np.int64).max)
    for turn, most in ((order, np.rint(x).astype(np.int64)), (longest, ends)):
        for i in turn.tolist():
            lens, per = parts[i]
            n = min(int(most[i]), int((left[lens] // per).min()))
            uses[i] += n
            left[lens] -= n * per
    return plan + [(p, int(n)) for p, n in zip(patterns, uses, strict=True) if n]


def _cuts(total: int, window: int) -> list[int]:
    """Bounds of sequences within the last part of the stream: powers of two, largest first."""
    at, rest = total - total % window, total % window
    bounds = []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        bounds.append(at)
        at, rest = at + size, rest - size
    return bounds


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stages = Stages(spark, "packing")
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))

    counted = T.StructType().add("n", T.LongType()).add("crcs", T.ArrayType(T.LongType()))
    wide = window * 4

    @F.arrow_udf(counted)
    def tokens(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _tokenizer(tokenizer_path).encode
        for column in columns:
            n, crcs = [], []
            for part in byte_texts(column):
                for ids in encode(part, end):
                    n.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[a : a + wide]) for a in range(0, len(ids), wide)])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], fields=[pa.field("n", pa.int64()), pa.field("crcs", pa.list_(pa.int64()))])

    sized = stages.keep(rows.withColumn("t", tokens("text")).select("doc_id", "text_hash", F.col("t.n").alias("doc_tokens"), "t.crcs"))
    pieces = sized.select("doc_id", "text_hash", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", "text_hash", "doc_tokens", "ids_crc32", (F.col("k") * window).cast("long").alias("start")
    )
    pieces = pieces.withColumn("length", F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("start")))

    counts = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    plan = fill_windows(counts, window)
    segments, used, base = [], np.zeros(window + 1, np.int64), 0
    for lens, n in plan:
        offset = 0
        for length in sorted(set(lens), reverse=True):
            per = lens.count(length)
            lo = int(used[length])
            segments.append((length, lo, lo + n * per, per, base, offset))
            used[length] += n * per
            offset += per * length
        base += n
    rest = counts - used
    places, at = [], 0  # of what is left: where the pieces of each length begin in the stream, longest first
    for length in range(window, 0, -1):
        if rest[length]:
            places.append((length, int(used[length]), at))
            at += int(rest[length]) * length
    bounds = _cuts(at, window)

    groups = max(8, int(counts.sum()) // 100_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(groups)))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    first = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    in_salt = W.partitionBy("length", "salt").orderBy("doc_id", "text_hash", "start")
    ranked = salted.withColumn("rank", F.row_number().over(in_salt) - 1).join(first, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first")
    # both tables below have at most a few rows for each length and combination: bounded by the window
    plan_rows = spark.createDataFrame(segments or [(0, 0, 0, 1, 0, 0)], "length long, lo long, hi long, per long, base long, at long")
    place_rows = spark.createDataFrame(places or [(0, 0, 0)], "length long, from_rank long, stream long")
    in_plan = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.alias("r").join(F.broadcast(plan_rows).alias("p"), in_plan, "left").drop(F.col("p.length"))
    placed = stages.keep(placed.join(F.broadcast(place_rows), "length", "left"))

    planned = placed.where("lo is not null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.expr("(rank - lo) div per")).alias("sequence_id"),
        (F.col("at") + F.expr("(rank - lo) % per") * F.col("length")).alias("offset"),
    )

    # the stream: each piece may be cut at one window bound, and in the last part at powers of two
    tail = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    streamed = placed.where("lo is null").withColumn("begin", F.col("stream") + (F.col("rank") - F.col("from_rank")) * F.col("length"))
    streamed = streamed.withColumn("stop", F.col("begin") + F.col("length"))
    bound = F.expr(f"(stop - 1) div {window} * {window}")
    cut = F.filter(F.array_distinct(F.concat(F.array(bound.cast("long")), tail)), lambda b: (b > F.col("begin")) & (b < F.col("stop")))
    parts = streamed.withColumn("cuts", F.array_sort(F.concat(F.array("begin"), cut))).select(
        "*", F.posexplode("cuts").alias("i", "from_pos")
    ).withColumn("to_pos", F.coalesce(F.get("cuts", F.col("i") + 1), F.col("stop")))
    last = F.lit(at - at % window)
    in_tail = F.col("from_pos") >= last
    opening = F.when(in_tail, F.array_max(F.filter(tail, lambda b: b <= F.col("from_pos")))).otherwise(F.expr(f"from_pos div {window} * {window}"))
    number = F.when(in_tail, last / window + F.size(F.filter(tail, lambda b: b <= F.col("from_pos"))) - 1).otherwise(F.expr(f"from_pos div {window}"))
    parts = parts.select(
        "doc_id", "text_hash", "doc_tokens", "ids_crc32", (F.size("cuts") == 1).alias("whole"),
        (F.col("start") + F.col("from_pos") - F.col("begin")).alias("start"), (F.col("to_pos") - F.col("from_pos")).alias("length"),
        (F.lit(base) + number).cast("long").alias("sequence_id"), (F.col("from_pos") - opening).alias("offset"),
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    result = planned.unionByName(parts.where("whole").select(columns))
    if not at:
        return result

    # cut pieces need the ids again; few documents are cut while the combinations fit
    wanted = parts.where(~F.col("whole")).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length", "sequence_id", "offset")).alias("parts"), F.first("doc_tokens").alias("doc_tokens")
    )
    wanted = stages.keep(wanted)
    if (wanted.agg(F.sum(F.size("parts") * 48 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = rows.alias("t").join(wanted.alias("w"), (F.expr("t.doc_id <=> w.doc_id")) & (F.expr("t.text_hash = w.text_hash")))
    texts = texts.select("t.doc_id", "t.text_hash", "t.text", "w.parts", "w.doc_tokens")
    one_each = W.partitionBy("doc_id", "text_hash").orderBy("doc_id")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def part_crcs(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = _tokenizer(tokenizer_path).encode
        for texts, parts in columns:
            spans, out, i = parts.to_pylist(), [], 0
            for part in byte_texts(texts):
                for ids in encode(part, end):
                    out.append([zlib.crc32(ids[s["start"] * 4 : (s["start"] + s["length"]) * 4]) for s in spans[i]])
                    i += 1
            yield pa.array(out, pa.list_(pa.int64()))

    texts = texts.withColumn("crcs", part_crcs("text", "parts")).drop("text")
    texts = texts.withColumn("again", F.row_number().over(one_each)).where("again = 1")  # parts hold those of repeated rows
    cut_rows = texts.select("doc_id", "doc_tokens", F.explode(F.arrays_zip("parts", "crcs")).alias("x")).select(
        "doc_id", F.col("x.parts.start").alias("start"), F.col("x.parts.length").alias("length"), F.col("x.crcs").alias("ids_crc32"),
        "doc_tokens", F.col("x.parts.sequence_id").alias("sequence_id"), F.col("x.parts.offset").alias("offset"),
    )
    return result.unionByName(cut_rows)
