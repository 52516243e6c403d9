"""Exact Jaccard join of documents on word n-grams, in size-banded tiles.

Equal shingle sets are one class. All shingles have one total order, in which those that are frequent in a sample come
last (the sample decides the speed only, never the result). Two sets that link must share one of their first
`n - ceil(threshold * n) + 1` shingles in that order: these are a set's keys. Classes are banded by set size, so that
sets that can link by their sizes meet in a band; the classes with one key in one band are a tile. In a few rounds
every class of a large tile is compared with one leader; this joins a group of near copies in time
linear in its size. Pairs of a tile that no leader has joined are then all compared, in blocks of bounded size where
the tile is large. A listed pair is bounded from above by what its sets' `BUCKETS` buckets of hashes have in common, which
travel with the tile's rows; each pair that is left is bounded by the bit counts of hashed
bitmaps; only what passes has its sorted arrays intersected. No tile, bucket or number of partners is capped, and
joins deal hot keys, leaders and labels to several tasks. Shingles and classes in links are 64-bit hashes; copies are
told by 128 bits.

A tile of very many sets that don't link (texts with one frequent passage that the sample misses) is compared in full,
blocks against blocks, which is quadratic in the tile.

Edge cases: null, empty and blank texts have an empty set and link with nothing; texts of fewer words than a shingle
are one shingle; repeated rows get equal rows; rows without an id take part through an equal set that has one (else
their component is null); different texts with one id are told apart; an empty table gives an empty result; very long
texts are taken whole; further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Stages, free_name, hot_join, list_array, mix, over_slices, word_hashes
from lexloom.llm.components import connected_components

#: Bytes of candidates' ids that may be broadcast to pick their texts; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Rows of the sample that tells frequent shingles, and the most shingles that are told (8 bytes each are broadcast).
ORDER_ROWS, ORDER_MOST = 4000, 1 << 17
#: Rounds with leaders at most; the largest tile whose pairs are listed by a join; sets in a block of a larger one, and
#: shingles in one at most (a set that is larger is alone with one other).
ROUNDS, LISTED, BLOCK_SETS, BLOCK_SHINGLES = 2, 128, 2048, 8_000_000
#: Buckets of hashes whose counts bound a listed pair's overlap before bitmaps travel.
BUCKETS = 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _times(odd: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(odd) * n & (1 << 64) - 1)


@dataclass(frozen=True)
class Rule:
    """Sets link when 100 * overlap >= percent * union."""

    words: int = 3
    percent: int = 90

    def overlap(self, both):
        """The least overlap of two sets with so many shingles together."""
        return -(-self.percent * both // (100 + self.percent))

    def largest(self, size: int) -> int:
        """The largest set that can link with one of `size`."""
        return 100 * size // self.percent


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.lower().split() for t in texts]
    hashes, counts = word_hashes(split)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += mix(hashes[j : j + n] + _times(_ODD[j % len(_ODD)], j + 1)) * _ODD[(j + 1) % len(_ODD)]
    rolled = mix(rolled)
    sets, at = [], 0
    for count in counts.tolist():
        if count >= words:
            sets.append(np.unique(rolled[at : at + count - words + 1]))
        elif count:
            few = np.array([count], np.uint64)
            for i in range(at, at + count):
                few = mix(few * _ODD[0] + hashes[i : i + 1])
            sets.append(few)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += count
    return sets


def prefix_keys(sets: list[np.ndarray], rule: Rule, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all sets in a row, and how many each has: the first shingles, those in `frequent` (sorted) last.

    Were two sets without a common key, the one whose keys end first in the order would share none of them; so at most
    ceil(threshold * n) - 1 of its n shingles are common, and the sets don't link.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    late = np.zeros(len(flat), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] == flat
    order = np.lexsort((mix(flat), late, of))
    wanted = np.where(sizes > 0, sizes - -(-rule.percent * sizes // 100) + 1, 0)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[order[place < np.repeat(wanted, sizes)]], wanted


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A hashed bitmap of four to eight bits for each shingle, as 64-bit words; halves fold on to each other."""
    bits = 1 << max(6, (4 * max(1, len(shingles)) - 1).bit_length())
    out = np.zeros(bits // 8, np.uint8)
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out.view(np.uint64)


def bucket_counts(sets: list[np.ndarray]) -> pa.ListArray:
    """How many shingles each set has in each bucket; an empty list where a count is beyond 16 bits."""
    rows = [np.bincount((s >> np.uint64(58)).astype(np.int64) % BUCKETS, minlength=BUCKETS) for s in sets]
    rows = [r.astype(np.int16) if r.max() < 1 << 15 else np.zeros(0, np.int16) for r in rows]
    return list_array(np.concatenate([np.zeros(0, np.int16), *rows]), np.array([len(r) for r in rows], np.int64), pa.int16())


def _may_link(rule: Rule) -> str:
    """The condition that the buckets of x and y allow a link: the overlap is at most the sum of the smaller counts.

    `least` skips nulls, so one empty list gives the other set's size; two empty lists tell nothing.
    """
    both = "aggregate(zip_with(x.buckets, y.buckets, (p, q) -> least(p, q)), 0L, (s, v) -> s + v)"
    return f"(size(x.buckets) + size(y.buckets) = 0 OR {100 + rule.percent} * {both} >= {rule.percent} * (x.n + y.n))"


def fold(words: np.ndarray, n: int) -> np.ndarray:
    while len(words) > n:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def bound(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> int:
    """The most that two sets can overlap, by the bits of one bitmap that the other lacks."""
    n = min(len(a), len(b))
    x, y = fold(a, n), fold(b, n)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) and len(b) else 0


def tile_pairs(ids: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], groups: np.ndarray, blocks: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Pairs of different groups, within a block or across two, whose bound allows a link."""
    order = np.argsort(ids, kind="stable")
    ids, sizes, groups, blocks, maps = ids[order], sizes[order], groups[order], blocks[order], [maps[i] for i in order]
    n = min(map(len, maps))
    bits = np.stack([fold(m, n) for m in maps])
    across, found = len(set(blocks.tolist())) > 1, []
    for i in range(len(ids) - 1):
        open_ = groups[i + 1 :] != groups[i]
        if across:
            open_ &= blocks[i + 1 :] != blocks[i]
        js = np.flatnonzero(open_) + i + 1
        if len(js):
            mine, other = bits[i], bits[js]
            most = np.minimum(sizes[i] - np.bitwise_count(mine & ~other).sum(1), sizes[js] - np.bitwise_count(other & ~mine).sum(1))
            found += [(int(ids[i]), int(ids[j])) for j in js[most >= rule.overlap(sizes[i] + sizes[js])]]
    return found


def _keyed(rule: Rule, frequent):
    def keyed(texts: list[bytes]) -> list[pa.Array]:
        sets = shingle_sets(texts, rule.words)
        keys, counts = prefix_keys(sets, rule, frequent.value)
        maps = pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
        return [pa.array([len(s) for s in sets], pa.int64()), *_set_hashes(sets), list_array(keys.view(np.int64), counts, pa.int64()), maps, bucket_counts(sets)]

    return keyed


def _shingles(rule: Rule):
    def shingles(texts: list[bytes]) -> list[pa.Array]:
        sets = shingle_sets(texts, rule.words)
        return [list_array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), np.array([len(s) for s in sets], np.int64), pa.int64())]

    return shingles


def frequent_shingles(texts: DataFrame, rule: Rule) -> np.ndarray:
    """Shingles of several texts of a sample of about `ORDER_ROWS` rows, the most frequent `ORDER_MOST` of them, sorted."""
    n = texts.count()
    part = texts.select("text").sample(ORDER_ROWS / n, seed=5) if n > ORDER_ROWS else texts.select("text")
    each = over_slices(part, _shingles(rule), "shingles array<long>").select(F.explode("shingles").alias("shingle"))
    most = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(ORDER_MOST)
    return np.sort(np.array([r.shingle for r in most.select("shingle").collect()], np.int64).view(np.uint64))


def _set_hashes(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit hashes of each set."""
    hashed = (np.array([mix(s + odd).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for odd in (_ODD[1], _ODD[4]))
    return tuple(map(pa.array, hashed))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return np.split(values, (offsets - offsets[0])[1:-1]) if len(column) else []


def _bounded(rule: Rule):
    @F.arrow_udf(T.BooleanType())
    def bounded(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in columns:
            n_a, a, n_b, b = (c.to_pylist() for c in batch)
            words = lambda x: np.frombuffer(x, np.uint64)
            yield pa.array([bound(i, words(x), j, words(y)) >= rule.overlap(i + j) for i, x, j, y in zip(n_a, a, n_b, b, strict=True)], pa.bool_())

    return bounded


def _overlapping(rule: Rule):
    @F.arrow_udf(T.BooleanType())
    def overlapping(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            yield pa.array([overlap(a, b) >= rule.overlap(len(a) + len(b)) for a, b in zip(_arrays(left), _arrays(right), strict=True)], pa.bool_())

    return overlapping


class _Sets:
    """Whole sets of classes, taken from the texts once a class stands in a pair that its bitmaps allow."""

    def __init__(self, texts: DataFrame, classes: DataFrame, rule: Rule, stages: Stages):
        self.texts, self.classes, self.rule, self.stages, self.known = texts, classes, rule, stages, None

    def of(self, pairs: DataFrame) -> DataFrame:
        """(node, shingles) of all classes in `pairs` (a, b), and of those asked for before."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if self.known is not None:
            nodes = nodes.join(self.known, "node", "left_anti")
        wanted = self.stages.keep(self.classes.join(nodes.withColumnRenamed("node", "h1"), "h1", "left_semi").select("doc_id", "text_hash", F.col("h1").alias("node")))
        few = wanted.count() * 40 <= BROADCAST_BYTES  # else the join is a shuffle
        texts = self.texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).dropDuplicates(["node"])
        sets = self.stages.keep(over_slices(texts, _shingles(self.rule), "doc_id long, text_hash long, node long, shingles array<long>").select("node", "shingles"))
        self.known = sets if self.known is None else self.known.unionByName(sets)
        return self.known


def _band(rule: Rule):
    """The band of a set's size: as wide as the sizes of two sets that link may differ."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / rule.percent) * 1.000001)).cast("long")


def _banded(rows: DataFrame) -> DataFrame:
    """`rows` (key, node, n, band, top) by key and band of sizes: (key, node, n, home).

    A set is at home in its band and visits the next one: so two that may link meet in the higher of their bands, where
    one of them at least is at home. In no band above `top`, the highest with this key, is a set at home.
    """
    home = lambda band, own: F.struct(band.alias("band"), F.lit(own).alias("home"))
    band = F.col("band")
    at = F.when(band < F.col("top"), F.array(home(band, True), home(band + 1, False))).otherwise(F.array(home(band, True)))
    return rows.withColumn("at", F.explode(at)).select(F.xxhash64("key", "at.band").alias("key"), "node", "n", F.col("at.home").alias("home"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, text_hash."""
    spark = docs.sparkSession
    stages = Stages(spark, "ngram-join")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(hashed, rule))
    keyed = stages.keep(over_slices(hashed, _keyed(rule, frequent), "doc_id long, text_hash long, n long, h1 long, h2 long, keys array<long>, bits binary, buckets array<short>"))
    facts = stages.keep(keyed.select("doc_id", "text_hash", "n", "h1", "h2"))
    classes = facts.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    classes = stages.keep(classes.select("h1", "h2", "one.*"))

    # from here on keys are those of one document for each class
    one = ["h1", "h2", "doc_id", "text_hash"]
    firsts = keyed.join(classes, one, "left_semi").dropDuplicates(one).select(F.col("h1").alias("node"), "n", "keys", "bits", "buckets")
    firsts = stages.keep(firsts)
    stages.drop(keyed)
    rows = firsts.select(F.explode("keys").alias("key"), "node", "n", _band(rule).alias("band"))
    shared = stages.keep(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("band").alias("top")).where("n > 1"))
    tiles = stages.keep(_banded(hot_join(rows, shared.drop("n"), "key", counts=shared)))
    stages.drop(shared)
    labels = _links(tiles, firsts.select("node", "n", "bits", "buckets"), _Sets(hashed, classes, rule, stages), rule, stages)
    stages.drop(firsts)

    named = classes.join(labels.select(F.col("node").alias("h1"), "label"), "h1", "left").select("h1", "h2", "doc_id", F.coalesce("label", "h1").alias("label"))
    named = stages.keep(named)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component"), F.count("*").alias("n"))
    least = stages.keep(least)
    named = hot_join(named, least.drop("n"), "label", counts=least).select("h1", "h2", "component")
    out = facts.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash")


def _verified(pairs: DataFrame, maps: DataFrame, sets: _Sets, rule: Rule, stages: Stages) -> DataFrame:
    """The pairs (a, b), a kept table, that link: bitmaps first, then whole sets for what passes. Many rows may have
    one b."""

    def both(rows: DataFrame, of: DataFrame, *what: str) -> DataFrame:
        side = lambda c: of.select(F.col("node").alias(c), *[F.col(w).alias(f"{w}_{c}") for w in what])
        return hot_join(rows.join(side("a"), "a"), side("b"), "b", counts=rows.groupBy("b").agg(F.count("*").alias("n")))

    maps = stages.keep(_of_nodes(maps.select("node", "n", "bits"), pairs))
    passed = stages.keep(both(pairs, maps, "n", "bits").where(_bounded(rule)("n_a", "bits_a", "n_b", "bits_b")).select("a", "b"))
    found = stages.keep(both(passed, _of_nodes(sets.of(passed), passed), "shingles").where(_overlapping(rule)("shingles_a", "shingles_b")).select("a", "b"))
    stages.drop(passed, maps)
    return found


def _of_nodes(maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `maps` whose node stands in a pair: ids travel, bitmaps that no pair needs don't."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = pairs.count() * 16 <= BROADCAST_BYTES  # bounds the nodes' bytes from above
    return maps.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def _merged(labels: DataFrame | None, found: DataFrame, stages: Stages) -> DataFrame:
    """(node, label): `labels` and the links (a, b) found since; only links between labels are searched for components.

    A node without a label is its own. Each label is the smallest node of its component, before and after.
    """
    if labels is None:
        return connected_components(found, stages)
    ends, few = found, labels.count() * 16 <= BROADCAST_BYTES
    for c in ("a", "b"):  # a node stands once in `labels`, but many pairs may have one end
        old = labels.select(F.col("node").alias(c), "label")
        ends = ends.join(F.broadcast(old), c, "left") if few else hot_join(stages.keep(ends), old, c, "left")
        ends = ends.withColumn(c, F.coalesce("label", c)).drop("label")
    between = stages.keep(ends.where("a <> b").distinct())
    if not between.limit(1).count():
        stages.drop(between)
        return labels
    tops = connected_components(between, stages)
    moved = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    moved = moved.select("node", F.coalesce("top", "label").alias("label"))
    out = stages.keep(moved.unionByName(tops.join(labels.select("node"), "node", "left_anti")))
    stages.drop(between)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with the label of their node: that of its component, or the node itself."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _links(tiles: DataFrame, maps: DataFrame, sets: _Sets, rule: Rule, stages: Stages) -> DataFrame:
    """(node, label) of the classes that link with others; `tiles` has (key, node, n, home).

    The classes of a large tile are compared with its leader, the class that stands in most of the large tiles, as the
    centre of a group of near copies does; what is still large after that gets a new leader. Pairs within a component
    found so far need no comparison. Small tiles take no part in these rounds.
    """
    fits = f"100 * least({{0}}.n, {{1}}.n) >= {rule.percent} * greatest({{0}}.n, {{1}}.n)"
    size = [F.count("*").alias("size"), F.max("n").alias("most")]
    told = stages.keep(tiles.groupBy("key").agg(*size, F.max("home").alias("home")).where("size > 1 AND home").select("key", F.col("size").alias("n"), "size", "most"))
    largest = told.agg(F.max("n")).first()[0]
    if largest is None:
        stages.drop(told)
        return tiles.select("node", F.col("node").alias("label")).where("false")
    sized = stages.keep(hot_join(tiles, told.drop("n"), "key", counts=told))
    stages.drop(tiles)
    small, labels, listed = sized.where(f"size <= {LISTED}"), None, []

    def pairs_of(rows: DataFrame) -> DataFrame:
        both = rows.alias("x").join(rows.alias("y"), F.expr(f"x.key = y.key AND x.node < y.node AND (x.home OR y.home) AND x.label <> y.label AND {fits.format('x', 'y')} AND {_may_link(rule)}"))
        return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    kept = []
    if largest > LISTED:
        large = sized.where(f"size > {LISTED}").select("key", "node", "n")
        rows = stages.keep(_labelled(large.join(large.groupBy("node").agg(F.count("*").alias("degree")), "node"), None))
        for _ in range(ROUNDS):
            leader = [F.count("*").alias("n"), F.max(F.struct("degree", "node", "n", "label")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi")]
            led_by = rows.groupBy("key").agg(*leader).where(f"lo <> hi AND n > {LISTED}")
            led_by = stages.keep(led_by.select("key", "n", F.col("x.node").alias("leader"), F.col("x.n").alias("leader_n"), F.col("x.label").alias("leader_label")))
            if not led_by.limit(1).count():
                stages.drop(led_by)
                break
            led = hot_join(rows, led_by.drop("n"), "key", counts=led_by).where(f"node <> leader AND label <> leader_label AND 100 * least(n, leader_n) >= {rule.percent} * greatest(n, leader_n)")
            pairs = stages.keep(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
            found = _verified(pairs, maps, sets, rule, stages)
            labels = _merged(labels, found, stages)
            others = rows.join(led_by.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti")  # a leader is done in its tile
            rest = stages.keep(_labelled(others, labels))
            stages.drop(pairs, led_by, rows)
            rows = rest
        left = stages.keep(rows.groupBy("key").agg(*size, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", F.col("size").alias("n"), "size", "most"))
        rest = stages.keep(hot_join(rows, left.drop("n"), "key", counts=left))
        listed.append(_blocked_pairs(rest, maps, rule))
        kept = [rows, left, rest]
    told_of = _labelled(maps.select("node", "buckets"), labels)  # one row a class, so labels meet no row of a tile
    small = stages.keep(small.select("key", "node", "n", "home").join(told_of, "node"))
    listed.insert(0, pairs_of(small))
    pairs = listed[0] if len(listed) == 1 else listed[0].unionByName(listed[1])
    pairs = stages.keep(pairs.distinct())
    found = _verified(pairs, maps, sets, rule, stages)
    labels = _merged(labels, found, stages)
    stages.drop(told, sized, small, pairs, *kept)
    return labels


def _blocked_pairs(large: DataFrame, maps: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of large tiles that the bitmaps allow, from pairs of blocks of bounded size."""
    capacity = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.expr(f"cast({BLOCK_SHINGLES} div most as int)")))
    rows = large.withColumn("blocks", F.ceil(F.col("size") / capacity).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.join(maps.select("node", "bits"), "node").select("key", "i", "j", "block", "node", "n", "label", "bits")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        found = []
        if tile["label"].nunique() > 1 and (tile["i"].iat[0] == tile["j"].iat[0] or tile["block"].nunique() > 1):
            bits = [np.frombuffer(x, np.uint64) for x in tile["bits"]]
            found = tile_pairs(tile["node"].to_numpy(), tile["n"].to_numpy(), bits, tile["label"].to_numpy(), tile["block"].to_numpy(), rule)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def keep_one(docs: DataFrame, rule: Rule = Rule(words=5, percent=80)) -> DataFrame:
    """`docs` with the first document of each component, and documents that link with nothing.

    Of equal rows one stays. Different texts with one id stand for their components together; rows without an id stay
    unless an equal set has an id.
    """
    row = free_name(docs.columns, "_row")
    found = near_duplicates(docs.select("doc_id", "text"), rule).where("doc_id <=> component_id")
    found = found.select(F.xxhash64("doc_id", "text_hash").alias(row)).distinct()
    own = docs.withColumn(row, F.xxhash64("doc_id", F.xxhash64("text")))
    return own.join(found, row, "left_semi").dropDuplicates([row, "doc_id"]).select([F.col(f"`{c}`") for c in docs.columns])
