"""Merkle manifest of a dataset: a binary hash tree for each group of rows, and one over the groups' roots.

The rows of a group take places in their order and are gathered into blocks of `BLOCK` places. A block is one ordered
array, which `transform`, `slice` and `aggregate` collapse level by level within the row; then the roots of blocks are
gathered in the same way, until each group has one block. No array ever holds more than a block, whatever a group's
size. On the way down each block gets the path from its root to the top, and each leaf the path within its block.

A path is an array of (left, right), the siblings of a node at each level as hex text, '' where there is none; a node
without siblings is hashed alone while its level has other nodes.

Edge cases: a null in any column is a value of its own ('-' in a leaf, a group before all others); rows with equal
order keys stand in the order of their leaves, so repeated rows are neighbours; a null order key comes first; an empty
table gives an empty result; columns that are not named take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Stages

LEVELS = 10
#: Leaves of a block: LEVELS levels of pairs make one node of them.
BLOCK = 1 << LEVELS


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def field(value: Column) -> Column:
    """A value of a leaf: its UTF-8 bytes' number, a colon, itself; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields together."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _above(level: Column) -> Column:
    """The next level: every two consecutive nodes hashed together, a last single one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.array_join(F.slice(level, 2 * i + 1, 2), ""), 256))


def _collapsed(nodes: Column, alone: Column) -> Column:
    """All levels of a block, from its nodes to its root; a block beside others always has all LEVELS of them."""
    step = lambda levels, _: F.when(
        ~alone | (F.size(F.element_at(levels, -1)) > 1), F.concat(levels, F.array(_above(F.element_at(levels, -1))))
    ).otherwise(levels)
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), step)


def _siblings(levels: Column, at: Column) -> Column:
    """The path of the node `at` (from 0) to the block's root."""

    def beside(level: Column, l: Column) -> Column:  # noqa: E741
        place = F.call_function("shiftright", at, l)
        left = F.when(place % 2 == 1, F.get(level, place - 1))
        right = F.when(place % 2 == 0, F.get(level, place + 1))
        return F.struct(F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _placed(stages: Stages, nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` (g, node, item, order columns) as (g, pos, n, node, item): the place in the group and the group's size.

    Rows are dealt by ranges of group and order together, so that a large group has many tasks; only counts by task and
    group meet in one place.
    """
    keys = ["g", *order]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g", "node", "item", F.monotonically_increasing_id().alias("at"))
    kept = stages.keep(ranged).withColumn("task", F.shiftrightunsigned("at", 33))
    runs = kept.groupBy("g", "task").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    mine = Window.partitionBy("g")
    before = F.sum("rows").over(mine.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("g", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(mine).alias("n"))
    return kept.join(stages.keep(runs), ["g", "task"]).select("g", (F.col("at") + F.col("shift")).alias("pos"), "n", "node", "item")


def _blocks(stages: Stages, placed: DataFrame) -> DataFrame:
    """(g, block, blocks, nodes, items, top): the blocks of all groups, in arrays of BLOCK rows at most."""
    block = F.floor(F.col("pos") / BLOCK)
    rows = F.sort_array(F.collect_list(F.struct("pos", "node", "item")))
    gathered = placed.groupBy("g", block.alias("block")).agg(rows.alias("rows"), (F.floor((F.first("n") - 1) / BLOCK) + 1).alias("blocks"))
    arrays = gathered.select("g", "block", "blocks", F.col("rows.node").alias("nodes"), F.col("rows.item").alias("items"))
    return stages.keep(arrays.withColumn("top", F.element_at(F.element_at(_collapsed(F.col("nodes"), F.col("blocks") == 1), -1), 1)))


def _tree(stages: Stages, placed: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves to one block for each group."""
    tables = [_blocks(stages, placed)]
    while (tables[-1].agg(F.max("blocks")).first()[0] or 1) > 1:
        up = tables[-1].select("g", F.col("block").alias("pos"), F.col("blocks").alias("n"), F.col("top").alias("node"), F.col("block").alias("item"))
        tables.append(_blocks(stages, up))
    return tables


def _unfolded(table: DataFrame, above: DataFrame) -> DataFrame:
    """(g, item, node, path, subroot, root) of all nodes in the blocks; `above` has each block's path (g, block, path, ...)."""
    both = table.drop("top").join(above, ["g", "block"])
    levels = _collapsed(F.col("nodes"), F.col("blocks") == 1)
    paths = _let(levels, lambda x: F.transform(
        F.sequence(F.lit(0), F.size("nodes") - 1),
        lambda i: F.struct(F.get("items", i).alias("item"), F.get("nodes", i).alias("node"), F.concat(_siblings(x, i), F.col("path")).alias("path")),
    ))
    others = [c for c in above.columns if c not in ("g", "block", "path")]
    return both.select("g", *others, F.explode(paths).alias("x")).select("g", *others, "x.*")


def _downwards(stages: Stages, tables: list[DataFrame], above: DataFrame) -> DataFrame:
    for table in tables[:0:-1]:
        found = _unfolded(table, above)
        above = stages.keep(found.drop("node").withColumnRenamed("item", "block"))
    return _unfolded(tables[0], above)


def manifest(leaves: DataFrame, group: str, order: list[str], node: str = "leaf") -> DataFrame:
    """`leaves` with path (array of left and right siblings), subroot of the row's group, and the root of all groups.

    Groups stand in the order of their UTF-8 bytes, null first.
    """
    stages = Stages(leaves.sparkSession, "merkle")
    # a mark in front keeps null apart from every text, and before it
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = leaves.select(key.alias("g"), F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("item"), F.col(node).alias("node"))
    rows = stages.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    # equal rows are dealt by their numbers
    sort = {f"k{i}": F.col("item").getField(c) for i, c in enumerate(order)}
    tables = _tree(stages, _placed(stages, rows.withColumns(sort), [*sort, "node", "row"]))
    subroots = tables[-1].select(F.lit("").alias("g"), F.col("top").alias("node"), F.col("g").alias("item"))
    tops = _tree(stages, _placed(stages, subroots, ["item"]))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = tops[-1].select("g", "block", nothing.alias("path"), F.col("top").alias("root"))
    groups = _downwards(stages, tops, root).select(F.col("item").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root")
    found = _downwards(stages, tables, stages.keep(groups))
    return found.select("item.*", "path", "subroot", "root")
