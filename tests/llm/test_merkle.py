import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    out = []
    for v in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text):
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*out)


def tree(nodes):
    """All levels, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        i = at // 2 * 2
        run = level[i : i + 2]
        out.append((run[0] if at % 2 else "", run[1] if at % 2 == 0 and len(run) == 2 else ""))
        at //= 2
    return out


def by_brute_force(rows):
    order = lambda v: (v is not None, v or 0)
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(r) for r in sorted((r for r in rows if r.lang == x), key=lambda r: (order(r.doc_id), leaf(r)))]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for x in langs:
        mine = sorted((r for r in rows if r.lang == x), key=lambda r: (order(r.doc_id), leaf(r)))
        for at, r in enumerate(mine):
            whole = path(trees[x], at) + path(top, langs.index(x))
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, 1) if changed else leaf(r)
            for left, right in whole:
                node = sha(left, node, right)
            proof = sha(*(s for pair in whole for s in pair))
            out.append((r.doc_id, leaf(r), trees[x][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def query(docs):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, M.leaf(*more))
    found = M.manifest(docs.select("doc_id", "lang", M.leaf(*fields).alias("leaf"), tampered.alias("tampered")), "lang", ["doc_id"])
    folded = M.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", M.proof(F.col("path")), folded, folded == F.col("root")).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_whole_table_and_hostile_rows(documents):
    docs = documents.drop("n_tokens", "n_words")
    got = query(docs)
    assert got == by_brute_force(docs.collect())
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_blocks(spark, monkeypatch, levels):
    """Small blocks, so that several levels of blocks are gathered; groups of one row, of a block, and of one more."""
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 1 << levels)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 16, "g": 17, "é": 37, "": 8, None: 6}
    rows = [(len(x or "") * 1000 + ord((x or "0")[:1]) * 100 + i, "s", x, i % 5 or None, f"text {i}") for x, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows + rows[-9:], "doc_id long, source string, lang string, n_chars long, text string")
    assert query(docs) == by_brute_force(docs.collect())


def test_empty_one_and_other_names(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert query(spark.createDataFrame([], kind)) == []
    one = spark.createDataFrame([(7, "s", "x", 1, "t")], kind)
    assert query(one) == by_brute_force(one.collect())
    leaves = one.select("doc_id", "lang", F.lit("p").alias("g"), F.lit("q").alias("node"), F.lit("r").alias("item"), F.lit("s").alias("pos"), M.leaf(F.col("doc_id")).alias("leaf"))
    found = M.manifest(leaves, "lang", ["doc_id"]).first()
    assert (found.g, found.node, found.item, found.pos) == ("p", "q", "r", "s") and found.root == found.subroot == found.leaf and found.path == []
