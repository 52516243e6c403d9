"""How far the sources of a language diverge in their words: a score for each pair, and the terms that stand out.

Terms are counted for each (language, source); a language keeps the terms that stand in at least `MIN_DOCS` of its
documents. Of two sources, each term adds floor((p - q)^2 / q) for their smoothed shares p and q. Nearly all terms are
missing from most sources, so each pair starts at V times the value of two zero counts, and only what departs from that
is added: for a term that one of the two has, the difference by the number of terms with that share (a short table
for each source); for a term that both have, a correction from the term's posting list. A long posting list is cut into
tiles whose pairs are dealt to other tasks.

Edge cases: null text, language and source are ''; repeated rows are documents of their own; a group without kept terms
has zero counts; a language without kept terms has pairs of value 0 and no terms; an empty table gives an empty result;
very long texts are taken in pieces; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Stages, byte_texts

MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Terms that a task counts before it passes them on, postings in a tile, bytes of a text taken at once, and the groups
#: up to which their table goes to every task.
HELD_TERMS, TILE, PIECE, FEW_GROUPS = 300_000, 256, 4 << 20, 50_000
#: Letters A-Z become a-z; every other ASCII byte that isn't a letter parts terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, as far as a task has come."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            arrays = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
            arrays += [pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            whole = pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
            yield from (whole.slice(i, 50_000) for i in range(0, len(terms), 50_000))
        held.clear()

    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for texts in byte_texts(batch.column("text")):
            for text in texts:
                n, docs = held.setdefault(next(keys), (Counter(), Counter()))
                before, mine = len(n), set()
                for piece in _pieces(text.translate(_LETTERS)):
                    words = piece.split()
                    n.update(words)
                    mine.update(words)
                docs.update(mine)
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from passed_on()
                    size = 0
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the group's documents that have it."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    plain = plain.withColumn("text", F.col("text").cast("binary"))
    return plain.mapInArrow(_counts, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exact; counts whose product leaves 64 bits go by decimals."""
    below = F.greatest(total + terms, F.lit(1))
    exact = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    wide = F.call_function("div", exact, below.cast("decimal(20,0)"))
    return 1 + F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(UNIT), below)).otherwise(wide)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), F.greatest(q, F.lit(1)))


def _groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, p0): every occurring group, and its share of a term that it lacks."""
    all_groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = terms.select("lang", F.explode("posts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    found = all_groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return found.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))


def _tiles(priced: DataFrame) -> DataFrame:
    """(lang, a, b): pieces of posting lists against each other; the pieces of long lists are dealt anew."""
    short = priced.where((F.size("posts") > 1) & (F.size("posts") <= TILE)).select("lang", F.col("posts").alias("a"), F.col("posts").alias("b"))
    starts = F.sequence(F.lit(1), F.size("posts"), F.lit(TILE))
    pairs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(starts, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cut = priced.where(F.size("posts") > TILE).select("lang", "term", "posts", F.explode(pairs).alias("x"))
    cut = cut.select("lang", "term", "x.*", F.slice("posts", F.col("x.i"), TILE).alias("a"), F.slice("posts", F.col("x.j"), TILE).alias("b"))
    return short.unionByName(cut.repartition("lang", "term", "i", "j").select("lang", "a", "b"))


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    few = F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups
    s, t = groups.select("lang", "source", "terms", "p0"), few.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = s.join(t, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * gap(F.col("p0"), F.col("q0"))).alias("value"))
    # terms that one of two sources has, as if the other had none: by their share and how many have it
    many = priced.select("lang", F.explode("posts").alias("x")).groupBy("lang", "x.source", "x.p", "x.p0").agg(F.count("*").alias("many"))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    sides = many.join(t, "lang").where("source <> item").select("lang", "source", "item", "many", "p", "p0", "q0")
    sides = sides.groupBy("lang", "source", "item").agg(
        F.sum(F.col("many") * (gap(p, q0) - gap(p0, q0))).alias("mine"), F.sum(F.col("many") * (gap(q0, p) - gap(q0, p0))).alias("other")
    )
    # terms that both have: what the two one-sided differences don't tell
    both = _tiles(priced).select("lang", "b", F.explode("a").alias("x")).select("lang", "x", F.explode("b").alias("y")).where("x.source < y.source")
    p, p0, q, q0 = F.col("x.p"), F.col("x.p0"), F.col("y.p"), F.col("y.p0")
    both = both.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(
        F.sum(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("mine"), F.sum(gap(q, p) - gap(q, p0) - gap(q0, p) + gap(q0, p0)).alias("other")
    )
    ways = lambda d: d.select("lang", "source", "item", F.col("mine").alias("value")).unionByName(
        d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("other").alias("value"))
    )
    return base.unionByName(ways(sides)).unionByName(ways(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source, part `term` the first `top` terms."""
    stages = Stages(docs.sparkSession, "divergence")
    counted = term_counts(docs)
    terms = counted.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", F.col("n").alias("n"))).alias("posts")
    )
    terms = stages.keep(terms.where(F.col("docs") >= min_docs).drop("docs"))
    groups = stages.keep(_groups(docs, terms))
    posts = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("posts").alias("x")).select("lang", "term", "lang_n", "x.*")
    posts = posts.join(groups, ["lang", "source"])
    posts = posts.select(
        "lang", "term", "source", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    priced = posts.groupBy("lang", "term").agg(F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("posts"))
    priced = stages.keep(priced)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups, priced).withColumn("rank", F.row_number().over(best))
    above = priced.select("lang", "term", "q", F.explode("posts").alias("x")).where("x.p > q")
    above = above.select("lang", "x.source", F.col("term").alias("item"), gap(F.col("x.p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    columns = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(above, "term"))
