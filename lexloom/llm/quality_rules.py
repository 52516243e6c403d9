"""Quality rules: repetition within a text, and lines that many documents of a host share.

Only DataFrame functions are used. Normalised lines are hashed and counted over the distinct documents of each host
(`source`): exact copies are one document, different texts are different documents. A line is above the limit of its host
if it stands in more than `line_share` of the host's documents and in more than `line_docs` of them. Such lines are
removed; a document that loses more than `max_lost` of its words is depleted and rejected. So are near copies that are
many on one host, where most of their lines are the same.

Edge cases: a null text has no words and fails the base rules, as does an empty one; a null host is a host of its own;
repeated rows give repeated rows and count as one text; an empty table gives an empty result; very long texts are taken
whole; `clean` returns exactly the columns it gets, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Stages, free_name, hot_join

_BLANKS = "\t\n\x0b\x0c\r"
_GRAM = 8
#: Bytes of lines above the limit that may be broadcast; beyond it they are joined by a shuffle that deals hot lines.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Limits:
    """The rules' limits."""

    min_words: int = 20
    max_repeated: float = 0.30
    line_docs: int = 12
    line_share: float = 0.002
    max_lost: float = 0.5


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _gram_hashes(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= _GRAM, F.transform(F.sequence(F.lit(1), n - (_GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, _GRAM)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort the hashes with their places and join the runs of equal ones."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = _let(placed, lambda s: F.zip_with(
        F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
        lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")),
    ))
    starts = F.array_sort(F.array_distinct(F.flatten(pairs)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, i: F.struct((acc.n + i + _GRAM - F.greatest(i, acc.upto)).alias("n"), (i + _GRAM).alias("upto"))
    counted = F.aggregate(starts, zero, step, lambda acc: acc.n)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(0)


def _normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(line, "\t\x0b\x0c\r", "    ")), " {2,}", " "))


def measured(docs: DataFrame, limits: Limits) -> DataFrame:
    """Per row of `docs` (doc_id, source, text): its keys, the base counts and its lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, " \t\x0b\x0c\r") > 0)
    base = docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host"), F.xxhash64("text").alias("text_hash"), split_words(text).alias("words"), lines.alias("whole_lines"),
        _without(text, " " + _BLANKS).alias("word_chars"), (F.length(text) - _without(text, "#*$%&|<>")).alias("n_symbols"),
    )
    grams = _let(F.col("words"), lambda w: F.struct(F.size(w).alias("n_words"), _gram_hashes(w).alias("hashes")))
    facts = _let(grams, lambda g: F.struct(g.n_words.alias("n_words"), _repeated_words(g.hashes).alias("n_repeat_words")))
    told = _let(F.col("whole_lines"), lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
        F.transform(ls, lambda x: F.struct(F.xxhash64(_normal_line(x)).alias("line"), F.size(split_words(x)).alias("words"))).alias("lines"),
    ))
    out = base.select("doc_id", "source", "host", "text_hash", "word_chars", "n_symbols", facts.alias("f"), told.alias("l"))
    out = out.select("doc_id", "source", "host", "text_hash", "word_chars", "n_symbols", "f.n_words", "f.n_repeat_words", "l.n_dup_lines", "l.lines")
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") > limits.max_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def frequent_lines(facts: DataFrame, limits: Limits, stages: Stages) -> DataFrame:
    """(host, line) above the limit, a kept table; every count is combined before it is shuffled, a document counts once."""
    texts = facts.select("host", "text_hash", F.explode(F.array_distinct("lines.line")).alias("line")).distinct()
    many = texts.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > limits.line_docs)
    every = facts.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("all"))
    many, every = stages.keep(many), stages.keep(every)
    found = stages.keep(hot_join(many, every, "host").where(F.col("documents") > limits.line_share * F.col("all")).select("host", "line"))
    stages.drop(many, every)
    return found


def _lost(facts: DataFrame, limits: Limits, stages: Stages) -> DataFrame:
    """Per document with frequent lines: their hashes and the words in them."""
    frequent = frequent_lines(facts, limits, stages)
    told = ["doc_id", "text_hash", "source"]
    lines = facts.select(*told, "host", F.posexplode("lines").alias("at", "x")).select(*told, "host", "at", "x.*")
    size = frequent.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0))).first()[0]
    on = ["host", "line"]
    found = lines.join(F.broadcast(frequent), on) if size <= BROADCAST_BYTES else hot_join(lines, frequent, on)
    # repeated rows give each place more than once: a place counts once
    places = found.groupBy(*told, "at", "line").agg(F.first("words").alias("words"))
    return places.groupBy(*told).agg(F.collect_set("line").alias("removed"), F.sum("words").alias("lost_words"))


_SAME = "{0}.doc_id <=> {1}.doc_id AND {0}.text_hash = {1}.text_hash AND {0}.source <=> {1}.source"


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row of `docs`: doc_id, source, text_hash, the base counts, lost_words, removed lines (hashes) and kept."""
    stages = Stages(docs.sparkSession, "quality")
    facts = stages.keep(measured(docs, limits))
    lost = _lost(facts, limits, stages)
    joined = facts.drop("lines", "host").alias("f").join(lost.alias("l"), F.expr(_SAME.format("f", "l")), "left")
    joined = joined.select("f.*", F.coalesce("l.lost_words", F.lit(0)).alias("lost_words"), "l.removed")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= limits.max_lost * F.col("n_words")))


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`docs` without rejected documents, and the others without the lines above their host's limit."""
    stages = Stages(docs.sparkSession, "quality-clean")
    verdicts = stages.keep(judge(docs.select("doc_id", "source", "text"), limits).where("kept").select("doc_id", "source", "text_hash", "removed"))
    verdicts = verdicts.dropDuplicates(["doc_id", "source", "text_hash"]).withColumnRenamed("removed", "removed_lines")
    mine = free_name(docs.columns, "_text_hash")
    own = docs.withColumn(mine, F.xxhash64("text")).alias("d")
    same = F.expr(f"d.doc_id <=> v.doc_id AND d.{mine} = v.text_hash AND d.source <=> v.source")
    both = own.join(verdicts.alias("v"), same)
    kept_lines = F.filter(F.split("d.text", "\n"), lambda x: ~F.array_contains("v.removed_lines", F.xxhash64(_normal_line(x))))
    text = F.when(F.col("v.removed_lines").isNull(), F.col("d.text")).otherwise(F.array_join(kept_lines, "\n"))
    return both.select([text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
