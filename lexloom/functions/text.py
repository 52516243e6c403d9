"""Text cleaning as column expressions; no step shuffles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import patterns as P


def strip(text: Column) -> Column:
    """From the first to the last character that is no white space; found from both ends, not by trying every place."""
    return F.regexp_extract(text, r"(?Us)\S(?:.*\S)?", 0)


def clean_text(md: Column) -> Column:
    """Tabs to spaces, artifact lines out, runs of spaces to one; line breaks stay."""
    lines = F.split(F.translate(md, "\t", " "), "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(f"(?d){P.ARTIFACT_LINE}"))
    return F.regexp_replace(F.array_join(kept, "\n"), "[ ]{2,}", " ")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, P.CONTROL, "")


def _often(keys: Column, least: int) -> Column:
    """For each key of an array, whether it stands there `least` times or more: sorted with their places, equal keys are
    neighbours, so one comparison over a distance tells."""

    def told(s: Column) -> Column:
        def many(x: Column, i: Column) -> Column:
            spans = [F.coalesce(F.get(s, i - o)["k"] == F.get(s, i - o + (least - 1))["k"], F.lit(False)) for o in range(least)]
            return F.struct(x["i"].alias("i"), reduce(or_, spans).alias("many"))

        return F.transform(F.array_sort(F.transform(s, many)), lambda y: y["many"])

    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.transform(F.array(placed), told)[0]


def strip_repeated_lines(docs: DataFrame, text: str = "md", least: int = 3, longest: int = 90) -> DataFrame:
    """`docs` without the short lines that a text repeats `least` times or more; blank lines stay.

    Each row is cleaned by itself, so null texts stay null, and rows with one id are texts of their own.
    """

    def cleaned(lines: Column) -> Column:
        keys = F.transform(lines, lambda x: F.lower(F.regexp_replace(strip(x), r"(?U)\s+", " ")))

        def kept(ks: Column) -> Column:
            each = F.arrays_zip(lines.alias("line"), ks.alias("key"), _often(ks, least).alias("often"))
            stay = F.filter(each, lambda x: (x["key"] == "") | ~x["often"] | (F.length(x["key"]) > longest))
            return F.array_join(F.transform(stay, lambda x: x["line"]), "\n")

        return F.transform(F.array(keys), kept)[0]

    return docs.withColumn(text, F.transform(F.array(F.split(text, "\n", -1)), cleaned)[0])


def cleaning_chain(docs: DataFrame, text: str = "md") -> DataFrame:
    """The whole cleaning in its order: repeated lines, then tabs, artifact lines and runs of spaces."""
    cleaned = strip_repeated_lines(docs, text)
    return cleaned.withColumn(text, clean_text(F.col(text)))


def collapse_lines(text: Column) -> Column:
    """Three line breaks and more to two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")
