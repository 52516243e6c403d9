"""Hierarchical chunks with their pages: paragraphs under a stack of six heading levels, peers packed greedily.

A paragraph never crosses a heading or a blank line. One of more than the most words is cut into runs of that many;
then consecutive ones under the same headings go together while they fit. White-space words stand for tokens. Headings
and positions come from windows over a document's lines; only the packing, which is a fold with state, runs on short
integer lists in Arrow batches.

Edge cases: a null or empty text, and one of headings alone, has no chunks; a heading without a title ends the levels
below it and adds none; ids must be unique (repeated ids count as one document); a text without a page has null pages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions.text import strip

LEVELS = range(1, 7)


def _greedy(most: int):
    """Column function over (sizes, runs): the number of each item's chunk; a chunk never crosses runs."""

    @F.arrow_udf("array<int>")
    def chunks(sizes: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for ns, rs in zip(sizes.to_pylist(), runs.to_pylist(), strict=True):
            number, size, last, mine = -1, 0, None, []
            for n, r in zip(ns, rs, strict=True):
                if r != last or size + n > most:
                    number, size = number + 1, 0
                size, last = size + n, r
                mine.append(number)
            out.append(mine)
        return pa.array(out, pa.list_(pa.int32()))

    return chunks


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at, line, level, start, section, paragraph, headings) of every line; `start` counts characters from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("at", "line"))
    found = {"level": F.length(F.regexp_extract("line", P.MARKDOWN_HEADING, 1)), "title": strip(F.regexp_extract("line", P.MARKDOWN_HEADING, 2))}
    lines = lines.withColumns(found)
    so_far = W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    of_level = lambda i, c: F.when(F.col("level") == i, c)
    blank = strip(F.col("line")) == ""
    seen = lines.withColumns(
        {f"p{i}": F.max(of_level(i, F.col("at"))).over(so_far) for i in LEVELS}
        | {f"t{i}": F.last(of_level(i, F.col("title")), ignorenulls=True).over(so_far) for i in LEVELS}
        | {
            "start": F.sum(F.length("line") + 1).over(so_far) - F.length("line") - 1,
            "section": F.sum((F.col("level") > 0).cast("int")).over(so_far),
            "paragraph": F.sum(((F.col("level") > 0) | blank).cast("int")).over(so_far),
            "body": (F.col("level") == 0) & ~blank,
        }
    )
    # a level's heading holds while no higher level has come after it
    above = lambda i: F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"p{j}", F.lit(-1)) for j in range(1, i)])
    names = F.array_compact(F.array(*[F.when((F.col(f"p{i}") > above(i)) & (F.col(f"t{i}") != ""), F.col(f"t{i}")) for i in LEVELS]))
    return seen.select("doc_id", "at", "line", "start", "section", "paragraph", "body", names.alias("headings"))


def items(docs: DataFrame, most: int = P.MAX_TOKENS) -> DataFrame:
    """(doc_id, orden, headings, start, stop, n, texto, run): paragraphs in order, long ones cut; equal runs are peers."""
    body = _lines(docs).where("body")
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.filter(F.split(x.line, r"[ \t]+"), lambda w: w != "")))
    whole = body.groupBy("doc_id", "section", "paragraph").agg(
        F.first("headings").alias("headings"), F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("stop"), words.alias("words")
    )
    cut = whole.where("size(words) > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / most).cast("int"))))
    part = F.slice("words", F.col("part") * most + 1, most)
    cut = cut.select("doc_id", "section", "paragraph", "part", "headings", "start", "stop", F.size(part).alias("n"), F.array_join(part, " ").alias("texto"))
    in_order = W.partitionBy("doc_id").orderBy("section", "paragraph", "part")
    changed = ~F.col("headings").eqNullSafe(F.lag("headings").over(in_order))
    out = cut.withColumns({"orden": F.row_number().over(in_order) - 1, "changed": changed.cast("int")})
    run = F.sum("changed").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    return out.select("doc_id", "orden", "headings", "start", "stop", "n", "texto", run.cast("int").alias("run"))


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """`rows` (doc_id, start, stop, ...) with first_page and last_page, as of their first and last character.

    `pages` has (doc_id, pagina, inicio), the place of each page's first character. One window over rows and pages.
    """
    probes = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("last")), F.struct((F.col("stop") - 1).alias("at"), F.lit(1).alias("last"))))
    asked = rows.select("doc_id", "orden", probes.alias("x")).select("doc_id", "x.at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("pagina"), "orden", "x.last")
    known = pages.select("doc_id", F.col("inicio").alias("at"), F.lit(0).alias("kind"), F.col("pagina").cast("int").alias("pagina"))
    both = asked.unionByName(known, allowMissingColumns=True)
    so_far = W.partitionBy("doc_id").orderBy("at", "kind", "pagina").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("pagina", F.last("pagina", ignorenulls=True).over(so_far)).where("kind = 1")
    told = seen.groupBy("doc_id", "orden").agg(F.max(F.when(F.col("last") == 0, F.col("pagina"))).alias("first_page"), F.max(F.when(F.col("last") == 1, F.col("pagina"))).alias("last_page"))
    return rows.join(told, ["doc_id", "orden"])


def hierarchical_chunks(docs: DataFrame, most: int = P.MAX_TOKENS, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk, headings, jerarquia, titulo_seccion, texto, n_tokens, embed_text), in order.

    With `pages` also page_start and page_end, the first and last page of all the chunk's paragraphs, and pagina_inicio
    and pagina_fin, which both are the page on which its first paragraph begins.
    """
    rows = items(docs, most)
    rows = rows.withColumns({"first_page": F.lit(None).cast("int"), "last_page": F.lit(None).cast("int")}) if pages is None else with_pages(rows, pages)
    each = F.array_sort(F.collect_list(F.struct("orden", "run", "n", "headings", "texto", "first_page", "last_page")))
    whole = rows.groupBy("doc_id").agg(each.alias("rows"))
    whole = whole.withColumn("chunks", _greedy(most)(F.col("rows.n"), F.col("rows.run")))
    zipped = F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("chunks").alias("chunk")))
    placed = whole.select("doc_id", zipped.alias("x")).select("doc_id", F.col("x.chunk").alias("chunk"), F.col("x.row").alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row.orden", "row.texto"))), lambda x: x.texto), "\n")
    out = placed.groupBy("doc_id", "chunk").agg(
        F.first("row.headings").alias("headings"), text.alias("texto"), F.sum("row.n").cast("int").alias("n_tokens"),
        F.min("row.first_page").alias("page_start"), F.max("row.last_page").alias("page_end"), F.min_by("row.first_page", "row.orden").alias("pagina_inicio"),
    )
    path: Column = F.array_join("headings", " > ")
    columns = ["doc_id", "chunk", "headings", path.alias("jerarquia"), F.coalesce(F.get("headings", F.size("headings") - 1), F.lit("")).alias("titulo_seccion"), "texto", "n_tokens"]
    columns.append(F.concat_ws("\n", F.nullif(path, F.lit("")), "texto").alias("embed_text"))
    return out.select(*columns, *([] if pages is None else ["page_start", "page_end", "pagina_inicio", F.col("pagina_inicio").alias("pagina_fin")]))


def page_starts(docs: DataFrame, mark: str = "\f") -> DataFrame:
    """(doc_id, pagina, inicio): pages from 1, each after a mark of its own (a form feed), which belongs to the page before."""
    each = docs.select("doc_id", F.posexplode(F.split("md", mark, -1)).alias("i", "text"))
    before = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + len(mark)).over(before), F.lit(0))
    return each.select("doc_id", (F.col("i") + 1).alias("pagina"), at.alias("inicio"))
