"""Sinks: JSON records, vector indexes with their model, the Markdown cache, per-document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import strip_control
from lexloom.operators.compare import flatten

_CELL = 32767


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines with null fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_markdown(docs: DataFrame, cache: str) -> None:
    """Texts (doc_id, md) into the cache that `corpus.convert_directory` reads, as of now: rows of its table, as millions
    of small files would not scale."""
    rows = docs.where("md IS NOT NULL").select("doc_id", F.current_timestamp().alias("mtime"), "md", F.lit(None).cast("string").alias("error"), F.lit("").alias("corrida"))
    rows.write.mode("append").parquet(f"{cache}/tabla")


def write_sheets(elements: DataFrame, path: str) -> None:
    """A folder for each document with the columns of its sheet; names of more than 31 characters that begin alike end in
    a part of their hash."""
    doc = F.col("doc_id").cast("string")
    names = elements.select("doc_id").distinct().withColumn("hoja", F.substring(doc, 1, 31))
    alike = names.groupBy("hoja").agg(F.count("*").alias("n"))
    names = names.join(alike, "hoja").select("doc_id", F.when(F.col("n") == 1, F.col("hoja")).otherwise(F.concat(F.substring(doc, 1, 22), F.lit("~"), F.substring(F.md5(doc), 1, 8))).alias("hoja"))
    elements = elements.join(names, "doc_id")
    cell = F.substring(strip_control(F.concat_ws("\n", F.nullif("encabezado", F.lit("")), "contenido")), 1, _CELL)
    rows = elements.select(
        "hoja", F.col("numero").alias("NUMERO"), cell.alias("ARTICULO"),
        F.lit("N/D").alias("PAGINA"), F.col("seccion").alias("SECCION"), F.col("fecha").alias("FECHA"),
    )
    rows.repartition("hoja").write.mode("overwrite").partitionBy("hoja").option("header", "true").option("escape", '"').csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """The flattened comparison as CSV."""
    flatten(rows).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def nested_documents(docs: DataFrame, marks: DataFrame, articles: DataFrame, annexes: DataFrame) -> DataFrame:
    """One row for each of `docs` (doc_id, ...): its columns, the numbers of its elements, and secciones, articulos and
    anexos as arrays of structs in order of position.

    The three kinds (doc_id, posicion, ...) meet in one grouping, in one array of a document that is then parted by
    kind; a document without elements has empty arrays.
    """
    kinds = {"secciones": marks, "articulos": articles, "anexos": annexes}
    own = {k: [c for c in rows.columns if c != "doc_id"] for k, rows in kinds.items()}
    every = None
    for i, (kind, rows) in enumerate(kinds.items()):
        place = "posicion" if "posicion" in rows.columns else "seq"
        empty = [F.lit(None).cast(other.select(*own[k]).schema.simpleString()).alias(k) for k, other in kinds.items()]
        empty[i] = F.struct(*own[kind]).alias(kind)
        part = rows.select("doc_id", F.struct(F.col(place).cast("long").alias("at"), F.lit(i).alias("kind"), F.to_json(F.struct(*own[kind])).alias("tie"), *empty).alias("x"))
        every = part if every is None else every.unionByName(part)
    gathered = every.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    both = docs.join(gathered, "doc_id", "left").withColumn("xs", F.coalesce("xs", F.array().cast(gathered.schema["xs"].dataType)))
    def of(i: int, kind: str) -> Column:
        return F.transform(F.filter("xs", lambda x: x.kind == i), lambda x: x[kind])

    lists = {k: of(i, k) for i, k in enumerate(kinds)}
    return both.withColumns(lists).withColumns({f"n_{k}": F.size(k) for k in kinds}).drop("xs")


def elements_of(nested: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ...): the elements of one kind out of nested documents, as tables again."""
    return nested.select("doc_id", F.explode(kind).alias("x")).select("doc_id", "x.*")
