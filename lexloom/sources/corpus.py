"""Sources: directories of regulations and manuals, the Markdown cache, saved indexes and records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import patterns as P
from lexloom.functions.text import cleaning_chain, strip
from lexloom.operators import chunks, extract
from lexloom.streaming.resume import stored

Converter = Callable[[bytes], str]


CACHE = "doc_id string, mtime timestamp, md string, error string, corrida string"
_TABLE, _POOR = "tabla", 200


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def poor(md: Column) -> Column:
    """Whether a text has under 200 characters without the white space around it, as a scan without recognised text has."""
    return F.length(strip(F.coalesce(md, F.lit("")))) < _POOR


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, md, extraccion_pobre): one row per Markdown file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(_stem(F.col("path")).alias("doc_id"), F.col("content").cast("string").alias("md"))
    return rows.withColumn("extraccion_pobre", poor(F.col("md")))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", exclude_prefix: str | None = None) -> DataFrame:
    """(doc_id, archivo, path, mtime) of a folder's files, without those whose names have the prefix; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    path = F.col("path")
    rows = files.select(_stem(path).alias("doc_id"), F.regexp_extract(path, "([^/]+)$", 1).alias("archivo"), "path", F.col("modificationTime").alias("mtime"))
    return rows if exclude_prefix is None else rows.where(~F.startswith("archivo", F.lit(exclude_prefix)))


def _cached(spark: SparkSession, cache: str) -> DataFrame:
    """(doc_id, md, mtime): the newest text of each document, from the cache's table or from a Markdown file in its folder."""
    kept = stored(spark, f"{cache}/{_TABLE}", CACHE).where("md IS NOT NULL").select("doc_id", "mtime", "md")
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(cache)
        kept = kept.unionByName(files.select(_stem(F.col("path")).alias("doc_id"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("md")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return kept.groupBy("doc_id").agg(F.max(F.struct("mtime", "md")).alias("x")).select("doc_id", "x.*")


def convert_directory(spark: SparkSession, folder: str, converter: Converter, cache: str | None = None, pattern: str = "*.pdf", exclude_prefix: str | None = None) -> DataFrame:
    """(doc_id, archivo, md, error, extraccion_pobre): the files of a folder by `converter`, in order of their names.

    With a cache, a file whose cached text is not older isn't converted and isn't even read; the others are converted
    once, in a job of its own, and their texts appended to the cache's table, which keeps every version. A file that
    fails has an error and no text, and the others go on; failures are tried again the next time. Files of no bytes have
    no row, as Spark doesn't list them.
    """
    files = list_files(spark, folder, pattern, exclude_prefix)
    schema = "doc_id string, mtime timestamp, md string, error string"

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, mtime, content in zip(batch["doc_id"], batch["mtime"], batch["content"], strict=True):
                try:
                    rows.append((doc_id, mtime, converter(bytes(content)) or "", None))
                except Exception as e:  # noqa: BLE001  one bad file must not stop the rest
                    rows.append((doc_id, mtime, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["doc_id", "mtime", "md", "error"])

    def converted(paths: str | list[str]) -> DataFrame:
        whole = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
        whole = whole.select(_stem(F.col("path")).alias("doc_id"), F.col("modificationTime").alias("mtime"), "content").join(F.broadcast(files.select("doc_id")), "doc_id", "left_semi")
        return whole.mapInPandas(convert, schema)

    if cache is None:
        told = converted(folder).drop("mtime")
    else:
        run = uuid.uuid4().hex
        fresh = lambda: files.alias("f").join(_cached(spark, cache).alias("c"), F.expr("f.doc_id = c.doc_id AND c.mtime >= f.mtime")).select("f.doc_id", "c.md")
        stale = [r.path for r in files.join(fresh(), "doc_id", "left_anti").select("path").collect()]  # names only, as many as Spark has listed
        if stale:
            converted(stale).withColumn("corrida", F.lit(run)).write.mode("append").parquet(f"{cache}/{_TABLE}")
        failed = stored(spark, f"{cache}/{_TABLE}", CACHE).where((F.col("corrida") == run) & F.col("md").isNull()).select("doc_id", "md", "error")
        told = fresh().withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    out = files.select("doc_id", "archivo").join(told, "doc_id").select("doc_id", "archivo", "md", "error")
    return out.withColumn("extraccion_pobre", F.when(F.col("error").isNull(), poor(F.col("md")))).orderBy("archivo")


def _with_failures(rows: DataFrame, docs: DataFrame, *order: str) -> DataFrame:
    """`rows` by name of file, and a row with the error for each file that has failed."""
    named = rows.join(docs.select("doc_id", "archivo"), "doc_id").withColumn("error", F.lit(None).cast("string"))
    failed = docs.where("error IS NOT NULL").select("doc_id", "archivo", "error")
    return named.unionByName(failed, allowMissingColumns=True).orderBy("archivo", *order)


def norm_elements(docs: DataFrame) -> DataFrame:
    """The articles, provisions and annexes of converted files (as from `convert_directory`), in order, and failed files.

    Repeated lines and artifacts are cleaned first; files without text, and without elements, have no rows. `docs` is
    read several times: pass a stored table, or one behind a cache.
    """
    texts = docs.where("md IS NOT NULL AND md <> ''").select("doc_id", "md")
    return _with_failures(extract.normativa(cleaning_chain(texts)), docs, "orden")


def manual_sections(docs: DataFrame, most: int = P.MAX_TOKENS) -> DataFrame:
    """(chunk_id, doc_id, fuente, pagina_inicio, pagina_fin, jerarquia, titulo_seccion, texto, embed_text, ...) of
    converted manuals, whose form feeds part pages, and failed files."""
    texts = docs.where("md IS NOT NULL AND md <> ''").select("doc_id", "md")
    found = chunks.hierarchical_chunks(texts, most, chunks.page_starts(texts))
    found = found.withColumn("chunk_id", F.format_string("%s_%04d", "doc_id", "chunk"))
    return _with_failures(found, docs, "chunk").withColumn("fuente", F.col("archivo"))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON records under a declared schema, so that numbers stored as text stay text."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)
