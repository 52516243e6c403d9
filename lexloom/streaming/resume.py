"""Work that isn't done twice: grades by the content of a pair, and a run's results by what each section depends on.

Both are Parquet folders to which finished rows are appended under a key, the hash of all that a row was made from. A
key's rows never change, so a row that two runs have written is taken once, and what a killed job leaves uncommitted is
not seen. Nothing is ever rewritten: a changed text, document or configuration has other keys.

Edge cases: null and '' are different contents; repeated sections or candidates share their key and cost one call;
empty tables call nothing and write nothing; a folder that doesn't exist yet is an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.operators import judge

GRADES = "clave string, relevante boolean, score_grade double, razon_grade string, estado string, corrida string"
DONE = "clave string, chunk_id {0}, h_texto string, h_normas string, h_config string, corrida string, parte int"


def content_key(*values: Column) -> Column:
    """SHA-256 of the values, each with its length in front, so that no two lists of values read alike."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that a folder has so far."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cached_grades(candidates: DataFrame, sections: DataFrame, path: str, model: str, grader: Callable[[str, list[dict]], list[dict]] = judge.overlap_grader) -> DataFrame:
    """`judge.grade` behind a cache in the folder `path`: as it returns, and `origen` ("cache", "nueva" or null).

    A pair's key holds the section's text, the article's number, heading and text, and `model`, the name of the grader
    with all its settings. Only pairs without a key go to the grader, with one call for each distinct section text, in
    which an article's id is the hash of its content. Failed calls are not kept, so the next run tries them again.
    """
    run = uuid.uuid4().hex
    texts = sections.select("chunk_id", F.substring(F.coalesce("texto", F.lit("")), 1, 1500).alias("texto"))
    each = candidates.join(texts, "chunk_id").withColumn("contenido", F.substring("contenido", 1, 600))
    each = each.withColumns({"de_seccion": content_key(F.lit(model), F.col("texto")), "de_articulo": content_key(F.col("numero"), F.col("encabezado"), F.col("contenido"))})
    each = each.withColumn("clave", content_key(F.col("de_seccion"), F.col("de_articulo")))
    known = stored(candidates.sparkSession, path, GRADES).select("clave").distinct()
    first = F.min(F.struct("rank", "score", "numero", "encabezado", "contenido", "texto"))
    todo = each.join(known, "clave", "left_anti").groupBy("de_seccion", "de_articulo").agg(first.alias("x"))
    todo = todo.select(F.col("de_seccion").alias("chunk_id"), F.col("de_articulo").alias("element_id"), "x.*")
    if not todo.isEmpty():
        graded = judge.grade(todo.drop("texto"), todo.groupBy("chunk_id").agg(F.first("texto").alias("texto")), grader)
        fresh = graded.where("estado <> 'error'").select(
            content_key(F.col("chunk_id"), F.col("element_id")).alias("clave"), "relevante", "score_grade", "razon_grade", "estado", F.lit(run).alias("corrida")
        )
        fresh.write.mode("append").parquet(path)
    kept = stored(candidates.sparkSession, path, GRADES).groupBy("clave").agg(F.min(F.struct("corrida", "relevante", "score_grade", "razon_grade", "estado")).alias("g"))
    both = each.select("chunk_id", F.col("element_id").cast("string").alias("element_id"), "clave").join(kept, "clave", "left")
    return both.select(
        "chunk_id", "element_id", F.coalesce("g.relevante", F.lit(True)).alias("relevante"), F.coalesce("g.score_grade", F.lit(P.MISSING_SCORE)).alias("score_grade"),
        F.coalesce("g.razon_grade", F.lit("")).alias("razon_grade"), F.coalesce("g.estado", F.lit("error")).alias("estado"),
        F.when(F.col("g.corrida") == run, "nueva").when(F.col("g.corrida").isNotNull(), "cache").alias("origen"),
    )


def _keyed(sections: DataFrame, depends: DataFrame, config: str) -> DataFrame:
    """`sections` with the hashes of its own columns, of the documents it depends on, and of the configuration.

    The hash over documents doesn't depend on their order and never gathers them: counts, sums and exclusive ors.
    """
    a, b = F.xxhash64("norma"), F.xxhash64(F.reverse("norma"), F.lit(1))
    sums = [F.count("*"), F.bit_xor(a), F.bit_xor(b), F.sum(a.cast("decimal(38,0)"))]
    over = depends.groupBy("chunk_id").agg(content_key(*sums).alias("h_normas"))
    own = content_key(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sections.columns])
    out = sections.withColumns({"h_texto": own, "h_config": F.sha2(F.lit(config), 256)}).join(over, "chunk_id", "left")
    out = out.withColumn("h_normas", F.coalesce("h_normas", F.lit("")))
    return out.withColumn("clave", content_key(F.col("h_texto"), F.col("h_normas"), F.col("h_config")))


def _done(sections: DataFrame, path: str) -> DataFrame:
    return stored(sections.sparkSession, f"{path}/hechas", DONE.format(sections.schema["chunk_id"].dataType.simpleString()))


def pending(sections: DataFrame, depends: DataFrame, path: str, config: str) -> DataFrame:
    """(chunk_id, motivo): the sections that a run would compute, and why: "nueva", "configuracion", "texto" or "norma".

    The reason is told against the section's finished states that come nearest: if one has the same text and documents,
    only the configuration is new, and so on.
    """
    keyed = _keyed(sections, depends, config).select("chunk_id", "h_texto", "h_normas", "h_config", "clave")
    done = _done(sections, path)
    todo = keyed.join(done.select("clave").distinct(), "clave", "left_anti").alias("k")
    same = lambda *names: F.max(F.when(F.expr(" AND ".join(f"k.{n} = d.{n}" for n in names)), 1))
    both = todo.join(done.alias("d"), F.expr("k.chunk_id <=> d.chunk_id"), "left")
    told = both.groupBy("k.chunk_id", "k.clave").agg(
        F.max(F.col("d.clave")).alias("any"), same("h_texto", "h_normas").alias("config"), same("h_normas").alias("text"), same("h_texto").alias("norm")
    )
    reason = F.when(F.col("any").isNull(), "nueva").when(F.col("config") == 1, "configuracion").when(F.col("norm") == 1, "norma").when(F.col("text") == 1, "texto")
    return told.select("chunk_id", reason.otherwise("texto").alias("motivo"))


def resume(sections: DataFrame, depends: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, config: str, parts: int = 8) -> DataFrame:
    """`step(sections)` part by part, kept in the folder `path`; parts that were finished before are not computed again.

    `sections` has chunk_id (unique, else rows of one id count as one section each) and what `step` reads, `depends`
    (chunk_id, norma): the hash or version of each document that a section depends on, so a changed document makes only
    its own sections due. `step` returns rows with chunk_id, any number for a section. After each part its rows are
    appended, then its sections are entered as done; rows count only as the run that entered them has written them, so
    a run that dies in between leaves nothing that is read. Returns the rows of all sections as they are now.
    """
    spark, run = sections.sparkSession, uuid.uuid4().hex
    keyed = _keyed(sections, depends, config)
    todo = keyed.join(_done(sections, path).select("clave").distinct(), "clave", "left_anti").dropDuplicates(["clave"])
    todo = todo.withColumn("parte", F.pmod(F.xxhash64("clave"), F.lit(parts)).cast("int"))
    due = f"{path}/pendientes/{run}"
    todo.write.partitionBy("parte").parquet(due)
    todo = spark.read.schema(todo.schema).parquet(due)
    for part in sorted(r.parte for r in todo.select("parte").distinct().collect()):  # at most `parts`
        mine = todo.where(F.col("parte") == part)
        rows = step(mine.select(sections.columns)).join(mine.select("chunk_id", "clave"), "chunk_id")
        rows.withColumn("corrida", F.lit(run)).write.mode("append").parquet(f"{path}/filas")
        done = mine.select("clave", "chunk_id", "h_texto", "h_normas", "h_config", F.lit(run).alias("corrida"), "parte")
        done.write.mode("append").parquet(f"{path}/hechas")
    entered = _done(sections, path).groupBy("clave").agg(F.min("corrida").alias("corrida"))
    now = keyed.select("clave").distinct().join(entered, "clave")
    shape = step(sections.limit(0)).schema
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shape), "clave string", "corrida string"])
    return stored(spark, f"{path}/filas", kind).join(now, ["clave", "corrida"], "left_semi").drop("clave", "corrida")
