"""Working papers of a comparison: six tables that are written together, and read together or not at all.

A template, which is plain data, says which columns a sheet has, under which labels and in which order; priorities are
rules over the rows, the first that holds. Each run writes its sheets into a folder of its own; the manifest's rows, in
one file, come last, so that a reader sees the whole set of the newest finished run and never half of one.

Edge cases: empty tables give sheets with headings alone; lists are joined, nulls are empty text; a run that died before
its manifest is never read; a template that names a column that isn't there is an error before anything is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import strip_control
from lexloom.operators import compare

MANIFEST = "corrida string, creado timestamp, hoja string, orden int, filas long, columnas array<struct<columna:string,etiqueta:string,ancho:int>>"

# The fill of a row by its level of compliance, and how the sheets are named.
FILLS = {"cumple": "E2EFDA", "parcial": "FFF2CC", "omision": "FCE4D6", "no_aplica": "F2F2F2"}
SHEETS = ["resumen", "via_manual", "via_normativa", "matriz", "revision", "trazabilidad"]

#: (condition, priority) over a sheet's rows: the first one that holds; `brechas` is an array there.
PRIORITIES = [
    ("nivel_cumplimiento = 'omision' AND criticidad >= 2", "crítica"), ("nivel_cumplimiento = 'omision'", "alta"),
    ("nivel_cumplimiento = 'parcial' AND size(brechas) > 0", "media"), ("nivel_cumplimiento IN ('cumple', 'parcial')", "baja"),
]
#: Of each sheet the columns in order, with their labels.
TEMPLATE = {
    "resumen": {"concepto": "Concepto", "valor": "Valor"},
    "via_manual": {
        "chunk_id": "Sección", "jerarquia": "Jerarquía", "articulos": "Artículos aplicables", "nivel_cumplimiento": "Nivel", "analisis_general": "Análisis", "brechas": "Brechas",
        "prioridad": "Prioridad", "color": "Color",
    },
    "via_normativa": {"doc_id": "Norma", "numero": "Artículo", "encabezado": "Epígrafe", "nivel_adopcion": "Adopción", "secciones": "Secciones", "prioridad": "Prioridad"},
    "matriz": {"element_id": "Artículo", "chunk_id": "Sección", "score": "Puntaje", "origenes": "Origen"},
    "revision": {"chunk_id": "Sección", "jerarquia": "Jerarquía", "motivos": "Motivos"},
    "trazabilidad": {"clave": "Clave", "valor": "Valor"},
}


def priority(rules: list[tuple[str, str]] = PRIORITIES, otherwise: str = "ninguna"):
    """The priority of a row as a column: what the first rule says that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(rules):
        out = F.when(F.expr(condition), name).otherwise(out)
    return out


def papers(compared: DataFrame, articles: DataFrame, links: DataFrame, trace: dict[str, str], rules: list[tuple[str, str]] = PRIORITIES, critical: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables of a run.

    `compared` is what `run.compare_all` returns, `articles` has (doc_id, element_id, numero, encabezado,
    es_referencia), `links` (element_id, chunk_id, score, origen), and `trace` what makes the run reproducible: models,
    thresholds, hashes. `critical` (element_id, criticidad) raises a section's priority by its most critical article.
    """
    spark = compared.sparkSession
    edges = compare.coverage_links(links)
    weight = spark.createDataFrame([], "chunk_id long, criticidad int") if critical is None else edges.join(critical, "element_id").groupBy("chunk_id").agg(F.max("criticidad").alias("criticidad"))
    weighed = compared.join(weight, "chunk_id", "left").withColumn("criticidad", F.coalesce("criticidad", F.lit(0)))
    fill = F.create_map(*[F.lit(x) for pair in FILLS.items() for x in pair])
    used = F.array_distinct(F.concat("articulos_lexicos", F.transform(F.filter("articulos_validados", lambda a: a.relevante), lambda a: a.numero)))
    manual = weighed.withColumns({"articulos": used, "prioridad": priority(rules), "color": F.coalesce(F.try_element_at(fill, "nivel_cumplimiento"), F.lit(""))})
    adopted = compare.adoption(articles, edges).withColumn("nivel_cumplimiento", F.when(F.col("nivel_adopcion") == "no_cubierto", "omision").when(F.col("nivel_adopcion") == "parcial", "parcial").when(F.col("nivel_adopcion") == "cubierto", "cumple"))
    heavy = F.lit(0) if critical is None else F.coalesce("criticidad", F.lit(0))
    adopted = adopted if critical is None else adopted.join(critical, "element_id", "left")
    adopted = adopted.withColumns({"criticidad": heavy, "brechas": F.when(F.col("nivel_adopcion") == "parcial", F.array(F.lit("parcial"))).otherwise(F.array().cast("array<string>"))})
    norms = adopted.withColumn("prioridad", priority(rules)).join(articles.select("element_id", "doc_id", "numero", "encabezado"), "element_id")
    best = F.array_max(F.transform("articulos_semanticos_raw", lambda a: a.sim))
    graded = F.when(F.size("articulos_validados") > 0, F.exists("articulos_validados", lambda a: a.relevante))
    reasons = compare.review_reasons(best, graded, F.size("articulos_lexicos"), F.col("nivel_cumplimiento"), F.size("brechas"))
    failed = F.when(F.col("estado_analisis") != "analizado", F.concat(F.lit("analisis_"), F.col("estado_analisis")))
    review = compared.withColumn("motivos", F.array_compact(F.concat(reasons, F.array(failed)))).where(F.size("motivos") > 0)
    levels = compare.level_counts(compared).select(F.concat(F.lit("nivel "), F.col("nivel")).alias("concepto"), F.col("cantidad").cast("string").alias("valor"), "orden")
    cover = compare.coverage(articles.where("NOT es_referencia"), edges)
    shown = F.explode(F.array(*[F.struct(F.lit(c).alias("concepto"), F.col(c).cast("string").alias("valor"), F.lit(10 + i).alias("orden")) for i, c in enumerate(cover.columns)]))
    summary = levels.unionByName(cover.select(shown.alias("x")).select("x.*")).orderBy("orden")
    facts = spark.createDataFrame(sorted(trace.items()), "clave string, valor string")
    return dict(zip(SHEETS, [summary, manual, norms, edges, review, facts], strict=True))


def write_papers(tables: dict[str, DataFrame], path: str, template: dict[str, dict[str, str]] = TEMPLATE) -> str:
    """Write the sheets of a run as CSV with labels for headings, then their manifest; returns the run's name."""
    spark, run = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    shown = {name: compare.flatten(tables[name].select(*[F.col(f"`{c}`") for c in columns])) for name, columns in template.items()}
    rows = []
    for i, (name, sheet) in enumerate(shown.items()):
        clean = sheet.select(*[F.substring(strip_control(F.col(f"`{c}`")), 1, 32767).alias(label) for c, label in template[name].items()])
        folder = f"{path}/corridas/{run}/{i}_{name}"
        clean.write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(folder)
        kept = spark.read.schema(clean.schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(folder)
        widths = {r.columna: r.ancho for r in compare.column_widths(kept).collect()}  # a row for each column
        rows.append((run, None, name, i, kept.count(), [(c, label, widths[label]) for c, label in template[name].items()]))
    manifest = spark.createDataFrame(rows, MANIFEST).withColumn("creado", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifiesto")
    return run


def read_papers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of the newest finished run, with the names of their columns, all as text."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifiesto")
    newest = manifest.orderBy(F.desc("creado"), "corrida").first().corrida
    out = {}
    for r in sorted(manifest.where(F.col("corrida") == newest).collect(), key=lambda r: r.orden):  # a row for each sheet
        kind = ", ".join(f"`{c.columna}` string" for c in r.columnas)
        sheet = spark.read.schema(kind).option("header", "true").option("enforceSchema", "true").option("escape", '"').option("multiLine", "true")
        out[r.hoja] = sheet.csv(f"{path}/corridas/{newest}/{r.orden}_{r.hoja}").fillna("")
    return out
