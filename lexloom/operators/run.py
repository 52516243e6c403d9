"""The whole comparison of sections with the articles in their scope, around injected models, as one plan.

For each section: the cited articles, the k nearest by the encoder, the n best of these by the scorer, their grades, and
an analyst's verdict. A model that raises costs its own section only: a failed grader leaves its candidates relevant, a
failed or unreadable analyst leaves the level `no_aplica` and the error's text, and a failed scorer leaves the section an
empty result; `estado_analisis` tells which. All input columns stay, and rows come in the order that is asked for.

Edge cases: a section that cites nothing and is near to nothing is analysed as "ninguna"; one without a scope too; null
texts are empty; missing columns fall back (texto to contenido, embed_text to texto, jerarquia to seccion), a column
that is there but null doesn't; chunk_id and element_id must be unique; input columns with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions import vectors as V
from lexloom.operators import answers, compare, judge

#: Characters of an article that any of the models' texts holds at most.
MOST = 800
_RAW, _GRADED = "array<struct<numero:string,sim:double>>", "array<struct<numero:string,relevante:boolean,score:double>>"
EMPTY_TEXT = "Error en procesamiento"


def hashed(text: Column) -> Column:
    """The offline encoder: hashed words."""
    return V.hash_embedding(text)


@dataclass(frozen=True)
class Models:
    """What a run calls; without a scorer the first candidates stay as they are."""

    encode: Callable[[Column], Column] = hashed
    scorer: Callable[[list[tuple[str, str]]], list[float]] | None = judge.shared_words
    grader: Callable[[str, list[dict]], list[dict]] = judge.overlap_grader
    analyst: Callable[[str, str, str, str], str] = answers.level_answer
    #: Put before what is encoded: kinds of models want one for each kind of text.
    query_prefix: str = ""
    passage_prefix: str = ""


@dataclass(frozen=True)
class Settings:
    """How many candidates are fetched and kept, and the least similarity."""

    k: int = P.TOP_K
    n: int = P.TOP_N
    least: float = P.MIN_SCORE


def fallback(rows: DataFrame, *names: str, within: str = "") -> Column:
    """The first of the columns that is there, null as ''; `within` is the struct that holds the columns by now."""
    found = [n for n in names if n in rows.columns]
    return F.coalesce(F.col(f"{within}`{found[0]}`").cast("string"), F.lit("")) if found else F.lit("")


def _norms(articles: DataFrame, models: Models) -> DataFrame:
    """(doc_id, arts): the articles of each norm with their vectors, and as much of their texts as any model reads."""
    vector = models.encode(judge.prefixed(fallback(articles, "embed_text", "contenido"), models.passage_prefix))
    rows = articles.select("doc_id", "element_id", F.col("numero").cast("string").alias("numero"), "encabezado", F.substring("contenido", 1, MOST).alias("contenido"), "orden", vector.alias("v"))
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*rows.columns[1:])).alias("arts"))


def candidates(texts: DataFrame, articles: DataFrame, scope: DataFrame, models: Models, settings: Settings) -> DataFrame:
    """(chunk_id, near, cites): the k best articles of the norms in scope, from the threshold on, and the cited ones.

    A pair of a section and a norm is one row, of which only the norm's best and cited articles go on; of a norm's cited
    articles the first three have their texts.
    """
    asked = texts.select("chunk_id", models.encode(judge.prefixed(F.col("embed"), models.query_prefix)).alias("q"), compare.cited(F.col("texto")).alias("cited"))
    within = scope.select("chunk_id", F.col("norm_id").alias("doc_id")).repartition("chunk_id").distinct()
    pairs = within.join(asked, "chunk_id").join(_norms(articles, models), "doc_id")
    text = lambda a: (a.numero.alias("numero"), a.encabezado.alias("encabezado"), a.contenido.alias("contenido"))
    score = lambda a: V.rounded(V.dot(F.col("q"), a.v), 9)
    near = F.filter(F.transform("arts", lambda a: F.struct((-score(a)).alias("less"), a.element_id.alias("element_id"), *text(a))), lambda a: a.less <= -settings.least)
    mine = F.filter("arts", lambda a: F.array_contains("cited", a.numero))
    cites = F.sort_array(F.transform(mine, lambda a: F.struct(F.col("doc_id").alias("doc_id"), a.orden.alias("orden"), a.element_id.alias("element_id"), *text(a))))
    named = ("doc_id", "orden", "element_id", "numero")
    cites = F.transform(cites, lambda a, i: F.struct(*[a[c].alias(c) for c in named], *[F.when(i < 3, a[c]).alias(c) for c in ("encabezado", "contenido")]))
    found = pairs.select("chunk_id", F.slice(F.sort_array(near), 1, settings.k).alias("near"), cites.alias("cites"))
    both = found.groupBy("chunk_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("near", "cites")])
    return both.select("chunk_id", F.slice(F.sort_array("near"), 1, settings.k).alias("near"), F.sort_array("cites").alias("cites"))


def compare_all(sections: DataFrame, articles: DataFrame, scope: DataFrame, models: Models = Models(), settings: Settings = Settings(), order: list[str] | None = None) -> DataFrame:
    """All columns of `sections` (chunk_id, texto, ...) with the result of the comparison.

    `articles` has (doc_id, element_id, numero, encabezado, contenido, orden) and `scope` (chunk_id, norm_id), the norms
    that a section is compared with. Articles are read once, sections twice. Rows come by chunk_id unless `order` says
    otherwise; an empty list leaves them as they are, without the sort, which would run the models twice.
    """
    texts = sections.select("chunk_id", fallback(sections, "texto", "contenido").alias("texto"), fallback(sections, "embed_text", "texto", "contenido").alias("embed"))
    row = F.struct(*[F.col(f"`{c}`") for c in sections.columns]).alias("_row")
    # the texts move once, to the candidates of their sections; from here on all is within the section's row
    out = sections.select("chunk_id", row).join(candidates(texts, articles, scope, models, settings), "chunk_id", "left")
    own = lambda *names: fallback(sections, *names, within="_row.")
    out = out.withColumns({"texto": own("texto", "contenido"), "jerarquia": own("jerarquia", "seccion"), **{c: F.coalesce(c, F.array()) for c in ("near", "cites")}})
    best = lambda x, i, *more: F.struct(*more, i.alias("rank"), *[x[c].alias(c) for c in ("element_id", "numero", "encabezado", "contenido")], (-x.less).alias("score"))
    if models.scorer:
        documents = F.transform("near", lambda x: judge.pair_text(x.numero, x.encabezado, x.contenido))
        out = out.withColumn("_scores", judge.pair_scores(models.scorer)(own("embed_text", "texto", "contenido"), documents))
        score = lambda i: F.get("_scores", i)
        ranked = F.sort_array(F.transform("near", lambda x, i: best(x, i, score(i).isNull().alias("failed"), (-score(i)).alias("by"))))
    else:
        ranked = F.transform("near", lambda x, i: best(x, i, F.lit(False).alias("failed")))
    out = out.withColumn("best", F.slice(ranked, 1, settings.n))
    asked = F.transform("best", lambda x, i: F.struct((i + 1).alias("rank"), x.element_id.cast("string").alias("element_id"), x.numero.alias("numero"), x.encabezado.alias("encabezado"), F.substring(x.contenido, 1, 600).alias("contenido"), x.score.alias("score")))
    out = out.withColumn("_grades", judge.section_grades(models.grader)(F.substring("texto", 1, 1500), asked))
    text = lambda x: (x.numero.alias("numero"), x.encabezado.alias("encabezado"), x.contenido.alias("contenido"))
    graded = F.transform("best", lambda x, i: F.struct(*text(x), F.get("_grades", i)["relevante"].alias("relevante"), F.get("_grades", i)["score_grade"].alias("score")))
    out = out.withColumns({"failed": F.exists("best", lambda x: x.failed), "graded": graded})
    out = out.withColumns({
        "articulos_lexicos": F.transform("cites", lambda x: x.numero), "lexicos": F.transform(F.slice("cites", 1, 3), lambda x: F.struct(*text(x))),
        "articulos_semanticos_raw": F.transform("near", lambda x: F.struct(x.numero.alias("numero"), V.rounded(-x.less, 4).alias("sim"))),
        "articulos_validados": F.transform("graded", lambda x: F.struct(x.numero.alias("numero"), x.relevante.alias("relevante"), x.score.alias("score"))),
        "relevantes": F.transform(F.filter("graded", lambda x: x.relevante), lambda x: F.struct(*text(x))),
    })
    outputs = [*answers.TEXTS, *answers.LISTS, "estado_analisis", "articulos_lexicos", "articulos_semanticos_raw", "articulos_validados"]
    taken = {o.lower() for o in outputs}
    out = out.withColumn("_kind", compare.match_type(F.size("lexicos"), F.size("relevantes")))
    asked = answers.ask(models.analyst)(F.substring("texto", 1, 2000), F.col("_kind"), F.col("jerarquia"), judge.reference_context(F.col("lexicos"), F.col("relevantes")))
    out = answers.parse_verdict(out.withColumn("_asked", asked).withColumn("_answer", F.col("_asked.respuesta")), "_answer")
    down = F.col("failed")
    good = (F.col("estado_analisis") == "analizado") & ~down
    error = F.concat(F.lit("Error en análisis: "), F.coalesce("_asked.error", "estado_analisis"))
    none = lambda c, kind: F.when(down, F.array().cast(kind)).otherwise(F.coalesce(c, F.array().cast(kind)))
    result = {c: F.when(good, F.col(c)) for c in answers.TEXTS}
    result["tipo_coincidencia"] = F.when(down, "ninguna").otherwise(F.col("_kind"))
    result["nivel_cumplimiento"] = F.when(good, F.col("nivel_cumplimiento")).otherwise("no_aplica")
    result["analisis_general"] = F.when(down, EMPTY_TEXT).when(good, F.col("analisis_general")).otherwise(error)
    result |= {c: none(F.col(c), "array<string>") for c in answers.LISTS}
    result["estado_analisis"] = F.when(down | F.col("_asked.error").isNotNull(), "error").otherwise(F.col("estado_analisis"))
    result["articulos_lexicos"] = none(F.col("articulos_lexicos"), "array<string>")
    result["articulos_semanticos_raw"] = none(F.col("articulos_semanticos_raw"), _RAW)
    result["articulos_validados"] = none(F.col("articulos_validados"), _GRADED)
    kept = [c for c in sections.columns if c.lower() not in taken]
    done = out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], *[result[c].alias(c) for c in outputs])
    order = ["chunk_id"] if order is None else order
    return done.orderBy(*order) if order else done
