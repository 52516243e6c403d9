"""Comparison of sections with articles: citations, grades, match types, summaries, coverage, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import patterns as P


def cited(text: Column) -> Column:
    """The distinct article numbers that a text cites, as an array."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + P.CITATION), F.lit(1)))


def cited_numbers(sections: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, numero): the distinct article numbers that each section cites."""
    return sections.select("chunk_id", "doc_id", F.explode(cited(F.col("texto"))).alias("numero"))


def lexical_join(sections: DataFrame, articles: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(chunk_id, element_id, numero, match_type, similarity, rank): articles of the norms in scope whose number the
    section cites. `scope` has (chunk_id, norm_id), the documents whose articles a section is compared with; without
    it, that is the section's own document. For all norms at once see `lexical_matches`."""
    numbers = cited_numbers(sections)
    if scope is not None:
        numbers = numbers.drop("doc_id").join(scope.select("chunk_id", F.col("norm_id").alias("doc_id")).distinct(), "chunk_id")
    found = numbers.join(articles.select("doc_id", "numero", "element_id", "orden"), ["doc_id", "numero"])
    order = ["orden", "element_id"] if scope is None else ["doc_id", "orden", "element_id"]
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy(*order))
    return found.select("chunk_id", "element_id", "numero", F.lit("exacto").alias("match_type"), F.lit(1.0).alias("similarity"), rank.alias("rank"))


def norm_numbers(articles: DataFrame) -> DataFrame:
    """(norm_id, numero, articulos, element_ids): a row for each number of a norm, its articles in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("orden", "element_id"))), lambda x: x.element_id)
    return articles.groupBy(F.col("doc_id").alias("norm_id"), "numero").agg(F.count("*").alias("articulos"), ordered.alias("element_ids"))


def lexical_matches(sections: DataFrame, articles: DataFrame) -> DataFrame:
    """(chunk_id, numero, normas, articulos): cited numbers that articles of any norm have, and how many have them.

    The result is factored: sections join one row per number, counted before, so a hot number costs a row for each
    section that cites it. Its pairs are those of this table with `norm_numbers` by number.
    """
    per_norm = articles.groupBy("doc_id", "numero").agg(F.count("*").alias("n"))
    counts = per_norm.groupBy("numero").agg(F.count("*").alias("normas"), F.sum("n").alias("articulos"))
    return cited_numbers(sections).drop("doc_id").join(counts, "numero").select("chunk_id", "numero", "normas", "articulos")


def cited_articles(sections: DataFrame, articles: DataFrame) -> DataFrame:
    """The articles of any norm whose number some section cites (the links of `coverage` across documents)."""
    return articles.join(cited_numbers(sections).select("numero").distinct(), "numero", "left_semi")


def merge_grades(candidates: DataFrame, grades: DataFrame) -> DataFrame:
    """Left join of grades (the last of several wins); candidates without one count as relevant."""
    last = grades.groupBy("chunk_id", "element_id").agg(F.max_by(F.struct("relevante", "score_grade", "razon_grade"), "pos").alias("g"))
    both = candidates.join(last, ["chunk_id", "element_id"], "left")
    return both.select(
        candidates["*"], F.coalesce("g.relevante", F.lit(True)).alias("relevante"),
        F.coalesce("g.score_grade", F.lit(P.MISSING_SCORE)).alias("score_grade"), F.coalesce("g.razon_grade", F.lit("")).alias("razon_grade"),
    )


def match_type(n_lexical: Column, n_relevant: Column) -> Column:
    return F.when(n_lexical > 0, "lexica").when(n_relevant > 0, "semantica").otherwise("ninguna")


def stand_in_verdict(n_lexical: Column, n_relevant: Column, grade: Column) -> Column:
    """The level of compliance by a deterministic stand-in for the analysis: nothing matches is an omission; else the
    best grade of the relevant candidates decides, and a citation alone is partial."""
    nothing = (n_lexical <= 0) & (n_relevant <= 0)
    return F.when(nothing, "omision").when((n_relevant > 0) & (grade >= P.MISSING_SCORE), "cumple").otherwise("parcial")


def compliance_summary(rows: DataFrame) -> DataFrame:
    """Counts and shares by level; null levels count in the total only."""
    total = F.sum("n").over(W.partitionBy())  # over at most a row for each level
    counts = rows.groupBy("nivel_cumplimiento").agg(F.count("*").alias("n"))
    shares = counts.withColumn("porcentaje", F.round(F.col("n") * 100.0 / total, 1))
    return shares.where("nivel_cumplimiento IS NOT NULL").select("nivel_cumplimiento", F.col("n").alias("cantidad"), "porcentaje")


def level_counts(rows: DataFrame) -> DataFrame:
    """A row for each level, zero where none."""
    levels = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(P.LEVELS)], "orden int, nivel string")
    counts = rows.groupBy(F.col("nivel_cumplimiento").alias("nivel")).agg(F.count("*").alias("cantidad"))
    return levels.join(counts, "nivel", "left").select("orden", "nivel", F.coalesce("cantidad", F.lit(0)).alias("cantidad"))


def coverage_links(links: DataFrame) -> DataFrame:
    """N:N edges: the best score of each (article, section) and all origins."""
    return links.groupBy("element_id", "chunk_id").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("origen")), ",").alias("origenes"))


def coverage(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Covered and uncovered articles and the share in percent."""
    linked = links.select("element_id").distinct().withColumn("hit", F.lit(1))
    both = articles.select("element_id").join(linked, "element_id", "left")
    counts = both.agg(F.count("*").alias("articulos"), F.coalesce(F.sum("hit"), F.lit(0)).alias("cubiertos"))
    share = F.round(F.col("cubiertos") * 100.0 / F.greatest(F.lit(1), F.col("articulos")), 1)
    return counts.select("articulos", "cubiertos", (F.col("articulos") - F.col("cubiertos")).alias("sin_cobertura"), share.alias("porcentaje"))


def adoption(articles: DataFrame, links: DataFrame, enough: float = 0.5) -> DataFrame:
    """(element_id, secciones, mejor_seccion, nivel_adopcion): the comparison from the articles' side.

    The best of the links (element_id, chunk_id, score) decides; citations of other norms need no section. Of equal
    scores the smallest section is named.
    """
    best = F.max_by("chunk_id", F.struct("score", -F.col("chunk_id")))
    per = links.groupBy("element_id").agg(F.count("*").alias("secciones"), F.max("score").alias("score"), best.alias("mejor_seccion"))
    level = F.when(F.col("es_referencia"), "no_aplica").when(F.col("secciones").isNull(), "no_cubierto").when(F.col("score") >= enough, "cubierto").otherwise("parcial")
    both = articles.select("element_id", "es_referencia").join(per, "element_id", "left")
    return both.select("element_id", F.coalesce("secciones", F.lit(0)).alias("secciones"), "mejor_seccion", level.alias("nivel_adopcion"))


def own_articles(articles: DataFrame, blocks: list[str] | None = None) -> DataFrame:
    """Articles that are no citations of other norms, of the named blocks only where some are named."""
    own = articles.where(~F.coalesce("es_referencia", F.lit(False)))
    return own if blocks is None else own.where(F.col("tipo_bloque").isin(blocks))


def own_sections(sections: DataFrame, under: list[str] | None = None, ids: list | None = None, path: str = "jerarquia") -> DataFrame:
    """Sections that stand under one of the named headings (whole steps of a path "A > B"), and of the named ids only;
    None leaves all, an empty list none."""
    out = sections
    if under is not None:
        here = F.concat(F.coalesce(path, F.lit("")), F.lit(" > "))
        out = out.where(F.exists(F.array(*map(F.lit, under)).cast("array<string>"), lambda h: F.startswith(here, F.concat(h, F.lit(" > ")))))
    return out if ids is None else out.where(F.col("chunk_id").isin(ids))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(columna, valor, n): how often each value of each column stands; null values are not counted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in columns]))
    each = rows.select(pairs.alias("x")).select("x.*").where("valor IS NOT NULL")
    return each.groupBy("columna", "valor").agg(F.count("*").alias("n"))


def column_widths(rows: DataFrame, most: int = 70) -> DataFrame:
    """(columna, ancho): the longest text of each column, its name included, and four more, at most `most`."""
    longest = rows.agg(*[F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).alias(f"w{i}") for i, c in enumerate(rows.columns)])
    width = lambda i, c: F.least(F.greatest(F.coalesce(f"w{i}", F.lit(0)), F.lit(len(c))) + 4, F.lit(most))
    return longest.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), width(i, c).alias("ancho")) for i, c in enumerate(rows.columns)])).alias("x")).select("x.*")


def review_reasons(score: Column, relevant: Column, n_lexical: Column, level: Column, n_gaps: Column, least: float = P.MIN_SCORE, delta: float = 0.05) -> Column:
    """Why a section should be reviewed by hand, in a fixed order."""
    near = F.when((score >= least - delta) & (score <= least + delta), "umbral")
    ungraded = F.when(relevant.isNull(), "sin_calificar")
    conflict = F.when((n_lexical > 0) & ~F.coalesce(relevant, F.lit(True)), "conflicto")
    orphan = F.when((n_lexical == 0) & (F.coalesce(score, F.lit(0.0)) < least), "huerfana")
    partial = F.when((level == "parcial") & (n_gaps > 0), "parcial_con_brechas")
    return F.array_compact(F.array(near, ungraded, conflict, orphan, partial))


def flatten(rows: DataFrame) -> DataFrame:
    """Lists to '; '-joined strings, everything else to strings, null to ''."""
    def flat(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array<struct"):
            return F.coalesce(F.to_json(c), F.lit(""))
        if kind.startswith("array"):
            return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), "; "), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(""))

    return rows.select([flat(n, k).alias(n) for n, k in rows.dtypes])


def sample_sections(rows: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """A seeded sample without replacement: the n smallest hashes (a sampling operator; `n` is its feature)."""
    return rows.orderBy(F.md5(F.concat(F.col("chunk_id").cast("string"), F.lit(str(seed)))), "chunk_id").limit(n)


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Recall@k, reciprocal rank and nDCG@k of each query, by binary relevance."""
    hits = gold.join(ranked.where(F.col("rank") <= k), ["query_id", "element_id"], "left")
    gain = F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return per.select(
        "query_id", F.round(F.col("found") / F.col("n"), 4).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.round(F.col("dcg") / ideal, 4).alias("ndcg"),
    )
