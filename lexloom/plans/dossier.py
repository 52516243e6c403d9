"""Registered queries, second part: the second style of parsing, graders and analysts, the articles' side, filters.

Like `catalog`, each query has a SQL twin that is written apart from it and runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions import text as X
from lexloom.operators import compare, extract, judge, search
from lexloom.plans import views
from lexloom.plans.catalog import _CHUNKS, _LEXICAL, _SCORES, query
from lexloom.plans.views import strip_sql, structure
from lexloom.session import table

# Second style of parsing --------------------------------------------------------------------------------------------

_HEAD = "CASE doc_id % 5 WHEN 0 THEN 'RESOLUCIÓN No.' WHEN 1 THEN 'Proyecto de Ley' WHEN 2 THEN 'LEY ORGÁNICA' WHEN 3 THEN 'Código y ley' ELSE 'Norma' END"
_MONTH = "CASE doc_id % 3 WHEN 0 THEN ' de Marzo de ' WHEN 1 THEN ' de diciembre de ' ELSE ' de marzal de ' END"
_MARK = "CASE doc_id % 2 WHEN 0 THEN chr(10) || chr(10) || 'CONSIDERANDO: ' ELSE chr(10) || 'CERTIFICA : ' END"
_VARIED = f"replace(replace(CASE WHEN md LIKE 'LEY ORGÁNICA%' THEN {_HEAD} || substring(md, 13) ELSE md END, ' de marzo de ', {_MONTH}), 'RESUELVE: ', {_MARK})"


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulations whose kinds, dates and marks differ."""
    return views.norm_md(spark, sf_dir).select("doc_id", F.expr(_VARIED).alias("md"))


_COLLAPSE = "regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_TITLE = strip_sql(f"regexp_replace({strip_sql(f"regexp_extract(match, '(?m){P.VARIANT_HEADING}', 3)")}, '{P.VARIANT_TITLE_END}', '')")
_STYLE = f"""WITH {views.MD_SQL.replace("md AS (", "md0 AS (", 1)}, md AS (SELECT doc_id, {_VARIED} AS md FROM md0),
{views.parts_sql("v0", P.VARIANT_ARTICLE)}, {views.parts_sql("h0", P.VARIANT_HEADING, "(?m)")}, {views.parts_sql("p0", P.PROVISION)}, {views.parts_sql("x0", P.ANNEX)},
{views.parts_sql("r0", P.VARIANT_RESOLUTION, "(?m)")},
marks AS (SELECT doc_id, posicion, concat_ws(' ', upper(regexp_extract(match, '(?m){P.VARIANT_HEADING}', 1)), regexp_extract(match, '(?m){P.VARIANT_HEADING}', 2), nullif(substring({_TITLE}, 1, 80), '')) AS label FROM h0
  UNION ALL SELECT doc_id, posicion, upper(regexp_extract(match, '(?im){P.PROVISION}', 1)) FROM p0
  UNION ALL SELECT doc_id, posicion, upper(regexp_extract(match, '(?m){P.VARIANT_RESOLUTION}', 1)) FROM r0)
"""


def _body(longest: int, most: int) -> str:
    tail = f"CASE WHEN seq = max(seq) OVER (PARTITION BY doc_id) THEN substring(tail, 1, {longest}) ELSE tail END"
    return f"md5(substring({_COLLAPSE.format(strip_sql(tail))}, 1, {most}))"


@query(
    f"""{_STYLE}, arts AS (SELECT doc_id, CAST(seq AS INTEGER) AS seq, posicion, regexp_extract(match, '(?im){P.VARIANT_ARTICLE}', 1) AS numero,
nullif({strip_sql(f"regexp_extract(match, '(?im){P.VARIANT_ARTICLE}', 2)")}, '') AS encabezado, {_body(4000, 3500)} AS contenido_md5 FROM v0)
SELECT a.doc_id, seq, a.posicion, numero, encabezado, contenido_md5, coalesce(label, '') AS seccion FROM arts a ASOF LEFT JOIN marks m ON a.doc_id = m.doc_id AND a.posicion >= m.posicion"""
)
def variant_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in the second style."""
    rows = extract.variant_articles(_varied(spark, sf_dir))
    return rows.select("doc_id", "seq", "posicion", "numero", "encabezado", F.md5("contenido").alias("contenido_md5"), "seccion")


@query(
    f"""{_STYLE} SELECT doc_id, CAST(seq AS INTEGER) AS seq, upper(regexp_extract(match, '(?im){P.ANNEX}', 1)) AS identificador,
{strip_sql(f"regexp_extract(match, '(?im){P.ANNEX}', 2)")} AS titulo, {_body(6000, 6000)} AS contenido_md5 FROM x0"""
)
def variant_annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annexes with their contents, in the second style."""
    rows = extract.variant_annexes(_varied(spark, sf_dir))
    return rows.select("doc_id", "seq", "identificador", "titulo", F.md5("contenido").alias("contenido_md5"))


_COUNTED = "coalesce((SELECT n FROM (SELECT doc_id, count(*) AS n FROM {0} GROUP BY doc_id) c WHERE c.doc_id = l.doc_id), 0)"


@query(
    f"""{_STYLE}, l AS (SELECT doc_id, md, list_transform(string_split(md, chr(10)), lambda x: {strip_sql("x")}) AS ls FROM md)
SELECT doc_id, substring(coalesce(list_filter(ls[1:30], lambda x: length(x) > 15 AND regexp_matches(upper(x), '{"|".join(P.VARIANT_TITLE_WORDS)}'))[1], list_filter(ls, lambda x: x <> '')[1], '{P.NO_TITLE}'), 1, 300) AS titulo,
CASE WHEN contains(upper(substring(md, 1, 800)), 'RESOLUCIÓN') THEN 'RESOLUCIÓN' WHEN contains(upper(substring(md, 1, 800)), 'PROYECTO DE LEY') THEN 'PROYECTO DE LEY'
  WHEN contains(upper(substring(md, 1, 800)), 'LEY ORGÁNICA') THEN 'LEY ORGÁNICA' WHEN contains(upper(substring(md, 1, 800)), 'LEY') THEN 'LEY' ELSE 'NORMATIVA' END AS tipo_norma,
lower(regexp_replace(regexp_extract(substring(md, 1, 3000), '(?i)\\b{P.MONTH_DATE}\\b', 0), '\\s+', ' ', 'g')) AS fecha,
{_COUNTED.format("v0")} AS n_articulos, {_COUNTED.format("marks")} AS n_secciones, {_COUNTED.format("x0")} AS n_anexos FROM l"""
)
def variant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, kind, textual date and counts of each regulation, in the second style."""
    return extract.variant_documents(_varied(spark, sf_dir))


_DIRTY = "coalesce(text, '') || chr(10) || '17' || chr(10) || ' 3 / 9 ' || chr(10) || 'a.b@c.org' || chr(10) || 'x' || chr(9) || '  y'"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS nr, unnest(ls) AS line FROM (SELECT doc_id, string_split({_DIRTY}, chr(10)) AS ls FROM documents)),
k AS (SELECT *, lower(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS key FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k),
j AS (SELECT doc_id, list(replace(line, chr(9), ' ') ORDER BY nr) AS ls FROM n WHERE key = '' OR n < 3 OR length(key) > 90 GROUP BY doc_id)
SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '{P.ARTIFACT_LINE}')), chr(10)), '[ ]{{2,}}', ' ', 'g')) AS md5 FROM j"""
)
def cleaning_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with artifacts behind it, through the whole chain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DIRTY).alias("md"))
    return X.cleaning_chain(docs).select("doc_id", F.md5("md").alias("md5"))


_WINDOWS = "greatest(1, CAST(ceil((len(ws) - 32) / 96.0) AS BIGINT))"


@query(
    rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n]+'), lambda w: w <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range({_WINDOWS})) AS v FROM d WHERE len(ws) > 0)
SELECT doc_id, CAST(v AS INTEGER) AS ventana, md5(array_to_string(ws[v * 96 + 1 : v * 96 + 128], ' ')) AS texto_md5 FROM c"""
)
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 words, 32 of them from the window before."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n]+", -1), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).where("size(ws) > 0")
    return extract.overlapping(rows, "ws").select("doc_id", "ventana", F.md5("texto").alias("texto_md5"))


# Citations and the articles' side -----------------------------------------------------------------------------------

_SCOPED = "scoped AS (SELECT DISTINCT c.chunk_id, n.element_id, n.numero, n.orden FROM cited c JOIN named n ON n.doc_id = c.chunk_id + 1 AND n.numero = c.numero)"


def _with(sql: str, *more: str) -> str:
    """`sql` behind the structure's expressions and `more`."""
    return structure("").rstrip() + "".join(f",\n{m}" for m in more) + "\n" + sql


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each section with the norm of the next id."""
    arts = extract.normativa(views.norm_md(spark, sf_dir)).where("tipo_elemento = 'articulo'")
    secs = views.sections(spark, sf_dir)
    scope = secs.select("chunk_id", (F.col("chunk_id") + 1).alias("norm_id"))
    return compare.lexical_join(secs, arts, scope), arts


@query(_with("SELECT chunk_id, element_id, numero, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY orden, element_id) AS INTEGER) AS rank FROM scoped", _LEXICAL, _SCOPED))
def lexical_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the articles of another document, the one in the section's scope."""
    return _scoped(spark, sf_dir)[0].select("chunk_id", "element_id", "numero", "rank")


@query(
    _with(
        """SELECT c.chunk_id, numero, normas, articulos FROM (SELECT DISTINCT chunk_id, numero FROM cited) c
JOIN (SELECT numero, count(DISTINCT doc_id) AS normas, count(*) AS articulos FROM articles GROUP BY numero) USING (numero)""",
        _LEXICAL,
    )
)
def lexical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations against the articles of all norms, counted by number instead of listed in pairs."""
    return compare.lexical_matches(views.sections(spark, sf_dir), extract.articles(views.norm_md(spark, sf_dir)))


@query(
    _with(
        """SELECT element_id, coalesce(n, 0) AS secciones, mejor AS mejor_seccion,
CASE WHEN es_referencia THEN 'no_aplica' WHEN n IS NULL THEN 'no_cubierto' WHEN s >= 0.5 THEN 'cubierto' ELSE 'parcial' END AS nivel_adopcion
FROM (SELECT doc_id || '_' || lpad(CAST(orden AS VARCHAR), CAST(greatest(4, length(CAST(orden AS VARCHAR))) AS INTEGER), '0') AS element_id, es_referencia FROM placed WHERE tipo_elemento = 'articulo')
LEFT JOIN (SELECT element_id, count(*) AS n, max(chunk_id % 10 / 10.0) AS s, arg_max(chunk_id, chunk_id % 10 * 1000000 - chunk_id) AS mejor FROM scoped GROUP BY element_id) USING (element_id)""",
        _LEXICAL, _SCOPED,
    )
)
def article_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each article finds in the manual, by its citations."""
    found, arts = _scoped(spark, sf_dir)
    return compare.adoption(arts, found.select("element_id", "chunk_id", F.expr("chunk_id % 10 / 10D").alias("score")))


# Filters and counts -------------------------------------------------------------------------------------------------


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.flagged_articles(views.norm_md(spark, sf_dir))


@query(structure("SELECT doc_id, CAST(seq AS INTEGER) AS seq, numero, tipo_bloque FROM flagged WHERE NOT es_referencia AND tipo_bloque IN ('articulado', 'anexo')"))
def own_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.own_articles(_flagged(spark, sf_dir), ["articulado", "anexo"]).select("doc_id", "seq", "numero", "tipo_bloque")


@query(
    structure(
        """SELECT 'tipo_bloque' AS columna, tipo_bloque AS valor, count(*) AS n FROM flagged GROUP BY tipo_bloque
UNION ALL SELECT 'es_referencia', CAST(es_referencia AS VARCHAR), count(*) FROM flagged GROUP BY es_referencia UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR), count(*) FROM flagged GROUP BY doc_id"""
    )
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.value_counts(_flagged(spark, sf_dir), "tipo_bloque", "es_referencia", "doc_id")


@query(
    f"""WITH {views.MD_SQL}, {_CHUNKS} SELECT coalesce(nullif(string_split(heading_path, ' > ')[1], ''), '{P.NO_SECTION}') AS seccion, count(*) AS chunks FROM cut GROUP BY 1"""
)
def chunks_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by their section of the first level."""
    first = F.coalesce(F.nullif(F.split("heading_path", " > ")[0], F.lit("")), F.lit(P.NO_SECTION))
    return extract.heading_chunks(views.norm_md(spark, sf_dir)).groupBy(first.alias("seccion")).agg(F.count("*").alias("chunks"))


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS columna, CAST(least(greatest(coalesce(max(length(CAST({c} AS VARCHAR))), 0), {len(c)}) + 4, 70) AS INTEGER) AS ancho FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
)
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.column_widths(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query(
    f"""WITH {_SCORES}, f AS (SELECT query_id, element_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS rank FROM r WHERE rank <= 25 AND contains(lower(source), '1'))
SELECT query_id, element_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5"""
)
def semantic_source_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of 25 candidates whose source holds a text."""
    queries, corpus = views.vectors(spark, sf_dir)
    found = search.top_k(queries, corpus.select("element_id", "embedding"), P.TOP_K * P.OVERFETCH).join(corpus.select("element_id", "source"), "element_id")
    return search.filter_source_like(found, "1").select("query_id", "element_id", F.round("score", 4).alias("score"), "rank")


# Injected models ----------------------------------------------------------------------------------------------------

_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[ \\t\\n]+'), lambda w: w <> ''))"
_SHARE = f"len(list_intersect({_WORDS.format('s')}, {_WORDS.format('d')})) / greatest(1, len({_WORDS.format('d')}))"
_TEXTS = f"""{_SCORES}, n AS (SELECT query_id AS chunk_id, element_id, rank, coalesce(a.text, '') AS s, coalesce(b.text, '') AS d
FROM r LEFT JOIN documents a ON a.doc_id = query_id LEFT JOIN documents b ON b.doc_id = element_id WHERE rank <= 5)"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with the texts of their ids as articles, and the sections."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("element_id"), F.coalesce("text", F.lit("")).alias("contenido"))
    found = search.top_k(*views.vectors(spark, sf_dir)).select(F.col("query_id").alias("chunk_id"), "element_id", "score", "rank").join(docs, "element_id", "left")
    found = found.withColumns({"numero": F.col("element_id").cast("string"), "encabezado": F.lit(""), "contenido": F.coalesce("contenido", F.lit(""))})
    wanted = found.select("chunk_id").distinct()
    return found, wanted.join(docs.select(F.col("element_id").alias("chunk_id"), F.col("contenido").alias("texto")), "chunk_id", "left")


@query(
    f"""WITH {_TEXTS}, p AS (SELECT chunk_id, element_id, rank, s, 'Artículo ' || element_id || ': ' || chr(10) || substring(d, 1, 600) AS d FROM n),
o AS (SELECT chunk_id, element_id, {_SHARE} AS x, rank FROM p), b AS (SELECT chunk_id, element_id, x, row_number() OVER (PARTITION BY chunk_id ORDER BY x DESC, rank) AS rank FROM o)
SELECT chunk_id, element_id, round(x, 6) AS reranker_score, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 3"""
)
def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a scorer of pairs of texts."""
    found, secs = _near(spark, sf_dir)
    pairs = found.withColumn("document", judge.pair_text(F.col("numero"), F.col("encabezado"), F.col("contenido"))).join(secs.select("chunk_id", F.coalesce("texto", F.lit("")).alias("query")), "chunk_id")
    return judge.rerank_pairs(pairs, judge.shared_words).select("chunk_id", "element_id", F.round("reranker_score", 6).alias("reranker_score"), "rank")


_GRADED = f"""g AS (SELECT chunk_id, element_id, rank, ls, {_SHARE} AS x, d FROM (SELECT chunk_id, element_id, rank, length(s) AS ls, substring(s, 1, 1500) AS s, substring(d, 1, 600) AS d FROM n))"""


@query(f"WITH {_TEXTS}, {_GRADED} SELECT chunk_id, CAST(element_id AS VARCHAR) AS element_id, x >= 0.2 AS relevante, round(x, 6) AS score_grade, 'calificado' AS estado FROM g")
def grade_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a grader, one call for each section."""
    return judge.grade(*_near(spark, sf_dir)).select("chunk_id", "element_id", "relevante", F.round("score_grade", 6).alias("score_grade"), "estado")


@query(
    f"""WITH {_TEXTS}, {_GRADED}, c AS (SELECT chunk_id, list('[Top ' || i || '] Art.' || element_id || ': ' || chr(10) || d ORDER BY i) AS tops
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rank) AS i FROM g WHERE x >= 0.2) WHERE i <= 3 GROUP BY chunk_id),
k AS (SELECT chunk_id, CASE WHEN chunk_id % 60 = 0 THEN 'lexica' WHEN tops IS NOT NULL THEN 'semantica' ELSE 'ninguna' END AS tipo_coincidencia, ls,
  coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN chunk_id % 60 = 0 THEN '{P.CITED_TITLE}Artículo 7: ' || chr(10) || 'cita' END, CASE WHEN tops IS NOT NULL THEN '{P.NEAR_TITLE}' || array_to_string(tops, chr(10) || chr(10)) END), ''), '{P.NO_REFERENCES}') AS refs
  FROM (SELECT DISTINCT chunk_id, ls FROM g) LEFT JOIN c USING (chunk_id))
SELECT chunk_id, tipo_coincidencia, CASE tipo_coincidencia WHEN 'lexica' THEN 'cumple' WHEN 'semantica' THEN 'parcial' ELSE 'omision' END AS nivel_cumplimiento,
CASE tipo_coincidencia WHEN 'lexica' THEN '' WHEN 'semantica' THEN 'parcial: ' || length(refs) || ' / ' || least(ls, 2000) ELSE 'omision: ' || length(refs) || ' / ' || least(ls, 2000) END AS brechas, 'analizado' AS estado_analisis FROM k"""
)
def analyse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match type and verdict of each section by an analyst; every third section of the query set has a citation."""
    found, secs = _near(spark, sf_dir)
    graded = judge.grade(found, secs).where("relevante").select("chunk_id", "element_id")
    kept = found.withColumn("element_id", F.col("element_id").cast("string")).join(graded, ["chunk_id", "element_id"])
    each = F.array_sort(F.collect_list(F.struct("rank", "numero", "encabezado", "contenido")))
    told = secs.join(kept.groupBy("chunk_id").agg(each.alias("relevantes")), "chunk_id", "left")
    cite = F.when(F.col("chunk_id") % 60 == 0, F.array(F.struct(F.lit("7").alias("numero"), F.lit("").alias("encabezado"), F.lit("cita").alias("contenido"))))
    out = judge.analyse(told.withColumn("lexicos", cite))
    return out.select("chunk_id", "tipo_coincidencia", "nivel_cumplimiento", F.array_join("brechas", ",").alias("brechas"), "estado_analisis")
