"""Registered queries, third part: chunks with pages, cached grades, resumed runs, whole comparisons, models' answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.operators import answers, chunks, compare, extract
from lexloom.operators import run as whole
from lexloom.plans import views
from lexloom.plans.catalog import _EMBED, _LEXICAL, query
from lexloom.plans.dossier import _COLLAPSE, _GRADED, _SHARE, _STYLE, _TEXTS, _near, _varied, _with
from lexloom.plans.views import parts_sql, strip_sql
from lexloom.session import scratch, table
from lexloom.sources import corpus, papers, sinks
from lexloom.streaming import resume

# Chunks -------------------------------------------------------------------------------------------------------------

_PAGE = 1200


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a manual: every fourth line becomes a heading of one of six levels, blank lines between some."""

    def line(text, at):
        i = at + 1
        mark = F.repeat(F.lit("#"), (F.floor(i / 4) * 5 % 6 + 1).cast("int"))
        return F.concat(F.when(i % 4 == 2, F.concat(mark, F.lit(" Nivel "), i.cast("string"))).otherwise(text), F.when(i % 3 == 0, "\n").otherwise(""))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("md"))


_LEVELED = rf"""md AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i:
  CASE WHEN i % 4 = 2 THEN repeat('#', CAST((i // 4) * 5 % 6 + 1 AS INTEGER)) || ' Nivel ' || i ELSE l END || CASE WHEN i % 3 = 0 THEN chr(10) ELSE '' END), chr(10)) AS md FROM documents),
l0 AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS ls FROM md)),
l1 AS (SELECT *, length(regexp_extract(line, '{P.MARKDOWN_HEADING}', 1)) AS level, {strip_sql(f"regexp_extract(line, '{P.MARKDOWN_HEADING}', 2)")} AS title, {strip_sql("line")} = '' AS blank FROM l0),
l2 AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS start, count(*) FILTER (level > 0) OVER w AS section, count(*) FILTER (level > 0 OR blank) OVER w AS paragraph
  FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING)),
heads AS (SELECT doc_id, ln, level, title, section FROM l2 WHERE level > 0),
stacks AS (SELECT h.doc_id, h.section, list(g.title ORDER BY g.ln) AS headings FROM heads h JOIN heads g ON g.doc_id = h.doc_id AND g.ln <= h.ln
  WHERE g.title <> '' AND NOT EXISTS (SELECT 1 FROM heads x WHERE x.doc_id = h.doc_id AND x.ln > g.ln AND x.ln <= h.ln AND x.level <= g.level) GROUP BY ALL),
paras AS (SELECT doc_id, section, paragraph, min(start) AS start, max(start + length(line)) AS stop,
  flatten(list(list_filter(string_split_regex(line, '[ \t]+'), lambda w: w <> '') ORDER BY ln)) AS ws FROM l2 WHERE level = 0 AND NOT blank GROUP BY ALL),
cut AS (SELECT *, unnest(range((len(ws) - 1) // {P.MAX_TOKENS} + 1)) AS part FROM paras WHERE len(ws) > 0),
pieces AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.section, paragraph, part) AS k, coalesce(headings, []) AS headings, start, stop,
  ws[part * {P.MAX_TOKENS} + 1 : part * {P.MAX_TOKENS} + {P.MAX_TOKENS}] AS ws FROM cut c LEFT JOIN stacks s USING (doc_id, section)),
packed AS (SELECT doc_id, k, 0 AS chunk, len(ws) AS size, headings FROM pieces WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN p.headings = q.headings AND q.size + len(p.ws) <= {P.MAX_TOKENS} THEN q.chunk ELSE q.chunk + 1 END,
  CASE WHEN p.headings = q.headings AND q.size + len(p.ws) <= {P.MAX_TOKENS} THEN q.size ELSE 0 END + len(p.ws), p.headings
  FROM packed q JOIN pieces p ON p.doc_id = q.doc_id AND p.k = q.k + 1)"""


@query(
    f"""WITH RECURSIVE {_LEVELED}
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(any_value(p.headings), ' > ') AS jerarquia, coalesce(any_value(p.headings)[-1], '') AS titulo_seccion,
md5(string_agg(array_to_string(ws, ' '), chr(10) ORDER BY k)) AS texto_md5, CAST(sum(len(ws)) AS INTEGER) AS n_tokens,
CAST(min(start // {_PAGE}) + 1 AS INTEGER) AS page_start, CAST(max((stop - 1) // {_PAGE}) + 1 AS INTEGER) AS page_end, CAST(arg_min(start, k) // {_PAGE} + 1 AS INTEGER) AS pagina_inicio
FROM packed JOIN pieces p USING (doc_id, k) GROUP BY doc_id, chunk"""
)
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers packed under six levels of headings, with the pages of all paragraphs and of the first one."""
    docs = _leveled(spark, sf_dir)
    page = F.explode(F.sequence(F.lit(0), F.floor(F.length("md") / _PAGE).cast("int")))
    pages = docs.select("doc_id", page.alias("i")).select("doc_id", (F.col("i") + 1).alias("pagina"), (F.col("i") * _PAGE).alias("inicio"))
    found = chunks.hierarchical_chunks(docs, pages=pages)
    return found.select("doc_id", "chunk", "jerarquia", "titulo_seccion", F.md5("texto").alias("texto_md5"), "n_tokens", "page_start", "page_end", "pagina_inicio")


# Work that isn't done twice -----------------------------------------------------------------------------------------


@query(
    f"""WITH {_TEXTS}, {_GRADED}, t AS (SELECT g.*, s FROM g JOIN (SELECT chunk_id, element_id, substring(s, 1, 1500) AS s FROM n) USING (chunk_id, element_id)),
old AS (SELECT DISTINCT s, element_id, d FROM t WHERE chunk_id % 40 = 0)
SELECT chunk_id, CAST(t.element_id AS VARCHAR) AS element_id, x >= 0.2 AS relevante, round(x, 6) AS score_grade, 'calificado' AS estado,
CASE WHEN old.s IS NULL THEN 'nueva' ELSE 'cache' END AS origen FROM t LEFT JOIN old ON old.s = t.s AND old.element_id = t.element_id AND old.d = t.d"""
)
def cached_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades behind a cache that already has every second section's."""
    found, secs = _near(spark, sf_dir)
    cache = scratch(spark, "grades")
    resume.cached_grades(found.where("chunk_id % 40 = 0"), secs, cache, "overlap 0.2")
    graded = resume.cached_grades(found, secs, cache, "overlap 0.2")
    return graded.select("chunk_id", "element_id", "relevante", F.round("score_grade", 6).alias("score_grade"), "estado", "origen")


def _before_and_after(spark: SparkSession, sf_dir: str):
    """Sections and norms as they were and as they are: some sections cite more, some norms have another article."""
    norms, secs = views.norm_md(spark, sf_dir), views.sections(spark, sf_dir)
    more = F.when(F.col("doc_id") % 7 == 0, "\n\nArt. 99.- Nuevo").otherwise("")
    new_norms = norms.withColumn("md", F.concat("md", more))
    new_secs = secs.withColumn("texto", F.concat("texto", F.when(F.col("chunk_id") % 10 == 3, " y Art. 99").otherwise("")))
    return (secs, norms), (new_secs, new_norms)


def _citations(norms: DataFrame):
    """The step of a run: how many articles of the next document have each number that a section cites."""
    counts = extract.articles(norms).groupBy((F.col("doc_id") - 1).alias("chunk_id"), "numero").agg(F.count("*").alias("articulos"))
    return lambda rows: compare.cited_numbers(rows).drop("doc_id").join(counts, ["chunk_id", "numero"])


def _versions(norms: DataFrame) -> DataFrame:
    return norms.select((F.col("doc_id") - 1).alias("chunk_id"), F.md5("md").alias("norma"))


@query(
    """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 3 THEN 'texto' ELSE 'norma' END AS motivo FROM documents d
WHERE doc_id % 10 = 3 OR ((doc_id + 1) % 7 = 0 AND EXISTS (SELECT 1 FROM documents n WHERE n.doc_id = d.doc_id + 1))"""
)
def pending_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run has to do after some sections and some norms have changed, and why."""
    (secs, norms), (new_secs, new_norms) = _before_and_after(spark, sf_dir)
    path = scratch(spark, "pending")
    resume.resume(secs, _versions(norms), _citations(norms), path, "v1", parts=2)
    return resume.pending(new_secs, _versions(new_norms), path, "v1")


@query(
    f"""WITH {views.MD_SQL.replace("md AS (", "md0 AS (", 1)}, md AS (SELECT doc_id, md || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || 'Art. 99.- Nuevo' ELSE '' END AS md FROM md0),
{parts_sql("a0", P.ARTICLE)},
articles AS (SELECT doc_id, upper(regexp_replace(trim(regexp_extract(match, '(?im){P.ARTICLE}', 1)), '[ \\t]*[-–][ \\t]*', '-', 'g')) AS numero FROM a0),
cited AS (SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_extract_all(coalesce(text, '') || ' según Art. ' || (doc_id % 9 + 1) || CASE WHEN doc_id % 10 = 3 THEN ' y Art. 99' ELSE '' END, '{P.CITATION}', 1)) AS numero FROM documents)
SELECT chunk_id, c.numero, count(*) AS articulos FROM cited c JOIN articles a ON a.doc_id = c.chunk_id + 1 AND a.numero = c.numero GROUP BY ALL"""
)
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over changed sections and norms that goes on from the run before: only due sections are computed."""
    (secs, norms), (new_secs, new_norms) = _before_and_after(spark, sf_dir)
    path = scratch(spark, "resumed")
    resume.resume(secs, _versions(norms), _citations(norms), path, "v1", parts=2)
    return resume.resume(new_secs, _versions(new_norms), _citations(new_norms), path, "v1", parts=2)


# Whole comparisons --------------------------------------------------------------------------------------------------

_ANSWER = """CASE doc_id % 8 WHEN 2 THEN substring({good}, 1, length({good}) - 10) WHEN 3 THEN replace({good}, '"cumple"', '"excelente"') WHEN 4 THEN replace({good}, 'analisis_general', 'otro')
WHEN 5 THEN NULL WHEN 6 THEN '  ' WHEN 7 THEN replace({good}, '["', '"') ELSE concat('Claro: ', {good}, ' Eso es todo.') END"""
_GOOD = """concat('{{"tipo_coincidencia": "lexica", "nivel_cumplimiento": "cumple", "analisis_general": "', lang, ' ', doc_id, '", "brechas": ["', coalesce(source, ''), '", "b', doc_id % 3, '"]}}')"""
_ANSWERED = _ANSWER.format(good=_GOOD.format())


@query(
    rf"""WITH a AS (SELECT doc_id, {_ANSWERED} AS a FROM documents), b AS (SELECT *, nullif(regexp_extract(a, '\{{.*\}}', 0, 's'), '') AS j FROM a),
c AS (SELECT *, CASE WHEN a IS NULL OR trim(a) = '' THEN 'sin_respuesta' WHEN j IS NULL OR NOT json_valid(j) OR json_type(j, '$.brechas') <> 'ARRAY' THEN 'malformado'
  WHEN json_extract_string(j, '$.analisis_general') IS NULL THEN 'incompleto' WHEN json_extract_string(j, '$.nivel_cumplimiento') NOT IN ('cumple', 'parcial', 'omision', 'no_aplica') THEN 'fuera_de_rango'
  ELSE 'analizado' END AS estado_analisis FROM b)
SELECT doc_id, estado_analisis, CASE WHEN estado_analisis = 'analizado' THEN json_extract_string(j, '$.nivel_cumplimiento') END AS nivel_cumplimiento,
CASE WHEN estado_analisis = 'analizado' THEN json_extract_string(j, '$.analisis_general') END AS analisis_general,
CASE WHEN estado_analisis = 'analizado' THEN array_to_string(CAST(json_extract(j, '$.brechas') AS VARCHAR[]), '; ') ELSE '' END AS brechas FROM c"""
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as text, an eighth of each kind: good within prose, cut short, out of range, incomplete, missing, blank."""
    asked = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ANSWERED).alias("respuesta"))
    told = answers.parse_verdict(asked, "respuesta")
    return told.select("doc_id", "estado_analisis", "nivel_cumplimiento", "analisis_general", F.array_join("brechas", "; ").alias("brechas"))


_RUN = f"""arts AS (SELECT doc_id || '_' || lpad(CAST(orden AS VARCHAR), CAST(greatest(4, length(CAST(orden AS VARCHAR))) AS INTEGER), '0') AS element_id, doc_id, numero, encabezado, contenido, orden,
  {_EMBED} AS embed FROM placed WHERE tipo_elemento = 'articulo'),
secs AS (SELECT doc_id AS chunk_id, coalesce(text, '') || ' según Art. ' || (doc_id % 9 + 1) AS texto, coalesce(lang, '') AS jerarquia FROM documents),
lex AS (SELECT chunk_id, a.*, row_number() OVER (PARTITION BY chunk_id ORDER BY a.orden, element_id) AS rank FROM cited c JOIN arts a ON a.doc_id = c.chunk_id + 1 AND a.numero = c.numero),
hashed AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM (
  SELECT id, unnest(list_filter(string_split(lower(translate(t, chr(10) || chr(9), '  ')), ' '), lambda w: w <> '')) AS w
  FROM (SELECT 's' || chunk_id AS id, texto AS t FROM secs UNION ALL SELECT 'a' || element_id, embed FROM arts)) GROUP BY ALL),
vectors AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM hashed),
pairs AS (SELECT s.chunk_id, s.texto, a.* EXCLUDE (doc_id, orden, embed) FROM secs s JOIN arts a ON a.doc_id = s.chunk_id + 1),
scores AS (SELECT p.chunk_id, p.element_id, round(sum(u.x * v.x), 9) AS score FROM pairs p JOIN vectors u ON u.id = 's' || p.chunk_id JOIN vectors v ON v.id = 'a' || p.element_id AND v.b = u.b GROUP BY ALL),
near AS (SELECT * FROM (SELECT p.*, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(score, 0) DESC, element_id) AS rank
  FROM pairs p LEFT JOIN scores USING (chunk_id, element_id)) WHERE rank <= 5 AND score >= 0.30),
reranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY x DESC, rank) AS i FROM (
  SELECT *, {_SHARE} AS x FROM (SELECT *, texto AS s, 'Artículo ' || numero || ': ' || encabezado || chr(10) || substring(contenido, 1, 600) AS d FROM near))),
graded AS (SELECT *, {_SHARE} AS g FROM (SELECT * EXCLUDE (s, d), substring(texto, 1, 1500) AS s, substring(contenido, 1, 600) AS d FROM reranked WHERE i <= 3)),
refs AS (SELECT chunk_id, list(numero ORDER BY rank) AS lexicos, list('Artículo ' || numero || ': ' || encabezado || chr(10) || substring(contenido, 1, 800) ORDER BY rank) FILTER (rank <= 3) AS cites FROM lex GROUP BY chunk_id),
tops AS (SELECT chunk_id, list('[Top ' || t || '] Art.' || numero || ': ' || encabezado || chr(10) || d ORDER BY t) AS tops
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS t FROM graded WHERE g >= 0.2) GROUP BY chunk_id),
raw AS (SELECT chunk_id, string_agg(numero || ':' || CAST(round(score, 4) * 10000 AS BIGINT), ' ' ORDER BY rank) AS raw FROM near GROUP BY chunk_id),
valid AS (SELECT chunk_id, string_agg(numero || ':' || (g >= 0.2) || ':' || CAST(round(g * 1000000) AS BIGINT), ' ' ORDER BY i) AS valid FROM graded GROUP BY chunk_id),
told AS (SELECT s.*, coalesce(lexicos, []) AS lexicos, CASE WHEN lexicos IS NOT NULL THEN 'lexica' WHEN tops IS NOT NULL THEN 'semantica' ELSE 'ninguna' END AS kind, coalesce(raw, '') AS raw, coalesce(valid, '') AS valid,
  coalesce(nullif(concat_ws(chr(10) || chr(10), '{P.CITED_TITLE}' || array_to_string(cites, chr(10) || chr(10)), '{P.NEAR_TITLE}' || array_to_string(tops, chr(10) || chr(10))), ''), '{P.NO_REFERENCES}') AS refs
  FROM secs s LEFT JOIN refs USING (chunk_id) LEFT JOIN tops USING (chunk_id) LEFT JOIN raw USING (chunk_id) LEFT JOIN valid USING (chunk_id)),
leveled AS (SELECT *, CASE kind WHEN 'lexica' THEN 'cumple' WHEN 'semantica' THEN 'parcial' ELSE 'omision' END AS level FROM told)"""


@query(
    _with(
        """SELECT chunk_id, jerarquia, array_to_string(lexicos, ' ') AS articulos_lexicos, raw AS articulos_semanticos_raw, valid AS articulos_validados, kind AS tipo_coincidencia, level AS nivel_cumplimiento,
kind || ': ' || level AS analisis_general, CASE WHEN kind = 'lexica' THEN 'citado' END AS analisis_lexico, CASE WHEN kind = 'semantica' THEN 'cercano' END AS analisis_semantico_top1,
CASE WHEN level = 'cumple' THEN '' ELSE level || ': ' || length(refs) || ' / ' || least(length(texto), 2000) END AS brechas,
array_to_string(list_sort(list_distinct(regexp_extract_all(refs, 'Art[.][0-9]+'))), ' ') AS entidades_normativas, 'analizado' AS estado_analisis FROM leveled""",
        _LEXICAL, _RUN,
    )
)
def compare_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison of each section with the articles of the next document, by the default models."""
    arts = extract.normativa(views.norm_md(spark, sf_dir)).where("tipo_elemento = 'articulo'")
    secs = views.sections(spark, sf_dir, F.coalesce("lang", F.lit("")).alias("jerarquia"))
    scope = secs.select("chunk_id", (F.col("chunk_id") + 1).alias("norm_id"))
    out = whole.compare_all(secs, arts, scope, order=[])
    shown = lambda c, of: F.array_join(F.transform(c, of), " ")
    sim = lambda x: F.concat(x.numero, F.lit(":"), F.round(x.sim * 10000).cast("long").cast("string"))
    grade = lambda x: F.concat_ws(":", x.numero, x.relevante.cast("string"), F.round(x.score * 1000000).cast("long").cast("string"))
    path = scratch(spark, "compared")
    out.select(
        "chunk_id", "jerarquia", F.array_join("articulos_lexicos", " ").alias("articulos_lexicos"), shown("articulos_semanticos_raw", sim).alias("articulos_semanticos_raw"),
        shown("articulos_validados", grade).alias("articulos_validados"), "tipo_coincidencia", "nivel_cumplimiento", "analisis_general", "analisis_lexico",
        "analisis_semantico_top1", F.array_join("brechas", "; ").alias("brechas"), F.array_join("entidades_normativas", " ").alias("entidades_normativas"), "estado_analisis",
    ).write.parquet(path)
    return spark.read.parquet(path).orderBy("chunk_id")  # a sort reads its input twice: what is stored, not the models


# Documents and papers -----------------------------------------------------------------------------------------------


@query(
    f"""{_STYLE}, s AS (SELECT doc_id, count(*) AS n, string_agg(posicion || '|' || label, chr(10) ORDER BY posicion) AS x FROM marks GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n, string_agg(posicion || '|' || regexp_extract(match, '(?im){P.VARIANT_ARTICLE}', 1) || '|' || md5(substring({_COLLAPSE.format(strip_sql("t"))}, 1, 3500)), chr(10) ORDER BY posicion) AS x
  FROM (SELECT *, CASE WHEN seq = max(seq) OVER (PARTITION BY doc_id) THEN substring(tail, 1, 4000) ELSE tail END AS t FROM v0) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n, string_agg(upper(regexp_extract(match, '(?im){P.ANNEX}', 1)), chr(10) ORDER BY seq) AS x FROM x0 GROUP BY doc_id)
SELECT md.doc_id, coalesce(s.n, 0) AS n_secciones, coalesce(a.n, 0) AS n_articulos, coalesce(x.n, 0) AS n_anexos,
md5(coalesce(s.x, '')) AS secciones_md5, md5(coalesce(a.x, '')) AS articulos_md5, coalesce(x.x, '') AS anexos FROM md LEFT JOIN s USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id)"""
)
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents with their elements nested, written as JSON and read back."""
    docs, path = _varied(spark, sf_dir), scratch(spark, "nested")
    nested = sinks.nested_documents(docs.select("doc_id"), extract.variant_marks(docs), extract.variant_articles(docs), extract.variant_annexes(docs))
    sinks.write_records(nested, path)
    read = corpus.read_records(spark, path, nested.schema)
    joined = lambda c, *of: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[f(x) for f in of])), "\n")
    place = lambda x: x.posicion.cast("string")
    return read.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_secciones", "n_articulos", "n_anexos")], F.md5(joined("secciones", place, lambda x: x.label)).alias("secciones_md5"),
        F.md5(joined("articulos", place, lambda x: x.numero, lambda x: F.md5(x.contenido))).alias("articulos_md5"), joined("anexos", lambda x: x.identificador).alias("anexos"),
    )


def _papers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The working papers of `compare_sections`' comparison, written and read back."""
    base = scratch(spark, "papers")
    arts = extract.normativa(views.norm_md(spark, sf_dir)).where("tipo_elemento = 'articulo'")
    arts.select("doc_id", "element_id", "numero", "encabezado", F.substring("contenido", 1, whole.MOST).alias("contenido"), "orden", "embed_text", "es_referencia").write.parquet(f"{base}/arts")
    arts = spark.read.parquet(f"{base}/arts")
    secs = views.sections(spark, sf_dir).withColumn("jerarquia", F.lit(""))
    scope = secs.select("chunk_id", (F.col("chunk_id") + 1).alias("norm_id"))
    # no sheet shows the sections' texts, and each has its own order
    whole.compare_all(secs, arts, scope, order=[]).drop("texto").write.parquet(f"{base}/done")
    done = spark.read.parquet(f"{base}/done")
    lexical = compare.lexical_join(secs, arts, scope).select("element_id", "chunk_id", F.lit(1.0).alias("score"), F.lit("lexica").alias("origen"))
    lexical.write.parquet(f"{base}/links")  # three sheets read the links
    tables = papers.papers(done, arts, spark.read.parquet(f"{base}/links"), {"modelo": "hash", "umbral": str(P.MIN_SCORE)})
    papers.write_papers(tables, base)
    return papers.read_papers(spark, base)


@query(
    _with(
        """SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, level AS nivel_cumplimiento, CASE level WHEN 'omision' THEN 'alta' WHEN 'parcial' THEN 'media' ELSE 'baja' END AS prioridad,
CASE level WHEN 'omision' THEN 'FCE4D6' WHEN 'parcial' THEN 'FFF2CC' ELSE 'E2EFDA' END AS color FROM leveled""",
        _LEXICAL, _RUN,
    )
)
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual's sheet of the working papers, with the priority and the fill of each section."""
    return _papers(spark, sf_dir)["via_manual"].select("chunk_id", "nivel_cumplimiento", "prioridad", "color")


@query(
    _with(
        """SELECT 'nivel ' || x AS concepto, CAST((SELECT count(*) FROM leveled WHERE level = x) AS VARCHAR) AS valor FROM (SELECT unnest(['cumple', 'parcial', 'omision', 'no_aplica']) AS x)
UNION ALL SELECT c, v FROM (SELECT unnest(['articulos', 'cubiertos', 'sin_cobertura', 'porcentaje']) AS c, unnest([CAST(n AS VARCHAR), CAST(k AS VARCHAR), CAST(n - k AS VARCHAR), CAST(round(k * 100.0 / greatest(1, n), 1) AS VARCHAR)]) AS v
  FROM (SELECT count(*) AS n, count(l.doc_id) AS k FROM placed p LEFT JOIN (SELECT DISTINCT doc_id, orden FROM lex) l ON l.doc_id = p.doc_id AND l.orden = p.orden WHERE tipo_elemento = 'articulo' AND NOT es_referencia))""",
        _LEXICAL, _RUN,
    )
)
def paper_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's sheet: sections by the level that the models found, and how many own articles are covered."""
    return _papers(spark, sf_dir)["resumen"]


@query(
    _with(
        """SELECT * FROM (SELECT CAST(t.chunk_id AS VARCHAR) AS chunk_id, array_to_string(list_filter([
  CASE WHEN s BETWEEN 0.25 AND 0.35 THEN 'umbral' END, CASE WHEN r IS NULL THEN 'sin_calificar' END, CASE WHEN len(lexicos) > 0 AND NOT coalesce(r, true) THEN 'conflicto' END,
  CASE WHEN len(lexicos) = 0 AND coalesce(s, 0) < 0.30 THEN 'huerfana' END, CASE WHEN level = 'parcial' THEN 'parcial_con_brechas' END], lambda m: m IS NOT NULL), '; ') AS motivos
FROM leveled t LEFT JOIN (SELECT chunk_id, max(round(score, 4)) AS s FROM near GROUP BY chunk_id) USING (chunk_id) LEFT JOIN (SELECT chunk_id, bool_or(g >= 0.2) AS r FROM graded GROUP BY chunk_id) USING (chunk_id))
WHERE motivos <> ''""",
        _LEXICAL, _RUN,
    )
)
def paper_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of sections to review by hand, with the reasons that the run's own results give."""
    return _papers(spark, sf_dir)["revision"].select("chunk_id", "motivos")


@query(
    _with(
        """SELECT CAST(p.doc_id AS VARCHAR) AS doc_id, p.numero, CASE WHEN es_referencia THEN 'no_aplica' WHEN n IS NULL THEN 'no_cubierto' ELSE 'cubierto' END AS nivel_adopcion,
CAST(coalesce(n, 0) AS VARCHAR) AS secciones, CASE WHEN es_referencia THEN 'ninguna' WHEN n IS NULL THEN 'alta' ELSE 'baja' END AS prioridad
FROM placed p LEFT JOIN (SELECT doc_id, orden, count(*) AS n FROM lex GROUP BY doc_id, orden) l ON l.doc_id = p.doc_id AND l.orden = p.orden WHERE p.tipo_elemento = 'articulo'""",
        _LEXICAL, _RUN,
    )
)
def paper_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norms' sheet of the working papers: how far each article is adopted, and its priority."""
    return _papers(spark, sf_dir)["via_normativa"].select("doc_id", "numero", "nivel_adopcion", "secciones", "prioridad")
