"""The registered queries and their SQL twins; each runs over its whole tables.

Searches take the rows whose id is divisible by 20 as their query set, against all rows. Scores are rounded in the
results only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions import text as X
from lexloom.functions import vectors as V
from lexloom.operators import compare, extract, search
from lexloom.plans import views
from lexloom.plans.views import structure
from lexloom.session import scratch, table
from lexloom.sources import index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return put


# Search -----------------------------------------------------------------------------------------------------------

_SCORES = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS wanted FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, wanted, vec_id AS element_id, CAST(label AS VARCHAR) AS source, round(list_dot_product(v, CAST(embedding AS DOUBLE[])), 9) AS score
      FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS rank FROM s)"""


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("query_id", "element_id", V.rounded(F.col("score"), 4).alias("score"), F.col("rank").cast("int").alias("rank"), *more)


@query(f"WITH {_SCORES} SELECT query_id, element_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND score >= 0.30")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = views.vectors(spark, sf_dir)
    return _shown(search.semantic_search(queries, rows))


@query(
    f"""WITH {_SCORES} SELECT query_id, element_id, round(score, 4) AS score, source,
CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS INTEGER) AS rank FROM r WHERE rank <= 5 AND score >= 0.30 AND source = wanted"""
)
def semantic_topk_source_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = views.vectors(spark, sf_dir)
    wanted = queries.select("query_id", F.col("wanted").cast("string").alias("source"))
    return _shown(search.filter_source(search.semantic_search(queries, rows), wanted, rows.select("element_id", "source")), "source")


@query(
    f"""WITH {_SCORES} SELECT query_id, element_id, round(score, 4) AS score, source, CAST(n AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS n FROM r WHERE rank <= 25 AND score >= 0.0 AND source = wanted) WHERE n <= 5"""
)
def semantic_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch five times as many, filter by source, then keep the best."""
    queries, rows = views.vectors(spark, sf_dir)
    wide = search.semantic_search(queries, rows, P.TOP_K * P.OVERFETCH, 0.0)
    wanted = queries.select("query_id", F.col("wanted").cast("string").alias("source"))
    return _shown(search.filter_source(wide, wanted, rows.select("element_id", "source")).where(F.col("rank") <= P.TOP_K), "source")


@query(
    f"""WITH {_SCORES} SELECT query_id, element_id, round(score, 4) AS score, source, CAST(n AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, element_id) AS n FROM r WHERE rank <= 10) WHERE n <= 2"""
)
def per_source_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best of each source among the over-fetched."""
    queries, rows = views.vectors(spark, sf_dir)
    found = search.top_k(queries, rows, 2 * P.OVERFETCH).join(rows.select("element_id", "source"), "element_id")
    nth = F.row_number().over(W.partitionBy("query_id", "source").orderBy(F.desc("score"), "element_id"))
    return _shown(found.withColumn("rank", nth).where("rank <= 2"), "source")


@query()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate, by an index that is built and stored first; its recall against semantic_topk is tested.

    Three quarters of the cells are probed, as vectors without clusters need that for a recall of 0.9.
    """
    queries, rows = views.vectors(spark, sf_dir)
    path = scratch(spark, "index")
    dim = rows.select(F.max(F.size("embedding"))).first()[0] or 1
    index.build(rows.select(F.col("element_id").cast("long"), "embedding"), path, "given", dim)
    built = index.load(spark, path, "given", dim)
    return _shown(index.find(built, queries, probes=-(-3 * built.meta["cells"] // 4)))


@query(
    f"""WITH {_SCORES}, c AS (SELECT *, abs(query_id - element_id) % 7 / 7.0 + score AS reranker_score FROM r WHERE rank <= 5)
SELECT query_id, element_id, round(reranker_score, 4) AS reranker_score, CAST(n AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, rank) AS n FROM c) WHERE n <= 3"""
)
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of five by a deterministic stand-in for the reranker."""
    found = search.top_k(*views.vectors(spark, sf_dir))
    scored = found.withColumn("reranker_score", F.abs(F.col("query_id") - F.col("element_id")) % 7 / F.lit(7.0) + F.col("score"))
    return search.rerank(scored).select("query_id", "element_id", V.rounded(F.col("reranker_score"), 4).alias("reranker_score"), F.col("rank").cast("int").alias("rank"))


@query(
    f"""WITH {_SCORES}, gold AS (SELECT query_id, element_id FROM r WHERE rank <= 10 AND source = wanted),
hits AS (SELECT g.query_id, x.rank FROM gold g LEFT JOIN (SELECT * FROM r WHERE rank <= 3) x USING (query_id, element_id)),
per AS (SELECT query_id, count(*) AS n, count(rank) AS found, min(rank) AS first, sum(CASE WHEN rank IS NULL THEN 0 ELSE 1 / log2(rank + 1.0) END) AS dcg FROM hits GROUP BY query_id)
SELECT query_id, round(found / n, 4) AS recall, round(coalesce(1.0 / first, 0), 4) AS mrr,
       round(dcg / list_sum(list_transform(range(1, least(n, 3) + 1), lambda i: 1 / log2(i + 1.0))), 4) AS ndcg FROM per"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG at 3 against those of the ten best that share the query's label."""
    queries, rows = views.vectors(spark, sf_dir)
    found = search.top_k(queries, rows, 10)
    gold = found.join(rows.select("element_id", "source"), "element_id").join(queries.select("query_id", "wanted"), "query_id")
    return compare.retrieval_metrics(found, gold.where("source = cast(wanted AS string)").select("query_id", "element_id"), k=3)


@query(
    """SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first
FROM (SELECT vec_id, CAST(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS DOUBLE[]) AS v FROM embeddings)"""
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v")).withColumn("u", V.l2_normalize(F.col("v")))
    return rows.select("vec_id", F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


_HASHED = """words AS (SELECT doc_id, list_filter(string_split(lower(translate(coalesce(text, ''), chr(10) || chr(9), '  ')), ' '), lambda w: w <> '') AS ws FROM documents),
buckets AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM words) GROUP BY ALL)"""


@query(
    f"""WITH {_HASHED}, norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM buckets GROUP BY doc_id)
SELECT w.doc_id, coalesce(max(round(n / norm, 6)), 0) AS largest, CAST(coalesce(sum(b * CAST(round(1e6 * n / norm) AS BIGINT)), 0) AS BIGINT) AS checksum
FROM words w LEFT JOIN buckets USING (doc_id) LEFT JOIN norms USING (doc_id) GROUP BY w.doc_id"""
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline embedding of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", V.hash_embedding(F.coalesce("text", F.lit(""))).alias("e"))
    rounded = F.transform("e", lambda x: F.round(x, 6))
    weighed = F.aggregate(F.transform("e", lambda x, i: F.round(x * 1e6).cast("long") * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", F.array_max(rounded).alias("largest"), weighed.alias("checksum"))



# Cleaning ---------------------------------------------------------------------------------------------------------


@query(
    r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS nr, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, lower(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS key FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY nr)) AS md5, count(*) AS lines FROM n WHERE key = '' OR n < 3 OR length(key) > 90 GROUP BY doc_id"""
)
def strip_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("md"))
    return X.strip_repeated_lines(docs).select("doc_id", F.md5("md").alias("md5"), F.size(F.split("md", "\n", -1)).cast("long").alias("lines"))


@query(
    rf"""SELECT doc_id, md5(cleaned) AS md5, CAST(length(cleaned) AS BIGINT) AS n_chars FROM (SELECT doc_id, regexp_replace(array_to_string(list_filter(
string_split(replace(coalesce(text, '') || chr(10) || '17' || chr(10) || ' 3 / 9 ' || chr(10) || 'a.b@c.org' || chr(10) || 'x' || chr(9) || '  y', chr(9), ' '), chr(10)),
lambda x: NOT regexp_matches(x, '{P.ARTIFACT_LINE}')), chr(10)), '[ ]{{2,}}', ' ', 'g') AS cleaned FROM documents)"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a page number, a fraction, an e-mail and a tabbed line behind it."""
    md = F.concat(F.coalesce("text", F.lit("")), F.lit("\n17\n 3 / 9 \na.b@c.org\nx\t  y"))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.clean_text(md).alias("cleaned"))
    return rows.select("doc_id", F.md5("cleaned").alias("md5"), F.length("cleaned").cast("long").alias("n_chars"))


@query(
    rf"""SELECT doc_id, md5(t) AS md5, CAST(length(t) AS BIGINT) AS n_chars FROM (
SELECT doc_id, substring(regexp_replace(coalesce(text, '') || chr(7), '{P.CONTROL}', '', 'g'), 1, 32767) AS t FROM documents)"""
)
def control_chars_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of a workbook: no control characters, at most 32767 characters."""
    cell = F.substring(X.strip_control(F.concat(F.coalesce("text", F.lit("")), F.lit("\x07"))), 1, 32767)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cell).alias("md5"), F.length(cell).cast("long").alias("n_chars"))


# Structure --------------------------------------------------------------------------------------------------------


@query(structure("SELECT doc_id, CAST(seq AS INTEGER) AS seq, numero, posicion, md5(tail) AS tail_md5 FROM articles"))
def article_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.articles(views.norm_md(spark, sf_dir)).select("doc_id", "seq", "numero", "posicion", F.md5("tail").alias("tail_md5"))


@query(structure("SELECT doc_id, CAST(seq AS INTEGER) AS seq, numero, encabezado, md5(contenido) AS contenido_md5 FROM headed"))
def header_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.with_header(extract.articles(views.norm_md(spark, sf_dir)))
    return rows.select("doc_id", "seq", "numero", "encabezado", F.md5("contenido").alias("contenido_md5"))


@query(structure("SELECT doc_id, posicion, seccion FROM placed WHERE tipo_elemento = 'articulo'"))
def sections_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.norm_md(spark, sf_dir)
    return extract.with_section(extract.articles(docs), extract.headings(docs)).select("doc_id", "posicion", "seccion")


@query(structure("SELECT doc_id, CAST(seq AS INTEGER) AS seq, numero, posicion, tipo_bloque, es_referencia FROM flagged"))
def reference_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, citations of other norms, repeated numbers."""
    return extract.flagged_articles(views.norm_md(spark, sf_dir)).select("doc_id", "seq", "numero", "posicion", "tipo_bloque", "es_referencia")


@query(structure("SELECT doc_id, CAST(seq AS INTEGER) AS seq, numero, posicion, md5(contenido) AS contenido_md5 FROM provisions"))
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.provisions(views.norm_md(spark, sf_dir)).select("doc_id", "seq", "numero", "posicion", F.md5("contenido").alias("contenido_md5"))


@query(structure("SELECT doc_id, CAST(seq AS INTEGER) AS seq, numero, posicion, titulo FROM annexes"))
def annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.annexes(views.norm_md(spark, sf_dir))


@query(structure("SELECT * FROM metadata"))
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.metadata(views.norm_md(spark, sf_dir))


_EMBED = """concat_ws(chr(10), nullif(seccion, ''), CASE WHEN tipo_elemento = 'articulo' THEN 'Artículo ' || numero ELSE numero END
  || CASE WHEN encabezado <> '' AND encabezado <> numero THEN ': ' || encabezado ELSE '' END, nullif(substring(contenido, 1, 1200), ''))"""


@query(
    structure(
        f"""SELECT doc_id || '_' || lpad(CAST(orden AS VARCHAR), CAST(greatest(4, length(CAST(orden AS VARCHAR))) AS INTEGER), '0') AS element_id, doc_id, numero, encabezado, tipo_elemento, tipo_bloque,
es_referencia, posicion, CAST(orden AS INTEGER) AS orden, tipo_norma, titulo_norma, fecha, md5({_EMBED}) AS embed_md5 FROM placed JOIN metadata USING (doc_id)"""
    )
)
def normativa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full table of articles, provisions and annexes."""
    rows = extract.normativa(views.norm_md(spark, sf_dir)).withColumn("embed_md5", F.md5("embed_text"))
    kept = "element_id doc_id numero encabezado tipo_elemento tipo_bloque es_referencia posicion orden tipo_norma titulo_norma fecha embed_md5"
    return rows.select(*kept.split())


@query(
    structure(
        rf"""SELECT v.doc_id, CAST(seq AS INTEGER) AS seq, regexp_extract(match, '(?im){P.VARIANT_ARTICLE}', 1) AS numero,
{views.strip_sql(f"regexp_extract(match, '(?im){P.VARIANT_ARTICLE}', 2)")} AS encabezado, v.posicion, coalesce(m.label, '') AS seccion,
md5(substring({views.strip_sql("CASE WHEN seq = max(seq) OVER (PARTITION BY v.doc_id) THEN substring(tail, 1, 4000) ELSE tail END")}, 1, 3500)) AS contenido_md5, 'LEY ORGÁNICA' AS tipo_norma
FROM v0 v ASOF LEFT JOIN (SELECT doc_id, posicion, label FROM headings UNION ALL SELECT doc_id, posicion, numero FROM provisions) m ON v.doc_id = m.doc_id AND v.posicion >= m.posicion"""
    )
)
def variant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second style of parsing; the documents' heads hold one kind unless a first line names one of higher rank."""
    rows = extract.variant(views.norm_md(spark, sf_dir))
    return rows.select("doc_id", "seq", "numero", "encabezado", "posicion", "seccion", F.md5("contenido").alias("contenido_md5"), "tipo_norma")


_CHUNKS = r"""lines AS (SELECT doc_id, unnest(range(len(ls))) AS nr, unnest(ls) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS ls FROM md)),
titled AS (SELECT *, line LIKE '## %' AS head FROM lines),
secs AS (SELECT *, sum(CAST(head AS INTEGER)) OVER w AS section, last_value(CASE WHEN head THEN trim(substring(line, 4)) END IGNORE NULLS) OVER w AS path
         FROM titled WINDOW w AS (PARTITION BY doc_id ORDER BY nr ROWS UNBOUNDED PRECEDING)),
packed AS (SELECT doc_id, section, coalesce(max(path), '') AS heading_path, list_filter(flatten(list(string_split_regex(line, '[ \t]+') ORDER BY nr)), lambda w: w <> '') AS ws
           FROM secs WHERE NOT head GROUP BY doc_id, section),
cut AS (SELECT doc_id, section, heading_path, unnest(range((len(ws) + 511) // 512)) AS part, ws FROM packed WHERE len(ws) > 0)"""


@query(
    f"""WITH {views.MD_SQL}, {_CHUNKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS INTEGER) AS chunk, heading_path,
md5(array_to_string(ws[part * 512 + 1 : part * 512 + 512], ' ')) AS texto_md5, CAST(len(ws[part * 512 + 1 : part * 512 + 512]) AS INTEGER) AS n_tokens FROM cut"""
)
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.heading_chunks(views.norm_md(spark, sf_dir))
    return rows.select("doc_id", "chunk", "heading_path", F.md5("texto").alias("texto_md5"), "n_tokens")


@query(
    f"""WITH {views.MD_SQL}, {_CHUNKS} SELECT source, coalesce(nullif(string_split(heading_path, ' > ')[1], ''), '(sin sección)') = '(sin sección)' AS sin_seccion,
count(*) AS chunks FROM cut JOIN documents USING (doc_id) GROUP BY ROLLUP (1, 2)"""
)
def chunks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by source, with and without a section, and the totals."""
    chunks = extract.heading_chunks(views.norm_md(spark, sf_dir)).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    first = F.coalesce(F.nullif(F.split("heading_path", " > ")[0], F.lit("")), F.lit("(sin sección)"))
    return chunks.withColumn("sin_seccion", first == "(sin sección)").rollup("source", "sin_seccion").agg(F.count("*").alias("chunks"))


# Comparison -------------------------------------------------------------------------------------------------------

_LEXICAL = rf"""cited AS (SELECT DISTINCT doc_id AS chunk_id, doc_id, unnest(regexp_extract_all(coalesce(text, '') || ' según Art. ' || (doc_id % 9 + 1), '{P.CITATION}', 1)) AS numero FROM documents),
named AS (SELECT doc_id, numero, orden, doc_id || '_' || lpad(CAST(orden AS VARCHAR), CAST(greatest(4, length(CAST(orden AS VARCHAR))) AS INTEGER), '0') AS element_id FROM placed WHERE tipo_elemento = 'articulo'),
lexical AS (SELECT chunk_id, element_id, numero, row_number() OVER (PARTITION BY chunk_id ORDER BY orden, element_id) AS rank FROM cited JOIN named USING (doc_id, numero))"""


def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    arts = extract.normativa(views.norm_md(spark, sf_dir)).where("tipo_elemento = 'articulo'")
    return compare.lexical_join(views.sections(spark, sf_dir), arts), arts


@query(structure("SELECT chunk_id, element_id, numero, 'exacto' AS match_type, 1.0::DOUBLE AS similarity, CAST(rank AS INTEGER) AS rank FROM lexical").replace("\nSELECT chunk_id", f",\n{_LEXICAL}\nSELECT chunk_id"))
def lexical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[0]


@query(structure("SELECT count(*) AS articulos, count(l.element_id) AS cubiertos, count(*) - count(l.element_id) AS sin_cobertura, round(count(l.element_id) * 100.0 / greatest(1, count(*)), 1) AS porcentaje FROM named LEFT JOIN (SELECT DISTINCT element_id FROM lexical) l USING (element_id)").replace("\nSELECT count", f",\n{_LEXICAL}\nSELECT count"))
def coverage_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, arts = _lexical(spark, sf_dir)
    return compare.coverage(arts, found)


_CANDIDATES = f"""{_SCORES}, c AS (SELECT query_id AS chunk_id, element_id, score, rank FROM r WHERE rank <= 5),
grades AS (SELECT chunk_id, element_id, p AS pos, (element_id + p) % 2 = 0 AS relevante, (element_id % 10) / 10.0 AS score_grade FROM c, (VALUES (1), (2)) AS v(p)
           WHERE (chunk_id + element_id) % 3 = 0 AND (p = 1 OR element_id % 2 = 0)),
last AS (SELECT chunk_id, element_id, arg_max(relevante, pos) AS relevante, arg_max(score_grade, pos) AS score_grade FROM grades GROUP BY ALL),
graded AS (SELECT c.chunk_id, c.element_id, c.score, coalesce(l.relevante, true) AS relevante, coalesce(l.score_grade, 0.5) AS score_grade FROM c LEFT JOIN last l USING (chunk_id, element_id))"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the grades of a deterministic stand-in; some have two grades, many none."""
    found = search.top_k(*views.vectors(spark, sf_dir)).select(F.col("query_id").alias("chunk_id"), "element_id", "score")
    told = found.where("(chunk_id + element_id) % 3 = 0").withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2)))).where("pos = 1 OR element_id % 2 = 0")
    told = told.select("chunk_id", "element_id", "pos", F.expr("(element_id + pos) % 2 = 0").alias("relevante"), F.expr("(element_id % 10) / 10D").alias("score_grade"), F.lit("").alias("razon_grade"))
    return compare.merge_grades(found, told)


@query(f"WITH {_CANDIDATES} SELECT chunk_id, element_id, relevante, CAST(score_grade AS DOUBLE) AS score_grade FROM graded")
def grade_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("chunk_id", "element_id", "relevante", "score_grade")


@query(
    f"""WITH {_CANDIDATES} SELECT chunk_id, CASE WHEN chunk_id % 60 = 0 THEN 'lexica' WHEN count(*) FILTER (relevante) > 0 THEN 'semantica' ELSE 'ninguna' END AS tipo_coincidencia
FROM graded GROUP BY chunk_id"""
)
def match_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).groupBy("chunk_id").agg(F.count_if("relevante").alias("n"))
    lexical = F.when(F.col("chunk_id") % 60 == 0, 1).otherwise(0)
    return rows.select("chunk_id", compare.match_type(lexical, F.col("n")).alias("tipo_coincidencia"))


@query(
    f"""WITH {_CANDIDATES}, per AS (SELECT chunk_id, max(score) AS score, bool_and(relevante) AS rel, CAST(chunk_id % 60 = 0 AS INTEGER) AS lex FROM graded GROUP BY chunk_id)
SELECT chunk_id, concat_ws(',', CASE WHEN score >= 0.25 AND score <= 0.35 THEN 'umbral' END, CASE WHEN lex > 0 AND NOT rel THEN 'conflicto' END,
CASE WHEN lex = 0 AND score < 0.30 THEN 'huerfana' END, CASE WHEN chunk_id % 3 = 1 THEN 'parcial_con_brechas' END) AS motivos FROM per"""
)
def review_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _graded(spark, sf_dir).groupBy("chunk_id").agg(F.max("score").alias("score"), F.bool_and("relevante").alias("rel"))
    lexical = (F.col("chunk_id") % 60 == 0).cast("int")
    level = F.when(F.col("chunk_id") % 3 == 1, "parcial").otherwise("cumple")
    return per.select("chunk_id", F.array_join(compare.review_reasons(F.col("score"), F.col("rel"), lexical, level, F.lit(1)), ",").alias("motivos"))


@query(
    f"""WITH {_CANDIDATES} SELECT element_id, chunk_id, round(max(s), 4) AS score, string_agg(DISTINCT o, ',' ORDER BY o) AS origenes
FROM (SELECT element_id, chunk_id, score AS s, 'semantica' AS o FROM graded UNION ALL SELECT element_id, chunk_id, score_grade, 'calificador' FROM graded WHERE relevante) GROUP BY element_id, chunk_id"""
)
def coverage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir)
    links = graded.select("element_id", "chunk_id", "score", F.lit("semantica").alias("origen"))
    links = links.unionByName(graded.where("relevante").select("element_id", "chunk_id", F.col("score_grade").alias("score"), F.lit("calificador").alias("origen")))
    return compare.coverage_links(links).withColumn("score", V.rounded(F.col("score"), 4))


_LEVEL = "CASE doc_id % 5 WHEN 0 THEN 'cumple' WHEN 1 THEN 'parcial' WHEN 2 THEN 'omision' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'omision' ELSE 'cumple' END END"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_LEVEL).alias("nivel_cumplimiento"))


@query(
    f"""WITH l AS (SELECT {_LEVEL} AS nivel FROM documents), c AS (SELECT nivel, count(*) AS n FROM l GROUP BY nivel)
SELECT nivel AS nivel_cumplimiento, n AS cantidad, round(n * 100.0 / (SELECT sum(n) FROM c), 1) AS porcentaje FROM c WHERE nivel IS NOT NULL"""
)
def compliance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compliance_summary(_levels(spark, sf_dir)).withColumn("porcentaje", F.col("porcentaje").cast("double"))


@query(
    f"""WITH l AS (SELECT {_LEVEL} AS nivel FROM documents)
SELECT CAST(i - 1 AS INTEGER) AS orden, x.nivel, (SELECT count(*) FROM l WHERE l.nivel = x.nivel) AS cantidad
FROM (SELECT unnest(range(1, 5)) AS i, unnest(['cumple', 'parcial', 'omision', 'no_aplica']) AS nivel) x"""
)
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.level_counts(_levels(spark, sf_dir))


@query("SELECT chunk_id FROM (SELECT doc_id AS chunk_id FROM documents) ORDER BY md5(chunk_id || '42'), chunk_id LIMIT 5")
def sample_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.sample_sections(views.sections(spark, sf_dir).select("chunk_id"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS fuente, concat_ws('; ', lang, coalesce(source, '')) AS etiquetas FROM documents")
def flatten_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("fuente"), F.array("lang", F.coalesce("source", F.lit(""))).alias("etiquetas"))
    return compare.flatten(rows)


def _pair_grades(found: DataFrame) -> DataFrame:
    """Grades of a deterministic stand-in by the hash of the pair: three of four are graded, a third of these irrelevant."""
    told = found.select("chunk_id", "element_id", F.pmod(F.xxhash64("chunk_id", "element_id"), F.lit(1320)).alias("h")).where("h % 4 <> 0")
    return told.select("chunk_id", "element_id", F.lit(1).alias("pos"), F.expr("h % 3 <> 0").alias("relevante"), F.expr("(h % 11) / 10D").alias("score_grade"), F.lit("").alias("razon_grade"))


@query()
def compare_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison in one plan: citations, search by the offline embedding, reranking, grades, verdict, lists.

    Every section has a row and its citations. Sections whose id is divisible by 20 are the query set of the search,
    against all articles; the others have null lists of it (`buscada` is false), so their match type tells citations
    only and they have a verdict only where they cite.
    """
    arts = extract.normativa(views.norm_md(spark, sf_dir)).where("tipo_elemento = 'articulo'")
    every = views.sections(spark, sf_dir)
    secs = every.where("chunk_id % 20 = 0")
    # both are stored, as they are read several times, and no scan should parse and embed them again
    path = scratch(spark, "run")
    arts.select("doc_id", "numero", F.xxhash64("element_id").alias("element_id"), V.hash_embedding(F.col("embed_text")).alias("embedding")).write.parquet(f"{path}/articles")
    secs.select(F.col("chunk_id").alias("query_id"), V.hash_embedding(F.col("texto")).alias("embedding")).write.parquet(f"{path}/queries")
    arts, queries = spark.read.parquet(f"{path}/articles"), spark.read.parquet(f"{path}/queries")
    found = compare.lexical_matches(every, arts)
    near = search.alike_top_k(queries, arts.select("element_id", "embedding"), f"{path}/distinct").where(F.col("score") >= P.MIN_SCORE)
    near = near.join(arts.select("element_id", "numero"), "element_id")
    # the reranker and the grader are stand-ins by the pair's hash, as `rerank` and `grade_merge` have theirs by the ids
    scored = near.withColumn("reranker_score", F.pmod(F.xxhash64("query_id", "element_id"), F.lit(7)) / F.lit(7.0) + F.col("score"))
    best = search.rerank(scored).withColumnRenamed("query_id", "chunk_id")
    graded = compare.merge_grades(best, _pair_grades(best))
    semantic = F.transform(F.array_sort(F.collect_list(F.struct("rank", "numero", "score"))), lambda x: F.struct(x.numero.alias("numero"), F.round(x.score, 4).alias("sim")))
    raw = near.groupBy(F.col("query_id").alias("chunk_id")).agg(semantic.alias("articulos_semanticos_raw"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("rank", "numero", "relevante", "score_grade"))), lambda x: F.struct(x.numero.alias("numero"), x.relevante.alias("relevante"), x.score_grade.alias("score")))
    validated = graded.groupBy("chunk_id").agg(told.alias("articulos_validados"), F.count_if("relevante").alias("n_rel"), F.max(F.when(F.col("relevante"), F.col("score_grade"))).alias("grado"))
    cited = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list("numero")).alias("articulos_lexicos"), F.sum("articulos").alias("n_articulos_lexicos"))
    out = every.select("chunk_id", F.coalesce(F.col("chunk_id") % 20 == 0, F.lit(False)).alias("buscada"))
    for part in (cited, raw, validated):
        out = out.join(part, "chunk_id", "left")
    n_lex, n_rel = F.coalesce(F.size("articulos_lexicos"), F.lit(0)), F.coalesce("n_rel", F.lit(0))
    kind = compare.match_type(F.greatest(n_lex, F.lit(0)), n_rel)
    verdict = F.when(F.col("buscada") | (n_lex > 0), compare.stand_in_verdict(n_lex, n_rel, F.col("grado")))
    return out.select(
        "chunk_id", "buscada", "articulos_lexicos", F.coalesce("n_articulos_lexicos", F.lit(0)).alias("n_articulos_lexicos"), "articulos_semanticos_raw",
        "articulos_validados", kind.alias("tipo_coincidencia"), verdict.alias("nivel_cumplimiento"),
    )
