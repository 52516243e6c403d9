"""Views that the registered queries share, in Spark and in SQL: test tables hold no regulations, so they are derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.session import table


def norm_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md): each document as a regulation; its lines become articles, headings, provisions and annexes."""

    def line(text, at):
        i = at + 1
        n = i.cast("string")
        doc = F.col("doc_id").cast("string")
        day, year = (1 + F.col("doc_id") % 28).cast("string"), (2020 + F.col("doc_id") % 6).cast("string")
        first = F.concat(F.lit("LEY ORGÁNICA "), doc, F.lit("\nQuito, "), day, F.lit(" de marzo de "), year)
        return (
            F.when(i == 1, first).when(i % 7 == 2, F.concat(F.lit("## TÍTULO "), n, F.lit(" "), text))
            .when(i % 11 == 5, F.concat(F.lit("DISPOSICIÓN GENERAL "), text)).when(i % 13 == 6, F.concat(F.lit("ANEXO "), n, F.lit(" "), text))
            .when(i % 17 == 8, F.concat(F.lit("RESUELVE: "), text)).otherwise(F.concat(F.lit("Art. "), (1 + i * 5 % 8).cast("string"), F.lit(".- "), text))
        )

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("md"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query set (ids divisible by 20) and all rows."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    return queries, rows.select(F.col("vec_id").alias("element_id"), "embedding", F.col("label").cast("string").alias("source"))


def sections(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """(chunk_id, doc_id, texto, ...): each document as a section that cites an article; `more` are further columns."""
    cites = F.concat(F.coalesce("text", F.lit("")), F.lit(" según Art. "), (F.col("doc_id") % 9 + 1).cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", cites.alias("texto"), *more)


def parts_sql(name: str, pattern: str, flags: str = "(?im)") -> str:
    """A common table expression like `extract.parts`."""
    p = (flags + pattern).replace("'", "''")
    return f"""{name} AS (
  SELECT doc_id, seq, m AS match, tail, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY seq) - length(m) AS INTEGER) AS posicion
  FROM (SELECT doc_id, unnest(range(len(ms))) AS seq, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap, unnest(gs[2:]) AS tail
        FROM (SELECT doc_id, regexp_extract_all(md, '{p}') AS ms, string_split_regex(md, '{p}') AS gs FROM md) WHERE len(ms) > 0))"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


MD_SQL = """md AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: CASE
  WHEN i = 1 THEN 'LEY ORGÁNICA ' || doc_id || chr(10) || 'Quito, ' || (1 + doc_id % 28) || ' de marzo de ' || (2020 + doc_id % 6)
  WHEN i % 7 = 2 THEN '## TÍTULO ' || i || ' ' || l
  WHEN i % 11 = 5 THEN 'DISPOSICIÓN GENERAL ' || l
  WHEN i % 13 = 6 THEN 'ANEXO ' || i || ' ' || l
  WHEN i % 17 = 8 THEN 'RESUELVE: ' || l
  ELSE 'Art. ' || (1 + i * 5 % 8) || '.- ' || l END), chr(10) || chr(10)) AS md FROM documents)"""

_months = "[" + ", ".join(f"'{m}'" for m in P.MONTHS) + "]"
_trim_head = r"'^[ .:\-–—\t\n]+|[ .:\-–—\t\n]+$', '', 'g'"

#: All expressions for the structure of regulations; DuckDB runs only those that a query reads.
STRUCTURE_SQL = ",\n".join([
    MD_SQL,
    parts_sql("a0", P.ARTICLE), parts_sql("h0", P.HEADING, "(?m)"), parts_sql("p0", P.PROVISION), parts_sql("x0", P.ANNEX), parts_sql("r0", P.RESOLUTION, "(?m)"),
    parts_sql("v0", P.VARIANT_ARTICLE),
    rf"articles AS (SELECT doc_id, seq, upper(regexp_replace(trim(regexp_extract(match, '(?im){P.ARTICLE}', 1)), '[ \t]*[-–][ \t]*', '-', 'g')) AS numero, posicion, tail FROM a0)",
    rf"""headings AS (SELECT doc_id, posicion, regexp_extract(match, '(?m){P.HEADING}', 1) || ' ' || regexp_extract(match, '(?m){P.HEADING}', 2)
  || CASE WHEN {strip_sql(f"regexp_extract(match, '(?m){P.HEADING}', 3)")} <> '' THEN ' — ' || {strip_sql(f"regexp_extract(match, '(?m){P.HEADING}', 3)")} ELSE '' END AS label FROM h0)""",
    f"""provisions AS (SELECT doc_id, seq, regexp_extract(match, '(?im){P.PROVISION}', 1) AS numero, posicion,
  {strip_sql("CASE WHEN instr(rest, chr(10) || chr(10)) > 0 THEN substring(rest, 1, instr(rest, chr(10) || chr(10)) - 1) ELSE substring(rest, 1, 1500) END")} AS contenido
  FROM (SELECT p0.*, substring(md, posicion + length(match) + 1, 3000) AS rest FROM p0 JOIN md USING (doc_id)))""",
    f"""annexes AS (SELECT doc_id, seq, regexp_extract(match, '(?im){P.ANNEX}', 1) AS numero, posicion, {strip_sql(f"regexp_extract(match, '(?im){P.ANNEX}', 2)")} AS titulo FROM x0)""",
    rf"""headed AS (SELECT doc_id, seq, numero, posicion, tail, substring(CASE WHEN valid THEN head ELSE '' END, 1, 250) AS encabezado,
  substring(CASE WHEN valid THEN {strip_sql(f"regexp_extract(tail, '{P.HEADER}', 2)")} ELSE {strip_sql("regexp_replace(tail, '^[ \t]*[.:\\-–—]+[ \t]*', '')")} END, 1, 3000) AS contenido
  FROM (SELECT *, length(head) >= 2 AND len(string_split_regex(head, '\s+')) <= 12 AND NOT regexp_matches(head, '(?i){P.BODY_OPENING}') AS valid
        FROM (SELECT *, regexp_replace(regexp_extract(tail, '{P.HEADER}', 1), {_trim_head}) AS head FROM articles)))""",
    "starts AS (SELECT doc_id, coalesce(min(posicion) FILTER (numero = '1'), min(posicion)) AS start FROM articles GROUP BY doc_id)",
    *[f"first_{n} AS (SELECT doc_id, min(posicion) AS at FROM {t} JOIN starts USING (doc_id) WHERE posicion > start GROUP BY doc_id)" for n, t in (("p", "p0"), ("r", "r0"), ("x", "x0"))],
    """blocks AS (SELECT h.*, coalesce(list_max(list_filter([
    {'at': CASE WHEN s.start <= h.posicion THEN s.start END, 'name': 'articulado'}, {'at': CASE WHEN p.at <= h.posicion THEN p.at END, 'name': 'disposicion'},
    {'at': CASE WHEN r.at <= h.posicion THEN r.at END, 'name': 'resolucion'}, {'at': CASE WHEN x.at <= h.posicion THEN x.at END, 'name': 'anexo'}],
    lambda e: e.at IS NOT NULL)).name, 'preambulo') AS tipo_bloque
  FROM headed h JOIN starts s USING (doc_id) LEFT JOIN first_p p USING (doc_id) LEFT JOIN first_r r USING (doc_id) LEFT JOIN first_x x USING (doc_id))""",
    f"""flagged AS (SELECT * EXCLUDE (cited), cited OR row_number() OVER (PARTITION BY doc_id, numero, cited ORDER BY posicion, seq) > 1 AS es_referencia
  FROM (SELECT b.*, tipo_bloque = 'preambulo' OR regexp_matches(tail, '(?i){P.CITED_AFTER}')
      OR (posicion > 0 AND regexp_matches(substring(md, greatest(1, posicion - 39), least(40, posicion)), '(?i){P.CITED_BEFORE}')) AS cited
        FROM blocks b JOIN md USING (doc_id)))""",
    rf"""metadata AS (SELECT doc_id, upper(regexp_extract(substring(md, 1, 1000), '(?i){P.NORM_KIND}', 1)) AS tipo_norma,
  substring(coalesce(list_filter(list_transform(string_split(md, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '')[1], CAST(doc_id AS VARCHAR)), 1, 200) AS titulo_norma,
  coalesce(list_filter(list_transform(regexp_extract_all(substring(md, 1, 3000), '(?i)\b{P.DATE}\b'), lambda d: regexp_extract(d, '(?i){P.DATE}', 3) || '-'
    || lpad(CAST(list_position({_months}, lower(regexp_extract(d, '(?i){P.DATE}', 2))) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(d, '(?i){P.DATE}', 1), 2, '0')),
    lambda d: length(d) = 10)[1], '') AS fecha FROM md)""",
    "paths AS (SELECT doc_id, posicion, concat_ws(' > ', lag(label, 2) OVER w, lag(label, 1) OVER w, label) AS path FROM headings WINDOW w AS (PARTITION BY doc_id ORDER BY posicion))",
    """elements AS (
  SELECT doc_id, seq, numero, encabezado, contenido, 'articulo' AS tipo_elemento, tipo_bloque, es_referencia, posicion, 0 AS rango FROM flagged
  UNION ALL SELECT doc_id, seq, numero, numero, contenido, 'disposicion', 'disposicion', false, posicion, 1 FROM provisions
  UNION ALL SELECT doc_id, seq, numero, CASE WHEN titulo <> '' THEN titulo ELSE numero END, titulo, 'anexo', 'anexo', false, posicion, 2 FROM annexes)""",
    """placed AS (SELECT e.*, coalesce(p.path, '') AS seccion, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.posicion, rango, seq) - 1 AS orden
  FROM elements e ASOF LEFT JOIN paths p ON e.doc_id = p.doc_id AND e.posicion >= p.posicion)""",
])


def structure(select: str) -> str:
    return f"WITH {STRUCTURE_SQL}\n{select}"
