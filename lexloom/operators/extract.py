"""Structure of regulations: anchors with exact positions, headers, sections as of a position, blocks, flags.

`parts` gives every match of a pattern with its position and the text up to the next match: markers stand at the start of
a line, so the text is split into lines, and positions are running sums of the lengths of gaps and matches. No Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions.text import collapse_lines, strip

FLAGS = {"article": "(?dmiu)", "heading": "(?dm)", "provision": "(?dmiu)", "annex": "(?dmiu)", "resolution": "(?dm)"}
#: How the patterns start whose matches are found line by line.
LINE_START = r"(?:^|\n)"
#: From the first character that is no white space to the end of its line.
FIRST_LINE = r"(?U)\S[^\n]*"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`; a value that a lambda reads is computed once."""
    return F.transform(F.array(value), body)[0]


def _whole(text: Column, pattern: str) -> Column:
    """The matches of a pattern in a text (m) and the gaps around them (g), by two scans of the whole text."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))


def _by_lines(text: Column, lines: Column, pattern: str) -> Column:
    """What `_whole` gives, where a pattern starts at a line and ends there or in the next one: each line is tried once,
    at its start, instead of every character twice.

    A match that ends in the next line takes it, so that no other starts there; the few texts with a second match in
    such a line are scanned as a whole.
    """
    flags, start, rest = pattern.partition(LINE_START)
    breaks = rest.replace(r"[^\n]", "").count(r"\n")
    if not start or r"\s" in rest or breaks > rest.count(r"\n?") or breaks > 1:
        return _whole(text, pattern)
    anchored = rf"{flags}\A{rest}"

    def match(x: Column, i: Column) -> Column:
        if not breaks:
            return F.regexp_extract(x, anchored, 0)
        return F.when(x.rlike(anchored), F.regexp_extract(F.concat_ws("\n", x, F.get(lines, i + 1)), anchored, 0)).otherwise("")

    def told(hits: Column) -> Column:
        def after(h: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(hits, k + 1)["i"], F.size(lines))
            return F.substr(F.array_join(F.slice(lines, h.i + 1, stop - h.i), "\n"), F.length(h.m) + 1)

        before = F.array_join(F.slice(lines, 1, F.get(hits, F.lit(0))["i"]), "\n")
        found = F.transform(hits, lambda h: F.concat(F.when(h.i > 0, "\n").otherwise(""), h.m))
        by_lines = F.struct(found.alias("m"), F.concat(F.array(before), F.transform(hits, after)).alias("g"))
        if not breaks:
            return by_lines
        taken = F.exists(F.transform(hits, lambda h, k: F.contains(h.m, F.lit("\n")) & F.coalesce(F.get(hits, k + 1)["i"] == h.i + 1, F.lit(False))), lambda x: x)
        return F.when(taken, _whole(text, pattern)).otherwise(by_lines)

    each = F.transform(lines, lambda x, i: F.struct(i.alias("i"), match(x, i).alias("m")))
    return _once(F.filter(each, lambda h: h.m != ""), told)


def _listed(kind: str, found: Column, want: set[str]) -> Column:
    """The matches of one pattern in a row, in order, as an array of structs: `found` has the matches m and the gaps g
    around them.

    `skip` is the length of the gap and the match together. On demand: `tail`, the text up to the next match; `before`,
    the 40 characters before a match (seven shortest matches are longer); `after`, the 3000 characters behind it.
    """
    none = F.lit(None).cast("string")

    def listed(r: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            gap = F.get(r.g, i)
            before = F.concat(*[F.coalesce(F.get(r.near, i - k), F.lit("")) for k in range(6, 0, -1)], F.substring(gap, -40, 40))
            after = F.substring(F.array_join(F.slice(r.next, i + 2, 151), ""), 1, 3000)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("seq"), x.alias("match"), (F.length(gap) + F.length(x)).alias("skip"), (i == F.size(r.m) - 1).alias("last"),
                (F.coalesce(F.get(r.g, i + 1), F.lit("")) if "tail" in want else none).alias("tail"),
                (F.substring(before, -40, 40) if "before" in want else none).alias("before"), (after if "after" in want else none).alias("after"),
            )

        return F.transform(r.m, one)

    ends = lambda at: lambda r: F.transform(r.g, lambda y, j: F.concat(F.substring(y, *at), F.coalesce(F.get(r.m, j), F.lit(""))))
    near = (lambda r: ends((-40, 40))(r)) if "before" in want else lambda r: F.array().cast("array<string>")
    ahead = (lambda r: ends((1, 3000))(r)) if "after" in want else lambda r: F.array().cast("array<string>")
    with_ends = lambda r: F.struct(r.m.alias("m"), r.g.alias("g"), near(r).alias("near"), ahead(r).alias("next"))
    return _once(_once(found, with_ends), listed)


def matches(docs: DataFrame, patterns: dict[str, tuple[str, set[str]]], text: str = "md", keep: tuple[str, ...] = (), told: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(doc_id, kind, seq, match, last, tail, before, after, posicion, ...) of every match of all patterns, by one scan and
    one shuffle; `patterns` has for each kind the pattern and which of tail, before and after are wanted. What `told` reads
    of a match and the text around it is read before the shuffle."""
    rows = docs.select("doc_id", *keep, F.col(text).alias("_text"), F.split(text, "\n", -1).alias("_lines"))
    lists = [_listed(kind, _by_lines(F.col("_text"), F.col("_lines"), p), want) for kind, (p, want) in patterns.items()]
    # an outer explode, as the filter that Spark puts before an inner one would run all patterns once more
    each = rows.select("doc_id", *keep, F.explode_outer(F.concat(*lists)).alias("x")).where("x.kind IS NOT NULL").select("doc_id", *keep, "x.*")
    so_far = W.partitionBy("doc_id", "kind").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    position = F.sum("skip").over(so_far) - F.length("match")
    return told(each).repartition("doc_id").withColumn("posicion", position.cast("int")).drop("skip")


def parts(docs: DataFrame, pattern: str, text: str = "md", want: set[str] = frozenset({"tail"})) -> DataFrame:
    """(doc_id, seq, match, tail, last, posicion) of each match in order."""
    return matches(docs, {"": (pattern, want)}, text).drop("kind")


def number(match: Column, pattern: str) -> Column:
    return F.upper(F.regexp_replace(strip(F.regexp_extract(match, pattern, 1)), "[ \\t]*[-–][ \\t]*", "-"))


def articles(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, numero, posicion, tail)."""
    pattern = FLAGS["article"] + P.ARTICLE
    return parts(docs, pattern).select("doc_id", "seq", number(F.col("match"), pattern).alias("numero"), "posicion", "tail")


def with_header(arts: DataFrame) -> DataFrame:
    """Split the tail of an article into encabezado and contenido."""
    lead = P.HEADER.removesuffix(r"[\s\S]*)$") + ")"  # whether it matches, and its first group, don't depend on the rest
    found = F.regexp_replace(F.regexp_extract("tail", lead, 1), r"^[ .:\-–—\t\n]+|[ .:\-–—\t\n]+$", "")
    head, valid = F.col("_head"), F.col("_valid")
    arts = arts.withColumn("_head", found)
    arts = arts.withColumn("_valid", (F.length(head) >= 2) & (F.size(F.split(head, r"\s+")) <= 12) & ~head.rlike("(?iu)" + P.BODY_OPENING))
    body = strip(F.regexp_extract("tail", P.HEADER, 2))
    rest = strip(F.regexp_replace("tail", r"^[ \t]*[.:\-–—]+[ \t]*", ""))
    return arts.withColumns(
        {"encabezado": F.substring(F.when(valid, head).otherwise(""), 1, 250), "contenido": F.substring(F.when(valid, body).otherwise(rest), 1, 3000)}
    ).drop("_head", "_valid")


def _heading_label(pattern: str) -> Column:
    group = lambda i: F.regexp_extract("match", pattern, i)
    title = strip(group(3))
    return F.concat(group(1), F.lit(" "), group(2), F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(""))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, posicion, label) of the hierarchy markers."""
    pattern = FLAGS["heading"] + P.HEADING
    return parts(docs, pattern, want=frozenset()).select("doc_id", "posicion", _heading_label(pattern).alias("label"))


def with_section(elements: DataFrame, marks: DataFrame, last: int = 3) -> DataFrame:
    """seccion: the last markers at or before each element, an as-of join as one window over both."""
    in_order = W.partitionBy("doc_id").orderBy("posicion")
    path = F.concat_ws(" > ", *[F.lag("label", i).over(in_order) for i in range(last - 1, 0, -1)], "label")
    marked = marks.where("doc_id IS NOT NULL").select("doc_id", "posicion", path.alias("_path"), F.lit(0).alias("_kind"))
    both = elements.where("doc_id IS NOT NULL").withColumn("_kind", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    so_far = W.partitionBy("doc_id").orderBy("posicion", "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("seccion", F.coalesce(F.last("_path", ignorenulls=True).over(so_far), F.lit("")))
    return seen.where("_kind = 1").drop("_path", "_kind")


def _provision_body() -> Column:
    """Of the text behind a match: up to a blank line within 3000 characters, else 1500."""
    stop = F.instr("after", "\n\n")
    return strip(F.when(stop > 0, F.substring(F.col("after"), F.lit(1), stop - 1)).otherwise(F.substring("after", 1, 1500)))


def provisions(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, numero, posicion, contenido): up to a blank line within 3000 characters, else 1500."""
    pattern = FLAGS["provision"] + P.PROVISION
    found = parts(docs, pattern, want=frozenset({"after"})).where("doc_id IS NOT NULL")
    return found.select("doc_id", "seq", F.regexp_extract("match", pattern, 1).alias("numero"), "posicion", _provision_body().alias("contenido"))


def annexes(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, numero, posicion, titulo)."""
    pattern = FLAGS["annex"] + P.ANNEX
    return parts(docs, pattern, want=frozenset()).select(
        "doc_id", "seq", F.regexp_extract("match", pattern, 1).alias("numero"), "posicion", strip(F.regexp_extract("match", pattern, 2)).alias("titulo")
    )


#: The kinds of matches that blocks and flags are told by, and what they need of the text around a match.
_STRUCTURE = {
    "articulo": (FLAGS["article"] + P.ARTICLE, {"tail", "before"}), "disposicion": (FLAGS["provision"] + P.PROVISION, {"after"}),
    "resolucion": (FLAGS["resolution"] + P.RESOLUTION, set()), "anexo": (FLAGS["annex"] + P.ANNEX, set()),
}


def _read(found: DataFrame) -> DataFrame:
    """Matches of `_STRUCTURE` with numero, encabezado, contenido and `cited` instead of the text around them."""
    article = F.col("kind") == "articulo"
    pattern = {k: p for k, (p, _) in _STRUCTURE.items()}
    rows = with_header(found.withColumn("tail", F.when(article, F.col("tail"))))
    title = strip(F.regexp_extract("match", pattern["anexo"], 2))
    named = F.regexp_extract("match", pattern["anexo"], 1)
    rows = rows.withColumns({
        "numero": F.when(article, number(F.col("match"), pattern["articulo"])).when(F.col("kind") == "disposicion", F.regexp_extract("match", pattern["disposicion"], 1)).when(F.col("kind") == "anexo", named),
        "contenido": F.when(article, F.col("contenido")).when(F.col("kind") == "disposicion", _provision_body()).when(F.col("kind") == "anexo", title),
        "cited": article & (F.col("tail").rlike("(?iu)" + P.CITED_AFTER) | F.col("before").rlike("(?diu)" + P.CITED_BEFORE)),
    })
    return rows.drop("tail", "before", "after", "last")


def _flagged(rows: DataFrame) -> DataFrame:
    """Matches that `_read` has read, with tipo_bloque and es_referencia of the articles.

    All is told within the document's rows, which one shuffle has brought together: the articles start at the first
    number 1 (else the first article), later openings follow; a citation of another norm is told by the block, by the
    words around it, or by a number that the document has had before.
    """
    article = F.col("kind") == "articulo"
    doc = W.partitionBy("doc_id")
    rows = rows.withColumn("start", F.coalesce(F.min(F.when(article & (F.col("numero") == "1"), F.col("posicion"))).over(doc), F.min(F.when(article, F.col("posicion"))).over(doc)))
    later = ["disposicion", "resolucion", "anexo"]
    rows = rows.withColumns({f"_{k}": F.min(F.when((F.col("kind") == k) & (F.col("posicion") > F.col("start")), F.col("posicion"))).over(doc) for k in later})
    opened = F.array(*[F.struct(F.when(F.col(c) <= F.col("posicion"), F.col(c)).alias("at"), F.lit(n).alias("name")) for c, n in (("start", "articulado"), *((f"_{k}", k) for k in later))])
    latest = F.array_max(F.filter(opened, lambda x: x.at.isNotNull()))
    rows = rows.withColumn("tipo_bloque", F.coalesce(latest["name"], F.lit("preambulo"))).drop("start", *(f"_{k}" for k in later))
    rows = rows.withColumn("cited", F.col("cited") | (F.col("tipo_bloque") == "preambulo"))
    nth = F.row_number().over(W.partitionBy("doc_id", "kind", "numero", "cited").orderBy("posicion", "seq"))
    return rows.withColumn("es_referencia", F.col("cited") | (nth > 1)).drop("cited")


def flagged_articles(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, numero, posicion, encabezado, contenido, tipo_bloque, es_referencia): articles with their blocks, and
    whether they are citations of other norms or repeat a number."""
    found = matches(docs.where("doc_id IS NOT NULL"), _STRUCTURE, told=_read)
    return _flagged(found).where("kind = 'articulo'").drop("kind", "match")


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, tipo_norma, titulo_norma, fecha)."""
    return docs.select("doc_id", *[c.alias(n) for n, c in _metadata().items()])


def _metadata() -> dict[str, Column]:
    first = F.nullif(strip(F.regexp_extract("md", FIRST_LINE, 0)), F.lit(""))
    head = F.substring("md", 1, 3000)
    dates = F.regexp_extract_all(head, F.lit("(?iU)\\b" + P.DATE + "\\b"), F.lit(0))
    month = F.create_map(*[x for i, m in enumerate(P.MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    iso = F.transform(dates, lambda d: F.concat_ws("-", F.regexp_extract(d, "(?iU)" + P.DATE, 3), F.element_at(month, F.lower(F.regexp_extract(d, "(?iU)" + P.DATE, 2))), F.lpad(F.regexp_extract(d, "(?iU)" + P.DATE, 1), 2, "0")))
    valid = F.filter(iso, lambda d: F.length(d) == 10)
    return {
        "tipo_norma": F.upper(F.regexp_extract(F.substring("md", 1, 1000), "(?iu)" + P.NORM_KIND, 1)),
        "titulo_norma": F.substring(F.coalesce(first, F.col("doc_id").cast("string")), 1, 200), "fecha": F.coalesce(F.get(valid, F.lit(0)), F.lit("")),
    }


def embed_text(section: Column, kind: Column, num: Column, header: Column, body: Column) -> Column:
    label = F.concat(F.when(kind == "articulo", F.concat(F.lit("Artículo "), num)).otherwise(num), F.when((header != "") & (header != num), F.concat(F.lit(": "), header)).otherwise(""))
    return F.concat_ws("\n", F.nullif(section, F.lit("")), label, F.nullif(F.substring(body, 1, 1200), F.lit("")))


def normativa(docs: DataFrame) -> DataFrame:
    """One row per article, provision and annex, in order of position, with the fixed columns.

    One scan of the documents finds all matches with the documents' metadata, and one shuffle brings a document's rows
    together; everything else is windows over them.
    """
    told = docs.where("doc_id IS NOT NULL").withColumns(_metadata())
    heading = FLAGS["heading"] + P.HEADING
    found = matches(told, {**_STRUCTURE, "titulo": (heading, set())}, keep=("tipo_norma", "titulo_norma", "fecha"), told=_read)
    rows = _flagged(found).where("kind <> 'resolucion'")
    element, article = F.col("kind") != "titulo", F.col("kind") == "articulo"
    in_order = W.partitionBy("doc_id", "kind").orderBy("posicion")
    rows = rows.withColumn("label", F.when(~element, _heading_label(heading)))
    path = F.concat_ws(" > ", F.lag("label", 2).over(in_order), F.lag("label", 1).over(in_order), "label")
    rows = rows.withColumns({"path": F.when(~element, path), "element": element})
    so_far = W.partitionBy("doc_id").orderBy("posicion", "element").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("seccion", F.coalesce(F.last("path", ignorenulls=True).over(so_far), F.lit(""))).where("element")
    rank = F.when(article, 0).when(F.col("kind") == "disposicion", 1).otherwise(2)
    rows = rows.withColumn("rango", rank).withColumn("orden", F.row_number().over(W.partitionBy("doc_id").orderBy("posicion", "rango", "seq")) - 1)
    annex = F.when(F.col("contenido") != "", F.col("contenido")).otherwise(F.col("numero"))
    rows = rows.withColumns({
        "encabezado": F.when(article, F.col("encabezado")).when(F.col("kind") == "disposicion", F.col("numero")).otherwise(annex),
        "tipo_bloque": F.when(article, F.col("tipo_bloque")).otherwise(F.col("kind")), "es_referencia": article & F.col("es_referencia"), "tipo_elemento": F.col("kind"),
    })
    text = embed_text(F.col("seccion"), F.col("tipo_elemento"), F.col("numero"), F.col("encabezado"), F.col("contenido"))
    rows = rows.withColumns({"element_id": F.format_string("%s_%04d", F.col("doc_id").cast("string"), "orden"), "embed_text": text})
    columns = "doc_id posicion numero encabezado contenido tipo_elemento tipo_bloque es_referencia seccion tipo_norma titulo_norma fecha orden element_id embed_text"
    return rows.select(*columns.split())


def variant(docs: DataFrame) -> DataFrame:
    """The second style of article parsing: header on the anchor's line, bodies of at most 3500 characters, the single
    latest marker as section, the kind of norm by priority."""
    pattern = FLAGS["article"] + P.VARIANT_ARTICLE
    arts = parts(docs, pattern)
    body = F.when(F.col("last"), F.substring("tail", 1, 4000)).otherwise(F.col("tail"))
    arts = arts.select(
        "doc_id", "seq", F.regexp_extract("match", pattern, 1).alias("numero"), strip(F.regexp_extract("match", pattern, 2)).alias("encabezado"),
        F.substring(strip(body), 1, 3500).alias("contenido"), "posicion",
    )
    marks = headings(docs).unionByName(provisions(docs).select("doc_id", "posicion", F.col("numero").alias("label")))
    head = F.upper(F.substring("md", 1, 800))
    kind = F.coalesce(*[F.when(F.contains(head, F.lit(k)), k) for k in P.VARIANT_KINDS], F.lit("NORMATIVA"))
    return with_section(arts, marks, last=1).join(docs.select("doc_id", kind.alias("tipo_norma")), "doc_id")


def variant_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, posicion, label) of the second style: kind in capitals, name and a title of at most 80 characters; a
    title ends where an article starts on its line."""
    patterns = {"titulo": FLAGS["heading"] + P.VARIANT_HEADING, "disposicion": FLAGS["provision"] + P.PROVISION, "resolucion": FLAGS["resolution"] + P.VARIANT_RESOLUTION}
    group = lambda kind, i: strip(F.regexp_extract("match", patterns[kind], i))
    title = F.substring(strip(F.regexp_replace(group("titulo", 3), P.VARIANT_TITLE_END, "")), 1, 80)
    label = F.when(F.col("kind") == "titulo", F.concat_ws(" ", F.upper(group("titulo", 1)), group("titulo", 2), F.nullif(title, F.lit(""))))
    for other in ("disposicion", "resolucion"):
        label = label.when(F.col("kind") == other, F.upper(group(other, 1)))
    return matches(docs, {k: (p, set()) for k, p in patterns.items()}).select("doc_id", "posicion", label.alias("label"))


def _variant_bodies(rows: DataFrame, longest: int, most: int) -> DataFrame:
    """contenido from tail: a document's last one ends after `longest` characters, all are cut at `most`."""
    body = F.when(F.col("last"), F.substring("tail", 1, longest)).otherwise(F.col("tail"))
    return rows.withColumn("contenido", F.substring(collapse_lines(strip(body)), 1, most))


def variant_articles(docs: DataFrame) -> DataFrame:
    """(doc_id, posicion, seq, numero, encabezado, contenido, seccion) in the second style; the section is the single
    latest mark, and a missing header is null."""
    pattern = FLAGS["article"] + P.VARIANT_ARTICLE
    rows = _variant_bodies(parts(docs, pattern), 4000, 3500)
    header = F.nullif(strip(F.regexp_extract("match", pattern, 2)), F.lit(""))
    rows = rows.select("doc_id", "seq", F.regexp_extract("match", pattern, 1).alias("numero"), header.alias("encabezado"), "contenido", "posicion")
    return with_section(rows, variant_marks(docs), last=1)


def variant_annexes(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, identificador, titulo, contenido): an annex reaches to the next one, the last 6000 characters."""
    pattern = FLAGS["annex"] + P.ANNEX
    rows = _variant_bodies(parts(docs, pattern), 6000, 6000)
    group = lambda i: strip(F.regexp_extract("match", pattern, i))
    return rows.select("doc_id", "seq", F.upper(group(1)).alias("identificador"), group(2).alias("titulo"), "contenido")


def variant_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, titulo, tipo_norma, fecha, n_articulos, n_secciones, n_anexos) in the second style."""
    lines = F.transform(F.slice(F.split("md", "\n", -1), 1, 30), strip)
    named = F.filter(lines, lambda x: (F.length(x) > 15) & F.exists(F.array(*map(F.lit, P.VARIANT_TITLE_WORDS)), lambda w: F.contains(F.upper(x), w)))
    title = F.coalesce(F.get(named, F.lit(0)), F.nullif(strip(F.regexp_extract("md", FIRST_LINE, 0)), F.lit("")), F.lit(P.NO_TITLE))
    head = F.upper(F.substring("md", 1, 800))
    kind = F.coalesce(*[F.when(F.contains(head, F.lit(k)), k) for k in P.VARIANT_KINDS], F.lit("NORMATIVA"))
    date = F.regexp_extract(F.substring("md", 1, 3000), "(?i)\\b" + P.MONTH_DATE + "\\b", 0)
    group = lambda i: F.regexp_extract(date, "(?i)" + P.MONTH_DATE, i)
    date = F.when(date == "", "").otherwise(F.concat_ws(" de ", group(1), F.lower(group(2)), group(3)))
    marks = [FLAGS["heading"] + P.VARIANT_HEADING, FLAGS["provision"] + P.PROVISION, FLAGS["resolution"] + P.VARIANT_RESOLUTION]
    found = {"n_articulos": [FLAGS["article"] + P.VARIANT_ARTICLE], "n_secciones": marks, "n_anexos": [FLAGS["annex"] + P.ANNEX]}
    counts = {name: reduce(add, [F.coalesce(F.regexp_count("md", F.lit(p)), F.lit(0)) for p in ps]).cast("long").alias(name) for name, ps in found.items()}
    return docs.select("doc_id", F.substring(title, 1, 300).alias("titulo"), kind.alias("tipo_norma"), date.alias("fecha"), *counts.values())


def overlapping(rows: DataFrame, words: str, size: int = 128, overlap: int = 32) -> DataFrame:
    """`rows` once for each window of `size` words, each of which repeats the last `overlap` words of the one before;
    (ventana, texto) instead of the array `words`. The other columns tell the parent."""
    step = size - overlap
    windows = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / step)).cast("int")
    each = rows.withColumn("ventana", F.explode(F.sequence(F.lit(0), windows - 1)))
    return each.withColumn("texto", F.array_join(F.slice(words, F.col("ventana") * step + 1, size), " ")).drop(words)


def heading_chunks(docs: DataFrame, most: int = P.MAX_TOKENS) -> DataFrame:
    """(doc_id, chunk, heading_path, texto, n_tokens, embed_text): words between headings in runs of at most `most`.

    Levels nest: a heading holds until one of its own or a higher level. White-space words stand for tokens.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("at", "line"))
    level = F.length(F.regexp_extract("line", P.MARKDOWN_HEADING, 1))
    lines = lines.withColumns({"level": level, "title": strip(F.regexp_extract("line", P.MARKDOWN_HEADING, 2))})
    so_far = W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    names = {f"p{i}": F.max(F.when(F.col("level") == i, F.col("at"))).over(so_far) for i in (1, 2, 3)}
    names |= {f"t{i}": F.last(F.when(F.col("level") == i, F.col("title")), ignorenulls=True).over(so_far) for i in (1, 2, 3)}
    names["section"] = F.sum((F.col("level") > 0).cast("int")).over(so_far)
    seen = lines.withColumns(names)
    above2 = F.coalesce("p1", F.lit(-1))
    above3 = F.greatest(above2, F.coalesce("p2", F.lit(-1)))
    path = F.concat_ws(" > ", "t1", F.when(F.col("p2") > above2, F.col("t2")), F.when(F.col("p3") > above3, F.col("t3")))
    body = seen.withColumn("path", path).where("level = 0")
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.filter(F.split(x.line, r"[ \t]+"), lambda w: w != "")))
    sections = body.groupBy("doc_id", "section").agg(F.max("path").alias("heading_path"), words.alias("words")).where("size(words) > 0")
    cut = sections.select("doc_id", "section", "heading_path", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / most))).alias("part"))
    part = F.slice("words", (F.col("part") * most + 1).cast("int"), most)
    cut = cut.select("doc_id", "section", "part", "heading_path", F.array_join(part, " ").alias("texto"), F.size(part).alias("n_tokens"))
    number_ = F.row_number().over(W.partitionBy("doc_id").orderBy("section", "part")) - 1
    text = F.concat_ws("\n", F.nullif("heading_path", F.lit("")), "texto")
    return cut.select("doc_id", number_.alias("chunk"), "heading_path", "texto", "n_tokens", text.alias("embed_text"))
