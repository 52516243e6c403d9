"""Injected models that fail, lie or leave things out, and the second style of parsing on small texts."""

from lexloom.functions import patterns as P
from lexloom.operators import compare, extract, judge, search

CANDIDATES = "chunk_id long, element_id string, rank int, numero string, encabezado string, contenido string, score double"


def candidates(spark):
    rows = [(1, "a", 1, "1", "x", "uno dos", 0.9), (1, "b", 2, None, None, None, 0.8), (2, "c", 1, "3", "", "tres", 0.7), (2**60 + 1, "d", 1, "4", "", "", 0.6)]
    return spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([(1, "uno"), (2, None), (2**60 + 1, "cuatro")], "chunk_id long, texto string")


def test_grades_and_failures(spark):
    def grader(text, found):
        if text == "":
            raise RuntimeError("no model")
        score = 1.5 if text == "cuatro" else 0.25
        return [{"element_id": found[0]["element_id"], "relevante": False, "score": score, "razon": "r"}, {"element_id": "other", "relevante": False, "score": 0.0, "razon": ""}]

    got = {(r.chunk_id, r.element_id): (r.relevante, r.score_grade, r.razon_grade, r.estado) for r in judge.grade(*candidates(spark), grader).collect()}
    assert got == {
        (1, "a"): (False, 0.25, "r", "calificado"), (1, "b"): (True, 0.5, "", "sin_calificar"),
        (2, "c"): (True, 0.5, "", "error"), (2**60 + 1, "d"): (True, 0.5, "", "error"),
    }
    found, secs = candidates(spark)
    assert judge.grade(found.where("false"), secs).count() == 0


def test_analysis_keeps_columns_and_tells_failures(spark):
    kind = "array<struct<numero:string,encabezado:string,contenido:string>>"
    rows = [(1, "t", [("5", "e", "c")], None), (2, None, None, [("6", None, "d")]), (3, "malo", [], []), (4, "", None, None)]
    secs = spark.createDataFrame(rows, f"chunk_id long, texto string, lexicos {kind}, relevantes {kind}")

    def analyst(text, kind, references):
        assert text != "malo"
        return {"nivel_cumplimiento": "cumple", "analisis_general": references, "brechas": [kind], "entidades": []}

    got = {r.chunk_id: r for r in judge.analyse(secs, analyst).collect()}
    assert set(secs.columns) < set(got[1].asDict())
    assert [got[i].tipo_coincidencia for i in (1, 2, 3, 4)] == ["lexica", "semantica", "ninguna", "ninguna"]
    assert [got[i].estado_analisis for i in (1, 2, 3, 4)] == ["analizado", "analizado", "error", "analizado"]
    assert got[3].nivel_cumplimiento is None and got[1].analisis_general == P.CITED_TITLE + "Artículo 5: e\nc"
    assert got[2].analisis_general == P.NEAR_TITLE + "[Top 1] Art.6: \nd" and got[4].analisis_general == P.NO_REFERENCES
    lying = judge.analyse(secs, lambda *_: {"nivel_cumplimiento": "bien", "analisis_general": "", "brechas": [], "entidades": []})
    assert {r.estado_analisis for r in lying.collect()} == {"error"}


def test_rerank_without_scorer_and_with_ties(spark):
    found = candidates(spark)[0].selectExpr("*", "'q' AS query", "contenido AS document")
    assert judge.rerank_pairs(found, None, 1).columns == found.columns
    assert {r.element_id for r in judge.rerank_pairs(found, None, 1).collect()} == {"a", "c", "d"}
    tied = judge.rerank_pairs(found, lambda pairs: [1.0] * len(pairs)).collect()
    assert {(r.element_id, r["rank"]) for r in tied} == {("a", 1), ("b", 2), ("c", 1), ("d", 1)}
    assert [r.p for r in spark.sql("SELECT 'x' AS t UNION ALL SELECT NULL").select(judge.prefixed(compare.F.col("t"), "query: ").alias("p")).collect()] == ["query: x", "query: "]


def test_second_style(spark):  # the anchor takes one mark after the number, so ".-" leaves a dash
    md = "Texto\nCapítulo Único. Nombre Art. 3 resto\nArt. 1.- Objeto\nuno\n\n\n\ndos\nCONSIDERANDO:\nArtículo 2a\n" + "x" * 5000 + "\nAnexo II. Lista\nfin"
    docs = spark.createDataFrame([(1, md), (2, ""), (3, "\n \n")], "doc_id long, md string")
    got = [tuple(r) for r in extract.variant_articles(docs).select("numero", "encabezado", "contenido", "seccion").orderBy("posicion").collect()]
    assert got == [("1", "- Objeto", "uno\n\ndos\nCONSIDERANDO:", "CAPÍTULO Único Nombre"), ("2a", None, "x" * 3500, "CONSIDERANDO")]
    told = {r.doc_id: r for r in extract.variant_documents(docs).collect()}
    assert (told[1].titulo, told[1].n_articulos, told[1].n_secciones, told[1].n_anexos) == ("Texto", 2, 2, 1)
    assert [told[i].titulo for i in (2, 3)] == [P.NO_TITLE] * 2 and told[2].fecha == "" and told[2].tipo_norma == "NORMATIVA"
    assert [tuple(r)[2:] for r in extract.variant_annexes(docs).collect()] == [("ANEXO II", "Lista", "fin")]


def test_windows_and_parents(spark):
    rows = spark.createDataFrame([(1, [str(i) for i in range(10)]), (2, ["a"]), (3, [str(i) for i in range(4)])], "doc_id long, ws array<string>")
    got = {(r.doc_id, r.ventana): r.texto for r in extract.overlapping(rows, "ws", 4, 1).collect()}
    assert got == {(1, 0): "0 1 2 3", (1, 1): "3 4 5 6", (1, 2): "6 7 8 9", (2, 0): "a", (3, 0): "0 1 2 3"}
    found = spark.createDataFrame([(1, "p", 0.2), (1, "p", 0.9), (1, "q", 0.5)], "query_id long, parent string, score double")
    assert [(r.parent, r["rank"]) for r in search.parents(found, "parent").orderBy("rank").collect()] == [("p", 1), ("q", 2)]


def test_articles_side(spark):
    arts = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "element_id string, es_referencia boolean")
    links = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.5), ("a", 3, 0.5), ("b", 1, 0.1), ("c", 1, 0.9)], "element_id string, chunk_id long, score double")
    got = {r.element_id: (r.secciones, r.mejor_seccion, r.nivel_adopcion) for r in compare.adoption(arts, links).collect()}
    assert got == {"a": (3, 2, "cubierto"), "b": (1, 1, "parcial"), "c": (1, 1, "no_aplica"), "d": (0, None, "no_cubierto")}
    empty = compare.column_widths(arts.where("false")).collect()
    assert {(r.columna, r.ancho) for r in empty} == {("element_id", 14), ("es_referencia", 17)}
