"""Answers of every kind, and whole runs whose models fail, lie or answer in other words."""

import json

from pyspark.sql import functions as F

from lexloom.operators import answers as A
from lexloom.operators import run as R

GOOD = {"tipo_coincidencia": "lexica", "nivel_cumplimiento": "parcial", "analisis_general": "bien"}


def test_verdicts_end_in_a_state(spark):
    full = GOOD | {"analisis_lexico": "a", "analisis_semantico_top1": "b", "brechas": ["x", "y"], "ner_general": ["n"], "entidades_financieras": ["5 %"], "entidades_normativas": ["Art. 1"]}
    cases = {
        "full": (json.dumps(full), "analizado"), "short": (f"Claro:\n```json\n{json.dumps(GOOD, indent=1)}\n```\nEso.", "analizado"),
        "none": (None, "sin_respuesta"), "blank": (" \n", "sin_respuesta"), "prose": ("no lo sé", "malformado"), "cut": (json.dumps(full)[:-30] + "}", "malformado"),
        "kind": (json.dumps(GOOD | {"brechas": "una"}), "malformado"), "partial": (json.dumps({"nivel_cumplimiento": "cumple"}), "incompleto"),
        "null": (json.dumps(GOOD | {"analisis_general": None}), "incompleto"), "level": (json.dumps(GOOD | {"nivel_cumplimiento": "bien"}), "fuera_de_rango"),
        "type": (json.dumps(GOOD | {"tipo_coincidencia": "otra"}), "fuera_de_rango"), "hole": (json.dumps(GOOD | {"brechas": ["a", None]}), "fuera_de_rango"),
        "more": (json.dumps(GOOD | {"otro": {"a": 1}}), "analizado"), "empty": ("{}", "incompleto"),
    }
    rows = spark.createDataFrame([(k, v[0], "mine") for k, v in cases.items()], "k string, a string, brechas string")
    got = {r.k: r for r in A.parse_verdict(rows, "a").collect()}
    assert {k: r.estado_analisis for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert {c: got["full"][c] for c in full} == full and got["short"].brechas == [] and got["short"].analisis_lexico is None
    assert all(r.nivel_cumplimiento is None and r.brechas == [] for k, r in got.items() if cases[k][1] != "analizado")


def test_grades_end_in_a_state(spark):
    grade = {"element_id": "e", "relevante": True, "score": 0.5, "razon": "r"}
    told = lambda **more: json.dumps({"candidatos": [grade, grade | more]})
    cases = [
        (told(), "calificado"), (told(score=1.2), "fuera_de_rango"), (told(score=-0.1), "fuera_de_rango"), (told(razon=None), "incompleto"),
        (told(relevante="sí"), "malformado"), (told(score=1), "calificado"), ('{"candidatos": []}', "calificado"), ("{}", "incompleto"), (None, "sin_respuesta"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string")
    got = {r.i: r for r in A.parse_grades(rows, "a").collect()}
    assert [got[i].estado_grados for i in range(len(cases))] == [c[1] for c in cases]
    assert len(got[0].candidatos) == 2 and got[0].candidatos[0].score == 0.5 and got[1].candidatos == []


def tables(spark):
    secs = [(3, "tasa fija Art. 1", "1.3", "z"), (1, "crédito seguro plazo", "1.1", "x"), (2, "nada que ver", "1.2", "y"), (4, None, None, None)]
    arts = [(10, "10_0", "1", "Objeto", "el objeto", 0), (10, "10_1", "2", "", "crédito seguro plazo largo", 1), (10, "10_2", "3", None, None, 2), (11, "11_0", "1", "Otra", "tasa fija", 0)]
    scope = [(i, 10) for i in (1, 2, 3, 3)]
    return (
        spark.createDataFrame(secs, "chunk_id long, texto string, jerarquia string, brechas string"),
        spark.createDataFrame(arts, "doc_id long, element_id string, numero string, encabezado string, contenido string, orden int"),
        spark.createDataFrame(scope, "chunk_id long, norm_id long"),
    )


def test_a_run_keeps_rows_order_and_columns(spark):
    rows = R.compare_all(*tables(spark)).collect()
    assert [r.chunk_id for r in rows] == [1, 2, 3, 4] and [r.jerarquia for r in rows] == ["1.1", "1.2", "1.3", None]
    assert [r.tipo_coincidencia for r in rows] == ["semantica", "ninguna", "lexica", "ninguna"]
    assert [r.nivel_cumplimiento for r in rows] == ["parcial", "omision", "cumple", "omision"] and {r.estado_analisis for r in rows} == {"analizado"}
    one, three = rows[0], rows[2]
    assert [a.numero for a in one.articulos_semanticos_raw] == ["2"] and one.articulos_validados[0].relevante and one.articulos_lexicos == []
    assert three.articulos_lexicos == ["1"] and three.analisis_lexico == "citado" and one.brechas[0].startswith("parcial: ")
    wanted = {*A.TEXTS, *A.LISTS, "articulos_lexicos", "articulos_semanticos_raw", "articulos_validados", "texto", "jerarquia"}
    assert wanted <= set(rows[0].asDict())
    late = R.compare_all(*tables(spark), order=["texto"]).collect()
    assert [r.chunk_id for r in late] == [4, 1, 2, 3]


def test_failures_cost_their_own_section(spark):
    def analyst(text, kind, hierarchy, references):
        if hierarchy == "1.2":
            raise RuntimeError("no model")
        return "???" if hierarchy == "1.3" else A.level_answer(text, kind, hierarchy, references)

    def scorer(pairs):
        if any("crédito" in q for q, _ in pairs):
            raise ValueError("no scorer")
        return [0.5] * len(pairs)

    got = {r.chunk_id: r for r in R.compare_all(*tables(spark), R.Models(analyst=analyst)).collect()}
    assert (got[2].estado_analisis, got[2].nivel_cumplimiento, got[2].analisis_general) == ("error", "no_aplica", "Error en análisis: RuntimeError: no model")
    assert (got[3].estado_analisis, got[3].nivel_cumplimiento, got[3].tipo_coincidencia) == ("malformado", "no_aplica", "lexica") and got[1].estado_analisis == "analizado"
    got = {r.chunk_id: r for r in R.compare_all(*tables(spark), R.Models(scorer=scorer), R.Settings(least=0.0)).collect()}
    empty = got[1]
    assert (empty.tipo_coincidencia, empty.nivel_cumplimiento, empty.analisis_general, empty.estado_analisis) == ("ninguna", "no_aplica", R.EMPTY_TEXT, "error")
    assert empty.articulos_semanticos_raw == [] and empty.analisis_lexico is None and got[3].estado_analisis == "analizado"


def test_settings_prefixes_and_no_scorer(spark):
    seen = R.compare_all(*tables(spark), R.Models(scorer=None), R.Settings(k=2, n=1, least=0.0)).where("chunk_id = 1").first()
    assert len(seen.articulos_semanticos_raw) == 2 and len(seen.articulos_validados) == 1
    far = R.compare_all(*tables(spark), settings=R.Settings(least=0.99)).where("chunk_id = 1").first()
    assert far.articulos_semanticos_raw == [] and far.tipo_coincidencia == "ninguna"
    same = R.Models(query_prefix="p " * 50, passage_prefix="p " * 50)
    assert len(R.compare_all(*tables(spark), same).where("chunk_id = 2").first().articulos_semanticos_raw) == 3


def test_missing_columns_fall_back(spark):
    secs, arts, scope = tables(spark)
    other = secs.select("chunk_id", F.col("texto").alias("contenido"), F.col("jerarquia").alias("seccion"))
    a = [r.tipo_coincidencia for r in R.compare_all(other, arts, scope).collect()]
    assert a == ["semantica", "ninguna", "lexica", "ninguna"]
    assert R.compare_all(secs.where("false"), arts, scope).count() == 0
