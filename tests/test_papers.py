"""Working papers: six sheets, template and rules as data, and readers that never see half a set."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import run as R
from lexloom.sources import papers as W


def bundle(spark):
    secs = [(1, "crédito seguro plazo", "1.1"), (2, "nada que ver", "1.2"), (3, 'tasa "fija", Art. 1\nsigue', "1.3"), (4, "falla", "1.4")]
    arts = [(10, "10_0", "1", "Objeto", "el objeto", 0, False), (10, "10_1", "2", "", "crédito seguro plazo largo", 1, False), (10, "10_2", "3", None, None, 2, True), (10, "10_3", "4", "", "otra cosa", 3, False)]
    secs = spark.createDataFrame(secs, "chunk_id long, texto string, jerarquia string")
    arts = spark.createDataFrame(arts, "doc_id long, element_id string, numero string, encabezado string, contenido string, orden int, es_referencia boolean")

    def analyst(text, kind, hierarchy, references):
        return "???" if text == "falla" else R.answers.level_answer(text, kind, hierarchy, references)

    done = R.compare_all(secs, arts, secs.select("chunk_id", F.lit(10).cast("long").alias("norm_id")), R.Models(analyst=analyst))
    links = spark.createDataFrame([("10_0", 3, 1.0, "lexica"), ("10_1", 1, 0.3, "semantica"), ("10_1", 1, 0.2, "lexica")], "element_id string, chunk_id long, score double, origen string")
    return done, arts, links


def test_six_sheets_and_back(spark, tmp_path):
    tables = W.papers(*bundle(spark), {"modelo": "hash", "umbral": "0.30"})
    W.write_papers(tables, f"{tmp_path}/p")
    got = W.read_papers(spark, f"{tmp_path}/p")
    assert list(got) == W.SHEETS
    manual = {r.chunk_id: r for r in got["via_manual"].collect()}
    assert {k: (r.nivel_cumplimiento, r.prioridad, r.color) for k, r in manual.items()} == {
        "1": ("parcial", "media", "FFF2CC"), "2": ("omision", "alta", "FCE4D6"), "3": ("cumple", "baja", "E2EFDA"), "4": ("no_aplica", "ninguna", "F2F2F2"),
    }
    assert manual["1"].articulos == "2" and manual["3"].articulos == "1" and manual["3"].brechas == "" and manual["1"].brechas.startswith("parcial: ")
    norms = {r.numero: (r.nivel_adopcion, r.secciones, r.prioridad) for r in got["via_normativa"].collect()}
    assert norms == {"1": ("cubierto", "1", "baja"), "2": ("parcial", "1", "media"), "3": ("no_aplica", "0", "ninguna"), "4": ("no_cubierto", "0", "alta")}
    assert {(r.element_id, r.chunk_id, r.score, r.origenes) for r in got["matriz"].collect()} == {("10_0", "3", "1.0", "lexica"), ("10_1", "1", "0.3", "lexica,semantica")}
    review = {r.chunk_id: r.motivos for r in got["revision"].collect()}
    assert review["1"] == "parcial_con_brechas" and "huerfana" in review["2"] and review["4"].endswith("analisis_malformado")
    assert {(r.clave, r.valor) for r in got["trazabilidad"].collect()} == {("modelo", "hash"), ("umbral", "0.30")}
    summary = {r.concepto: r.valor for r in got["resumen"].collect()}
    assert summary["nivel omision"] == "1" and (summary["articulos"], summary["cubiertos"], summary["porcentaje"]) == ("3", "2", "66.7")
    widths = {c.columna: c.ancho for r in spark.read.parquet(f"{tmp_path}/p/manifiesto").where("hoja = 'via_manual'").collect() for c in r.columnas}
    assert widths["jerarquia"] == len("Jerarquía") + 4


def test_rules_criticality_and_labels_are_data(spark, tmp_path):
    done, arts, links = bundle(spark)
    critical = spark.createDataFrame([("10_1", 2), ("10_3", 3)], "element_id string, criticidad int")
    tables = W.papers(done, arts, links, {}, critical=critical)
    assert {r.numero: r.prioridad for r in tables["via_normativa"].collect()} == {"1": "baja", "2": "media", "3": "ninguna", "4": "crítica"}
    tables = W.papers(done, arts, links, {}, rules=[("criticidad > 1", "ya"), ("true", "luego")], critical=critical)
    assert {r.chunk_id: r.prioridad for r in tables["via_manual"].collect()} == {1: "ya", 2: "luego", 3: "luego", 4: "luego"}
    other = {"via_manual": {"nivel_cumplimiento": "Estado", "chunk_id": "N.º"}}
    W.write_papers(tables, f"{tmp_path}/p", other)
    run = spark.read.parquet(f"{tmp_path}/p/manifiesto").first()
    assert spark.read.option("header", True).csv(f"{tmp_path}/p/corridas/{run.corrida}/0_via_manual").columns == ["Estado", "N.º"]
    with pytest.raises(Exception, match="absent"):
        W.write_papers(tables, f"{tmp_path}/p", {"via_manual": {"absent": "x"}})


def test_a_reader_never_sees_half_a_set(spark, tmp_path, monkeypatch):
    done, arts, links = bundle(spark)
    path = f"{tmp_path}/p"
    W.write_papers(W.papers(done, arts, links, {"v": "1"}), path)
    calls = []

    def dying(rows):
        calls.append(1)
        if len(calls) == 6:
            raise KeyboardInterrupt
        return kept(rows)

    kept = W.compare.column_widths
    monkeypatch.setattr(W.compare, "column_widths", dying)
    with pytest.raises(KeyboardInterrupt):
        W.write_papers(W.papers(done.where("chunk_id = 1"), arts, links, {"v": "2"}), path)
    got = W.read_papers(spark, path)
    assert got["via_manual"].count() == 4 and got["trazabilidad"].first().valor == "1"
    monkeypatch.setattr(W.compare, "column_widths", kept)
    W.write_papers(W.papers(done.where("false"), arts.where("false"), links.where("false"), {"v": "3"}), path)
    got = W.read_papers(spark, path)
    assert got["trazabilidad"].first().valor == "3" and got["via_manual"].count() == got["matriz"].count() == 0


def test_registered_papers_store_their_links_and_no_texts(spark, monkeypatch):
    from lexloom.plans import runs

    seen, kept = [], W.papers
    monkeypatch.setattr(runs.papers, "papers", lambda done, arts, links, trace: (seen.append((done.columns, links.inputFiles())), kept(done, arts, links, trace))[1])
    assert runs.paper_summary(spark, "/root/testdata/sf0.001").count() == 8
    columns, files = seen[0]
    assert "texto" not in columns and files and all("/links/" in f for f in files)
