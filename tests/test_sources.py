import os

import pytest
from pyspark.sql import functions as F

from lexloom.operators import search
from lexloom.sources import corpus, index, sinks
from lexloom.streaming import incremental


def test_convert_directory_isolates_errors_and_reads_the_cache(spark, tmp_path):
    src, cache = tmp_path / "pdf", tmp_path / "md"
    src.mkdir(), cache.mkdir()
    for name in ("a", "b", "c"):
        (src / f"{name}.pdf").write_bytes(name.encode())
    (cache / "c.md").write_text("cached " * 50)

    def convert(content: bytes) -> str:
        if content == b"b":
            raise ValueError("broken")
        return f"text of {content.decode()}"

    got = {r.doc_id: r for r in corpus.convert_directory(spark, str(src), convert, str(cache)).collect()}
    assert got["a"].md == "text of a" and got["c"].md.startswith("cached")
    assert got["b"].md is None and got["b"].error == "ValueError: broken"
    assert not corpus.read_markdown(spark, str(cache)).first().extraccion_pobre


def counted(folder):
    """A converter that leaves a file for each call."""

    def convert(content: bytes) -> str:
        import uuid

        (folder / uuid.uuid4().hex).write_bytes(content)
        if content == b"bad":
            raise ValueError("broken")
        return content.decode()

    def calls():
        seen = sorted(p.read_bytes() for p in folder.iterdir())
        for p in folder.iterdir():
            p.unlink()
        return seen

    return convert, calls


def test_cache_is_written_and_read_through(spark, tmp_path):
    src, cache, folder = tmp_path / "pdf", tmp_path / "md", tmp_path / "calls"
    src.mkdir(), folder.mkdir()
    for name, text in (("b", "dos"), ("a", "uno"), ("c", "bad"), ("L1-XVI-x", "no"), ("d", " "), ("e", "")):
        (src / f"{name}.pdf").write_bytes(text.encode())
    convert, calls = counted(folder)
    get = lambda: [(r.archivo, r.md, r.error) for r in corpus.convert_directory(spark, str(src), convert, str(cache), exclude_prefix="L1-XVI").collect()]
    want = [("a.pdf", "uno", None), ("b.pdf", "dos", None), ("c.pdf", None, "ValueError: broken"), ("d.pdf", " ", None)]
    assert get() == want and calls() == [b" ", b"bad", b"dos", b"uno"]
    assert get() == want and calls() == [b"bad"]  # failures are tried again, nothing else
    os.utime(src / "a.pdf", (2_000_000_000, 2_000_000_000))
    (src / "c.pdf").write_bytes(b"tres")
    assert [x[1] for x in get()] == ["uno", "dos", "tres", " "] and calls() == [b"tres", b"uno"]
    assert [x[1] for x in get()] == ["uno", "dos", "tres", " "] and calls() == []
    sinks.write_markdown(spark.createDataFrame([("b", "otro")], "doc_id string, md string"), str(cache))
    assert [x[1] for x in get()][1] == "otro" and calls() == []
    assert corpus.convert_directory(spark, str(src), convert, pattern="z*").count() == 0


def test_white_space_is_no_text(spark):
    rows = spark.createDataFrame([("\n\t\u00a0 " * 100 + "x" * 199,), ("x" * 200,), (None,)], "md string")
    assert [r.p for r in rows.select(corpus.poor(rows.md).alias("p")).collect()] == [True, False, True]


def test_folders_to_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    norm = "LEY\n\nArt. 1.- Objeto. Regula todo.\n\nArt. 2.- Fin. Acaba.\n\nDISPOSICIÓN FINAL Rige.\n\nANEXO I Tabla"
    for name, text in (("b", norm), ("a", norm.replace("Regula", "Ordena")), ("c", "bad"), ("e", "")):
        (src / f"{name}.pdf").write_bytes(text.encode())
    convert = lambda content: (_ for _ in ()).throw(ValueError("broken")) if content == b"bad" else content.decode()
    docs = corpus.convert_directory(spark, str(src), convert)
    rows = corpus.norm_elements(docs).collect()
    assert [(r.archivo, r.tipo_elemento, r.numero) for r in rows] == [
        (f, k, n) for f in ("a.pdf", "b.pdf") for k, n in (("articulo", "1"), ("articulo", "2"), ("disposicion", "DISPOSICIÓN FINAL"), ("anexo", "ANEXO I"))
    ] + [("c.pdf", None, None)]
    assert rows[0].element_id == "a_0000" and rows[0].contenido == "Ordena todo." and rows[-1].error == "ValueError: broken"
    (src / "b.pdf").write_bytes("# Uno\n\ntexto\f\n## Dos\n\nmás".encode())
    got = [(r.chunk_id, r.fuente, r.pagina_inicio, r.jerarquia, r.texto, r.error) for r in corpus.manual_sections(docs).where("fuente > 'a.pdf'").collect()]
    assert got == [("b_0000", "b.pdf", 1, "Uno", "texto\f", None), ("b_0001", "b.pdf", 2, "Uno > Dos", "más", None), (None, "c.pdf", None, None, None, "ValueError: broken")]


def test_nested_documents_and_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "uno"), (2, "dos"), (3, None)], "doc_id long, titulo string")
    marks = spark.createDataFrame([(1, 5, "TÍTULO I"), (1, 0, "B"), (1, 0, "A")], "doc_id long, posicion int, label string")
    arts = spark.createDataFrame([(1, 9, "1", None), (2, 3, "2", "x"), (1, 7, "1", "y")], "doc_id long, posicion int, numero string, contenido string")
    anns = spark.createDataFrame([(1, 0, "ANEXO I"), (1, 1, "ANEXO II")], "doc_id long, seq int, identificador string")
    nested = sinks.nested_documents(docs, marks, arts, anns)
    sinks.write_records(nested, f"{tmp_path}/n")
    read = corpus.read_records(spark, f"{tmp_path}/n", nested.schema)
    one = read.where("doc_id = 1").first()
    assert (one.n_secciones, one.n_articulos, one.n_anexos, [a.posicion for a in one.articulos]) == (3, 2, 2, [7, 9])
    assert read.where("doc_id = 3").first().articulos == []
    for kind, rows in (("secciones", marks), ("articulos", arts), ("anexos", anns)):
        assert sorted(map(tuple, sinks.elements_of(read, kind).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_sheets_with_names_that_begin_alike(spark, tmp_path):
    long = "x" * 31
    rows = [(long + "a", "1"), (long + "b", "2"), ("corto", "3"), (long + "a", "4")]
    elements = spark.createDataFrame(rows, "doc_id string, numero string").withColumns({"encabezado": F.lit("e\x00"), "contenido": F.lit("c"), "seccion": F.lit(""), "fecha": F.lit("")})
    sinks.write_sheets(elements, f"{tmp_path}/s")
    got = spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/s")
    sheets = {r.hoja: r.n for r in got.groupBy("hoja").agg(F.sort_array(F.collect_list(F.col("NUMERO").cast("string"))).alias("n")).collect()}
    assert sorted(sheets.values()) == [["1", "4"], ["2"], ["3"]] and "corto" in sheets and all(len(h) == 31 for h in sheets if h != "corto")
    assert {r.ARTICULO for r in got.collect()} == {"e\nc"}


def test_index_keeps_its_model(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "s"), (2, None, "t")], "element_id long, embedding array<double>, source string")
    index.build(rows, f"{tmp_path}/i", "hash", 2, prefix_doc="passage: ", prefix_query="query: ")
    got = index.load(spark, f"{tmp_path}/i", "hash", 2)
    assert got.rows.count() == 1 and got.rows.first().source == "s" and (got.meta["n"], got.meta["backend"]) == (1, "local")
    with pytest.raises(ValueError):
        index.load(spark, f"{tmp_path}/i", "other", 2)
    with pytest.raises(ValueError):
        index.load(spark, f"{tmp_path}/i", "hash", 3)
    texts = spark.createDataFrame([("a",), (None,)], "t string")
    shown = texts.select(got.encode(F.col("t"), lambda c: c).alias("q"), got.encode(F.col("t"), lambda c: c, query=False).alias("d")).collect()
    assert [tuple(r) for r in shown] == [("query: a", "passage: a"), ("query: ", "passage: ")]
    index.build(rows.where("false"), f"{tmp_path}/i", "newer", 2)
    newer = index.load(spark, f"{tmp_path}/i")
    assert newer.meta["model"] == "newer" and index.find(newer, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")).count() == 0


def test_only_probed_cells_are_read(spark, tmp_path):
    """Clustered vectors: one probe finds the exact neighbours, and the scan is told which cells it needs."""
    import math

    point = lambda i: [math.cos(i % 8 + i / 4000), math.sin(i % 8 + i / 4000)]
    rows = spark.createDataFrame([(i, point(i)) for i in range(400)], "element_id long, embedding array<double>")
    index.build(rows, f"{tmp_path}/i", "m", 2)
    got = index.load(spark, f"{tmp_path}/i")
    assert index.clamps(400) == (20, 5) and index.clamps(3) == (4, 1) and 4 <= got.meta["cells"] <= 20
    queries = rows.where("element_id < 8").withColumnRenamed("element_id", "query_id")
    exact = {(r.query_id, r.element_id): r.score for r in search.top_k(queries, rows).collect()}
    near = {(r.query_id, r.element_id): r.score for r in index.find(got, queries, probes=got.meta["cells"]).collect()}
    assert near == exact
    one = index.find(got, queries.where("query_id = 0"), probes=1)
    told = one._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in told.split("PartitionFilters: [")[1].split("]")[0]
    files = {r.f for r in got.rows.where("cell = 0").select(F.input_file_name().alias("f")).collect()}
    assert all("cell=0" in f for f in files)
    assert len(set(one.select("element_id").collect())) == 5


def test_ties_and_small_blocks(spark, monkeypatch):
    """Blocks of two rows and two queries, several broadcasts, and many equal scores give the plain ranking."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "element_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "query_id long, embedding array<double>")
    want = {}
    for q in range(9):
        scored = sorted((-(v[0] + v[1] * (q % 2)), e) for e, v in rows if e != q)[:5]
        want |= {(q, e): (-s, i) for i, (s, e) in enumerate(scored, 1)}
    for name, value in (("ROW_BLOCK", 4096), ("ROW_BLOCK", 2), ("QUERY_BLOCK", 2), ("QUERY_BYTES", 40)):
        monkeypatch.setattr(search, name, value)
        assert {(r.query_id, r.element_id): (r.score, r["rank"]) for r in search.top_k(queries, corpus).collect()} == want


def test_records_keep_nulls_and_types(spark, tmp_path):
    rows = spark.createDataFrame([("7", None)], "numero string, fecha string")
    sinks.write_records(rows, f"{tmp_path}/r")
    assert '"fecha":null' in "".join(r.value for r in spark.read.text(f"{tmp_path}/r").collect())
    assert corpus.read_records(spark, f"{tmp_path}/r", rows.schema).first().numero == "7"


def test_new_sections_are_compared_once(spark, tmp_path):
    arts = spark.createDataFrame([(1, "5", "1_0000", 0), (1, "6", "1_0001", 1)], "doc_id long, numero string, element_id string, orden int")
    rows = lambda i, text: spark.createDataFrame([(i, 1, text)], "chunk_id long, doc_id long, texto string")
    for i, text in enumerate(("ver Art. 5 y artículo 6", "ver ARTÍCULO 5", "ver Art. 6")):
        rows(i, text).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.compare_new(spark, f"{tmp_path}/in", arts, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("chunk_id", "numero").collect()
    assert sorted(map(tuple, got)) == [(0, "5"), (0, "6"), (2, "6")]


def test_windows(spark):
    rows = spark.range(3).select(F.timestamp_seconds(F.col("id") * 1800).alias("at"))
    assert sorted(r.secciones for r in incremental.citations_by_window(rows).collect()) == [1, 2]
