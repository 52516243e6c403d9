"""Plans that read and shuffle their input a fixed number of times, and what must hold on the way."""

import re

import pytest

from lexloom.plans import catalog, dossier, runs  # noqa: F401  all register queries

SF = "/root/testdata/sf0.001"


def steps(rows) -> tuple[int, int]:
    """Scans and shuffles of a plan."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan", plan)), len(re.findall(r"Exchange (?:hash|range)partitioning", plan))


@pytest.mark.parametrize("name", ["normativa", "value_counts", "reference_flags", "own_articles", "variant_documents"])
def test_structure_is_read_in_one_scan(spark, name):
    scans, shuffles = steps(catalog.QUERIES[name](spark, SF))
    assert scans == 1 and shuffles <= 2


def test_texts_around_matches_reach_over_short_gaps(spark):
    md = "Art. 1 x del\nArt. 2\nArt. 3\nDISPOSICIÓN GENERAL\nDISPOSICIÓN FINAL a\n\nb" + "\nDISPOSICIÓN GENERAL" * 3
    docs = spark.createDataFrame([(1, md), (2, ""), (3, None), (4, " \n\t")], "doc_id long, md string")
    got = {r.posicion: r.contenido for r in catalog.extract.provisions(docs).collect()}
    want = {m.start(): md[m.end() :].split("\n\n")[0][:1500].strip() for m in re.finditer(r"\nDISPOSICIÓN (GENERAL|FINAL)", md)}
    assert got == want
    found = catalog.extract.matches(docs, catalog.extract._STRUCTURE).where("kind = 'articulo'").collect()
    assert {r.posicion: r.before for r in found} == {m.start(): md[max(0, m.start() - 40) : m.start()] for m in re.finditer(r"(^|\n)Art. \d", md)}
    assert {r.numero: r.es_referencia for r in catalog.extract.flagged_articles(docs).collect()} == {"1": False, "2": True, "3": False}


def test_scores_are_rounded_as_in_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    from lexloom.functions import vectors as V

    halves = [float(f"0.{i:04d}5") for i in range(10_000)] + [-0.30015, 0.0, 1.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(halves)], "i int, x double").select("i", V.rounded(F.col("x"), 4).alias("y")).orderBy("i").collect()
    want = duckdb.execute("SELECT round(x, 4) FROM (SELECT unnest(?) AS x, unnest(range(?)) AS i) ORDER BY i", [halves, len(halves)]).fetchall()
    assert [r.y for r in got] == [r[0] for r in want]


def test_similarities_are_shown_as_in_sql(spark):
    from pyspark.sql import functions as F

    from lexloom.operators import run

    secs = spark.createDataFrame([(1, "1.0")], "chunk_id long, texto string")
    arts = spark.createDataFrame([(2, "2_0000", "1", "", "0.30035", 0)], "doc_id long, element_id string, numero string, encabezado string, contenido string, orden int")
    scope = spark.createDataFrame([(1, 2)], "chunk_id long, norm_id long")
    models = run.Models(encode=lambda text: F.array(text.cast("double")))
    import duckdb

    for x in ("0.30015", "0.30065", "0.30115", "0.5"):
        told = arts.withColumn("contenido", F.lit(x))
        row = run.compare_all(secs, told, scope, models).first()
        assert row.articulos_semanticos_raw[0].sim == duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [x]).fetchone()[0]


def test_models_get_few_rows_at_a_time(spark):
    from pyspark.sql import functions as F

    from lexloom.functions import vectors as V
    from lexloom.operators import judge

    def scorer(pairs):
        return [float(len(pairs))] * len(pairs)

    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("chunk_id"), F.lit(1).alias("rank"), F.lit("a").alias("query"), F.lit("b").alias("document"))
    got = judge.rerank_pairs(rows, scorer).agg(F.max("reranker_score"), F.count("*")).first()
    assert got[0] <= V.SLICE and got[1] == 1000


def test_search_holds_small_blocks():
    from lexloom.operators import search

    assert search.QUERY_BLOCK * search.ROW_BLOCK * 8 <= 8 << 20 and search.QUERY_BYTES <= 16 << 20


def test_compare_run_parses_articles_once(spark):
    plan = catalog.compare_run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ANEXO" not in plan  # the articles are read as stored, however many blocks of queries there are


def test_matches_by_lines_are_those_of_the_whole_text(spark):
    import random

    from pyspark.sql import functions as F

    from lexloom.functions import patterns as P

    X, dice = catalog.extract, random.Random(4)
    bits = ["\n", "\n", "\n\n", "TÍTULO I", "Título V.", "ANEXO 1", "Anexo II", "Art. 1", "ARTÍCULO 2 - A", "## ", "- ", "1. ", " ", "\t", "x ñ", "😀", "-", ".", "DISPOSICIÓN GENERAL", "RESUELVE:", "y" * 310, "\r", "Capítulo ÚNICO"]
    texts = ["".join(dice.choices(bits, k=dice.randrange(14))) for _ in range(3000)] + [None, "TÍTULO I\nTÍTULO II\nTÍTULO III\nTÍTULO IV"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, md string").withColumn("lines", F.split("md", "\n", -1))
    kinds = {"article": [P.ARTICLE, P.VARIANT_ARTICLE], "heading": [P.HEADING, P.VARIANT_HEADING], "provision": [P.PROVISION], "annex": [P.ANNEX], "resolution": [P.RESOLUTION, P.VARIANT_RESOLUTION]}
    for pattern in (X.FLAGS[k] + p for k, ps in kinds.items() for p in ps):
        both = docs.select(X._by_lines(F.col("md"), F.col("lines"), pattern).alias("a"), X._whole(F.col("md"), pattern).alias("b"))
        seen = both.where("size(b.m) > 0").agg(F.count("*"), F.count_if(~F.col("a.m").eqNullSafe(F.col("b.m")) | ~F.col("a.g").eqNullSafe(F.col("b.g")))).first()
        assert seen[0] > 100 and seen[1] == 0
        assert both.where("coalesce(size(b.m), 0) <= 0 AND size(a.m) > 0").count() == 0


def test_texts_are_not_scanned_by_every_pattern(spark):
    plan = catalog.normativa(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "\\A" in plan and not re.search(r"split\(md#\d+, \(\?d", plan)


def test_a_comparison_moves_each_text_once(spark):
    from pyspark.sql import functions as F

    from lexloom.operators import run

    docs = catalog.views.norm_md(spark, SF)
    arts = catalog.extract.normativa(docs).where("tipo_elemento = 'articulo'")
    secs = catalog.views.sections(spark, SF)
    out = run.compare_all(secs, arts, secs.select("chunk_id", (F.col("chunk_id") + 1).alias("norm_id")), order=[])
    scans, shuffles = steps(out)
    assert scans <= 4 and shuffles <= 7


def test_search_scores_few_pairs_in_double_precision(monkeypatch):
    import numpy as np

    from lexloom.operators import search

    dice, scored = np.random.default_rng(3), []
    rows, ids = dice.random((12_000, 16)), np.arange(12_000)
    rows[500:900] = rows[:400]  # equal scores follow by id, also over blocks
    queries = rows[:300]
    kept = search._Best._keep
    monkeypatch.setattr(search._Best, "_keep", lambda self, mine, query, *more: (scored.append(len(query)), kept(self, mine, query, *more))[1])
    best = search._Best(ids[:300], queries, None, 5)
    for at in range(0, len(rows), 2048):
        best.meet(np.arange(300), ids[at : at + 2048], rows[at : at + 2048])
    exact = np.round(queries @ rows.T, 9)
    exact[ids[:300], ids[:300]] = -np.inf
    for i in range(300):
        want = sorted(zip(-exact[i], ids, strict=True))[:5]
        assert [(-s, e) for s, e in zip(best.scores[i], best.elements[i], strict=True)] == want
    assert sum(scored) < 0.02 * exact.size


def test_equal_vectors_are_searched_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lexloom.operators import search

    vector = lambda c: F.array((c % 7 / 7).cast("double"), (c % 3 / 3).cast("double"), F.lit(0.5))
    corpus = spark.range(400).select((F.col("id") * 37 % 400 + 1000).alias("element_id"), vector(F.col("id")).alias("embedding"))
    queries = spark.range(90).select(F.col("id").alias("query_id"), vector(F.col("id") * 5).alias("embedding"))
    want = {tuple(r) for r in search.top_k(queries, corpus, 5).select("query_id", "element_id", "score", "rank").collect()}
    seen, kept = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda q, c, k: (seen.append((q.count(), c.count())), kept(q, c, k))[1])
    got = search.alike_top_k(queries, corpus, f"file://{tmp_path}/d", 5)
    assert {tuple(r) for r in got.select("query_id", "element_id", "score", "rank").collect()} == want and seen == [(21, 21)]
