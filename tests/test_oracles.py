"""Every query with SQL against DuckDB over whole tables, and the others against what they approximate."""

import math
from collections import Counter

import duckdb
import pytest

from lexloom.plans import catalog, dossier, runs  # noqa: F401  all register queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = Counter(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall())
    assert mine == theirs and mine


def test_ivf_recall(spark):
    exact = {(r.query_id, r.element_id) for r in catalog.search.top_k(*catalog.views.vectors(spark, SF)).collect()}
    found = {(r.query_id, r.element_id) for r in catalog.ivf_search(spark, SF).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_compare_run(spark):
    rows = catalog.compare_run(spark, SF).collect()
    assert {r.tipo_coincidencia for r in rows} <= {"lexica", "semantica", "ninguna"}
    assert all((r.tipo_coincidencia == "lexica") == bool(r.articulos_lexicos) for r in rows)
    assert len(rows) == len({r.chunk_id for r in rows}) > 0


def test_citations_reach_other_documents(spark):
    compare = catalog.compare
    secs = spark.createDataFrame([(1, 1, "véase Art. 3 y Art. 4"), (2, 2, "según Art. 3"), (3, 3, "nada")], "chunk_id long, doc_id long, texto string")
    rows = [(10, "3", "10_0", 0), (10, "3", "10_5", 5), (10, "4", "10_1", 1), (11, "3", "11_0", 0), (12, "9", "12_0", 0)]
    arts = spark.createDataFrame(rows, "doc_id long, numero string, element_id string, orden int")
    assert compare.lexical_join(secs, arts).count() == 0  # own documents only
    scope = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, 10)], "chunk_id long, norm_id long")
    got = {(r.chunk_id, r.element_id, r["rank"]) for r in compare.lexical_join(secs, arts, scope).collect()}
    assert got == {(1, "10_0", 1), (1, "10_1", 2), (1, "10_5", 3), (2, "11_0", 1)}
    got = {(r.chunk_id, r.numero, r.normas, r.articulos) for r in compare.lexical_matches(secs, arts).collect()}
    assert got == {(1, "3", 2, 3), (1, "4", 1, 1), (2, "3", 2, 3)}
    numbers = {(r.norm_id, r.numero): r.element_ids for r in compare.norm_numbers(arts).collect()}
    assert numbers[10, "3"] == ["10_0", "10_5"] and len(numbers) == 4
    covered = compare.coverage(arts, compare.cited_articles(secs, arts)).first()
    assert (covered.articulos, covered.cubiertos, covered.sin_cobertura) == (5, 4, 1)


def test_compare_run_cites_across_documents(spark):
    arts = catalog.extract.normativa(catalog.views.norm_md(spark, SF)).where("tipo_elemento = 'articulo'")
    per = Counter(r.numero for r in arts.select("numero").collect())
    cited = {(r.chunk_id, r.numero) for r in catalog.compare.cited_numbers(catalog.views.sections(spark, SF)).collect()}
    for r in catalog.compare_run(spark, SF).collect():
        want = sorted(n for c, n in cited if c == r.chunk_id and n in per)
        assert (r.articulos_lexicos or []) == want and r.n_articulos_lexicos == sum(per[n] for n in want)


def test_compare_run_has_every_step(spark):
    rows = catalog.compare_run(spark, SF).collect()
    ids = {r.chunk_id for r in catalog.views.sections(spark, SF).select("chunk_id").collect()}
    assert {r.chunk_id for r in rows} == ids and len(rows) == len(ids)
    graded = [g for r in rows for g in r.articulos_validados or []]
    assert {g.relevante for g in graded} == {True, False} and len({g.score for g in graded}) > 1
    for r in rows:
        raw, best = r.articulos_semanticos_raw or [], r.articulos_validados or []
        assert len(best) == min(3, len(raw)) and {g.numero for g in best} <= {x.numero for x in raw}
        assert not raw or r.chunk_id % 20 == 0
        relevant = [g for g in best if g.relevante]
        kind = "lexica" if r.articulos_lexicos else "semantica" if relevant else "ninguna"
        assert r.tipo_coincidencia == kind
        level = "omision" if kind == "ninguna" else "cumple" if any(g.score >= 0.5 for g in relevant) else "parcial"
        assert r.nivel_cumplimiento == (level if r.buscada or r.articulos_lexicos else None)
