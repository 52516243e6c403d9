"""Runs that are repeated, changed and killed: how often models are called, and what comes out."""

import pytest
from pyspark.sql import functions as F

from lexloom.streaming import resume as R

CANDIDATES = "chunk_id long, element_id string, rank int, numero string, encabezado string, contenido string, score double"


def pairs(spark, changed=""):
    rows = [(1, "a", 1, "1", "x", "uno dos", 0.9), (1, "b", 2, None, None, None, 0.8), (2, "c", 1, "3", "", "tres" + changed, 0.7), (3, "a", 1, "1", "x", "uno dos", 0.2)]
    return spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([(1, "uno"), (2, None), (3, "uno")], "chunk_id long, texto string")


def counting(folder, fails=()):
    """A grader that leaves a file for each call."""

    def grader(text, found):
        import uuid

        (folder / uuid.uuid4().hex).write_text("\n".join(sorted(str(c["numero"]) for c in found)))
        if text in fails:
            raise RuntimeError("no model")
        return [{"element_id": c["element_id"], "relevante": c["numero"] == "1", "score": 0.25, "razon": text} for c in found if c["numero"]]

    def calls():
        seen = sorted(p.read_text() for p in folder.iterdir())
        for p in folder.iterdir():
            p.unlink()
        return seen

    return grader, calls


def told(found):
    return {(r.chunk_id, r.element_id): (r.relevante, r.score_grade, r.estado, r.origen) for r in found.collect()}


def test_grades_are_asked_for_once(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    grader, calls = counting(folder)
    path = f"{tmp_path}/cache"
    first = told(R.cached_grades(*pairs(spark), path, "m1", grader))
    assert calls() == ["1\nNone", "3"]  # sections 1 and 3 have one text
    assert first[1, "a"] == first[3, "a"] == (True, 0.25, "calificado", "nueva") and first[1, "b"] == (True, 0.5, "sin_calificar", "nueva")
    again = told(R.cached_grades(*pairs(spark), path, "m1", grader))
    assert calls() == [] and {k: v[:3] for k, v in again.items()} == {k: v[:3] for k, v in first.items()} and {v[3] for v in again.values()} == {"cache"}
    one = told(R.cached_grades(*pairs(spark, " más"), path, "m1", grader))
    assert calls() == ["3"] and one[2, "c"][3] == "nueva" and one[1, "a"][3] == "cache"
    told(R.cached_grades(*pairs(spark), path, "m2", grader))
    assert len(calls()) == 2
    none, secs = pairs(spark)
    assert R.cached_grades(none.where("false"), secs, f"{tmp_path}/other", "m1", grader).count() == 0 and calls() == []


def test_failed_grades_are_tried_again(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    grader, calls = counting(folder, fails=("",))
    path = f"{tmp_path}/cache"
    first = told(R.cached_grades(*pairs(spark), path, "m", grader))
    assert first[2, "c"] == (True, 0.5, "error", None) and len(calls()) == 2
    good, calls = counting(folder)
    assert told(R.cached_grades(*pairs(spark), path, "m", good))[2, "c"] == (False, 0.25, "calificado", "nueva")
    assert calls() == ["3"]


def sections(spark, more=""):
    rows = [(i, f"texto {i}{more if i == 4 else ''}", i % 3) for i in range(40)]
    return spark.createDataFrame(rows, "chunk_id long, texto string, norma long")


def versions(spark, changed=None):
    return sections(spark).select("chunk_id", F.concat(F.col("norma").cast("string"), F.when(F.col("norma") == changed, "v2").otherwise("v1")).alias("norma"))


def words(rows):
    """Two rows for a section, none for every seventh."""
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1)))).where("chunk_id % 7 <> 0")
    return each.select("chunk_id", "i", F.concat("texto", F.col("i").cast("string")).alias("t"))


def finished(spark, path):
    return spark.read.parquet(f"{path}/hechas")


def test_a_killed_run_goes_on(spark, tmp_path):
    path, secs, docs = f"{tmp_path}/run", sections(spark), versions(spark)
    want = sorted(map(tuple, words(secs).collect()))
    parts = []

    def dying(rows):
        parts.append(1)
        if len(parts) == 4:
            raise KeyboardInterrupt
        return words(rows)

    with pytest.raises(KeyboardInterrupt):
        R.resume(secs, docs, dying, path, "c1", parts=6)
    before = {r.clave for r in finished(spark, path).collect()}
    assert 0 < len(before) < 40
    due = R.pending(secs, docs, path, "c1")
    assert due.count() == 40 - len(before) and {r.motivo for r in due.collect()} == {"nueva"}
    got = R.resume(secs, docs, words, path, "c1", parts=6)
    assert sorted(map(tuple, got.collect())) == want
    rows = finished(spark, path).collect()
    assert len(rows) == len({r.clave for r in rows}) == 40 and len({r.corrida for r in rows if r.clave in before}) == 1
    assert sorted(map(tuple, R.resume(secs, docs, words, path, "c1").collect())) == want and finished(spark, path).count() == 40


def test_rows_of_a_run_that_died_before_its_entry_are_not_read(spark, tmp_path):
    path, secs, docs = f"{tmp_path}/run", sections(spark), versions(spark)
    half = words(secs).join(R._keyed(secs, docs, "c1").select("chunk_id", "clave"), "chunk_id").withColumn("corrida", F.lit("dead"))
    half.write.parquet(f"{path}/filas")
    assert sorted(map(tuple, R.resume(secs, docs, words, path, "c1").collect())) == sorted(map(tuple, words(secs).collect()))


def test_only_what_changed_is_due(spark, tmp_path):
    path, secs, docs = f"{tmp_path}/run", sections(spark), versions(spark)
    R.resume(secs, docs, words, path, "c1", parts=2)
    due = lambda *a: {(r.chunk_id, r.motivo) for r in R.pending(*a).collect()}
    assert due(secs, docs, path, "c1") == set()
    assert due(sections(spark, "!"), docs, path, "c1") == {(4, "texto")}
    assert due(secs, versions(spark, 2), path, "c1") == {(i, "norma") for i in range(40) if i % 3 == 2}
    assert due(secs, docs, path, "c2") == {(i, "configuracion") for i in range(40)}
    got = R.resume(sections(spark, "!"), docs, words, path, "c1")
    assert {r.t for r in got.where("chunk_id = 4").collect()} == {"texto 4!0", "texto 4!1"} and finished(spark, path).count() == 41
    assert R.resume(secs.where("false"), docs.where("false"), words, f"{tmp_path}/none", "c1").count() == 0
