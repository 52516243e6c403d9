"""Injected models in Arrow batches: rerankers, graders and analysts, with checked results and defaults on failure.

A model is a plain function that runs inside tasks. One that raises, or that returns what its contract doesn't allow,
costs its own section the defaults and a state that says so; the other sections go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions.vectors import SLICE, sliced
from lexloom.operators.compare import match_type

_VERDICT = "nivel_cumplimiento string, analisis_general string, brechas array<string>, entidades array<string>"


def prefixed(text: Column, prefix: str = "") -> Column:
    """What a model embeds: the prefix of its kind of text before it, null as empty."""
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))


def pair_text(num: Column, header: Column, body: Column) -> Column:
    """The article's side of a pair that a reranker sees."""
    name = F.concat(F.lit("Artículo "), F.coalesce(num, F.lit("?")), F.lit(": "), F.coalesce(header, F.lit("")))
    return F.concat(name, F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 600))


def _scores(scorer: Callable[[list[tuple[str, str]]], list[float]], pairs: list[tuple[str, str]]) -> list[float] | None:
    """A score for each pair; none where the scorer fails."""
    try:
        scores = [float(s) for s in scorer(pairs)]
    except Exception:  # noqa: BLE001  a model may fail in any way
        return None
    return scores if len(scores) == len(pairs) else None


def _all_scores(scorer: Callable[[list[tuple[str, str]]], list[float]], pairs: list[tuple[str, str]]) -> list[float | None]:
    """A score for each pair; where the scorer fails, pairs are scored one by one, and those that fail again have none."""
    scores = _scores(scorer, pairs)
    return scores if scores is not None else [(_scores(scorer, [p]) or [None])[0] for p in pairs]


def pair_scores(scorer: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """The scores of a row's query with each of its documents (an array), as `rerank_pairs` has them for rows of pairs;
    the query is passed once."""

    @F.arrow_udf("array<double>")
    def score(queries: pa.Array, lists: pa.Array) -> pa.Array:
        sizes, out, pairs = [], [], []
        for query, documents in sliced(queries, lists):
            sizes.append(len(documents or ()))
            pairs += [(query or "", d or "") for d in documents or ()]
            while len(pairs) >= SLICE:
                out += _all_scores(scorer, pairs[:SLICE])
                del pairs[:SLICE]
        out += _all_scores(scorer, pairs) if pairs else []
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(out, pa.float64()))

    return score


def rerank_pairs(candidates: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]] | None, n: int = P.TOP_N) -> DataFrame:
    """The n best candidates (chunk_id, rank, query, document, ...) by the scores of (query, document) pairs.

    Equal scores keep their order. Without a scorer the first n stay as they are, without further columns. Where a
    scorer raises, or returns another number of scores, pairs are scored one by one; those that fail again have a null
    score and come last.
    """
    if scorer is None:
        return candidates.where(F.col("rank") <= n)

    @F.arrow_udf("double")
    def score(queries: pa.Array, documents: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(queries), SLICE):
            mine = zip(queries.slice(at, SLICE).to_pylist(), documents.slice(at, SLICE).to_pylist(), strict=True)
            out += _all_scores(scorer, [(q or "", d or "") for q, d in mine])
        return pa.array(out, pa.float64())

    order = W.partitionBy("chunk_id").orderBy(F.desc_nulls_last("reranker_score"), "rank")
    scored = candidates.withColumn("reranker_score", score("query", "document"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _words(text: str) -> set[str]:
    return set(text.lower().replace("\t", " ").replace("\n", " ").split(" ")) - {""}


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in for a reranker: the share of the document's distinct words that the query has too."""
    out, query, mine = [], None, set()
    for q, d in pairs:
        if q != query:  # the pairs of a query follow each other
            query, mine = q, _words(q)
        words = _words(d)
        out.append(len(mine & words) / max(1, len(words)))
    return out


def overlap_grader(section: str, candidates: list[dict]) -> list[dict]:
    """A stand-in for a grader: relevant from a fifth of shared words on."""
    shares = shared_words([(section, c["contenido"] or "") for c in candidates])
    return [{"element_id": c["element_id"], "relevante": s >= 0.2, "score": s, "razon": ""} for c, s in zip(candidates, shares, strict=True)]


def _checked(grades: list[dict]) -> dict[str, dict]:
    for g in grades:
        if not (isinstance(g["element_id"], str) and isinstance(g["relevante"], bool) and 0.0 <= g["score"] <= 1.0 and isinstance(g["razon"], str)):
            raise ValueError(f"not a grade: {g}")
    return {g["element_id"]: g for g in grades}  # the last of several wins


def _grades(grader: Callable[[str, list[dict]], list[dict]], text: str, candidates: list[dict]) -> Iterator[tuple]:
    """(relevante, score, razon, estado) of each candidate of a section, by one call."""
    try:
        told, missing = _checked(grader(text, candidates)), "sin_calificar"
    except Exception:  # noqa: BLE001  a model may fail in any way
        told, missing = {}, "error"
    for c in candidates:
        g = told.get(c["element_id"])
        yield (g["relevante"], float(g["score"]), g["razon"], "calificado") if g else (True, P.MISSING_SCORE, "", missing)


def section_grades(grader: Callable[[str, list[dict]], list[dict]]) -> Callable[[Column, Column], Column]:
    """The grades (relevante, score_grade) of a row's candidates, an array as `grade` makes one of its rows, in their order."""

    @F.arrow_udf("array<struct<relevante:boolean,score_grade:double>>")
    def graded(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [list(_grades(grader, text or "", candidates)) if candidates else [] for text, candidates in sliced(texts, lists)]
        flat = [g for row in rows for g in row]
        told = pa.StructArray.from_arrays([pa.array([g[0] for g in flat], pa.bool_()), pa.array([g[1] for g in flat], pa.float64())], ["relevante", "score_grade"])
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), told)

    return graded


def grade(candidates: DataFrame, sections: DataFrame, grader: Callable[[str, list[dict]], list[dict]] = overlap_grader) -> DataFrame:
    """(chunk_id, element_id, relevante, score_grade, razon_grade, estado): one call for each section.

    `candidates` has (chunk_id, element_id, rank, numero, encabezado, contenido, score), a few for each section, and
    `sections` (chunk_id, texto). Ungraded candidates count as relevant; so do all where the call fails.
    """
    each = F.struct("rank", F.col("element_id").cast("string").alias("element_id"), "numero", "encabezado", F.substring("contenido", 1, 600).alias("contenido"), "score")
    asked = candidates.groupBy("chunk_id").agg(F.array_sort(F.collect_list(each)).alias("candidatos"))
    asked = asked.join(sections.select("chunk_id", F.substring(F.coalesce("texto", F.lit("")), 1, 1500).alias("texto")), "chunk_id")
    kind = asked.schema["chunk_id"].dataType.simpleString()
    schema = f"chunk_id {kind}, element_id string, relevante boolean, score_grade double, razon_grade string, estado string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, max(1, whole.num_rows), SLICE)):
            rows = []
            for row in batch.to_pylist():
                for c, got in zip(row["candidatos"], _grades(grader, row["texto"], row["candidatos"]), strict=True):
                    rows.append((row["chunk_id"], c["element_id"], *got))
            types = [batch.schema.field("chunk_id").type, pa.string(), pa.bool_(), pa.float64(), pa.string(), pa.string()]
            names = ["chunk_id", "element_id", "relevante", "score_grade", "razon_grade", "estado"]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return asked.select("chunk_id", "texto", "candidatos").mapInArrow(run, schema)


def reference_context(lexical: Column, semantic: Column) -> Column:
    """The articles that an analysis is based on: three cited ones and three relevant ones at most, each shortened.

    Both are arrays of (numero, encabezado, contenido) in their order; null is empty.
    """

    def text(x: Column, most: int) -> Column:
        return F.concat(F.coalesce(x.numero, F.lit("?")), F.lit(": "), F.coalesce(x.encabezado, F.lit("")), F.lit("\n"), F.substring(F.coalesce(x.contenido, F.lit("")), 1, most))

    cited = F.array_join(F.transform(F.slice(lexical, 1, 3), lambda x: F.concat(F.lit("Artículo "), text(x, 800))), "\n\n")
    top = lambda x, i: F.concat(F.lit("[Top "), (i + 1).cast("string"), F.lit("] Art."), text(x, 600))
    near = F.array_join(F.transform(F.slice(semantic, 1, 3), top), "\n\n")
    both = F.concat_ws("\n\n", F.when(F.size(lexical) > 0, F.concat(F.lit(P.CITED_TITLE), cited)), F.when(F.size(semantic) > 0, F.concat(F.lit(P.NEAR_TITLE), near)))
    return F.coalesce(F.nullif(both, F.lit("")), F.lit(P.NO_REFERENCES))


def level_analyst(section: str, kind: str, references: str) -> dict:
    """A stand-in for an analyst: a citation complies, a relevant candidate does in part, nothing is an omission."""
    level = {"lexica": "cumple", "semantica": "parcial"}.get(kind, "omision")
    gaps = [] if level == "cumple" else [f"{level}: {len(references)} / {len(section)}"]
    return {"nivel_cumplimiento": level, "analisis_general": f"{kind}: {level}", "brechas": gaps, "entidades": sorted(set(re.findall("Art[.][0-9]+", references)))}


def _verdict(told: dict) -> tuple:
    lists = told["brechas"], told["entidades"]
    if told["nivel_cumplimiento"] not in P.LEVELS or not isinstance(told["analisis_general"], str) or not all(isinstance(x, str) for y in lists for x in y):
        raise ValueError(f"not a verdict: {told}")
    return told["nivel_cumplimiento"], told["analisis_general"], list(lists[0]), list(lists[1])


def analyse(sections: DataFrame, analyst: Callable[[str, str, str], dict] = level_analyst) -> DataFrame:
    """All columns of `sections` (texto, lexicos, relevantes, ...) with tipo_coincidencia, the verdict and its state.

    The match type is computed here, whatever a model says of it. A failed call leaves the level null, the error in
    `analisis_general`, and `estado_analisis` "error", so that a failure is no verdict.
    """

    @F.arrow_udf(f"struct<{_VERDICT.replace(' ', ':').replace(',:', ',')},estado_analisis:string>")
    def verdict(texts: pa.Array, kinds: pa.Array, references: pa.Array) -> pa.Array:
        out = []
        for text, kind, context in sliced(texts, kinds, references):
            try:
                told = (*_verdict(analyst(text, kind, context)), "analizado")
            except Exception as e:  # noqa: BLE001  a model may fail in any way
                told = (None, str(e), [], [], "error")
            out.append(dict(zip(names, told, strict=True)))
        lists = pa.list_(pa.string())
        return pa.array(out, pa.struct(list(zip(names, [pa.string(), pa.string(), lists, lists, pa.string()], strict=True))))

    names = ["nivel_cumplimiento", "analisis_general", "brechas", "entidades", "estado_analisis"]
    found = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    out = sections.withColumn("tipo_coincidencia", match_type(found("lexicos"), found("relevantes")))
    text = F.substring(F.coalesce("texto", F.lit("")), 1, 2000)
    out = out.withColumn("verdict", verdict(text, "tipo_coincidencia", reference_context(F.col("lexicos"), F.col("relevantes"))))
    return out.select("*", "verdict.*").drop("verdict")
