"""Models' answers as text: JSON, perhaps within other text, to typed and checked columns.

`from_json` reads an answer permissively; ranges, enumerations and required fields are expressions, and every answer
ends in a state: "analizado" (or "calificado"), "sin_respuesta" (null or blank), "malformado" (no JSON object, or a
field of another kind), "incompleto" (a required field is missing or null) or "fuera_de_rango" (a value that the
contract doesn't allow). Only a good answer's values are passed on. A number where a text belongs is read as its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import patterns as P
from lexloom.functions.text import strip
from lexloom.functions.vectors import sliced

TEXTS = ["tipo_coincidencia", "nivel_cumplimiento", "analisis_lexico", "analisis_semantico_top1", "analisis_semantico_top2", "analisis_semantico_top3", "analisis_general"]
LISTS = ["brechas", "ner_general", "entidades_financieras", "entidades_normativas"]
_CORRUPT = "_corrupto"
VERDICT = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} array<string>" for c in LISTS)])
GRADES = "candidatos array<struct<element_id: string, relevante: boolean, score: double, razon: string>>"


def _read(answer: Column, schema: str) -> Column:
    """The first `{` to the last `}` of an answer, under a schema; what doesn't fit goes to a column of its own."""
    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    return F.from_json(body, f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def _state(answer: Column, told: Column, missing: Column, wrong: Column, good: str) -> Column:
    blank = answer.isNull() | (strip(answer) == "")
    broken = told.isNull() | told[_CORRUPT].isNotNull()
    return F.when(blank, "sin_respuesta").when(broken, "malformado").when(missing, "incompleto").when(wrong, "fuera_de_rango").otherwise(good)


def parse_verdict(rows: DataFrame, answer: str) -> DataFrame:
    """`rows` with the eleven fields of a verdict and estado_analisis; missing lists are empty."""
    told, text = F.col("_told"), F.col(f"`{answer}`")
    missing = told.tipo_coincidencia.isNull() | told.nivel_cumplimiento.isNull() | told.analisis_general.isNull()
    nulls = [F.coalesce(F.exists(told[c], lambda x: x.isNull()), F.lit(False)) for c in LISTS]
    wrong = ~told.tipo_coincidencia.isin("lexica", "semantica", "ninguna") | ~told.nivel_cumplimiento.isin(P.LEVELS) | F.greatest(*nulls)
    read = rows.withColumn("_told", _read(text, VERDICT)).withColumn("estado_analisis", _state(text, told, missing, wrong, "analizado"))
    good = F.col("estado_analisis") == "analizado"
    empty = F.array().cast("array<string>")
    fields = {c: F.when(good, told[c]) for c in TEXTS} | {c: F.when(good, F.coalesce(told[c], empty)).otherwise(empty) for c in LISTS}
    return read.withColumns(fields).drop("_told")


def parse_grades(rows: DataFrame, answer: str) -> DataFrame:
    """`rows` with candidatos, an array of (element_id, relevante, score, razon), and estado_grados; one bad grade makes
    the whole answer bad, as its other grades can't be trusted to be those meant."""
    told, text = F.col("_told"), F.col(f"`{answer}`")
    grades = told.candidatos
    missing = grades.isNull() | F.exists(grades, lambda g: g.isNull() | g.element_id.isNull() | g.relevante.isNull() | g.score.isNull() | g.razon.isNull())
    wrong = F.exists(grades, lambda g: (g.score < 0) | (g.score > 1) | F.isnan(g.score))
    read = rows.withColumn("_told", _read(text, GRADES)).withColumn("estado_grados", _state(text, told, missing, wrong, "calificado"))
    return read.withColumn("candidatos", F.when(F.col("estado_grados") == "calificado", grades).otherwise(F.array().cast(grades_type()))).drop("_told")


def grades_type() -> str:
    return GRADES.removeprefix("candidatos ").replace(": ", ":").replace(", ", ",")


def level_answer(section: str, kind: str, hierarchy: str, references: str) -> str:
    """A stand-in for an analyst that answers in text: a citation complies, a relevant candidate does in part."""
    level = {"lexica": "cumple", "semantica": "parcial"}.get(kind, "omision")
    told = {
        "tipo_coincidencia": kind, "nivel_cumplimiento": level, "analisis_general": f"{kind}: {level}",
        "analisis_lexico": "citado" if kind == "lexica" else None, "analisis_semantico_top1": "cercano" if kind == "semantica" else None,
        "brechas": [] if level == "cumple" else [f"{level}: {len(references)} / {len(section)}"], "ner_general": [hierarchy] if hierarchy else [],
        "entidades_financieras": [], "entidades_normativas": sorted(set(re.findall("Art[.][0-9]+", references))),
    }
    return f"Respuesta:\n```json\n{json.dumps(told, ensure_ascii=False)}\n```"


def ask(analyst: Callable[[str, str, str, str], str]):
    """Column function over (section, kind, hierarchy, references): the answer, or the error of a call that failed."""

    @F.arrow_udf("struct<respuesta:string,error:string>")
    def answers(*columns: pa.Array) -> pa.Array:
        out = []
        for asked in sliced(*columns):
            try:
                told = analyst(*asked)
                out.append({"respuesta": told if told is None else str(told), "error": None})
            except Exception as e:  # noqa: BLE001  a model may fail in any way
                out.append({"respuesta": None, "error": f"{type(e).__name__}: {e}"[:500]})
        return pa.array(out, pa.struct([("respuesta", pa.string()), ("error", pa.string())]))

    return answers
