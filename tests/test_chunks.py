"""The hierarchical chunker and the pages of its chunks against a plain fold over lines."""

import re

from lexloom.operators import chunks as C

MD = """intro uno

# A
uno dos tres

cuatro
cinco
## B
seis
#### D
siete
###### F
ocho
## C

nueve
# 
diez
# A
once
# A

doce trece catorce quince dieciseis diecisiete

dieciocho"""


def fold(md, most):
    stack, paragraphs, words = {}, [], None
    for line in [*md.split("\n"), ""]:
        heading = re.match(r"^(#{1,6})[ \t]+(.*)$", line)
        if heading or not line.strip():
            if words:
                paragraphs.append((tuple(stack[k] for k in sorted(stack) if stack[k]), words))
            words = None
            if heading:
                level = len(heading[1])
                stack = {k: v for k, v in stack.items() if k < level} | {level: heading[2].strip()}
        else:
            words = (words or []) + line.split()
    pieces = [(path, ws[i : i + most]) for path, ws in paragraphs for i in range(0, len(ws), most)]
    out = []
    for path, ws in pieces:
        if out and out[-1][0] == path and out[-1][2] + len(ws) <= most:
            out[-1][1].append(" ".join(ws))
            out[-1][2] += len(ws)
        else:
            out.append([path, [" ".join(ws)], len(ws)])
    return [(list(p), "\n".join(t), n) for p, t, n in out]


def test_chunks_by_a_plain_fold(spark):
    texts = [MD, "", None, "# only\n## headings", "x " * 1500, "\n\n".join(f"{'#' * (i % 6 + 1)} h{i}\np{i} q\n\nr{i}" for i in range(60)), "# A\n\na\n\n# A\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string")
    for most in (3, 7, 512):
        got = C.hierarchical_chunks(docs, most).orderBy("doc_id", "chunk").collect()
        for i, text in enumerate(texts):
            mine = [r for r in got if r.doc_id == i]
            assert [(r.headings, r.texto, r.n_tokens) for r in mine] == fold(text or "", most)
            assert [r.chunk for r in mine] == list(range(len(mine)))
            assert all(r.jerarquia == " > ".join(r.headings) and r.titulo_seccion == (r.headings or [""])[-1] for r in mine)
            assert all(r.embed_text == (f"{r.jerarquia}\n{r.texto}" if r.jerarquia else r.texto) for r in mine)


def test_deep_headings_keep_their_titles(spark):
    docs = spark.createDataFrame([(1, MD)], "doc_id long, md string")
    paths = {r.texto: r.jerarquia for r in C.hierarchical_chunks(docs).collect()}
    assert paths["siete"] == "A > B > D" and paths["ocho"] == "A > B > D > F" and paths["nueve"] == "A > C"


def test_pages(spark):
    md = "uno dos\n\ntres\fcuatro\n\ncinco\n\n# T\n\nseis\f\f\nsiete ocho"
    docs = spark.createDataFrame([(1, md), (2, "sin marca"), (3, None)], "doc_id long, md string")
    starts = C.page_starts(docs)
    assert sorted((r.doc_id, r.pagina, r.inicio) for r in starts.collect()) == [(1, 1, 0), (1, 2, 14), (1, 3, 39), (1, 4, 40), (2, 1, 0)]
    got = C.hierarchical_chunks(docs, 4, starts).orderBy("doc_id", "chunk").collect()
    # a form feed is white space to neither rule: "tres\fcuatro" is one word on two pages
    assert [(r.texto, r.page_start, r.page_end, r.pagina_inicio, r.pagina_fin) for r in got] == [
        ("uno dos\ntres\fcuatro\ncinco", 1, 2, 1, 1), ("seis\f\f siete ocho", 2, 4, 2, 2), ("sin marca", 1, 1, 1, 1),
    ]
    some = C.hierarchical_chunks(docs, 4, starts.where("pagina > 1")).orderBy("doc_id", "chunk").collect()
    assert [(r.page_start, r.page_end, r.pagina_inicio) for r in some] == [(2, 2, None), (2, 4, 2), (None, None, None)]
