"""Repeated lines by a plain count, row by row, and filters of what is compared."""

import random
from collections import Counter

from lexloom.functions import text as X
from lexloom.operators import compare


def plain(md, least=3, longest=90):
    lines = md.split("\n")
    keys = [" ".join(x.split()).lower() for x in lines]
    times = Counter(keys)
    return "\n".join(x for x, k in zip(lines, keys, strict=True) if k == "" or times[k] < least or len(k) > longest)


def test_repeated_lines_row_by_row(spark):
    draw = random.Random(3)
    texts = ["\n".join(draw.choice(["Pie  de página", "pie de PÁGINA ", "a", "b", "", " ", "x" * 91, f"única {i}"]) for i in range(n)) for n in (0, 1, 2, 3, 4, 9, 40, 400)]
    rows = [(1, None, "n"), (2, "a\nb", "n"), (2, "a\nb", "n"), *[(10 + i, t, "n") for i, t in enumerate(texts)], (None, "z\nz\nz\ny", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, md string, otra string")
    for least, longest in ((3, 90), (2, 3), (1, 90)):
        got = X.strip_repeated_lines(docs, least=least, longest=longest)
        assert got.columns == docs.columns
        want = Counter((i, None if t is None else plain(t, least, longest), o) for i, t, o in rows)
        assert Counter(map(tuple, got.collect())) == want
    assert X.strip_repeated_lines(docs.where("false")).count() == 0
    plan = X.cleaning_chain(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_scopes(spark):
    secs = spark.createDataFrame([(1, "Uno > A"), (2, "Uno"), (3, "Unos"), (4, None), (5, "Dos > A")], "chunk_id long, jerarquia string")
    kept = lambda *a, **b: [r.chunk_id for r in compare.own_sections(secs, *a, **b).orderBy("chunk_id").collect()]
    assert kept() == [1, 2, 3, 4, 5] and kept(["Uno"]) == [1, 2] and kept(["Dos", "Uno > A"]) == [1, 5]
    assert kept(ids=[4, 5]) == [4, 5] and kept(["Uno"], [1, 4]) == [1] and kept([]) == []
