import re
from collections import Counter, defaultdict

from lexloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def by_brute_force(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(lower(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        n = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


def audited(docs, **limits):
    rows = D.audit(docs, **limits).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_whole_table_and_hostile_rows(documents):
    docs = documents.select("text", "lang", "source")
    assert audited(docs) == by_brute_force([tuple(r) for r in docs.collect()])


def test_long_posting_lists_small_memory_and_few_terms(spark, monkeypatch):
    """Tiles of two postings, counters that pass on early, and texts in pieces give the same rows."""
    rows = [(f"The the {'x' * (i % 3)} own{i % 7} né{i % 5} {'pad ' * (i % 4)}", "en", f"s{i % 11}") for i in range(150)]
    rows += [("solo words", "de", "a"), (None, "de", "b"), ("", None, None), ("common", "fr", "one")] + [("common Ünder", "fr", "one")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(D, "TILE", 2)
    monkeypatch.setattr(D, "HELD_TERMS", 5)
    monkeypatch.setattr(D, "PIECE", 8)
    assert audited(docs) == by_brute_force(rows)
    assert audited(docs, top=3) == by_brute_force(rows, top=3)
    monkeypatch.setattr(D, "FEW_GROUPS", 0)
    assert audited(docs) == by_brute_force(rows)


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(10**13, 3 * 10**13, 10**6), (8_999_999_998, 10**10, 5), (9_000_000_000, 10**10, 5), (0, 0, 0)], "n long, t long, v long")
    got = [r.p for r in rows.select(D.share(*map(rows.__getitem__, "ntv")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 1) // max(1, t + v) for n, t, v in [(10**13, 3 * 10**13, 10**6), (8_999_999_998, 10**10, 5), (9_000_000_000, 10**10, 5), (0, 0, 0)]]


def test_empty_table_and_other_columns(spark):
    assert D.audit(spark.createDataFrame([], KIND)).count() == 0
    docs = spark.createDataFrame([(1, "a a b", "x", "s", "n", "t")] * 3, f"{KIND}, n string, term string")
    assert audited(docs) == by_brute_force([("a a b", "x", "s")] * 3)
