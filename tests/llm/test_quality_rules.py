import re
from collections import Counter, defaultdict

from lexloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return re.sub(" {2,}", " ", re.sub("[\t\x0b\x0c\r]", " ", line).lower()).strip(" ")


def boilerplate(spark):
    """A line in many documents of one host, an exact copy in many, near copies in many, and few near copies that share their lines."""
    words = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    rows = [(i, f"Read  more here now\n{words(i, 30)}", "h") for i in range(40)]
    rows += [(100 + i, f"read more here now\nAll rights are kept by us and by nobody else at all\n{words(i, 9)}", "h") for i in range(40)]
    rows += [(200 + i, f"{words(0, 30)}\nold copies stay {words(1, 4)}", "h") for i in range(60)]
    near = words(7777, 60).split()
    rows += [(300 + i, " ".join([*near[:30], f"edit{i}", *near[31:]]) + "\nthe same last line of all", "h") for i in range(60)]
    rows += [(400 + i, f"{words(9, 40)}\nnear copy {words(i, 3)}", "h") for i in range(12)]
    return rows + [(500, None, "h"), (501, "", None), (502, f"read more here now\n{words(1, 30)}", None), (503, words(5, 25), "other")]


def test_base_counts(documents):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.judge(documents.drop("n_words")).collect()
    )
    assert got == Counter((r.doc_id, *base(r.text)) for r in documents.collect())


def test_verdicts(spark):
    rows = boilerplate(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert all(got[i].kept and got[i].lost_words == 4 for i in range(40))
    assert not any(got[100 + i].kept for i in range(40)) and got[100].lost_words == 16
    assert all(got[200 + i].kept and got[200 + i].lost_words == 0 for i in range(60))
    assert all(got[300 + i].kept and got[300 + i].lost_words == 6 for i in range(60))
    assert all(got[400 + i].kept and got[400 + i].lost_words == 0 for i in range(12))
    assert got[502].lost_words == 0 and got[502].kept and got[503].kept and not got[500].kept and not got[501].kept


def verdicts(rows, limits):
    """(lost words, kept) of rows (doc_id, text, source), by plain counting of distinct texts."""
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        hosts[source].add(text)
        for line in filter(WORD.search, (text or "").split("\n")):
            holders[source, normal(line)].add(text)
    above = {k for k, v in holders.items() if len(v) > limits.line_docs and len(v) > limits.line_share * len(hosts[k[0]])}
    out = []
    for doc_id, text, source in rows:
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (source, normal(x)) in above)
        n, *_, failed = base(text)
        out.append((doc_id, lost, not failed and lost <= limits.max_lost * n))
    return Counter(out), above


def test_verdicts_by_brute_force(spark, monkeypatch):
    """Different texts of one form are different documents: invoices, list entries, one footer."""
    words = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    rows = boilerplate(spark)
    rows += [(1000 + i, f"The item number {i} stays in our list for everybody who may want to look at it again\nOne footer of our shop for all the items in the list", "shop") for i in range(20)]
    rows += [(2000 + i, f"Invoice {i}\nTo be paid within thirty days from now\n{words(3, 4)} {i} {words(4, 20)}", None) for i in range(13)]
    rows += [(3000 + i, f"Invoice {i}\nTo be paid within thirty days from now\n{words(3, 4)} {i} {words(4, 20)}", "") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limits, size in ((Q.Limits(), 8 << 20), (Q.Limits(line_docs=5, line_share=0.1), 8 << 20), (Q.Limits(), -1)):
        monkeypatch.setattr(Q, "BROADCAST_BYTES", size)
        want, above = verdicts(rows, limits)
        assert len(above) >= 3
        assert Counter((r.doc_id, r.lost_words, r.kept) for r in Q.judge(docs, limits).collect()) == want


def test_verdicts_on_a_table_whose_lines_exceed_the_limit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    want, above = verdicts([tuple(r) for r in docs.collect()], Q.Limits())
    assert len(above) > 50 and any(lost for _, lost, _ in want)
    assert Counter((r.doc_id, r.lost_words, r.kept) for r in Q.judge(docs).collect()) == want


def test_clean(spark, documents):
    rows = boilerplate(spark)
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, rows[0]]], "doc_id long, text string, source string, removed string")
    kept = Q.clean(docs).collect()
    texts = {r.doc_id: r.text for r in kept}
    assert texts[3].startswith("u3x0") and len(kept) == 40 + 120 + 12 + 2 + 1 and {r.removed for r in kept} == {"x"}
    assert Q.clean(documents).columns == documents.columns
    assert Q.clean(documents.where("false")).count() == 0


def test_lines_in_documents_that_are_mostly_boilerplate(spark):
    """Many wordings of boilerplate, 60 to 90 % of each text: every wording's lines are counted as by brute force."""
    words = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    rows = []
    for wording in range(40):
        shared = [words(f"b{wording}p{k}", 15) for k in range(2)]  # 30 shared words
        own, holders = (20, 13, 8, 4)[wording % 4], (13, 12, 60)[wording % 3]
        for i in range(holders):
            # some lack the second line, some exact copies
            rows.append((len(rows), "\n".join([*shared[: 1 + (i != 5)], words(f"o{wording}d{i}", own)]), f"h{wording % 4}"))
        rows += [(len(rows) + i, rows[-1][1], rows[-1][2]) for i in range(20)]
    near = [words("n", 60).split() for _ in range(2)]
    rows += [(10000 + i, " ".join([*near[0][:30], f"edit{i}", *near[0][31:]]) + "\nfooter of one host", "h9") for i in range(60)]
    rows += [(20000 + i, words(f"s{i}", 25) + "\nfooter of one host", "h9") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = defaultdict(set)
    for _, text, source in rows:
        for line in text.split("\n"):
            texts[source, line].add(text)
    frequent = {k for k, v in texts.items() if len(v) > 12}
    assert len(frequent) > 40
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    for doc_id, text, source in rows:
        lost = sum(len(x.split()) for x in set(text.split("\n")) if (source, x) in frequent)
        assert got[doc_id].lost_words == lost, doc_id
        assert got[doc_id].kept == (len(text.split()) >= 20 and lost <= 0.5 * len(text.split()))


def test_rows_whose_columns_have_inner_names(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "s", text, "mine"), (2, "s", text[::-1], "too")], "doc_id long, source string, text string, _text_hash string")
    got = Q.clean(docs)
    assert got.columns == docs.columns and sorted(r._text_hash for r in got.collect()) == ["mine", "too"]
