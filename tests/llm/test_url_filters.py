import datetime as dt

from lexloom.llm import url_filters as U

DAY = dt.date(2024, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


def brute(captures, entries):
    for key, url, at in captures:
        host = (url or "").partition("://")[2].partition("/")[0].lower()
        found = set()
        for category in {e[0] for e in entries if e[0]}:
            for domain in {e[1].lower() for e in entries if e[1]}:
                dated = {}
                for c, d, listed, since in entries:
                    if c == category and d and d.lower() == domain and since and at and since <= at:
                        dated[since] = dated.get(since, False) or listed
                if dated and dated[max(dated)] and host and (host == domain or host.endswith("." + domain)):
                    found.add(category)
        yield key, host, ",".join(sorted(found)), bool(found)


def test_equals_brute_force(spark):
    entries = [
        ("spam", "a.org", True, on(5)), ("spam", "a.org", False, on(9)), ("spam", "a.org", True, on(20)), ("ads", "b.a.org", True, on(1)),
        ("spam", "Tie.org", False, on(3)), ("spam", "tie.org", True, on(3)), ("ads", None, True, on(1)), (None, "a.org", True, on(1)), ("ads", "c.org", True, None),
        ("spam", "org", True, on(30)),
    ]
    hosts = ["http://a.org/x", "https://www.b.a.org", "http://xa.org/", "http://TIE.org/q", "http://c.org", None, "no url", "http://sub.a.org/"]
    captures = [(i * 100 + n, u, on(n)) for i, u in enumerate(hosts) for n in range(0, 35, 2)] + [(-1, "http://a.org/x", None), (-2, "http://a.org/x", on(6)), (-2, "http://a.org/x", on(6))]
    frame = spark.createDataFrame([(*c, "old") for c in captures], "id long, url string, fetched date, host string")
    rules = spark.createDataFrame(entries, "category string, domain string, listed boolean, at date")
    got = sorted((r.id, r.host, ",".join(r.categories), r.blocked) for r in U.filter_urls(frame, rules).collect())
    assert got == sorted(brute(captures, entries))
    assert any(r[3] for r in got)
    assert U.filter_urls(frame, rules.where("false")).where("blocked").count() == 0
    assert U.filter_urls(frame.where("false"), rules).count() == 0
