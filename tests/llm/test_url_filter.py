from __future__ import annotations

import re
from itertools import combinations

import __spark_entry__ as E
from pyspark.sql import functions as F
from regiolens.llm import url_filter as U
from tests.llm.conftest import SF


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def fits(host, path):
    hit = [(len(h) + len(p), h + p, v) for v, h, p in U.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(hit)[1:] if hit else (None, None)


def test_query_list_part(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = E.queries()["op5_url_filter"](spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == split(urls[r.page_id])
        rule, verdict = fits(r.host, r.path)
        assert r.rule == rule and (r.verdict == verdict if rule else r.verdict in ("allow", "block"))


def test_mined_rules_and_matches_against_enumeration(spark):
    hosts = ["a.net", "b.net", "c.org", "x.spam.com", "y.spam.com", "d.com"]
    urls = [f"http{'s' if i % 3 else ''}://{h}/{p}/{i}{e}" for i in range(9) for h in hosts for p in ("en", "buy") for e in ("", ".html")]
    data = [(u, "block" if "net/" in u or ("spam" in u and "buy" in u) else "allow") for u in urls]
    test = [f"https://z.spam.com/{p}/1" for p in ("en", "buy")] + ["http://q.net/en/2", "ftp://other/", "https://n.org/buy/x.html"]
    labelled = spark.createDataFrame(data, "url string, label string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(test)], "page_id long, url string")
    got = {r.url: r for r in U.filter_urls(pages, rules=(), labelled=labelled, min_support=0.05, min_confidence=0.8).collect()}

    def sets(us):
        df = spark.createDataFrame([(u,) for u in us], "url string")
        rows = df.select("url", U.tokens_of(F.col("url"), U.host_of(F.col("url")), U.path_of(F.col("url"))).alias("t")).collect()
        return {r.url: frozenset(r.t) for r in rows}
    tok, all_tok = sets(test), sets(urls)
    count, joint = {}, {}
    for u, label in data:
        for n in range(1, len(all_tok[u]) + 1):
            for c in combinations(sorted(all_tok[u]), n):
                count[c] = count.get(c, 0) + 1
                joint[c, label] = joint.get((c, label), 0) + 1
    rules = {(c, v): n / count[c] for (c, v), n in joint.items() if n >= 0.05 * len(data) and n / count[c] >= 0.8}
    for u in test:
        best = max((p for (c, v), p in rules.items() if set(c) <= tok[u]), default=None)
        assert (got[u].confidence is None) == (best is None) and (best is None or abs(got[u].confidence - best) < 1e-9)
        if best is not None:
            sure = {v for (c, v), p in rules.items() if set(c) <= tok[u] and p == best}
            assert got[u].verdict in sure
    assert got["https://z.spam.com/buy/1"].verdict == "block" and got["https://z.spam.com/en/1"].verdict == "allow"


def test_query_learns_from_the_documents_labels(spark, tmp_path):
    """A host of bad documents is blocked, hosts that tell nothing get the default."""
    urls = [(i, f"https://{('bad', 'a', 'b', 'c')[i % 4]}.example.org/en/{i}{('', '.html', '?q=1')[i % 3]}") for i in range(600)]
    urls += [(600, "https://bad.example.org/en/99999"), (601, "https://new.example.org/es/5"), (602, "https://a.example.org/en/" + "9" * 30)]
    labels = [(i, 0 if i % 4 == 0 else int(i % 5 != 0), 0) for i in range(0, 600) if i % 8 < 5] + [(7, None, None), (None, 0, 1)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in U.op5_query(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls)
    for i, u in urls:
        assert got[i].rule is None and got[i].verdict == ("block" if "//bad." in u else "allow"), u
    assert "bad.example.org" in got[600].mined_rule and got[601].mined_rule is None


def test_no_evidence_gives_the_default(spark):
    """Labels of the test data have nothing to do with the urls."""
    rows = E.queries()["op5_url_filter"](spark, "/root/testdata/sf0.1").where("rule is null").collect()
    assert len(rows) == 1407 and {(r.verdict, r.mined_rule) for r in rows} == {("allow", None)}


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "http://A.Example.NET/en/x"), (2, "no scheme"), (3, "x://"), (4, "http://h?q=1#f"),
            (5, "http://a.net"), (6, "http://a.net/"), (7, "http://" + "a." * 5000 + "net/" + "b/" * 5000), (8, "a://b://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as tokens", "3 as id", "'z' as label")
    got = U.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("", "", None, "allow") and by[None] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[2][:2] == by[3][:2] == ("", "") and by[4][:3] == ("h", "", None)
    assert by[5][:3] == ("a.net", "", None) and by[6][2:] == ("net/", "block") and by[7][2:] == ("net/", "block")
    assert by[8][:2] == ("b:", "//c/d")
    assert U.filter_urls(pages.limit(0)).collect() == []
