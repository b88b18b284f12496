from __future__ import annotations

import hashlib
import math
import re
import time

import __spark_entry__ as E
from regiolens.llm import secrets as S
SF = "/root/testdata/sf0.01"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_query_against_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op9_secret_scan"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("cred")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in S.KINDS[:3])


def test_guess_cost_is_the_cheapest_of_all_spellings():
    ranks = {"pass": 3, "word": 9, "password": 40, "red": 7, "the": 1}

    def brute(v, segs, i=0):
        return 0.0 if i == len(v) else min(c + brute(v, segs, j) for a, j, c in segs if a == i)

    for v in ("password", "Password1", "aaaa", "qwerty12", "20240131", "red2019", "x9$kQz", "thered1234", "zzz"):
        assert math.isclose(S.guess_cost(v, ranks), brute(v, list(S.segments(v, ranks))))
    assert S.guess_cost("password2019", ranks) < S.MIN_GUESSES < S.guess_cost("f8cb0ab732d29a", ranks)
    assert S.guess_cost("a" * 100_000, ranks) < S.MIN_GUESSES


def test_contexts_and_mask():
    got = S.find_secrets("ü Bearer aZ39kLqp01xV; pwd: changeme url ftp://bob:Xk29dm1Qw@h/".encode(), {"changeme": 5}, 7.0)
    assert [(k, a, b) for k, a, b, _ in got] == [("cred", 9, 21), ("cred", 51, 60)]
    assert S.mask("abcdef", [(1, 3), (2, 4), (4, 5)]) == "a[SECRET][SECRET]f"


def test_url_credentials_of_any_length():
    jwt = "eyJ" + "aZ39kLqp01xV" * 40
    for user, value in (("oauth2", jwt), ("u" * 65, "Xk29dm1Qw"), ("", "Xk29dm1Qw"), ("bob", "Xk2:9dm1Qw"), ("ü" * 40, "Xk29dm1Qw")):
        text = f"ü see https://{user}:{value}@host/x and http://h:80/p@q"
        at = text.index(value)
        assert [s[:3] for s in S.find_secrets(text.encode(), {}, 7.0)] == [("cred", at, at + len(value))]
    assert S.find_secrets(b"http://h/a:Xk29dm1Qw@b x://a b:Xk29dm1Qw@ y://h:Xk29dm1Qw", {}, 7.0) == []
    assert S.find_secrets(b"a://" * 200_000 + b":Xk29dm1Qw@h", {}, 7.0) != []


def test_word_ranks_cover_all_documents(spark):
    docs = spark.createDataFrame([("aaa bbb",), ("aaa Ccc",), (None,), ("aaa",)], "text string").repartition(4)
    assert S.word_ranks(docs, min_share=0.3, flush=1) == {"aaa": 1}
    assert S.word_ranks(docs, min_share=0.01) == {"aaa": 1, "bbb": 2, "ccc": 3}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.scan_secrets(odd_docs).collect()
    assert len(rows) == 8 and sum(len(r.spans) > 0 for r in rows) == 2
    out = S.redact_secrets(odd_docs)
    assert out.columns == odd_docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "[SECRET] all rights reserved" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[5].n_chars == 300_000
    assert S.scan_secrets(no_docs).collect() == [] and S.redact_secrets(no_docs).collect() == []


def test_any_number_of_blanks():
    for n in (1, 8, 9, 5000):
        text = ("pwd" + " " * n + "=" + " " * n + "zQ9$kf!2LmV#x81pR and Bearer" + " " * n + "zQ9kf2LmVx81pRw7Yt").encode()
        kinds = [k for k, *_ in S.find_secrets(text, {}, S.MIN_GUESSES)]
        assert kinds.count("cred") == 2
    started = time.time()
    assert S.find_secrets(b"password" + b" " * 200_000 + b"x " * 10, {}, S.MIN_GUESSES) == []
    assert time.time() - started < 5
