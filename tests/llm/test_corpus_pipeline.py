from __future__ import annotations

import hashlib
from collections import defaultdict

import corpus_pipeline as P
from regiolens.llm import decontaminate as D
from regiolens.llm import lang_id, mixing, secrets
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import plain_distance
from tests.llm.test_jaccard_join import WORD, brute
from tests.llm.test_mixing import level_targets


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_run_against_brute_force(spark):
    """Every stage again in plain Python, on the rows the stage before kept."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [D.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: r.text for i, r in rows.items() if lang_id.has_letter(r.text)}
    comp = brute(list(texts.items()))
    texts = {i: t for i, t in texts.items() if comp[i] == i}

    def leaky(t):
        hay = D.normalise(t)
        return any(any(x[a:b] in hay for a, b in cuts(x)) and plain_distance(x, hay) <= len(x) // D.CHARS_PER_EDIT for x in items)

    def cuts(x):
        k = len(x) // D.CHARS_PER_EDIT
        at = [len(x) * j // (k + 1) for j in range(k + 2)]
        return zip(at, at[1:], strict=False)

    texts = {i: t for i, t in texts.items() if not leaky(t)}
    ranks = secrets.word_ranks(spark.createDataFrame([(t,) for t in texts.values()], "text string"))
    texts = {i: secrets.mask(t, [s[1:3] for s in secrets.find_secrets(t.encode(), ranks, secrets.MIN_GUESSES)])
             for i, t in texts.items()}
    sizes = {i: len(WORD.findall(t)) for i, t in texts.items()}
    per = defaultdict(int)
    for i, n in sizes.items():
        per[rows[i].source] += n
    target = level_targets(dict(per), mixing.WEIGHTS)
    want = {}
    for s in per:
        ids = sorted((i for i in sizes if rows[i].source == s), key=lambda i: md5(f"17:{i}:{s}:{md5(texts[i])}"))
        epochs, left = divmod(int(target[s] + 1e-9), per[s])
        for i in ids:
            cut = max(0, min(sizes[i], left))
            left -= sizes[i]
            if epochs * sizes[i] + cut:
                want[i] = (texts[i], sizes[i], epochs * sizes[i] + cut)
    got = {r.doc_id: (r.text, r.size, r.taken) for r in P.run(spark, SF).collect()}
    assert got == want


def test_near_duplicates_under_shared_ids(spark):
    """Rows that share an id go by their own texts: one row of each component stays."""
    text = lambda n: " ".join(f"w{n}x{j}" for j in range(60))
    rows = [(7, text(i)) for i in range(30)]  # unlike texts under one id
    rows += [(7, text(3)), (7, text(3)), (3, text(5)), (9, text(5) + " more"), (9, text(40)), (2, text(41)), (2, text(41) + " more"),
             (7, text(41)), (11, ""), (11, None), (None, text(0)), (None, text(0))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, df, SF).collect()]
    ours = [r for r in got if r != (2, text(41)) and r != (2, text(41) + " more")]
    want = [(7, text(i)) for i in range(30) if i != 5] + [(3, text(5)), (9, text(40)), (11, ""), (11, None), (None, text(0)), (None, text(0))]
    assert sorted(ours, key=str) == sorted(want, key=str) and len(got) == len(want) + 1


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for name, stage in P.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF)
            if name != "mixing":
                assert out.columns == docs.columns
            out.collect()


def test_language_stage_drops_texts_without_a_main_language(spark):
    """The score decides, not only whether a text has letters."""
    en, fr = "the cat and the dog sat on the mat", "le chat et le chien dorment sous la table"
    docs = [(1, en, "en"), (2, fr, "fr"), (3, "zzqx wwvk", None), (4, "the cat and the dog", None), (5, "12", None), (6, None, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    # text 3 has letters but matches no language; 4 has no label and matches one
    assert sorted(r.doc_id for r in P.language_id(spark, df, SF).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in lang_id.keep_identified(df).collect()) == [1, 2, 3, 4]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id for r in lang_id.identify(docs, lang_id.train(docs)).where(f"lang_score >= {P.MIN_LANG_SCORE}").collect()}
    assert {r.doc_id for r in P.language_id(spark, docs, SF).collect()} == found
