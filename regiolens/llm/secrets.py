"""Secret scan with password guess costs.

Three exact patterns give the base spans.  The method adds the values that
stand in a credential context (``password = ...``, ``Bearer ...``,
``scheme://user:...@host``) and would take many guesses: a dynamic programme
finds the cheapest way to spell the value as a chain of words, dates, repeats,
keyboard walks and brute-force characters, in log10 of guesses.  Placeholders
such as ``changeme2020`` are cheap and stay; random values are dear.

Words cost their rank in the corpus' own word counts.  The counts run over all
documents (per-task pre-aggregation, one small shuffle); the dictionary keeps
the words with at least ``min_share`` of all words, so it has at most
``1 / min_share`` entries whatever the corpus, and is broadcast.

Defined results: null and empty texts have no spans; every input row gives one
row, repeated rows and null ids too; spans at one start go by kind, equal spans
of one kind count once; a very long text is searched whole, in linear time; other
columns, whatever their names, pass unread; an empty corpus gives an empty
dictionary and no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import ASCII_LOWER, Scratch, releasing, slices, table

KINDS = ("assign", "access", "hex", "cred")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
_HEX_MAP = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
# credential contexts of the method; the value is the last group
CONTEXTS = (
    (re.compile(rb"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|private[_-]?key|api[_-]?key|auth)["']?"""
                rb"""\x20*+[:=]\x20*+["']?([!-&(-~]{6,})""", re.I),
     (b"pass", b"pwd", b"secret", b"token", b"credential", b"private", b"api", b"auth")),
    (re.compile(rb"bearer\x20++([A-Za-z0-9+/_.=~-]{6,})", re.I), (b"bearer",)),
)
_USERINFO_END = re.compile(rb"[\x00-\x20\x7f/@]")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Keyboard rows and character orders walked along
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
MIN_GUESSES = 7.0
MIN_SHARE = 2e-5
LONGEST_WORD = 24

_NEXT = {(a, b) for w in WALKS for a, b in zip(w, w[1:], strict=False)} | {
    (b, a) for w in WALKS for a, b in zip(w, w[1:], strict=False)}


def segments(value: str, ranks: Mapping[str, int], longest: int = LONGEST_WORD) -> Iterator[tuple[int, int, float]]:
    """Every segment ``(start, end, log10 guesses)`` the spelling may use, by
    start.  Repeats and walks reach to their end, so the count is linear."""
    low, n = value.lower(), len(value)
    run_end, walk_end = [n] * n, [n] * n
    for i in range(n - 2, -1, -1):
        run_end[i] = run_end[i + 1] if value[i] == value[i + 1] else i + 1
        walk_end[i] = walk_end[i + 1] if (low[i], low[i + 1]) in _NEXT else i + 1
    for i in range(n):
        yield i, i + 1, 1.0  # brute force: ten guesses a character
        if run_end[i] - i >= 3:
            yield i, run_end[i], math.log10(20 * (run_end[i] - i))
        if walk_end[i] - i >= 4:
            yield i, walk_end[i], math.log10(50 * (walk_end[i] - i))
        if low[i].isdigit() and (m := DATE.match(low, i)):
            yield i, m.end(), math.log10(120 if m.end() - i == 4 else 365 * 120)
        if low[i].isalpha():
            for j in range(i + 3, min(n, i + longest) + 1):
                if rank := ranks.get(low[i:j]):
                    yield i, j, math.log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0.0)


def guess_cost(value: str, ranks: Mapping[str, int], longest: int = LONGEST_WORD) -> float:
    """log10 of the guesses for the cheapest spelling of ``value``."""
    best = [0.0] + [math.inf] * len(value)
    for i, j, cost in segments(value, ranks, longest):
        best[j] = min(best[j], best[i] + cost)
    return best[-1]


def url_passwords(raw: bytes) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of what stands between the first ``:`` and the ``@`` of a
    url's ``user:...@``, whatever their lengths (the user may be empty).  Each
    walk ends at the next url's slashes, so all are linear in the text."""
    at = raw.find(b"://")
    while at >= 0:
        start = at + 3
        m = _USERINFO_END.search(raw, start)
        if m and m[0] == b"@" and (colon := raw.find(b":", start, m.start())) >= 0:
            yield colon + 1, m.start()
        at = raw.find(b"://", start)


def find_secrets(raw: bytes, ranks: Mapping[str, int], min_guesses: float) -> list[tuple[str, int, int, float]]:
    """Spans ``(kind, start, end, guesses)`` in code points, by start, kind and end.
    All patterns are ASCII, so the UTF-8 bytes are searched as they are."""
    found: list[tuple[int, int, int, float]] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    hexes = raw.translate(_HEX_MAP)
    if b"h" * 24 in hexes:
        found += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(raw)]
    values = [m.span(1) for pattern, words in CONTEXTS if any(w in low for w in words) for m in pattern.finditer(raw)]
    for a, b in [*values, *url_passwords(raw)]:
        value = raw[a:b].rstrip(b"\"',;)]}>")
        if len(value) >= 6 and (cost := guess_cost(value.decode("latin-1"), ranks)) >= min_guesses:
            found.append((a, 3, a + len(value), cost))
    found = sorted(set(found))
    out, at, chars = [], 0, 0
    for a, kind, b, cost in found:  # code points: count up to each start once
        chars, at = chars + len(raw[at:a].decode("utf-8", "replace")), a
        out.append((KINDS[kind], chars, chars + len(raw[a:b].decode("utf-8", "replace")), cost))
    return out


_NOT_LETTER = bytes(ASCII_LOWER[b] if 0x61 <= ASCII_LOWER[b] <= 0x7A else 0x20 for b in range(256))


def word_ranks(docs: DataFrame, *, text_col: str = "text", min_share: float = MIN_SHARE,
               longest: int = LONGEST_WORD, flush: int = 200_000) -> dict[str, int]:
    """Ranks of the words (a-z runs) with at least ``min_share`` of all word
    places, counted over all documents; at most ``1 / min_share`` entries."""
    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in c], pa.string()),
                                               pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        words: Counter = Counter()
        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                if x:
                    words.update(x.translate(_NOT_LETTER).split())
                    if len(words) > flush:
                        yield out(words)
                        words = Counter()
        yield out(words)

    scratch = Scratch(docs.sparkSession, "words")
    counts = scratch.store("counts", docs.select(F.col(text_col).cast("string").alias("text"))
                           .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = (counts.where((F.col("n") >= min_share * total) & F.length("word").between(3, longest))
           .collect())  # at most 1 / min_share rows
    scratch.drop("counts")
    return {r["word"]: i + 1 for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"])))}


SCHEMA = "id long, spans array<struct<kind:string,start:long,end:long,guesses:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: Mapping[str, int] | None = None,
                 min_guesses: float = MIN_GUESSES) -> DataFrame:
    """One row per input row: ``id`` and ``spans`` (kind, start, end in code
    points, log10 guesses of credential values), by start, kind and end."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dict(ranks) if ranks is not None else word_ranks(docs, text_col=text_col))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "guesses"), s, strict=True))
                      for s in find_secrets(x, words, min_guesses)] if x else []
                     for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, SCHEMA))


def mask(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars",
                   ranks: Mapping[str, int] | None = None, min_guesses: float = MIN_GUESSES,
                   mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret replaced by ``mark``; the length
    column, where there is one, follows.  Rows without secrets are unchanged."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dict(ranks) if ranks is not None else word_ranks(docs, text_col=text_col))
    at, length = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for b in slices(batches, text_col, 4_000_000):
            raw = b.column(at).cast(pa.binary()).to_pylist()
            texts, changed = list(raw), {}
            for i, x in enumerate(raw):
                if x and (spans := find_secrets(x, words, min_guesses)):
                    new = mask(x.decode(), [s[1:3] for s in spans], mark)
                    texts[i], changed[i] = new.encode(), len(new)
            if changed:
                cols = list(b.columns)
                cols[at] = pa.array(texts, pa.binary()).cast(b.column(at).type)
                if length is not None:
                    sizes = b.column(length).to_pylist()
                    sizes = [changed.get(i, n) for i, n in enumerate(sizes)]
                    cols[length] = pa.array(sizes, b.column(length).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def op9_query(spark, sf_dir: str) -> DataFrame:
    r = scan_secrets(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "cred")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return r.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
                    count("hex").alias("n_hex"),
                    F.sha2(F.array_join(F.transform(base, name), ",").cast("binary"), 256).alias("base_sha256"),
                    F.array_join(F.transform("spans", name), ",").alias("spans"))
