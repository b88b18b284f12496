"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike (lower case, words joined by single
blanks).  An item with an error budget of k edits is split into k + 1 pieces;
wherever a document holds the item within k edits, one piece is unchanged
there.  An Aho-Corasick automaton over all pieces finds the exact piece hits in
one run over the whole text, and Myers' bit-parallel distance verifies the
item in the window around each hit.

The items are a query set: they are collected in blocks of at most
``block_chars`` characters (one block unless the benchmark is huge), and every
block is broadcast and run against all documents; no shuffle of texts.

Items of fewer than ``min_words`` words are looked for exactly, as whole words
(a budget of 0 edits); they are reported, but a document is not dropped for
them alone (an answer like "yes" is no evidence).

Defined results: null and empty texts match nothing; items without a word (null
and empty ones too) match nothing; equal items report every id; repeated
documents report each row; a null document id is reported as null; of places at
equal distance the first counts; a text of any length is searched whole; other
columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import releasing, slices, table

CHARS_PER_EDIT = 16
MIN_WORDS = 5
BLOCK_CHARS = 8_000_000

_WORD = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(b if b in _WORD else 0x20 for b in range(256))


def normalise(text: str | None) -> str:
    """Lower case, words joined by blanks; one character for each UTF-8 byte."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_TO_WORDS).split()).decode("latin-1")


def myers(pattern: str, text: str) -> Iterator[int]:
    """Edit distance of the pattern to the best substring ending at each
    character of the text (bit-parallel, one machine integer a column)."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        x = eq.get(c, 0)
        d0 = ((((x & plus) + plus) ^ plus) | x | minus) & full
        hp, hm = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | (full & ~(d0 | hp)), hp & d0
        yield score


def best_match(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest substring within ``most`` edits;
    the first end wins ties, then the nearest start."""
    best, end = most + 1, -1
    for i, s in enumerate(myers(pattern, text)):
        if s < best:
            best, end = s, i + 1
    if end < 0:
        return None
    back, start = most + 1, 0
    for i, s in enumerate(myers(pattern[::-1], text[:end][::-1])):
        if s < back:
            back, start = s, end - i - 1
    return best, start, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, min_words: int):
        self.items: list[tuple[str, int, list[int]]] = []  # text, budget (-1: whole words only), ids
        where: dict[str, int] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
            if text in where:
                self.items[where[text]][2].append(item_id)
                continue
            where[text] = len(self.items)
            k = -1 if text.count(" ") < min_words - 1 else len(text) // chars_per_edit
            cut = [0, len(text)] if k < 0 else [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((text, k, [item_id]))
        self.automaton = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.automaton.add_word(p, (len(p), at))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, hay: str) -> list[tuple[int, int, int, int]]:
        """(item index, distance, start, end), the nearest place of each item."""
        if not self.any or not hay:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        done: dict[int, tuple[int, int, int]] = {}
        for end, (length, places) in self.automaton.iter(hay):
            for item, at in places:
                if item in done:
                    continue
                text, k, _ = self.items[item]
                s = end - length + 1 - at
                if k < 0:
                    if (s == 0 or hay[s - 1] == " ") and hay[s + length:s + length + 1] in ("", " "):
                        done[item] = (0, s, s + length)
                    continue
                if s >= 0 and hay.startswith(text, s):
                    done[item] = (0, s, s + len(text))
                    continue
                lo, hi = max(0, s - k), s + len(text) + k
                w = windows.setdefault(item, [])
                if w and lo <= w[-1][1] and w[-1][0] <= lo:
                    w[-1] = (w[-1][0], max(hi, w[-1][1]))
                else:
                    w.append((lo, hi))
        for item, spans in windows.items():
            if item not in done:
                text, k, _ = self.items[item]
                found = [(d, lo + a, lo + b) for lo, hi in spans
                         if (m := best_match(text, hay[lo:hi], k)) for d, a, b in [m]]
                if found:
                    done[item] = min(found)
        return sorted((i, *v) for i, v in done.items())


LEAKS = "array<struct<item_id:long,distance:long,item_chars:long,first_word:long,last_word:long>>"
_LEAKS = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "item_chars", "first_word", "last_word")]))


def leaks_of(matcher: Matcher, text: str | None) -> list[dict]:
    hay = normalise(text)
    return [{"item_id": x, "distance": distance, "item_chars": len(matcher.items[item][0]),
             "first_word": hay.count(" ", 0, start), "last_word": hay.count(" ", 0, end)}
            for item, distance, start, end in matcher.find(hay) for x in matcher.items[item][2]]


def mark_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: list[str] | None = None,
               item_id_col: str = "item_id", item_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT,
               min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row with the columns ``keep`` (default: all) as struct ``_row``,
    and ``leaks``: each test item found in it, the distance in edits, and the
    words (from 0) it covers at its nearest place."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    out = docs.select(F.col(text_col).cast("string").alias("_text"),
                      F.struct(*[f"`{c}`" for c in (docs.columns if keep is None else keep)]).alias("_row"),
                      F.expr(f"cast(array() as {LEAKS})").alias("leaks"))
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()
        normal = [(r["item_id"], t) for r in rows if (t := normalise(r["text"]))]
        known = spark.sparkContext.broadcast((normal, chars_per_edit, min_words))

        @releasing
        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*known.value)
            for b in batches:
                more = [leaks_of(matcher, t) for t in b.column(0).to_pylist()]
                if blocks > 1:
                    more = [x + y for x, y in zip(b.column(2).to_pylist(), more, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, _LEAKS)],
                                                 names=["_text", "_row", "leaks"])

        out = out.mapInArrow(run, out.schema)
    return out.select("_row", "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """One row per document row and test item found in it."""
    marked = mark_leaks(docs.withColumn("_id", F.col(id_col).cast("long")), benchmark, keep=["_id"], **more)
    return marked.select(F.col("_row._id").alias("doc_id"), F.inline("leaks"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "text",
                      chars_per_edit: int = CHARS_PER_EDIT, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item of ``min_words`` words or more;
    their columns, whatever their names, are kept as they are."""
    at = docs.columns.index(text_col)
    out = docs
    for normal in _blocks(benchmark, item_col, block_chars):
        long = [(0, t) for t in normal if t.count(" ") >= min_words - 1]
        known = docs.sparkSession.sparkContext.broadcast((long, chars_per_edit, min_words))

        @releasing
        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*known.value)
            for b in slices(batches, text_col, 4_000_000):
                clean = [not matcher.find(normalise(t)) for t in b.column(at).cast(pa.string()).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def _blocks(benchmark: DataFrame, item_col: str, block_chars: int) -> Iterator[list[str]]:
    """The normalised items in blocks of at most about ``block_chars`` characters."""
    items = benchmark.select(F.col(item_col).cast("string").alias("text"))
    blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()
        yield [t for r in rows if (t := normalise(r["text"]))]


def op1_query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
