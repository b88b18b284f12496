"""Fuzzy scan for short license notices.

A text is lower-cased (A-Z) and cut into words (runs of digits, a-z and
non-ASCII characters); the words joined by single blanks are what is searched,
so line breaks and punctuation inside a notice don't matter.  Exact phrases are
looked up as whole words.  For the fuzzy search each notice with an error
budget of k edits is split into k + 1 pieces: a passage within k edits holds at
least one piece unchanged, so a plain substring search for the pieces finds
every candidate place.  The ``regex`` library then matches the notice with at
most k errors inside the window around the place and gives span and edits.

One pass over the rows, no shuffle; the notices are a fixed parameter.

Defined results: null and empty texts have no words and no hits; every input
row gives one row, repeated rows too; null ids stay null; hits at one place come
exact first, then by label; a very long text is searched whole, in time linear
in its words and hits; other columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import ASCII_LOWER, table

# Phrases and labels of the base rule
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Public short notices, in words as searched
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
    "subject to the terms of the mozilla public license": "mpl",
    "spdx license identifier": "spdx",
}
CHARS_PER_EDIT = 10

_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(ASCII_LOWER[b] if ASCII_LOWER[b] in _WORD else 0x20 for b in range(256))
_WORD_RE = re.compile(rb"[^ ]+")

SCHEMA = ("id long, n_words long, "
          "hits array<struct<label:string,exact:boolean,word:long,start:long,end:long,edits:int,length:int>>")
_HITS = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("word", pa.int64()), ("start", pa.int64()),
                            ("end", pa.int64()), ("edits", pa.int32()), ("length", pa.int32())]))


def pieces(notice: str, k: int) -> list[tuple[int, bytes]]:
    """The k + 1 pieces of a notice with their offsets."""
    cut = [len(notice) * j // (k + 1) for j in range(k + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: Mapping[str, str], notices: Mapping[str, str], chars_per_edit: int):
        self.phrases = [(re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), p.split()[0].encode(), label)
                        for p, label in phrases.items()]
        self.notices = []
        for text, label in notices.items():
            k = max(1, len(text) // chars_per_edit)
            self.notices.append((text, label, k, pieces(text, k),
                                 regex.compile(rf"(?:{regex.escape(text)}){{e<={k}}}", regex.ENHANCEMATCH)))

    def windows(self, hay: bytes, length: int, k: int, seeds: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        found = []
        for at, seed in seeds:
            p = hay.find(seed)
            while p >= 0:
                found.append((max(0, p - at - k), min(len(hay), p - at + length + k)))
                p = hay.find(seed, p + 1)
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        norm = raw.translate(_TO_WORDS)
        words = norm.split()
        hay = b" ".join(words)
        places = []  # (label, exact, start and end in hay, edits, length)
        for pattern, seed, label in self.phrases:
            if seed in hay:
                places += [(label, True, m.start(), m.end(), 0, m.end() - m.start()) for m in pattern.finditer(hay)]
        for text, label, k, seeds, pattern in self.notices:
            for a, b in self.windows(hay, len(text), k, seeds):
                part = hay[a:b].decode("latin-1")  # one character a byte keeps the offsets
                places += [(label, False, a + m.start(), a + m.end(), sum(m.fuzzy_counts), len(text))
                           for m in pattern.finditer(part)]
        if not places:
            return len(words), []
        ends = [(m.start(), m.end()) for m in _WORD_RE.finditer(norm)]
        # blanks before each place and code points before each byte, once for all hits
        blanks = np.flatnonzero(np.frombuffer(hay, np.uint8) == 0x20)
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        hits = []
        for label, exact, a, b, edits, length in sorted(places, key=lambda x: (x[2], not x[1], x[0])):
            first = int(np.searchsorted(blanks, a))
            if a < len(hay) and hay[a:a + 1] == b" ":
                first += 1
            last = max(first, int(np.searchsorted(blanks, max(a, b - 1))))
            lo, hi = ends[min(first, len(ends) - 1)][0], ends[min(last, len(ends) - 1)][1]
            hits.append({"label": label, "exact": exact, "word": first, "start": int(points[lo]), "end": int(points[hi]),
                         "edits": edits, "length": length})
        return len(words), hits


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES,
                  chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per input row: ``id``, ``n_words`` and ``hits`` (label, exact
    phrase or fuzzy notice, first word, span in code points, edits, length)."""
    phrases, notices = dict(phrases), dict(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        for b in batches:
            res = [scanner.scan(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in res], pa.int64()), pa.array([h for _, h in res], _HITS)],
                names=["id", "n_words", "hits"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, SCHEMA))


def op2_query(spark, sf_dir: str) -> DataFrame:
    r = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["exact"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["word"])
    return r.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: 1.0 - h["edits"] / h["length"])), F.lit(0.0)).alias("score"),
        F.transform(F.filter("hits", lambda h: ~h["exact"]),
                    lambda h: F.concat_ws(":", h["label"], h["start"], h["end"], h["edits"])).alias("fuzzy_spans"))
