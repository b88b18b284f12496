"""Removal of repeated passages by level-wise doubling.

A window (``window`` consecutive words of one text) that repeats holds shorter
windows that repeat.  Levels double the length from ``first`` to ``window``: at
each level every window still alive is looked at through one of its shorter
windows, the one with the least hash (the same one wherever the window occurs,
so about one place in six is sent); windows whose short window occurs once in
the whole input are dropped, the others are extended to twice the length.  The
doubling ends when no candidate is alive, or at ``window``, where each remaining
candidate is compared whole and the smallest id that holds it is found.

Texts are read in units (rows of a scan, about ``unit_bytes`` of text), stored
once in the shared folder.  A unit sends each distinct hash once, sorted and
packed (``packed``), and gets bits back, so a passage that a third of all rows
share costs one entry a unit.  Words covered by a window that also starts
earlier (smaller id, or earlier in the same row) are removed; windows are judged
on the input.

Defined results: null, empty and blank texts, and texts shorter than a window,
lose nothing; rows with a null id come after all others; of rows that share an
id (repeated rows, null ids) none is earlier than another, so the first starts
in each stay; ties between rows are thus never broken by chance; a text of any
length is one row of one unit and is looked at in pieces; extra columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.llm import packed
from regiolens.llm.common import Scratch, read_units, rows_of, table
from regiolens.llm.words import byte_set, run_hashes, window_min, words_of

BLANK = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
NULL_ID = (1 << 63) - 1  # after all ids


def _spans(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, as rows."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)


def _starts(spans: np.ndarray) -> np.ndarray:
    """All places inside the spans."""
    n = spans[:, 1] - spans[:, 0]
    return np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else n


class Unit:
    """The words of one unit's texts, joined; ``row`` bounds them by text."""

    def __init__(self, texts: list[str | None], window: int):
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        self.words, at, _ = words_of(b"\n".join(raws), BLANK)
        self.row = np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in raws)]))
        size = np.diff(self.row)
        inside = np.zeros(len(self.words) + 1, np.int64)
        fits = size >= window
        np.add.at(inside, self.row[:-1][fits], 1)
        np.add.at(inside, self.row[1:][fits] - window + 1, -1)
        self.windows = np.cumsum(inside[:-1]).astype(bool)  # at these words a window starts

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row, starts, side="right") - 1

    def least(self, level: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place its short window's hash, and for each window the least in it."""
        runs = run_hashes(self.words, level)
        return runs, window_min(runs, window - level + 1)

    def short_keys(self, level: int, window: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct short windows of the windows alive, with 2 where the unit holds
        one at two places, else 1."""
        runs, least = self.least(level, window)
        mine = np.flatnonzero(alive[:len(least)])
        held = least[mine]
        change = np.concatenate([[True], (held[1:] != held[:-1]) | (np.diff(mine) > 1)]) if len(mine) else np.zeros(0, bool)
        keys, n = np.unique(held[change], return_counts=True)
        # equal short windows closer than a window's slack can look like one place
        near = np.zeros(len(runs), bool)
        for d in range(1, window - level + 1):
            near[:-d] |= runs[d:] == runs[:-d] if d < len(runs) else False
        twice = (n > 1) | np.isin(keys, runs[near])
        return keys, np.where(twice, 2, 1)

    def repeated(self, level: int, window: int, alive: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The windows alive whose short window occurs more than once."""
        least = self.least(level, window)[1]
        out = np.zeros(len(self.words), bool)
        mine = np.flatnonzero(alive[:len(least)])
        out[mine] = bits[np.searchsorted(keys, least[mine])] if len(keys) else False
        return out


_ALIVE = "unit long, keys binary, vals binary, n long, alive binary"


def _mask(spans: bytes | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[_starts(packed.unpack_ints(spans or b"").reshape(-1, 2))] = True
    return out


def _level(units: DataFrame, state: DataFrame | None, level: int | None, next_level: int | None, window: int, size: int = 0) -> DataFrame:
    """Judge ``level`` by the answered bits in ``state`` and send the keys of
    ``next_level``; with next_level None the windows themselves are sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                u = Unit(r["texts"], window)
                alive = u.windows
                if level is not None:
                    if r["alive"] is not None:
                        alive = _mask(r["alive"], len(u.words))
                    keys, _ = u.short_keys(level, window, alive)  # as they were sent
                    alive = u.repeated(level, window, alive, keys, packed.answered(r["bits"]))
                if next_level is not None:
                    keys, vals = u.short_keys(next_level, window, alive)
                    row = [r["unit"], keys.tobytes(), packed.pack_ints(vals), len(keys), packed.pack_ints(_spans(alive).reshape(-1))]
                    yield pa.RecordBatch.from_pylist([dict(zip(("unit", "keys", "vals", "n", "alive"), row, strict=True))], schema=short)
                else:
                    yield pa.RecordBatch.from_pylist([_whole_windows(u, r["unit"], r["ids"], alive, window)], schema=whole)

    types = {"unit": pa.int64(), "keys": pa.binary(), "vals": pa.binary(), "n": pa.int64(), "alive": pa.binary(), "gone": pa.binary(),
             "starts": pa.binary(), "which": pa.binary()}
    short = pa.schema([(c, types[c]) for c in ("unit", "keys", "vals", "n", "alive")])
    whole = pa.schema([(c, types[c]) for c in ("unit", "keys", "vals", "n", "gone", "starts", "which")])
    src = units if state is None else packed.with_answers(units, state, size)
    if next_level is not None:
        return src.mapInArrow(run, _ALIVE)
    return src.mapInArrow(run, "unit long, keys binary, vals binary, n long, gone binary, starts binary, which binary")


def _whole_windows(u: Unit, unit: int, ids: list, alive: np.ndarray, window: int) -> dict:
    """The unit's candidates: each distinct window with the smallest id that holds
    it here; ``gone`` are starts with an earlier one in the unit, ``starts`` and
    ``which`` the others with their key's number."""
    at = np.flatnonzero(alive)
    keys, which = np.unique(run_hashes(u.words, window, at), return_inverse=True)
    row = u.row_of(at)
    own = np.array([NULL_ID if x is None else x for x in ids], np.int64)[row] if len(at) else at
    least = np.full(len(keys), NULL_ID, np.int64)
    np.minimum.at(least, which, own)
    order = np.lexsort((at, row, which))  # the first start in each row
    again = np.zeros(len(at), bool)
    again[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    gone = again | (own > least[which])
    return {"unit": unit, "keys": keys.tobytes(), "vals": packed.pack_ints(least), "n": len(keys),
            "gone": packed.pack_ints(at[gone]), "starts": packed.pack_ints(at[~gone]), "which": packed.pack_ints(which[~gone])}


def _more_than_one(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(group, weights=n)[group] > 1


def _not_least(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    least = np.full(int(group.max()) + 1, NULL_ID, np.int64)
    np.minimum.at(least, group, ids)
    return ids > least[group]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, first: int = 10,
                     unit_bytes: int = 2_000_000) -> DataFrame:
    """One row per input row: id, ``n_words``, ``removed`` (spans of word numbers,
    end exclusive) and ``kept_text`` (the words that stay, joined by one blank).
    ``window`` is ``first`` doubled some times."""
    levels = [first]
    while levels[-1] * 2 < window:
        levels.append(levels[-1] * 2)
    if levels[-1] * 2 != window:
        raise ValueError("window must be first times a power of two")
    scratch = Scratch(docs.sparkSession, "substrings")
    units = read_units(docs, scratch, id_col, text_col, unit_bytes)
    state, level, size = None, None, 0
    for nxt in [*levels, None]:
        sent = scratch.store(f"level{nxt or window}", _level(units, state, level, nxt, window, size))
        told = sent.agg(F.sum("n").alias("n"), F.sum(F.octet_length("alive") if nxt else F.lit(0)).alias("alive")).first()
        n, size = told["n"] or 0, ((told["n"] or 0) // 8 + (told["alive"] or 0))  # bits and spans that travel back
        judge = _more_than_one if nxt else _not_least
        bits = packed.answer(packed.deal(sent.where("n > 0"), packed.parts_for(n)), judge)
        bits = scratch.store(f"bits{nxt or window}", bits)
        # only bits and spans travel back: the keys are worked out again from the texts
        if nxt is None:
            state = sent.select("unit", "gone", "starts", "which").join(bits, "unit", "left")
        elif level is None:
            state = bits.withColumn("alive", F.lit(None).cast("binary"))
        else:
            state = scratch.store(f"state{nxt}", sent.select("unit", "alive").join(bits, "unit", "left"))
        level = nxt
        if not n:  # no candidate is alive
            break
    if level is None:
        state = scratch.store("spans", _removed(state, window))
        size = state.agg(F.sum(F.octet_length("spans"))).first()[0] or 0
    else:
        state = state.select("unit", F.lit(None).cast("binary").alias("spans"))
    out = scratch.store("out", packed.with_answers(units, state, size).mapInArrow(
        _apply, "id long, n_words long, removed array<struct<start:long,end:long>>, kept_text string"))
    for name in ("units", "spans", *(f"{x}{n}" for n in [*levels, window] for x in ("level", "bits", "state"))):
        scratch.drop(name)
    return out.withColumnRenamed("id", id_col)


def _removed(state: DataFrame, window: int) -> DataFrame:
    """Word spans of the unit that a window with an earlier start covers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                gone, starts, which = (packed.unpack_ints(r[c] or b"") for c in ("gone", "starts", "which"))
                bits = packed.answered(r["bits"])
                at = np.concatenate([gone, starts[bits[which]] if len(which) else starts])
                spans = np.zeros((0, 2), np.int64)
                if len(at):
                    cover = np.zeros(int(at.max()) + window + 1, np.int32)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    spans = _spans(np.cumsum(cover) > 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["unit"]]), pa.array([packed.pack_ints(spans.reshape(-1))], pa.binary())],
                                                 names=["unit", "spans"])

    return state.mapInArrow(run, "unit long, spans binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        for r in rows_of(b):
            spans = packed.unpack_ints(r["spans"] or b"").reshape(-1, 2)
            ends = spans[:, 1]
            out: dict[str, list] = {"id": r["ids"], "n_words": [], "removed": [], "kept_text": []}
            a = 0  # the row's first word, counted in the unit
            for t in r["texts"]:
                words = (t or "").encode("utf-8", "replace").split()
                e = a + len(words)
                kept, removed, last = [], [], a
                for s, x in spans[np.searchsorted(ends, a, side="right"):np.searchsorted(spans[:, 0], e)].tolist():
                    s, x = max(s, a), min(x, e)  # windows of neighbouring rows can touch
                    kept.extend(words[last - a:s - a])
                    removed.append({"start": s - a, "end": x - a})
                    last = x
                kept.extend(words[last - a:])
                out["n_words"].append(len(words))
                out["removed"].append(removed)
                out["kept_text"].append(b" ".join(kept).decode())
                a = e
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                                              pa.array(out["removed"], kind), pa.array(out["kept_text"], pa.string())],
                                             names=list(out))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(list_slice(w, s, s + 19), ' ') ORDER BY doc_id, s) AS k FROM p),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM h WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n
      FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.i = r.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op13_query(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
