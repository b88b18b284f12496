"""Language identification with language-bitmask n-gram filters.

Texts are folded (letters lower-cased, every run of other characters one
blank) and cut into character 4-grams.  Training counts the n-grams of every
labelled document by language; an n-gram belongs to a language when it makes
up at least ``min_share`` of that language's n-grams and at least ``near_top``
of its share in the language where it is commonest (so foreign passages inside
a language's documents do not count).  At most ``1 / min_share`` n-grams belong
to a language, whatever the corpus.

The sets go into one bit-sliced Bloom filter: a slot holds a mask with one bit
a language, an n-gram sets its languages' bits in ``hashes`` slots, and the AND
of those slots gives all languages containing it at once.  A document's score
for a language is its popcount of that bit, corrected for the false positives
that the slice's fill predicts; the largest corrected count wins.

Defined results: ``und`` with score 0 for null texts and texts without a
letter; if nothing matches, the language with most training text and score 0;
ties go to the language with more training text, then by code point; without
any training row everything is ``und``; repeated rows count and are judged one by
one, null ids (remainder 0 of the hash) too; a very long text is looked at whole,
in overlapping pieces; other columns, whatever their names, pass unread; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import Scratch, crc_mod, mix64, releasing, slices, table

N = 4
PIECE = 400_000  # characters looked at together
_TOP = 0x32400  # above the last letters assigned
_SEP, _END, _BLANK = 0, 1, 32


@cache
def fold_table() -> np.ndarray:
    """Code point -> lower-cased letter, or blank."""
    t = np.full(_TOP + 1, _BLANK, dtype=np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


def folded(text: str) -> Iterator[np.ndarray]:
    """The folded text in pieces that overlap so that no n-gram is lost or met
    twice: blank, text, blank, end mark."""
    carry = np.array([_BLANK], dtype=np.uint32)
    for a in range(0, len(text), PIECE):
        codes = np.frombuffer(text[a:a + PIECE].encode("utf-32-le", "replace"), dtype=np.uint32)
        piece = np.concatenate([carry, fold_table()[np.minimum(codes, _TOP)]])
        if a + PIECE >= len(text):
            piece = np.concatenate([piece, np.array([_BLANK], dtype=np.uint32)])
        blank = piece == _BLANK
        piece = piece[~(blank & np.concatenate([[False], blank[:-1]]))]
        if a + PIECE >= len(text):
            piece = np.concatenate([piece, np.array([_END], dtype=np.uint32)])
        yield piece
        carry = piece[-(N - 1):]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def gram_hashes(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of the pieces, and each one's piece."""
    sep = np.array([_SEP], dtype=np.uint32)
    codes = np.concatenate([x for p in pieces for x in (p, sep)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(codes) - N + 1, dtype=np.uint64)
    ok = np.ones(len(h), dtype=bool)
    for i in range(N):
        part = codes[i:len(codes) - N + 1 + i]
        h = h * np.uint64(0x100000001B3) + part
        ok &= part != _SEP
    return mix64(h[ok]), owner[:len(h)][ok]


def batches_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, index of the text) for groups of pieces of bounded size."""
    pieces, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for p in folded(t or ""):
            pieces.append(p)
            owners.append(i)
            size += len(p)
            if size >= PIECE:
                h, o = gram_hashes(pieces)
                yield h, np.asarray(owners)[o]
                pieces, owners, size = [], [], 0
    if pieces:
        h, o = gram_hashes(pieces)
        yield h, np.asarray(owners)[o]


class Model:
    """Languages by falling training size, and the bit-sliced filter."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], bits: int = 20, hashes: int = 3):
        self.langs, self.bits, self.hashes = langs, bits, hashes
        words = max(1, -(-len(langs) // 64))
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.slots = np.zeros((words, 1 << bits), dtype=kind)
        for i, g in enumerate(grams):
            for s in self.places(g):
                np.bitwise_or.at(self.slots[i // 64], s, kind(1 << (i % 64)))
        self.false_rate = np.array([float(np.mean((self.slots[i // 64] >> kind(i % 64)) & kind(1))) ** hashes
                                    for i in range(len(langs))])

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return [((h >> np.uint64(21 * j)) & low).astype(np.int64) for j in range(self.hashes)]

    def contained(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """Per language, whether the filter holds each n-gram."""
        at = self.places(h)
        for w in range(len(self.slots)):
            mask = self.slots[w][at[0]]
            for s in at[1:]:
                mask &= self.slots[w][s]
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                yield (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        n, hits = np.zeros(len(texts)), np.zeros((len(self.langs), len(texts)))
        for h, owner in batches_of(texts):
            n += np.bincount(owner, minlength=len(texts))
            for i, inside in enumerate(self.contained(h)):
                hits[i] += np.bincount(owner, weights=inside, minlength=len(texts))
        out = []
        f = self.false_rate[:, None]
        sure = np.maximum((hits - n * f) / np.maximum(1 - f, 1e-9), 0.0)
        for i, t in enumerate(texts):
            if not self.langs or not has_letter(t):
                out.append(("und", 0.0))
            else:
                best, total = int(np.argmax(sure[:, i])), float(sure[:, i].sum())
                out.append((self.langs[best], round(float(sure[best, i]) / total, 6) if total > 0 else 0.0))
        return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_share: float = 2e-5,
          near_top: float = 0.25, flush: int = 1_000_000) -> Model:
    """Fit on every row of ``docs`` with a language; counts cover all of them."""
    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            g = np.concatenate([x for x, _ in kept[lang]])
            c = np.concatenate([x for _, x in kept[lang]])
            u, at = np.unique(g, return_inverse=True)
            kept[lang] = [(u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64))]
            return kept[lang][0]

        def out(lang: str) -> pa.RecordBatch:
            g, c = merged(lang)
            kept[lang] = []
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)),
                                               pa.array(c)], names=["lang", "gram", "n"])

        for b in batches:
            by: dict[str, list[str]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                for h, _ in batches_of(texts):
                    kept.setdefault(lang, []).append(np.unique(h, return_counts=True))
                    if sum(len(x) for x, _ in kept[lang]) > flush and len(merged(lang)[0]) > flush // 2:
                        yield out(lang)
        for lang in list(kept):
            if kept[lang]:
                yield out(lang)

    spark = docs.sparkSession
    scratch = Scratch(spark, "lang")
    counts = scratch.store("counts", docs.where(F.col(lang_col).isNotNull())
                           .select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
                           .mapInArrow(count, "lang string, gram long, n long")
                           .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))]),
                                      F.col("lang")) if totals else F.lit(0.0)
    # at most 1 / min_share rows a language come to the driver
    top = counts.select("lang", "gram", share.alias("share")).where(F.col("share") >= min_share).toPandas()
    scratch.drop("counts")
    most = top.groupby("gram")["share"].transform("max")
    top = top[top["share"] >= near_top * most]
    return Model(langs, [top.loc[top["lang"] == x, "gram"].to_numpy(dtype=np.int64).view(np.uint64) for x in langs])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with ``lang_pred`` and
    ``lang_score``, which replace input columns of these names."""
    cols = [F.col(c) if isinstance(c, str) else c
            for c in (keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "lang_score")])]
    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.struct(*cols).alias("_row"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = known.value.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())],
                                             names=["_row", "lang_pred", "lang_score"])

    schema = src.select("_row").schema.add("lang_pred", "string").add("lang_score", "double")
    return src.mapInArrow(run, schema).select("_row.*", "lang_pred", "lang_score")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_score: float = 0.0) -> DataFrame:
    """The rows whose language is found: not ``und``, score ``min_score`` or more.
    At 0 only texts without letters go; at 0.5 the language holds at least half of
    what all languages match, so texts that match nothing and mixtures without a
    main language go too."""
    known = docs.sparkSession.sparkContext.broadcast(train(docs, text_col=text_col, lang_col=lang_col))
    at = docs.columns.index(text_col)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 4_000_000):
            found = known.value.predict(b.column(at).cast(pa.string()).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= min_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    return identify(docs, model, keep=["doc_id", held.alias("held_out")]).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
