"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes weighted terms hashed into three ranges: word shapes (letters to
x/X, runs shortened, marks kept), words, and bands of a few whole-text
statistics (length, repeats, marks, capitals, repeated lines).  Document
frequencies of the hashed terms are counted over all documents.  A truncated
SVD of the labelled sample's TF-IDF matrix gives the latent space; the sample's
unit vectors and labels are broadcast, and each document takes its exact
cosines with all of them in matrix blocks.  The nearest ``neighbours`` vote with
weight cos^``sharpness`` for their labels.

The labelled rows to fit on are bounded by ``sample`` (the rows with the
smallest hash of their id), so the broadcast is ``sample x rank`` numbers
whatever the corpus; everything else covers all documents and whole texts.

Defined results: null and empty texts are scored like any other (their only
terms are the statistics' bands); rows with a null label are not learnt from;
repeated label rows of an id count as many times, and repeated documents each
have a score; rows with a null id are scored, never learnt from; ties among the
last neighbours go to the sample's first (by id, label, terms); a very long text
is scored whole; without labelled rows every score is ``no_model``; other
columns, whatever their names, pass unread; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import crc_mod, table

SHAPES, BANDS, DIMS = 256, 128, 1024
SHAPE_WEIGHT, BAND_WEIGHT = 2.0, 3.0
_SHAPE = bytes(0x58 if 0x41 <= b <= 0x5A else 0x78 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b
               for b in range(256))
_RUNS = re.compile(rb"([xX9])\1+")
_MARKS = bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace()))


def _band(name: bytes, value: float) -> int:
    return SHAPES + zlib.crc32(b"%s:%d" % (name, int(value))) % BANDS


def terms(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, weight) of a text's terms; a dimension comes once."""
    count: dict[int, int] = {}
    words = raw.split()
    n = len(words)
    seen = Counter(words)
    crc, first = zlib.crc32, SHAPES + BANDS
    for w, c in seen.items():
        d = first + crc(w.lower()) % (DIMS - first)
        count[d] = count.get(d, 0) + c
    for s, c in Counter(_RUNS.sub(rb"\1", raw.translate(_SHAPE)).split()).items():
        d = crc(s) % SHAPES
        count[d] = count.get(d, 0) + c
    lines = raw.split(b"\n")
    size = max(1, len(raw))
    upper = sum(c for w, c in seen.items() if w[:2].isupper())
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = size - len(raw.translate(None, _MARKS)) if raw else 0
    bands = Counter(_band(name, value) for name, value in (
        (b"length", math.log2(n + 1)), (b"types", 10 * len(seen) / max(1, n)),
        (b"repeat", math.ceil(20 * again / max(1, n))), (b"marks", math.ceil(30 * marks / size)),
        (b"upper", math.ceil(10 * upper / max(1, n))),
        (b"lines", math.ceil(10 * (len(lines) - len(set(lines))) / len(lines)))))
    dims = np.array([*count, *bands], dtype=np.int64)
    weight = np.log1p(np.array([*count.values(), *([0] * len(bands))], dtype=np.float64))
    weight[dims < SHAPES] *= SHAPE_WEIGHT
    weight[len(count):] = BAND_WEIGHT * np.array([*bands.values()])
    order = np.argsort(dims)
    return dims[order], weight[order]


def tfidf(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(found), DIMS), dtype=np.float64)
    for i, (d, w) in enumerate(found):
        x[i, d] = w * idf[d]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, idf: np.ndarray, found: list, labels: np.ndarray, rank: int, neighbours: int, sharpness: float):
        self.idf, self.labels, self.neighbours, self.sharpness = idf, labels.astype(np.float64), neighbours, sharpness
        x = tfidf(found, idf)
        _, vec = np.linalg.eigh(x.T @ x)
        self.axes = np.ascontiguousarray(vec[:, ::-1][:, :rank])
        self.vectors = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.axes
        return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, found: list) -> np.ndarray:
        cos = self.latent(tfidf(found, self.idf)) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(cos, near, 1).min(axis=1)
        for i in np.flatnonzero((cos >= edge[:, None]).sum(axis=1) > k):  # ties at the edge: the sample's first ones
            above, at = np.flatnonzero(cos[i] > edge[i]), np.flatnonzero(cos[i] == edge[i])
            near[i] = np.concatenate([above, at[:k - len(above)]])
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(np.float64) ** self.sharpness
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0.0, 1.0)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents with each dimension, documents), over all rows: one vector of
    fixed length a task, summed by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, dtype=np.int64)
        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                df[terms(x or b"")[0]] += 1
                df[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], names=["dim", "n"])

    rows = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "dim long, n long")
            .groupBy("dim").agg(F.sum("n").alias("n")).collect())  # DIMS + 1 rows
    df = np.zeros(DIMS + 1, dtype=np.int64)
    for r in rows:
        df[r["dim"]] = r["n"]
    return df[:DIMS], int(df[DIMS])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "quality", sample: int = 6000, rank: int = 64, neighbours: int = 25,
        sharpness: float = 8.0) -> Model | None:
    """Fit on at most ``sample`` labelled rows, those with the smallest hash of
    their id; document frequencies come from all of ``docs``."""
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    key = F.md5(F.col("_id").cast("string"))
    chosen = (labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
              .where(F.col("_label").isNotNull() & F.col("_id").isNotNull()).orderBy(key, "_label").limit(sample))
    spark = docs.sparkSession
    # at most ``sample`` ids, a documented bound
    picked = spark.createDataFrame([(r["_id"], r["_label"]) for r in chosen.collect()], "_id long, _label double")
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(x or b"") for x in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(1), b.column(2), pa.array([d.astype("<i2").tobytes() for d, _ in found], pa.binary()),
                pa.array([w.astype("<f4").tobytes() for _, w in found], pa.binary())], names=["id", "label", "dims", "weights"])

    rows = (texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_text", "_id", "_label")
            .mapInArrow(encode, "id long, label double, dims binary, weights binary").collect())
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["id"], r["label"], bytes(r["dims"]), bytes(r["weights"])))
    found = [(np.frombuffer(r["dims"], "<i2").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(np.float64))
             for r in rows]
    return Model(idf, found, np.array([r["label"] for r in rows]), rank, neighbours, sharpness)


def score_quality(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: list[str] | None = None,
                  block: int = 512, no_model: float = 0.5) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, and ``_score``."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).cast("string").alias("_text"),
                      F.struct(*[f"`{c}`" for c in (docs.columns if keep is None else keep)]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                b = batch.slice(a, block)
                raw = b.column(0).cast(pa.binary()).to_pylist()
                s = m.score([terms(x or b"") for x in raw]) if m else np.full(len(raw), no_model)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.round(s, 6))], names=["_row", "_score"])

    schema = src.select("_row").schema.add("_score", "double")
    return src.mapInArrow(run, schema).select("_row.*", "_score")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    out = score_quality(docs, model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= 0.3).cast("int").alias("predicted"))
