"""Mix sources to target weights.

Every document gets a hash-random key.  Within each source the documents are
range-sorted by that key: the keys are uniform, so fixed key ranges (as many
as the source has rows for) are an even range partition that needs no
sampling and comes out alike on every run.  Range totals give each range its
offset (a prefix sum over the small table of ranges), a running sum inside a
range gives each document its place, and the source is cut where its budget
ends.  A budget above the source's size repeats whole epochs first; the last
document taken is cut at the exact word.

A source holding a third of all rows is spread over its ranges, so no window
sees more than about ``rows_per_range`` rows.

Defined results: null text has size 0; a null source is a source of its own,
last in the order; empty tables give no rows; repeated rows are separate
documents, each taken on its own (equal keys are ordered by size and text
hash, so equal rows are interchangeable); null ids are ids like any other, told
apart by their texts; rows equal in id, source and text have one key and stay in
one range; a very long text counts whole; columns of the input that clash with
the result's are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolens.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(per_source: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """``per_source(source, source_size, ...)`` with ``weight`` and ``target``.

    Targets share ``share`` times all sizes by weight; none exceeds ``most``
    times its source's size, and what it can't take is shared anew by weight.
    That is ``min(most * size, level * weight)`` with the level at which the
    targets add up; sorted by ``most * size / weight``, the capped sources are
    a prefix, so prefix sums over the table of sources find the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = per_source.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    d = (d.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
         .withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
         # the first source whose cap lies above the level reached there fixes the level
         .withColumn("level", F.min(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.struct(
             F.col("cap") / F.col("weight"), F.col("level_here").alias("value")))).over(every)["value"]))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return d.withColumn("target", target).drop("cap", "total", "level_here", "level")


def mix_to_weights(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   share: float = 1.5, weights: Sequence[float] = WEIGHTS, most: float = 2.0, seed: int = 17,
                   rows_per_range: int = 20_000) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, epochs
    (whole repeats), cut_words (words of the further, possibly cut, repeat)
    and taken = epochs * size + cut_words, and ``text_hash`` to join by."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # with the text in it, rows that share an id are spread over the ranges too
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                         F.coalesce(F.col(source_col), F.lit("")), F.lit(":"), F.md5(text)))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                        key.alias("key"), F.xxhash64(text).alias("tie"))
    slim = scratch.store("sized", sized)
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = scratch.store("targets", source_targets(per, share, weights, most))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_per_range)).cast("long")
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2.0 ** 32)).cast("long")
    small = targets.select(F.col("source").alias("s"), "source_size", "target", ranges.alias("ranges"))
    # few bytes a source; Spark broadcasts the written table when its size allows, else it shuffles
    d = slim.join(small, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("range", place)
    starts = (d.groupBy("source", "range").agg(F.sum("size").alias("words"))
              .withColumn("offset", F.coalesce(F.sum("words").over(
                  Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(F.col("source").alias("s2"), F.col("range").alias("r2"), "offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", "tie").rowsBetween(
        Window.unboundedPreceding, -1)
    d = (d.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
         .join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")), "left"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    out = (d.withColumn("epochs", epochs)
           .withColumn("cut_words", F.greatest(F.lit(0), F.least("size", rest - F.col("offset") - F.col("run"))).cast("long"))
           .withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut_words"))
           .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                   "epochs", "cut_words", "taken", F.col("tie").alias("text_hash")))
    return out


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  **more) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target,
    epochs, cut_words and taken (which replace columns of these names): a row
    goes in ``epochs`` times whole and once with its first ``cut_words`` words.
    Rows equal in id, source and text come out once, with their summed take."""
    scratch = Scratch(docs.sparkSession, "mixed")
    new = ["size", "source_size", "target", "epochs", "cut_words", "taken"]
    d = mix_to_weights(docs, id_col=id_col, text_col=text_col, source_col=source_col, **more)
    d = scratch.store("mix", d.groupBy(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), F.col("text_hash").alias("mix_hash"))
                      .agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
                           F.max("epochs").alias("epochs"), F.sum("cut_words").alias("cut_words"), F.sum("taken").alias("taken"),
                           F.count("*").alias("mix_rows")).where("taken > 0"))
    keep = [c for c in docs.columns if c not in new]
    # the row stays in one column, so its names meet none of the mix's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"),
                       F.col(id_col).alias("row_id"), F.col(source_col).alias("row_source"))
    same = (F.col("row_hash") == F.col("mix_hash")) & F.col("row_id").eqNullSafe(F.col("mix_id")) \
        & F.col("row_source").eqNullSafe(F.col("mix_source"))
    out = rows.join(d, same)
    if not d.where("mix_rows > 1").isEmpty():
        out = out.dropDuplicates(["row_id", "row_source", "row_hash"])
    return out.select("row.*", *new)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
                  WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
-- capped sources at each possible level: those whose own ratio lies below it
lv AS (SELECT a.cap / a.weight AS ratio,
              (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
               - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight), 0))
              / (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS lev
       FROM w a),
t AS (SELECT w.source, source_size,
             least(cap, coalesce((SELECT arg_min(lev, ratio) FROM lv WHERE lev <= ratio), cap / weight) * weight) AS target
      FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS e,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - before)) AS BIGINT) AS taken
FROM r
"""


def op10_query(spark, sf_dir: str) -> DataFrame:
    from regiolens.llm.common import table

    out = mix_to_weights(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
