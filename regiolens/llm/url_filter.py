"""URL filter: a rule list, and association rules where the list is silent.

Urls are split into host and path; the longest fitting list rule decides.  For
the rest, Spark's FP-growth mines combinations of URL tokens (scheme, host
suffixes, first path parts, file ending, query keys, fragment; digits as ``#``)
together with the label from labelled urls.  Association rules ``tokens ->
label`` are pruned by support and confidence, and by rules with one token less
that are as sure.  An inverted index from each rule's rarest token finds the
rules of a url; the surest rule decides, and urls without one get the default.

The query learns from the labels of the documents that the pages are: the number
that ends a url's path is a document's id.  A document of low quality or a toxic
one gives ``block``, others ``allow``.  As one label is much more frequent, a
rule counts only where its confidence lies over the label's share in all labelled
urls by ``min_z`` standard errors of that share: tokens that tell nothing leave
the default.

DataFrame operations and Spark ML's FP-growth only.  Urls are matched once per
distinct token set.  A url has at most a dozen tokens by construction, so
neither mining nor matching grows with its length.

Defined results: a null url or one without ``://`` has empty host and path, no
tokens, no rule and the default verdict; each input row gives one row, repeated
rows and null ids too; of several rules that match the surest decides, then support, length and tokens;
without labelled urls there are no mined rules; extra columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import Scratch, table

# The list of the contract, (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MIN_Z = 4.0  # standard errors over the label's share
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url, at most eleven."""
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    labels = F.split(host, r"\.")
    tail = lambda n: F.when(F.size(labels) >= n, F.concat(F.lit("host:"), F.substring_index(host, ".", -n)))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    part = lambda n: F.concat(F.lit(f"path{n}:"), plain(F.get(parts, F.lit(n - 1))))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))), "&")
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    found = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))),
        tail(1), tail(2), tail(3), tail(4), part(1), part(2),
        F.when(F.size(parts) > 2, F.lit("deep")),
        F.when(ending != "", F.concat(F.lit("ending:"), F.lower(ending))),
        F.when(query != "", F.concat(F.lit("query:"), plain(keys))),
        F.when(F.instr(url, "#") > 0, F.lit("fragment")))
    return F.when(host == "", F.expr("cast(array() as array<string>)")).otherwise(
        F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))


def page_labels(pages: DataFrame, labels: DataFrame, *, url_col: str = "url", id_col: str = "doc_id", quality_col: str = "quality",
                toxic_col: str = "toxic") -> DataFrame:
    """``url, label`` of the pages whose path ends in a labelled document's number
    (with each of its label rows); a label row with neither value tells nothing."""
    number = F.regexp_extract(path_of(F.col(url_col)), r"(?:^|/)([0-9]+)(?:\.[A-Za-z]{1,5})?/?$", 1).try_cast("long")
    bad = (F.col(quality_col) == 0) | (F.col(toxic_col) == 1)
    known = labels.select(F.col(id_col).cast("long").alias("_doc"), F.when(bad, "block").when(
        F.coalesce(F.col(quality_col), F.col(toxic_col)).isNotNull(), "allow").alias("label")).where("_doc is not null and label is not null")
    return (pages.select(F.col(url_col).cast("string").alias("url"), number.alias("_number"))
            .join(known, F.col("_number") == F.col("_doc")).select("url", "label"))


def mine_rules(labelled: DataFrame, scratch: Scratch, *, min_support: float = 0.002, min_confidence: float = 0.8,
               min_z: float | None = None) -> DataFrame:
    """``labelled(tokens, label)`` -> rules (antecedent, label, confidence,
    support, anchor): anchor is the antecedent's rarest token.  ``min_z``: how
    many standard errors the confidence must lie over the label's share."""
    label = F.concat(F.lit("label="), F.col("label"))
    baskets = scratch.store("baskets", labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0))
                            .select(F.concat("tokens", F.array(label)).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (model.associationRules.where(F.get("consequent", F.lit(0)).startswith("label="))
             .where(~F.exists("antecedent", lambda x: x.startswith("label=")))
             .select(F.array_sort("antecedent").alias("antecedent"),
                     F.substring(F.get("consequent", F.lit(0)), 7, 10_000).alias("label"), "confidence", "support", "lift"))
    if min_z is not None:
        share = F.col("confidence") / F.col("lift")
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) * F.col("confidence") / F.col("support")) / math.sqrt(max(1, baskets.count()))
        found = found.where((F.col("lift") > 1) & (F.col("confidence") - share >= min_z * error))
    rules = scratch.store("found", found.drop("lift"))
    # a rule with one token less that is as sure makes a rule redundant
    less = rules.where(F.size("antecedent") > 1).select(
        F.col("antecedent").alias("full"), "label", F.col("confidence").alias("sure"),
        F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("antecedent"))
    spare = (less.join(rules, ["antecedent", "label"]).where(F.col("confidence") >= F.col("sure"))
             .select(F.col("full").alias("antecedent"), "label").distinct())
    rules = rules.join(spare, ["antecedent", "label"], "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    anchor = (rules.select("antecedent", "label", F.explode("antecedent").alias("token")).join(single, "token")
              .groupBy("antecedent", "label").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor")))
    return scratch.store("rules", rules.join(anchor, ["antecedent", "label"]))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(tokens)`` -> the surest rule's label for each set that has one:
    by confidence, support, length, then tokens."""
    candidates = sets.select("tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "antecedent", "label"))
    return (candidates.where(fits).groupBy("tokens").agg(best.alias("best"))
            .select("tokens", F.col("best.label").alias("mined"), F.col("best.antecedent").alias("antecedent"),
                    F.col("best.confidence").alias("confidence")))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, default: str = "allow",
                min_support: float = 0.002, min_confidence: float = 0.8, min_z: float | None = None) -> DataFrame:
    """id, url, host, path, rule, verdict, and the mined rule (antecedent,
    confidence) where one decided.  ``labelled(url, label)`` are the urls to
    learn from; by default those of ``pages`` that the list decides."""
    scratch = Scratch(pages.sparkSession, "urls")
    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    split = split.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = scratch.store("judged", split.select("*", rule.alias("rule"), verdict.alias("verdict"),
                                                  tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))
    if labelled is None:
        learn = judged.select("tokens", F.col("verdict").alias("label"))
    else:
        u = labelled.select(F.col("url").cast("string").alias("url"), "label")
        learn = u.select(tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "label")
    mined = mine_rules(learn, scratch, min_support=min_support, min_confidence=min_confidence, min_z=min_z)
    silent = judged.where(F.col("rule").isNull() & (F.size("tokens") > 0)).select("tokens").distinct()
    found = match_rules(silent, mined).select(F.col("tokens").alias("_set"), "mined", "antecedent", "confidence")
    return (judged.join(found, (F.col("tokens") == F.col("_set")) & F.col("rule").isNull(), "left")
            .select(F.col("id").alias(id_col), "url", "host", "path", "rule",
                    F.coalesce("verdict", "mined", F.lit(default)).alias("verdict"), "antecedent", "confidence"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages, labelled=page_labels(pages, table(spark, sf_dir, "labels")), min_z=MIN_Z)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("antecedent", " ").alias("mined_rule"))
