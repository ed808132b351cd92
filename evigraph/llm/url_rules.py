"""URL filters: listed rules first, then association rules mined by FP-growth."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

# The listed rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Mined rules that are broadcast, at most; more are joined by a shuffle, with the same result.
FEW_RULES = 1_000
#: Parts into which the token sets of one key, and copies of its rules, are dealt there.
SALTS = 16
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest listed rule that fits, else null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        ours = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(ours & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels, path segments and query keys, digits as one #, and the fragment."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), plain(x)))
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    scheme, fragment = F.array(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.array(F.regexp_extract(url, "#(.*)$", 1))
    return F.array_sort(F.array_distinct(F.concat(named("scheme:", scheme), named("host:", F.split(host, r"\.")), named("path:", F.split(path, "/")), named("query:", keys), named("part:", fragment))))


def together(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that ``least`` rows or more of labelled (row, tokens) hold; those that hold the same rows are one item, named by the first.

    Two sums of hashes over a token's rows tell whether two tokens hold the same.
    At most the tokens of a row divided by the least support are left.
    """
    each = labelled.select("row", F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).filter(F.col("n") >= least)
    named = marks.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    return marks.hint("shuffle_merge").join(named.hint("shuffle_merge"), ["n", "x", "y"]).select("token", "item")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, classes: DataFrame | None = None) -> DataFrame:
    """Association rules (tokens array, key, verdict, confidence, support) from labelled (row, tokens, verdict).

    Every token is an item, or with classes (see ``together``) those that always go together are one: a
    site whose urls share forty query keys has one item for them in place of all
    their subsets, and a rule holds for a url with any of an item's tokens, as the
    rules of the single tokens would. FP-growth runs over all labelled rows, with
    the label as one more item. Rules that conclude a label stay if support and
    confidence reach their least and no rule with one item less does as well,
    however many they are. key is the rule's rarest item, by which it is found.
    """
    rows = labelled.select("tokens", "verdict")
    if classes is not None:
        met = labelled.select("row", F.explode("tokens").alias("token")).hint("shuffle_merge").join(classes.hint("shuffle_merge"), "token")
        found = met.groupBy("row").agg(F.collect_set("item").alias("tokens"))
        rows = labelled.select("row", "verdict").hint("shuffle_merge").join(found.hint("shuffle_merge"), "row", "left")
    items = rows.select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.concat(F.lit("label:"), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:")))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(F.element_at("consequent", 1), ":", -1).alias("verdict"), "confidence", "support")
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("less")).select(
        F.col("tokens").alias("whole"), "verdict", "confidence", F.array_remove("tokens", F.col("less")).alias("tokens")
    )
    as_good = shorter.alias("s").join(rules.alias("r").hint("shuffle_merge"), ["tokens", "verdict"]).filter(F.col("r.confidence") >= F.col("s.confidence"))
    rules = rules.join(as_good.select(F.col("whole").alias("tokens"), "verdict").distinct().hint("shuffle_merge"), ["tokens", "verdict"], "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("key"), "freq")
    rarest = rules.select("tokens", "verdict", F.explode("tokens").alias("key")).hint("shuffle_merge").join(single.hint("shuffle_merge"), "key")
    rarest = rarest.groupBy("tokens", "verdict").agg(F.min_by("key", F.struct("freq", "key")).alias("key"))
    return rules.hint("shuffle_merge").join(rarest.hint("shuffle_merge"), ["tokens", "verdict"])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", work: Workspace | None = None, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page's url.

    The longest listed rule that fits decides. It labels its urls; from them
    FP-growth mines which token combinations go with which verdict, and the
    other urls get the verdict of the most confident mined rule all of whose items
    they have (then the longer, then the more frequent one), else
    ``default``. rule is null and confidence the mined rule's there.

    Urls are judged once per distinct set of tokens. A null url has empty host
    and path and no tokens. Rows that repeat are each judged. Other columns are
    ignored. Without labelled urls all get ``default``. DataFrame functions and
    Spark ML only.
    """
    work = work or Workspace(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"listed": listed_rule(F.col("host"), F.col("path"), rules), "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))}).drop("url")
    rows = work.written(rows, "rows")
    labelled = rows.filter(F.col("listed").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "tokens", F.col("listed.verdict").alias("verdict"))
    open_ = rows.filter(F.col("listed").isNull())
    n = labelled.count()
    if not n:
        judged = None
    else:
        labelled = work.written(labelled, "labelled")
        classes = work.written(together(labelled, math.ceil(n * mining.get("min_support", MIN_SUPPORT) * (1 - 1e-9))), "items")
        mined = work.written(mine(labelled, classes=classes, **mining), "rules")
        # sets of tokens as sets of items; tokens that no rule can have are left out
        sets = open_.select("tokens").distinct()
        held = sets.select("tokens", F.explode("tokens").alias("token")).hint("shuffle_merge").join(classes.hint("shuffle_merge"), "token")
        sets = held.groupBy("tokens").agg(F.collect_set("item").alias("items"))
        index = mined.select("key", F.col("tokens").alias("needed"), "verdict", "confidence", "support")
        keyed = sets.select("tokens", "items", F.explode("items").alias("key"))
        if mined.count() <= FEW_RULES:
            met = keyed.join(F.broadcast(index), "key")
        else:
            keyed = keyed.withColumn("salt", F.expr(f"pmod(xxhash64(tokens), {SALTS})"))
            index = index.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
            met = keyed.hint("shuffle_merge").join(index.hint("shuffle_merge"), ["key", "salt"])
        met = met.filter(F.size(F.array_except("needed", "items")) == 0)
        rank = F.struct("confidence", F.size("needed"), "support", F.array_join("needed", " "), "verdict")
        judged = work.written(met.groupBy("tokens").agg(F.max(rank).alias("best")).select("tokens", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence")), "judged")
    listed = rows.filter(F.col("listed").isNotNull()).select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    none = F.lit(None).cast("string").alias("rule")
    if judged is None:
        rest = open_.select("page_id", "host", "path", none, F.lit(default).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    else:
        # a site's numbered pages are one set of tokens: they are dealt over SALTS tasks
        dealt = open_.withColumn("salt", F.expr(f"pmod(xxhash64(page_id, path), {SALTS})"))
        copied = judged.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        rest = dealt.hint("shuffle_merge").join(copied.hint("shuffle_merge"), ["tokens", "salt"], "left").select("page_id", "host", "path", none, F.coalesce("mined", F.lit(default)).alias("verdict"), "confidence")
    return listed.unionByName(rest)
