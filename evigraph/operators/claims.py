"""Triage, asks, proposals and their verification, measured values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ASK_CHUNK, DATA_ROWS, KIND_CAP, TRIAGE_CHARS, TRIAGE_PRE_CAP
from ..functions import text as T


def triage_items(items: DataFrame) -> DataFrame:
    """Items with text, blank parts dropped and cut for triage; items without text go."""
    text = F.concat_ws("\n", F.filter(F.array("label", "body"), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    return items.withColumn("text", F.substring(text, 1, TRIAGE_CHARS)).filter(F.trim("text") != "")


def _first(df: DataFrame, keys: list[str], order: list, most: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def triage_asked(items: DataFrame, confidence: DataFrame, most: int = TRIAGE_PRE_CAP) -> DataFrame:
    """The items of each kind that are asked about: best incoming confidence first."""
    best = confidence.groupBy("node").agg(F.max("confidence").alias("best"))
    known = items.join(best, "node", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return _first(known, ["graph_id", "kind"], [F.desc("best"), "node"], most)


def triage_survivors(asked: DataFrame, scores: DataFrame, most: int = KIND_CAP) -> DataFrame:
    """Items whose score, out of 3, reaches one half; the best of each kind."""
    scored = asked.drop("place").join(scores, "node").withColumn("score", F.col("score") / 3).filter("score >= 0.5")
    return _first(scored, ["graph_id", "kind"], [F.desc("score"), "node"], most)


def chunked(items: DataFrame, keys: list[str], order: list, size: int = ASK_CHUNK) -> DataFrame:
    """Items with the chunk they are asked in and their number inside it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return items.withColumn("n", n).withColumns({"chunk": F.floor(F.col("n") / size), "local": F.pmod("n", F.lit(size))}).drop("n")


def with_answers(asks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Asks with their answers; those of a failed chunk have none."""
    return asks.join(answers, keys, "left")


def ask_key(*parts: Column) -> Column:
    """Hash of a request body with keys in order: equal asks are asked once."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def mock_answers(asks: DataFrame) -> DataFrame:
    """The offline judge: the first option, the middle score, one half; unknown types fail."""
    q = F.col("qtype")
    known = q.isin("choice", "score", "noul")
    return asks.withColumns({
        "choice": F.when(q == "choice", F.element_at("criteria", 1)),
        "score": F.when(q == "score", (F.size("criteria") - 1) / 2),
        "noul": F.when(q == "noul", F.lit(0.5)),
        "confidence": F.when(known, F.when(q == "choice", F.lit(0.5))).otherwise(F.raise_error(F.concat(F.lit("unknown question type: "), q)).cast("double")),
    })


def judge(asks: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A pluggable judge: fn maps an iterator of pandas batches of asks to batches of answers."""
    return asks.mapInPandas(fn, schema)


propose = judge


def verified_claims(proposals: DataFrame, answers: DataFrame) -> DataFrame:
    """Edges of proposals that were judged, however low; those without an answer go."""
    judged = proposals.hint("shuffle_merge").join(answers.filter("noul is not null").hint("shuffle_merge"), ["node", "claim_no"])
    return judged.select(*claim_triple(), "claim", "quote", F.col("noul").alias("confidence"))


def claim_triple() -> list[Column]:
    """(subject, predicate, object) of a judged proposal (node, type, claim): what it says is a node named by its hash."""
    condition = F.col("type") == "condition"
    named = F.concat(F.when(condition, "condition:").otherwise("claim:"), F.substring(F.sha2("claim", 256), 1, 12))
    return [F.col("node").alias("subject"), F.when(condition, "has_condition").otherwise("reports").alias("predicate"), named.alias("object")]


def citation_fidelity(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(answer_id, cited, valid, fidelity): share of distinct cited nodes that exist; null without citations."""
    cited = answers.select("answer_id", F.explode_outer(F.array_distinct("cited")).alias("id"))
    known = nodes.select("id").distinct().withColumn("known", F.lit(1))
    met = cited.hint("shuffle_merge").join(known.hint("shuffle_merge"), "id", "left").groupBy("answer_id").agg(F.count("id").alias("cited"), F.count("known").alias("valid"))
    return met.withColumn("fidelity", F.round(F.col("valid") / F.nullif("cited", F.lit(0)), 6))


def percentiles(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rank within the group as a percentage, 0 to 100, ties in order; null for a lone value."""
    w = Window.partitionBy(*keys)
    rank, n = F.row_number().over(w.orderBy("value", *order)) - 1, F.count("*").over(w)
    return values.withColumn("percentile", F.when(n > 1, F.round(100 * rank / F.nullif(n - 1, F.lit(0)), 1)))


def sample_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the readable values, to 3 places; groups without one go."""
    out = rows.groupBy(*keys).agg(F.round(F.avg(F.col("value").try_cast("double")), 3).alias("value"))
    return out.filter(F.col("value").isNotNull())


def replicate_mean(cell: Column) -> Column:
    """Mean of the readable numbers of a comma-separated cell, to 3 places."""
    nums = F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(nums) > 0, F.round(F.aggregate(nums, F.lit(0.0), lambda a, x: a + x) / F.size(nums), 3))


def rows_text(rows: DataFrame, keys: list[str], most: int = DATA_ROWS) -> DataFrame:
    """Each dataset's rows as text, the strongest first, with only the columns that occur."""
    cols = ("value", "percentile", "p_value")
    w = Window.partitionBy(*keys)
    rank = F.coalesce(F.col("percentile").try_cast("double"), F.abs(F.col("value").try_cast("double")), F.lit(0.0))
    flagged = rows.withColumns({f"_{c}": F.count(c).over(w) > 0 for c in cols}).withColumns({"n": F.row_number().over(w.orderBy(F.desc(rank), "pos")), "total": F.count("*").over(w)})
    flagged = flagged.filter(F.col("n") <= most)
    line = F.concat_ws(" | ", F.col("sample").cast("string"), *(F.when(F.col(f"_{c}"), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in cols))
    head = F.concat_ws(" | ", F.lit("sample"), *(F.when(F.col(f"_{c}"), F.lit(c)) for c in cols))
    out = flagged.groupBy(*keys).agg(F.max(head).alias("head"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"), F.max("total").alias("total"))
    more = F.when(F.col("total") > most, F.concat(F.lit("\n... "), (F.col("total") - most).cast("string"), F.lit(" more rows"))).otherwise("")
    return out.select(*keys, F.concat("head", F.lit("\n"), F.array_join(F.col("lines.line"), "\n"), more).alias("text"))


def value_source(tpms: DataFrame, fpkms: DataFrame, contrasts: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, gene, value, via): contrasts for differential datasets, else tpms, else fpkms."""
    base, diff = datasets.filter("not differential"), datasets.filter("differential")
    first = base.join(tpms, "dataset").withColumn("via", F.lit("tpms"))
    rest = base.join(tpms.select("dataset").distinct(), "dataset", "left_anti").join(fpkms, "dataset").withColumn("via", F.lit("fpkms"))
    return first.unionByName(rest).unionByName(diff.join(contrasts, "dataset").withColumn("via", F.lit("contrasts"))).select("dataset", "gene", "value", "via")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, of normalized texts."""
    x, y = F.lower(T.collapsed(a)), F.lower(T.collapsed(b))
    return F.round(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)), 6)


def claim_overlap(recorded: DataFrame, generated: DataFrame, least: float) -> DataFrame:
    """Per ask: recall and precision as mean best similarity, matched claims of each side.

    The two sides meet on the ask's id, so each ask compares its few claims only.
    """
    pairs = recorded.select("ask_id", F.col("claim").alias("a"), F.col("claim_no").alias("i")).join(generated.select("ask_id", F.col("claim").alias("b"), F.col("claim_no").alias("j")).hint("shuffle_merge"), "ask_id")
    pairs = pairs.withColumn("sim", similarity(F.col("a"), F.col("b")))
    best = lambda side: pairs.groupBy("ask_id", side).agg(F.max("sim").alias("best")).groupBy("ask_id").agg((F.round(F.sum("best"), 4) / F.count("*")).alias("mean"), F.count_if(F.col("best") >= least).alias("matched"), F.count("*").alias("n"))
    r, p = best("i"), best("j")
    return r.select("ask_id", F.col("mean").alias("recall"), F.col("matched").alias("recorded_matched"), F.col("n").alias("n_recorded")).hint("shuffle_merge").join(p.hint("shuffle_merge").select("ask_id", F.col("mean").alias("precision"), F.col("matched").alias("generated_matched"), F.col("n").alias("n_generated")), "ask_id")


def greedy_matches(pairs: DataFrame, least: float) -> DataFrame:
    """(ask_id, i, j, sim): one-to-one matches, the most similar first, within the few claims of an ask."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "i", "j")))
    none = F.array().cast("array<struct<s:double,i:bigint,j:bigint>>")
    free = lambda done, x: ~F.exists(done, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    taken = F.aggregate(order, none, lambda done, x: F.when(free(done, x), F.concat(done, F.array(x))).otherwise(done))
    found = pairs.filter(F.col("sim") >= least).groupBy("ask_id").agg(taken.alias("t")).select("ask_id", F.inline("t"))
    return found.select("ask_id", "i", "j", (-F.col("s")).alias("sim"))
