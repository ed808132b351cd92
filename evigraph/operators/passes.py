"""Compositions over tables of model output: claims from texts and data, summaries, and answers to questions.

What a model said comes as a table (or through ``claims.propose`` and
``claims.judge``); what was not answered is absent there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PROMPT_CHARS
from ..functions import text as T
from . import claims
from .graph import graph_text, picked_categories
from .stages import merge_join

NO_CATEGORY = "The question fits no category of the graph, so its answer is not scored."
NO_JUDGE = "The judge gave no scores, so the answer is not scored."


def proposed(units: DataFrame, keys: list[str], contents: DataFrame) -> DataFrame:
    """(keys, claim_no, claim, type, quote, n_cited) of the proposals in contents (keys, content) about units (keys, units array)."""
    met = merge_join(units, contents, keys)
    each = met.select(*keys, "units", F.posexplode(T.proposals(T.outer_proposals(F.col("content")), F.size("units"))).alias("claim_no", "p"))
    return each.select(*keys, "claim_no", F.col("p.claim").alias("claim"), F.col("p.type").alias("type"), T.quote(F.col("units"), F.col("p.cited")).alias("quote"), F.size(F.array_distinct("p.cited")).cast("long").alias("n_cited"))


def normalized(proposals: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """proposals with conditions worded as in labels (keys, claim_no, label); others and those without a label stay."""
    met = merge_join(proposals, labels, [*keys, "claim_no"], "left")
    return met.withColumn("claim", F.when((F.col("type") == "condition") & (F.trim(F.coalesce("label", F.lit(""))) != ""), T.collapsed(F.col("label"))).otherwise(F.col("claim"))).drop("label")


def text_claims(items: DataFrame, confidence: DataFrame, scores: DataFrame, contents: DataFrame, labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(graph_id, subject, predicate, object, claim, quote, confidence, category): the claim pass over items (graph_id, node, kind, label, body).

    Items are triaged (scores: node, score), those that survive are cut into
    sentences, their proposals (contents: node, content) get normalized labels
    (labels: node, claim_no, label), and every proposal with a verdict (node,
    claim_no, noul, category) becomes an edge. Categories belong to claims only.
    """
    triaged = claims.triage_survivors(claims.triage_asked(claims.triage_items(items), confidence), scores)
    known = merge_join(triaged.select("graph_id", "node"), items.select("node", "body"), "node")
    units = known.select("graph_id", "node", T.truncated(F.col("body"), PROMPT_CHARS).alias("units"))
    found = normalized(proposed(units, ["node"], contents), labels, ["node"])
    judged = merge_join(found, verdicts.filter("noul is not null"), ["node", "claim_no"])
    condition = F.col("type") == "condition"
    edges = judged.select(
        "node",
        *claims.claim_triple(),
        "claim",
        "quote",
        T.clamped(F.col("noul").cast("string")).alias("confidence"),
        F.when(~condition, F.coalesce("category", F.lit("other"))).alias("category"),
    )
    return merge_join(edges, units.select("graph_id", "node"), "node").drop("node").select("graph_id", "subject", "predicate", "object", "claim", "quote", "confidence", "category")


def data_claims(values: DataFrame, contents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(dataset, claim, quote, n_rows, n_cited, confidence): claims from measured values (dataset, sample, value, percentile, p_value, pos).

    Proposals cite the lines of the dataset's text, in its order; n_rows counts
    all rows of the dataset.
    """
    shown = claims.rows_text(values, ["dataset"])
    units = shown.select("dataset", F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n"))).alias("units"))
    sizes = values.groupBy("dataset").agg(F.count("*").alias("n_rows"))
    found = proposed(units, ["dataset"], contents)
    judged = merge_join(merge_join(found, verdicts.filter("noul is not null"), ["dataset", "claim_no"]), sizes, "dataset")
    return judged.select("dataset", "claim", "quote", "n_rows", "n_cited", T.clamped(F.col("noul").cast("string")).alias("confidence"))


def summaries(graphs: DataFrame, edges: DataFrame, labels: DataFrame, contents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(graph_id, claims array<struct<claim, quote, confidence>>) of each graph (graph_id): verified sentences about its text; an empty list without any."""
    shown = graph_text(edges, labels)
    units = shown.select("graph_id", F.split("text", "\n").alias("units"))
    judged = merge_join(proposed(units, ["graph_id"], contents), verdicts.filter("noul is not null"), ["graph_id", "claim_no"])
    listed = judged.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim", "quote", T.clamped(F.col("noul").cast("string")).alias("confidence")))).alias("x"))
    met = merge_join(graphs.select("graph_id"), listed, "graph_id", "left")
    none = F.array().cast("array<struct<claim:string,quote:string,confidence:double>>")
    return met.select("graph_id", F.coalesce(F.transform("x", lambda c: F.struct(c["claim"].alias("claim"), c["quote"].alias("quote"), c["confidence"].alias("confidence"))), none).alias("claims"))


def answers(questions: DataFrame, flags: DataFrame, contents: DataFrame, scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per question (graph_id, question_id, question): what was answered and how it was scored.

    flags: graph_id, question_id, category, noul; contents: the proposer's text;
    scores: accuracy and completeness. Results have three shapes: without a
    category the answer is unscored; with one, cited nodes are checked against
    the whole graph and the answer is scored; where the judge gave no scores,
    fidelity stays and a warning says so.
    """
    key = ["graph_id", "question_id"]
    picked = picked_categories(flags.select(*key, "category", "noul"))
    met = merge_join(merge_join(questions, picked, key, "left"), contents, key)
    met = met.withColumn("a", T.answer(F.col("content"))).select(*key, "question", "categories", F.col("scores").alias("category_scores"), F.col("a.answer").alias("answer"), F.col("a.cited_nodes").alias("cited_nodes"))
    cited = met.select(*key, F.posexplode("cited_nodes").alias("pos", "id"))
    unknown = merge_join(cited, nodes.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_anti")
    wrong = unknown.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("invalid_cited_nodes"))
    out = merge_join(merge_join(met, wrong, key, "left"), scores.select(*key, "accuracy", "completeness", F.lit(True).alias("_judged")), key, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"categories": F.coalesce("categories", empty), "invalid_cited_nodes": F.coalesce("invalid_cited_nodes", empty)})
    sliced = F.size("categories") > 0
    scored = sliced & F.coalesce("_judged", F.lit(False))
    n = F.size("cited_nodes")
    fidelity = F.when(sliced & (n > 0), (n - F.size("invalid_cited_nodes")) / n)
    only = lambda c: F.when(scored, F.col(c))
    return out.select(*key, "question", "answer", "cited_nodes", "invalid_cited_nodes", "categories", "category_scores", scored.alias("scored"), F.when(~sliced, NO_CATEGORY).when(~scored, NO_JUDGE).alias("warning"), fidelity.alias("citation_fidelity"), only("accuracy").alias("accuracy"), only("completeness").alias("completeness"))


def listed(xs: str) -> Column:
    return F.array_join(xs, ",")
