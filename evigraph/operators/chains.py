"""Passes chained to whole runs: from questions to scored answers, from identifiers to verified summaries.

Between the passes tables are written (``work``), as a proposer's and a judge's
answers must not be asked for twice. Both are batch functions: a judge maps the
asks of one chunk (a pandas frame with ``item`` and ``body``) to (item, noul), a
proposer maps (item, system, user) to (item, content). Where a judge is to choose, it
gives (item, noul, choice). What raises fails its
chunk alone: such questions are answered unscored, such graphs have no summary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORY_TEXTS, CLAIM_CATEGORIES, PROMPT_CHARS
from ..functions import asks as A
from ..functions import text as T
from ..sources.workspace import Work
from . import claims, passes
from .asking import judged_chunks
from .graph import graph_text, picked_categories, projection, slice_graphs
from .stages import merge_join

Batch = Callable[[pd.DataFrame], pd.DataFrame]


def projected(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, graph): each projection as JSON, its nodes by id and its strongest edges, with how many edges there are."""
    n = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "type", "label"))).alias("nodes"))
    top = projection(edges.select(*keys, "subject", "predicate", "object", "confidence"), keys)
    e = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "subject", "predicate", "object"))).alias("x"), F.max("edges_total").alias("edges_total"))
    e = e.select(*keys, F.transform("x", lambda r: F.struct(r["subject"].alias("subject"), r["predicate"].alias("predicate"), r["object"].alias("object"), (-r["c"]).alias("confidence"))).alias("edges"), "edges_total")
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    met = merge_join(n, e, keys, "left")
    return met.select(*keys, F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"), F.coalesce("edges_total", F.lit(0)).alias("edges_total"))).alias("graph"))


def answered_questions(questions: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, judge: Batch, proposer: Batch, work: Work) -> DataFrame:
    """One row per question (graph_id, question_id, question) over graphs, in the shapes of ``passes.answers``.

    1. the judge says which categories a question needs (a chunk a question);
    2. the categories cut a slice of the question's graph, or there is none and
       the whole graph counts; either is shown as its strongest edges;
    3. the proposer answers from that and cites nodes (a chunk a question);
    4. cited nodes are checked against the whole graph; the judge scores accuracy
       and completeness of answers that came from a slice.

    nodes and edges are those of all graphs, queries (graph_id, id). Questions
    whose classification failed count as without a category; those whose proposer
    failed have no row.
    """
    key = ["graph_id", "question_id"]
    asked = questions.select(*key, F.inline(A.question_categories(F.col("question"), CATEGORY_TEXTS))).select(*key, F.col("category").alias("item"), F.to_json("ask").alias("body"))
    flags = work(judged_chunks(asked, judge, key, ["item"], "noul double"), "flags")
    flags = flags.select(*key, F.col("item").alias("category"), "noul")
    chosen = work(picked_categories(flags).select(*key, F.explode("categories").alias("category")), "chosen")
    n, e = slice_graphs(nodes, edges, chosen, queries)
    slices = projected(n, e, key).withColumn("excerpt", F.lit(True))
    rest = merge_join(questions.select(*key), chosen.select(*key).distinct(), key, "left_anti")
    whole = merge_join(rest, projected(nodes, edges, ["graph_id"]), "graph_id").withColumn("excerpt", F.lit(False))
    shown = work(merge_join(slices.unionByName(whole.select(slices.columns)), questions.select(*key, "question"), key), "shown")
    prompt = F.when(F.col("excerpt"), A.answer_prompt(F.col("question"), F.col("graph"), True)).otherwise(A.answer_prompt(F.col("question"), F.col("graph"), False))
    told = shown.select(*key, F.lit(0).alias("item"), prompt.alias("p")).select(*key, "item", "p.system", "p.user")
    contents = work(judged_chunks(told, proposer, key, ["item"], "content string").filter("content is not null").select(*key, "content"), "contents")
    lists = chosen.groupBy(*key).agg(F.array_sort(F.collect_list("category")).alias("categories"))
    toscore = merge_join(merge_join(shown.filter("excerpt"), contents, key), lists, key)
    scored = toscore.select(*key, F.inline(A.answer_scores(F.col("question"), T.answer(F.col("content"))["answer"], F.col("graph"), F.array_join("categories", ",")))).select(*key, F.col("score").alias("item"), F.to_json("ask").alias("body"))
    scores = work(judged_chunks(scored, judge, key, ["item"], "noul double").filter("error is null"), "scores")
    of = lambda name: F.max(F.when(F.col("item") == name, F.col("noul"))).alias(name)
    return passes.answers(questions, flags, contents, scores.groupBy(*key).agg(of("accuracy"), of("completeness")), nodes)


def verified_summaries(nodes: DataFrame, edges: DataFrame, meta: DataFrame, judge: Batch, proposer: Batch, work: Work) -> DataFrame:
    """(graph_id, claims array<struct<claim, quote, confidence>>) of the resolved graphs of meta (graph_id, query, outcome).

    Each graph's text goes to the proposer, what it proposes is checked against
    the lines it cites, and the judge says how far each claim holds (a chunk a
    graph). A graph whose proposer or judge failed has an empty list.
    """
    graphs = meta.filter("outcome = 'resolved'").select("graph_id", "query")
    own = merge_join(edges, graphs.select("graph_id"), "graph_id", "left_semi")
    shown = work(graph_text(own, nodes), "texts")
    named = merge_join(shown, graphs, "graph_id")
    told = named.select("graph_id", F.lit(0).alias("item"), A.summary_prompt(F.col("query"), F.lit(None).cast("string"), F.col("text")).alias("p")).select("graph_id", "item", "p.system", "p.user")
    contents = work(judged_chunks(told, proposer, ["graph_id"], ["item"], "content string").filter("content is not null").select("graph_id", "content"), "contents")
    found = passes.proposed(shown.select("graph_id", F.split("text", "\n").alias("units")), ["graph_id"], contents)
    asked = merge_join(found.select("graph_id", "claim_no", "claim"), named, "graph_id")
    asked = asked.select("graph_id", F.col("claim_no").alias("item"), F.to_json(A.summary_claim(F.col("query"), F.col("text"), F.col("claim"))).alias("body"))
    verdicts = work(judged_chunks(asked, judge, ["graph_id"], ["item"], "noul double").select("graph_id", F.col("item").alias("claim_no"), "noul"), "verdicts")
    return passes.summaries(graphs.select("graph_id"), own, nodes, contents, verdicts)


def proposed_claims(items: DataFrame, confidence: DataFrame, judge: Batch, proposer: Batch, work: Work, vocabulary: Mapping[str, str] = CLAIM_CATEGORIES) -> DataFrame:
    """Edges, as ``passes.text_claims`` gives them, that a proposer found in texts and a judge looked at.

    items: graph_id, node, kind, label, body; confidence: node, confidence.

    1. the judge scores how much each text has to say, 0 to 3 (chunks of a graph's
       items of a kind); the best of those that reach one half go on;
    2. the proposer lists conditions and claims and cites sentences (a chunk a text);
    3. it words the conditions of a text alike; where it fails, or gives another
       number of labels, the first wording stays;
    4. the judge says how far each proposal holds, and names a category for claims.

    Texts whose triage or proposals failed give no edges, nor do proposals
    without a verdict; a claim without a category is of category other.
    """
    asked = work(claims.triage_asked(claims.triage_items(items), confidence).drop("place"), "asked")
    chunk = ["graph_id", "kind", "chunk"]
    bodies = claims.chunked(asked, chunk[:2], ["node"]).select(*chunk, F.col("node").alias("item"), F.to_json(A.triage(F.col("node"), F.col("kind"), F.col("text"))).alias("body"))
    scores = work(judged_chunks(bodies, judge, chunk, ["item"], "noul double").filter("noul is not null").select(F.col("item").alias("node"), F.col("noul").alias("score")), "scores")
    triaged = claims.triage_survivors(asked.withColumn("place", F.lit(0)), scores)
    units = merge_join(triaged.select("node").distinct(), items.select("node", "body").dropDuplicates(["node"]), "node").select("node", T.truncated(F.col("body"), PROMPT_CHARS).alias("units"))
    units = work(units, "units")
    prompts = lambda rows, p: rows.select("node", F.lit(0).alias("item"), p.alias("p")).select("node", "item", "p.system", "p.user")
    told = prompts(units, A.text_prompt(F.col("node"), T.numbered(F.col("units"))))
    said = lambda rows, name: work(judged_chunks(rows, proposer, ["node"], ["item"], "content string").filter("content is not null").select("node", "content"), name)
    contents = said(told, "contents")
    found = work(passes.proposed(units, ["node"], contents), "proposed")
    conditions = found.filter("type = 'condition'").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))).alias("x"))
    conditions = conditions.select("node", F.transform("x", lambda c: c["claim_no"]).alias("numbers"), F.transform("x", lambda c: c["claim"]).alias("claims"))
    worded = merge_join(conditions, said(prompts(conditions, A.normalize_prompt(F.col("claims"))), "wordings"), "node")
    given = T.labels_or_none(F.from_json("content", "normalized string")["normalized"], F.size("numbers"))
    labels = worded.select("node", F.explode(F.arrays_zip(F.col("numbers").alias("n"), given.alias("label"))).alias("z")).select("node", F.col("z.n").alias("claim_no"), F.col("z.label").alias("label"))
    final = merge_join(passes.normalized(found, labels, ["node"]), units, "node")
    body = F.array_join("units", " ")
    judged = final.select("node", F.col("claim_no").alias("item"), F.to_json(A.verify(F.col("node"), F.col("type"), F.col("claim"), F.col("quote"), body)).alias("body"))
    verdicts = work(judged_chunks(judged, judge, ["node"], ["item"], "noul double").select("node", F.col("item").alias("claim_no"), "noul"), "verdicts")
    kinds = final.select("node", F.col("claim_no").alias("item"), F.to_json(A.category(F.col("node"), F.col("type"), F.col("claim"), vocabulary)).alias("body")).filter("body is not null")
    chosen = work(judged_chunks(kinds, judge, ["node"], ["item"], "choice string").select("node", F.col("item").alias("claim_no"), F.col("choice").alias("category")), "chosen")
    return passes.text_claims(items, confidence, scores, contents, labels, merge_join(verdicts, chosen, ["node", "claim_no"], "left"))
