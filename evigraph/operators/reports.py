"""Reports over runs, calls and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage(calls: DataFrame) -> DataFrame:
    """(stage, calls, tokens_in, tokens_out, reproduced) per stage and for all, in one pass."""
    out = calls.rollup("stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.count_if(F.col("before").eqNullSafe(F.col("after"))).alias("reproduced"), F.grouping("stage").alias("_all"))
    return out.withColumn("stage", F.when(F.col("_all") == 1, "all").otherwise(F.col("stage"))).drop("_all")


def elapsed(marks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Seconds since the previous mark, to 2 places."""
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy(*order))
    seconds = (F.unix_micros("ts") - F.unix_micros(before)) / 1e6
    return marks.withColumn("elapsed", F.round(seconds, 2))


def assertions(nodes: DataFrame, edges: DataFrame, least_nodes: int, required: list[str], anchor_type: str) -> DataFrame:
    """Per graph: predicates, counts, whether there are enough nodes and an anchor, and predicates missing."""
    by_edge = edges.groupBy("graph_id").agg(F.array_sort(F.collect_set("predicate")).alias("found"), F.count("*").alias("n_edges"))
    by_node = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), (F.count_if(F.col("type") == anchor_type) > 0).alias("anchored"))
    missing = F.array_except(F.array(*map(F.lit, required)), "found")
    return by_edge.join(by_node, "graph_id").select("graph_id", F.array_join("found", ",").alias("predicates"), "n_nodes", "n_edges", (F.col("n_nodes") >= least_nodes).alias("enough_nodes"), F.array_join(missing, ",").alias("missing"), "anchored")


def latency(calls: DataFrame) -> DataFrame:
    """(stage, n, p50, p90, longest): the value at place floor(n p) of the sorted times, per stage and for all.

    Times are counted first, so that ranks run over distinct times of a stage only.
    """
    counts = calls.groupBy("stage", "ms").agg(F.count("*").alias("k"))
    both = counts.unionByName(counts.groupBy("ms").agg(F.sum("k").alias("k")).withColumn("stage", F.lit("all")))
    w = Window.partitionBy("stage")
    ranked = both.withColumns({"upto": F.sum("k").over(w.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("ms")))
    return ranked.groupBy("stage").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("ms").alias("longest"))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of two runs' cases (case, outcome, ok, wall_s, tokens): flips, regressions, differences, missing."""
    a = old.select("case", *(F.col(c).alias(f"old_{c}") for c in ("outcome", "ok", "wall_s", "tokens")))
    b = new.select("case", *(F.col(c).alias(f"new_{c}") for c in ("outcome", "ok", "wall_s", "tokens")))
    out = a.join(b, "case", "full_outer")
    status = F.when(F.col("old_outcome").isNull(), "only_new").when(F.col("new_outcome").isNull(), "only_old").when(F.col("old_outcome") != F.col("new_outcome"), "flipped").when(F.col("old_ok") & ~F.col("new_ok"), "regressed").otherwise("same")
    return out.select("case", status.alias("status"), F.round(F.col("new_wall_s") - F.col("old_wall_s"), 2).alias("wall_diff"), (F.col("new_tokens") - F.col("old_tokens")).alias("token_diff"))


def compare_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "flipped").alias("flips"), F.count_if(F.col("status") == "regressed").alias("regressions"), F.round(F.sum("wall_diff"), 2).alias("wall_diff"), F.sum("token_diff").alias("token_diff"))


def answer_diff(asked: DataFrame) -> DataFrame:
    """Per question: absolute difference and 0.5 flip of nouls, agreement of choices."""
    noul = F.col("qtype") == "noul"
    return asked.withColumns({
        "delta": F.when(F.col("qtype").isin("noul", "score"), F.round(F.abs(F.col("old_value") - F.col("new_value")), 4)),
        "flip": F.when(noul, (F.col("old_value") >= 0.5) != (F.col("new_value") >= 0.5)),
        "agree": F.when(F.col("qtype") == "choice", F.col("old_choice").eqNullSafe(F.col("new_choice"))),
    })


def answer_diff_summary(diffs: DataFrame) -> DataFrame:
    """Per backend and stage, and per backend over all stages, in one pass."""
    out = diffs.rollup("backend", "stage")
    noul = F.col("qtype") == "noul"
    out = out.agg(
        F.count("*").alias("rows"),
        F.count_if(noul).alias("noul_n"),
        F.round(F.avg(F.when(noul, F.col("delta"))), 4).alias("noul_mean_delta"),
        F.round(F.avg(F.when(noul, F.col("flip").cast("double"))), 4).alias("noul_flip_rate"),
        F.count_if(F.col("qtype") == "choice").alias("choice_n"),
        F.round(F.avg(F.when(F.col("qtype") == "choice", F.col("agree").cast("double"))), 4).alias("choice_agree_rate"),
        F.round(F.avg(F.when(F.col("qtype") == "score", F.col("delta"))), 4).alias("score_mean_delta"),
        F.grouping("backend").alias("_b"),
        F.grouping("stage").alias("_s"),
    )
    return out.filter("_b = 0").withColumn("stage", F.when(F.col("_s") == 1, "all").otherwise(F.col("stage"))).drop("_b", "_s")


def generation_summary(overlap: DataFrame) -> DataFrame:
    """Per stage: asks, mean claims of each side, mean recall and precision, matched claims, asks without generated claims."""
    mean = lambda c: F.round(F.round(F.sum(c), 4) / F.count(c), 4)
    return overlap.groupBy("stage").agg(F.count("*").alias("asks"), mean("n_recorded").alias("mean_recorded"), mean("n_generated").alias("mean_generated"), mean("recall").alias("recall"), mean("precision").alias("precision"), F.sum("recorded_matched").alias("matched"), F.count_if(F.coalesce("n_generated", F.lit(0)) == 0).alias("empty"))


def type_mix(recorded: DataFrame, generated: DataFrame) -> DataFrame:
    """(side, type, n): how many proposals of each type either side has."""
    both = recorded.select(F.lit("recorded").alias("side"), "type").unionByName(generated.select(F.lit("generated").alias("side"), "type"))
    return both.groupBy("side", "type").agg(F.count("*").alias("n"))


def unmatched(recorded: DataFrame, generated: DataFrame, matches: DataFrame) -> DataFrame:
    """(side, ask_id, claim_no) of the claims of either side that no match (ask_id, i, j) uses."""
    out = []
    for side, claims, column in (("recorded", recorded, "i"), ("generated", generated, "j")):
        used = matches.select("ask_id", F.col(column).alias("claim_no")).distinct()
        out.append(claims.select("ask_id", "claim_no").hint("shuffle_merge").join(used.hint("shuffle_merge"), ["ask_id", "claim_no"], "left_anti").select(F.lit(side).alias("side"), "ask_id", "claim_no"))
    return out[0].unionByName(out[1])
