"""Which record an identifier means, and how source records join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALTERNATES, DATASET_CAP, LONE_HIT_LEAST, ORTHOLOG_CAP
from ..functions import ids as I
from .stages import TOGETHER, spread_join


def exact_matches(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(graph_id, record_id): records that carry the query among their ids, whatever the case; an equi-join on ids.

    Repeats are taken out of both sides first; a graph with one query then meets
    no record twice, so its pairs aren't shuffled.
    """
    each = records.select("record_id", F.explode(F.array_distinct(F.transform(F.array_compact("ids"), F.lower))).alias("key")).distinct()
    asked = queries.select("graph_id", F.lower(F.trim("query")).alias("key")).filter("key <> ''").distinct()
    asked = asked.withColumn("_times", F.count("*").over(Window.partitionBy("graph_id")))
    met = lambda some: spread_join(asked.filter(some).drop("_times"), each, "key", TOGETHER).select("graph_id", "record_id")
    return met("_times = 1").unionByName(met("_times > 1").distinct())


def pick_candidate(candidates: DataFrame, answers: DataFrame, least: float = LONE_HIT_LEAST) -> DataFrame:
    """One decision per graph from candidates (graph_id, pos, record_id, exact) and answers (graph_id, noul, choice).

    One exact candidate is taken as asserted. Else the pool is the exact ones,
    or all; a lone one needs noul >= ``least``, among many the judge's choice is an
    index into the pool and anything else refuses.
    """
    w = Window.partitionBy("graph_id")
    counted = candidates.withColumn("n_exact", F.count_if("exact").over(w))
    pool = counted.filter((F.col("n_exact") == 0) | F.col("exact"))
    pool = pool.withColumns({"k": F.row_number().over(w.orderBy("pos")) - 1, "size": F.count("*").over(w)}).join(answers, "graph_id", "left")
    asserted = F.col("n_exact") == 1
    taken = F.when(asserted, True).when(F.col("size") == 1, F.col("noul") >= least).otherwise(F.col("choice").try_cast("int") == F.col("k"))
    confidence = F.when(asserted, 1.0).otherwise(I.score_of(F.col("noul"), F.lit(None).cast("double")))
    got = F.when(F.coalesce(taken, F.lit(False)), F.struct("record_id", confidence.alias("confidence"), asserted.alias("asserted")))
    out = pool.groupBy("graph_id").agg(F.max(got).alias("x"), F.first("n_exact").alias("n_exact"), F.first("size").alias("pool"))
    return out.select("graph_id", F.when(F.col("x").isNull(), "refused").otherwise("resolved").alias("outcome"), "x.record_id", "x.confidence", F.col("n_exact").cast("long").alias("n_exact"), F.col("pool").cast("long").alias("pool"))


def routed(first: DataFrame, second: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Hits in the first source; queries that miss there take the second's."""
    hits = queries.join(first, key)
    missed = queries.join(first.select(key).distinct(), key, "left_anti")
    return hits.withColumn("route", F.lit(1)).unionByName(missed.join(second, key).withColumn("route", F.lit(2)))


def fill(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """left with null columns filled from right; other columns stay."""
    side = right.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = left.join(side, key, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def superseded(accessions: DataFrame) -> DataFrame:
    """(old, new): same number, higher version; an equi-join on the number with a residual."""
    known = accessions.select("accession", I.accession_number(F.col("accession")).alias("num"), I.accession_version(F.col("accession")).alias("ver")).filter("num <> '' and ver is not null").distinct()
    a = known.select(F.col("accession").alias("old"), "num", F.col("ver").alias("v"))
    b = known.select(F.col("accession").alias("new"), "num", F.col("ver").alias("w"))
    return a.hint("shuffle_merge").join(b.hint("shuffle_merge"), "num").filter("w > v").select("old", "new")


def first_alternate(queries: DataFrame, keys: str, records: DataFrame, most: int = ALTERNATES) -> DataFrame:
    """(graph_id, rank, key, record_id): records of the first key in priority order that has any.

    queries has ``keys``, an array: the direct id first, at rank 0, then up to
    ``most`` distinct alternates.
    """
    direct = F.element_at(keys, 1)
    ordered = F.concat(F.array(direct), F.slice(F.array_remove(F.array_distinct(F.array_compact(keys)), direct), 1, most))
    each = queries.select("graph_id", F.posexplode(ordered).alias("rank", "key"))
    hits = each.hint("shuffle_merge").join(records.hint("shuffle_merge"), "key").withColumn("best", F.min("rank").over(Window.partitionBy("graph_id")))
    return hits.filter("rank = best").drop("best")


def capped(rows: DataFrame, keys: list[str], score, place: list, most: int = ORTHOLOG_CAP) -> DataFrame:
    """The best rows of each group by score (null is 0), ties in order of place."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), *place)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def capped_if_many(rows: DataFrame, keys: list[str], order: list, most: int = DATASET_CAP) -> DataFrame:
    """All rows of a small group; of a larger one the first ``most`` in order."""
    w = Window.partitionBy(*keys)
    out = rows.withColumns({"size": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(*order))})
    return out.filter((F.col("size") <= most) | (F.col("rank") <= most))


def merged_hits(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both hit lists, a record of both only once, as the first has it."""
    return first.unionByName(second.join(first.select("graph_id", key), ["graph_id", key], "left_anti"))


def species_links(genes: DataFrame, places: DataFrame) -> DataFrame:
    """(gene, place, matched_on) where tax ids agree or the species is the same; by tax id if both.

    genes: gene, tax_id, species; places: place, place_tax_id, place_species.
    Three equi-joins (tax id; species key; epithet and initial with a residual)
    instead of one join by OR.
    """
    g = genes.withColumns({"key": I.species_key(F.col("species")), "ep": I.epithet(F.col("species")), "ini": F.substring(I.genus(F.col("species")), 1, 1)})
    p = places.withColumns({"pkey": I.species_key(F.col("place_species")), "pep": I.epithet(F.col("place_species")), "pini": F.substring(I.genus(F.col("place_species")), 1, 1)})
    g, p = g.hint("shuffle_merge"), p.hint("shuffle_merge")
    by_tax = g.join(p, F.col("tax_id") == F.col("place_tax_id")).select("gene", "place", F.lit(0).alias("how"))
    by_key = g.join(p, (F.col("key") == F.col("pkey")) & (F.col("key") != "")).select("gene", "place", F.lit(1).alias("how"))
    short = g.join(p, (F.col("ep") == F.col("pep")) & (F.col("ini") == F.col("pini")) & (F.col("ep") != ""))
    short = short.filter(I.same_species(F.col("species"), F.col("place_species"))).select("gene", "place", F.lit(1).alias("how"))
    best = by_tax.union(by_key).union(short).groupBy("gene", "place").agg(F.min("how").alias("how"))
    return best.select("gene", "place", F.when(F.col("how") == 0, "tax_id").otherwise("species").alias("matched_on"))


def presence(places: DataFrame, annotated: DataFrame, seen: DataFrame) -> DataFrame:
    """(gene, accession, via): places where a gene isn't annotated but was seen, by accession or by its core.

    places and annotated are (gene, accession), seen is (gene, seen_accession).
    Two equi-joins, of which the one by accession is preferred.
    """
    open_ = places.hint("shuffle_merge").join(annotated.hint("shuffle_merge"), ["gene", "accession"], "left_anti").withColumn("core", I.accession_core(F.col("accession")))
    known = seen.select("gene", "seen_accession", I.accession_core(F.col("seen_accession")).alias("core")).distinct()
    by_id = open_.hint("shuffle_merge").join(known.select("gene", F.col("seen_accession").alias("accession")), ["gene", "accession"]).select("gene", "accession", F.lit(0).alias("how"))
    by_core = open_.hint("shuffle_merge").join(known.select("gene", "core"), ["gene", "core"]).select("gene", "accession", F.lit(1).alias("how"))
    best = by_id.union(by_core).groupBy("gene", "accession").agg(F.min("how").alias("how"))
    return best.select("gene", "accession", F.when(F.col("how") == 0, "accession").otherwise("core").alias("via"))


def pick_protein(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """The protein entry of each graph from candidates (graph_id, pos, record_id, id_exact, symbol_exact).

    The first that agrees on an id is taken as asserted, else one that alone
    agrees on the symbol; else the judge decides as in ``pick_candidate``.
    """
    w = Window.partitionBy("graph_id")
    counted = candidates.withColumns({"_ids": F.count_if("id_exact").over(w), "_first": F.min(F.when(F.col("id_exact"), F.struct("pos", "record_id"))).over(w), "_symbols": F.count_if("symbol_exact").over(w)})
    sure = F.when(F.col("_ids") > 0, F.col("record_id") == F.col("_first.record_id")).otherwise((F.col("_symbols") == 1) & F.col("symbol_exact"))
    marked = counted.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    known = marked.filter("_sure").select("graph_id", F.lit("resolved").alias("outcome"), "record_id", F.lit(1.0).alias("confidence"))
    rest = marked.filter(~((F.col("_ids") > 0) | (F.col("_symbols") == 1)))
    judged = pick_candidate(rest.select("graph_id", "pos", "record_id", F.lit(False).alias("exact")), answers)
    return known.unionByName(judged.select("graph_id", "outcome", "record_id", "confidence"))


def link_pool(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of a link's candidates (keys, pos, record_id, exact, same_taxon): with ``via``, their ``number`` and the pool's size.

    One record that carries the id is taken (via exact); else, of those that
    carry it or of all, one of the same taxon (via taxon); else the judge is asked
    about those of the taxon, or all where none is of it (via asked).
    """
    w = Window.partitionBy(*keys)
    exact, taxon = F.coalesce("exact", F.lit(False)), F.coalesce("same_taxon", F.lit(False))
    counted = candidates.withColumns({"exact": exact, "same_taxon": taxon}).withColumn("_exact", F.count_if("exact").over(w))
    pool = counted.filter((F.col("_exact") == 0) | F.col("exact")).withColumn("_taxon", F.count_if("same_taxon").over(w))
    sole = F.col("_exact") == 1
    pool = pool.filter(sole | (F.col("_taxon") == 0) | F.col("same_taxon"))
    via = F.when(sole, "exact").when(F.col("_taxon") == 1, "taxon").otherwise("asked")
    return pool.withColumns({"via": via, "number": F.row_number().over(w.orderBy("pos", "record_id")) - 1, "size": F.count("*").over(w)}).drop("_exact", "_taxon")


def link_asks(pool: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidates array<record_id>): what the judge is asked, candidates in the order their numbers stand for."""
    asked = pool.filter("via = 'asked'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "record_id"))).alias("x"))
    return asked.select(*keys, F.transform("x", lambda r: r["record_id"]).alias("candidates"))


def linked(pool: DataFrame, answers: DataFrame, keys: list[str], least: float = LONE_HIT_LEAST) -> DataFrame:
    """(keys, outcome, record_id, confidence): each link's decision from its pool and answers (keys, noul, choice, confidence).

    exact and taxon are asserted. A lone candidate needs noul >= ``least`` (outcome
    lone); of several the judge's choice counts, with its confidence (outcome
    choice). A choice that is no number of the pool, none and a missing answer
    refuse: null record, confidence 0, or the noul that was too low.
    """
    met = pool.hint("shuffle_merge").join(_said(answers, keys).hint("shuffle_merge"), keys, "left")
    return _decided(met, keys, least)


def linked_by_ask(questions: DataFrame, pool: DataFrame, answers: DataFrame, keys: list[str], least: float = LONE_HIT_LEAST) -> DataFrame:
    """As ``linked``, for questions (keys, ask) that share pools (ask): each key meets only the candidate it takes or judges.

    That is the pool's only one, else the one whose number was chosen, so no pool
    is repeated for the keys that share it. Keys without candidates have no row.
    """
    told = questions.hint("shuffle_merge").join(_said(answers, keys).hint("shuffle_merge"), keys, "left")
    pools = pool.filter("number = 0").select("ask", "via", "size")
    told = told.hint("shuffle_merge").join(pools.hint("shuffle_merge"), "ask")
    told = told.withColumn("number", F.when((F.col("via") == "asked") & (F.col("size") > 1), F.col("choice").try_cast("int")).otherwise(0))
    met = told.hint("shuffle_merge").join(pool.select("ask", "number", "record_id").hint("shuffle_merge"), ["ask", "number"], "left")
    return _decided(met, keys, least)


def _said(answers: DataFrame, keys: list[str]) -> DataFrame:
    return answers.select(*keys, "noul", F.col("choice"), F.col("confidence").alias("_c"))


def _decided(met: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Decisions of candidates (keys, record_id, via, number, size) with what was said of their key."""
    sure, lone = F.col("via") != "asked", F.col("size") == 1
    score = I.score_of(F.col("noul"), F.col("_c"))
    taken = F.when(sure, True).when(lone, score >= least).otherwise(F.coalesce(F.col("record_id").isNotNull() & (F.col("choice").try_cast("int") == F.col("number")), F.lit(False)))
    confidence = F.when(sure, 1.0).when(lone, score).otherwise(F.coalesce("_c", F.lit(0.0)))
    how = F.when(sure, F.col("via")).when(lone, "lone").otherwise("choice")
    got = met.groupBy(*keys).agg(F.max(F.when(taken, F.struct("record_id", confidence.alias("confidence"), how.alias("how")))).alias("x"), F.max(F.when(lone & ~sure, score)).alias("low"))
    return got.select(*keys, F.coalesce("x.how", F.lit("refused")).alias("outcome"), "x.record_id", F.coalesce("x.confidence", "low", F.lit(0.0)).alias("confidence"))
