"""Joins on keys that many rows share: results as of all pairs, without making the pairs that aren't asked for."""

import pandas as pd
from pyspark.sql import functions as F

from evigraph.operators import asking, identity, stages
from evigraph.sources import snapshots

SHUFFLED = "shuffleRecordsWritten"


def _group_case(spark):
    members = [("g1", f"m{n:02}", ("s1", "s2", "s3", None)[n % 4], (True, False, None)[n % 3], n // 2) for n in range(40)]
    members += [("g2", f"x{n}", "s9", True, n) for n in range(2)]
    df = spark.createDataFrame(members, "grp string, member string, species string, core boolean, pos int")
    memberships = [(1, "a", "g1"), (2, "b", "g1"), (2, "b2", "g2"), (3, "c", "g1"), (3, "d", "g1"), (4, "e", "gx")]
    known = [(1, "s2"), (1, "s2"), (1, "none"), (2, "s1"), (2, "s2"), (2, "s3"), (3, "s3")]
    return members, memberships, known, df, spark.createDataFrame(memberships, "graph_id int, gene string, grp string"), spark.createDataFrame(known, "graph_id int, species string")


def test_groups_take_the_first_members_of_all(spark):
    members, memberships, known, df, asked, species = _group_case(spark)
    for most in (1, 3, 10, 25, 100):
        got = stages.group_claims(asked, df, species, most).filter("predicate = 'has_member'").collect()
        want = []
        for graph, grp in {(g, x) for g, _, x in memberships}:
            times = sum((g, x) == (graph, grp) for g, _, x in memberships)
            rows = [m for m in members if m[0] == grp for _ in range(times)]
            rows.sort(key=lambda m: (not (m[2] and (graph, m[2]) in known), not m[3], m[4], m[1]))
            want += [(graph, f"omclseq:{m[1]}", n + 1) for n, m in enumerate(rows[:most])]
        assert sorted((r.graph_id, r.object, r.place) for r in got) == sorted(want)


def test_groups_are_cut_before_they_meet_graphs(spark):
    members = spark.range(4000).selectExpr("'g' as grp", "cast(id as string) as member", "concat('s', id % 7) as species", "true as core", "id as pos")
    asked = spark.range(50).selectExpr("id as graph_id", "'x' as gene", "'g' as grp")
    known = spark.range(50).selectExpr("id as graph_id", "concat('s', id % 7) as species")
    made = stages.group_claims(asked, members, known, 10)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert _most_rows(made) <= 50 * 20 + 2 * 4000


def _most_rows(df, metric="numOutputRows"):
    """The most rows that any step of a finished plan put out, or by another metric, wrote to a shuffle."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        m = p.metrics().get(metric)
        if m.isDefined():
            most = max(most, m.get().value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_bridges_are_distinct_without_a_shuffle_of_pairs(spark):
    rows = [(1, "a", "n1"), (1, "a", "n1"), (1, "b", "n1"), (2, "a", None), (3, None, "n2")]
    records = [(7, "n1", ["x", "a", " ", "x", None], ["9", "9", None]), (7, "n1", ["x"], None), (8, "n1", ["b"], []), (9, None, ["z"], ["1"]), (8, "n2", ["c"], ["9"])]
    left, right = spark.createDataFrame(rows, "k int, own string, n string"), spark.createDataFrame(records, "r int, n string, aliases array<string>, pmids array<string>")
    want = set()
    for k, own, n in rows:
        for r, m, aliases, pmids in records:
            if n is not None and n == m:
                want |= {(k, r, "has_alias", a) for a in aliases if a and a.strip() and a != own}
                want |= {(k, r, "cited_in", f"pubmed:{p}") for p in pmids or [] if p}
    got = [tuple(x) for x in stages.bridge(left, right, "n", ["k", "r"], F.col("own"), "pmids").collect()]
    assert sorted(got) == sorted(want)
    made = stages.bridge(spark.range(300).selectExpr("id as k", "concat('n', id % 1) as n"), spark.range(200).selectExpr("id as r", "concat('n', id % 1) as n", "array(concat('a', id)) as aliases"), "n", ["k", "r"], F.lit("me"))
    assert len(made.collect()) == 60_000
    assert _most_rows(made, SHUFFLED) <= 200 * stages.SPREAD


def test_pathways_are_distinct_without_a_shuffle_of_pairs(spark):
    entries = spark.range(300).selectExpr("1 as graph_id", "concat('g', id) as gene", "cast(array() as array<struct<id:string,term:string,code:string>>) as go", "array('k', 'k', null) as kegg", "cast(array() as array<struct<id:string,name:string,source:string>>) as domains")
    pathways = spark.range(400).selectExpr("'k' as kegg", "concat('p', id % 200) as pathway", "concat('path:n', id % 200) as name")
    made = stages.annotation_claims(entries, pathways)
    got = made.groupBy("predicate").count().collect()
    assert {r["predicate"]: r["count"] for r in got} == {"in_pathway": 60_000, "same_as": 300}
    made.collect()
    assert _most_rows(made, SHUFFLED) <= 200 * stages.SPREAD


def test_exact_matches_are_distinct_without_a_shuffle_of_pairs(spark):
    queries = spark.createDataFrame([(1, " A "), (1, "b"), (2, "a"), (2, "A"), (3, ""), (4, None)], "graph_id int, query string")
    records = spark.createDataFrame([(7, ["a", "B", None]), (7, ["a"]), (8, ["b"])], "record_id int, ids array<string>")
    assert sorted(tuple(r) for r in identity.exact_matches(queries, records).collect()) == [(1, 7), (1, 8), (2, 7)]
    made = identity.exact_matches(spark.range(300).selectExpr("id as graph_id", "concat('q', id % 1) as query"), spark.range(200).selectExpr("id as record_id", "array(concat('Q', id % 1), 'x') as ids"))
    assert len(made.collect()) == 60_000
    assert _most_rows(made, SHUFFLED) <= 400 * stages.SPREAD


def test_searches_rank_hits_once_for_all_queries(spark):
    queries = spark.range(200).selectExpr("id as graph_id", "if(id % 2 = 0, 'Name', ' word') as query")
    hits = spark.range(400).selectExpr("lpad(id, 4, '0') as uid", "if(id % 2 = 0, 'name', 'other') as name", "'word and word' as description", "'Al, word' as otheraliases")
    made = snapshots.gene_search(queries, hits, 5)
    got = sorted((r.graph_id, r.uid, r.how, r.n) for r in made.collect())
    assert got == [(g, f"{2 * n if g % 2 == 0 else n:04}", g % 2, n + 1) for g in range(200) for n in range(5)]
    assert _most_rows(made) <= 5 * 400
    entries = spark.range(600).selectExpr("lpad(id, 4, '0') as accession", "'SYM' as gene_name", "concat('o', id % 2) as organism", "id % 3 = 0 as reviewed")
    made = snapshots.protein_search(spark.range(200).selectExpr("id as graph_id", "'sym' as symbol", "concat('o', id % 2) as organism"), entries, 3)
    assert made.columns == ["graph_id", "symbol", "organism", "accession", "gene_name", "reviewed", "n"]
    assert sorted((r.graph_id, r.accession, r.n) for r in made.collect()) == [(g, f"{6 * n + 3 * (g % 2):04}", n + 1) for g in range(200) for n in range(3)]
    assert _most_rows(made) <= 600


def test_links_that_ask_the_same_share_their_pool(spark):
    records = spark.range(60).selectExpr("id as record_id", "id % 3 as tax_id", "array(concat('ID', id), if(id < 40, concat('two', id % 20), null)) as ids", "array(concat('w', id % 4), if(id = 5, 'solo', 'many')) as found_by")
    terms = [f"{p}{n}" for p in ("id", "TWO", "w", "none") for n in range(6)] + [" Solo ", "many", "", None]
    rows = [(k, terms[k % len(terms)], k % 4 if k % 5 else None) for k in range(150)]
    rows += [(k, terms[(k * 7) % len(terms)], k % 3) for k in range(0, 60, 4)]
    rows = spark.createDataFrame(rows, "k int, term string, tax_id long")
    answers = spark.createDataFrame([(k, (k * 37 % 101) / 100, ("none", "0", "1", "7", None)[k % 5], 0.75) for k in range(0, 150) if k % 11], "k int, noul double, choice string, confidence double")
    alone = identity.linked(identity.link_pool(stages.link_candidates(rows, records, ["k"]), ["k"]), answers, ["k"])
    questions, asked = stages.link_questions(rows, ["k"])
    shared = identity.linked_by_ask(questions, identity.link_pool(stages.link_candidates(asked, records, ["ask"]), ["ask"]), answers, ["k"])
    want = sorted(map(tuple, alone.collect()))
    assert sorted(map(tuple, shared.collect())) == want
    assert {w[1] for w in want} == {"exact", "taxon", "lone", "choice", "refused"}
    assert _most_rows(shared) < _most_rows(alone)


def test_chunks_are_asked_alone_though_a_task_has_many(spark):
    rows = [(f"c{n // 7:03}" if n >= 14 else None, n % 7, f"b{n}") for n in range(700)]
    asks = spark.createDataFrame(rows, "c string, i int, body string")

    def judge(frame):
        assert list(frame.index) == list(range(len(frame))) and frame["c"].nunique(dropna=False) == 1
        name = frame["c"].iloc[0] or "none"
        if name.endswith("3"):
            raise RuntimeError(name)
        got = pd.DataFrame({"i": frame["i"], "noul": pd.Series([float(b[1:]) for b in frame["body"]])})
        return got.iloc[::-1].iloc[1:] if name.endswith("4") else got

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        made = asking.judged_chunks(asks, judge, ["c"], ["i"], "noul double")
        got = {(r.c, r.i, r.noul, r.error) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = {c: max(n for n, r in enumerate(rows) if r[0] == c) for c in {r[0] for r in rows}}
    fails, short = (lambda c: (c or "").endswith("3")), (lambda c: (c or "").endswith("4"))
    left_out = {(c, n) for c, n in last.items() if short(c)}
    err = {c for c, _, _, e in got if e}
    assert err == {c for c in last if fails(c)}
    nones = {c for c, _, v, e in got if v is None and not e}
    assert nones == {c for c, _ in left_out} and sum(v is None and not e for _, _, v, e in got) == len(left_out)
    assert all(v is None or f"b{int(v)}" in {b for c2, i2, b in rows if c2 == c and i2 == i} for c, i, v, _ in got)
    assert len(got) == 700
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()


def test_limits_are_fitted_on_all_labelled_documents(spark):
    from evigraph.llm import compression_bands

    docs = spark.range(21_000).selectExpr("id as doc_id", "concat('some words in a row that are of a length, number ', id + 100000) as text")
    labels = docs.selectExpr("doc_id", "1 as quality")
    limits = compression_bands.fit_limits(docs, labels)
    assert len(limits) == 1
    assert not hasattr(compression_bands, "hashed_sample")
    few = compression_bands.fit_limits(docs.limit(0), labels)
    assert few == compression_bands.DEFAULT_LIMITS
