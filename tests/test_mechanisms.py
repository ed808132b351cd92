"""Chunks that fail alone, stored answers, streams with restarts, file loaders, tolerant decoding, links, large documents, chained passes."""

import gzip
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evigraph.constants import CLAIM_CATEGORIES
from evigraph.functions import asks, text
from evigraph.operators import asking, claims, identity, merge, stages
from evigraph.plans.resolve import match, resolve
from evigraph.sources import graph_json, matrices
from evigraph.sources.workspace import Work
from evigraph.streaming import claims as streams

RAW = "graph_id string, subject string, predicate string, object string, confidence double, jev_question_id string, source string, endpoint string, summary string, payload string, seq long"


def test_a_chunk_that_fails_keeps_the_others(spark):
    items = claims.chunked(spark.range(120).select(F.lit("g").alias("graph_id"), F.col("id").alias("item")), ["graph_id"], ["item"])

    def judge(frame):
        if frame["item"].min() == 50:
            raise KeyError("too long")
        return pd.DataFrame({"item": frame["item"][1:], "noul": 0.5})

    got = asking.judged_chunks(items, judge, ["graph_id", "chunk"], ["item"], "noul double").collect()
    assert len(got) == 120
    assert {r.item for r in got if r.error} == set(range(50, 100)) and all(r.noul is None and r.error == "KeyError: 'too long'" for r in got if r.error)
    assert {r.item for r in got if r.noul is None and r.error is None} == {0, 100}
    outcomes = asking.chunk_outcomes(asking.judged_chunks(items, judge, ["graph_id", "chunk"], ["item"], "noul double").withColumn("answered", F.col("noul").isNotNull()), ["graph_id", "chunk"])
    assert sorted((r.chunk, r.n_items, r.n_answered) for r in outcomes.collect()) == [(0, 50, 49), (1, 50, 0), (2, 20, 19)]
    assert asking.judged_chunks(items.limit(0), judge, ["graph_id", "chunk"], ["item"], "noul double").count() == 0


def test_failed_chunks_are_asked_again_and_only_they(spark, tmp_path):
    items = spark.range(90).select((F.col("id") % 3).alias("chunk"), F.col("id").alias("item"))
    folder = str(tmp_path)

    def judge(frame):
        import os

        chunk = int(frame["chunk"].iloc[0])
        at = f"{folder}/{chunk}-{len([x for x in os.listdir(folder) if x.startswith(f'{chunk}-')])}"
        open(at, "w").close()
        if chunk == 2 or (chunk == 1 and at.endswith("-0")):
            raise RuntimeError("busy")
        return pd.DataFrame({"item": frame["item"], "noul": 1.0})

    got = asking.judged_with_retries(items, judge, ["chunk"], ["item"], "noul double", Work(spark), rounds=3).collect()
    assert len(got) == 90 and {(r.chunk, r.round, r.error) for r in got} == {(0, 0, None), (1, 1, None), (2, 2, "RuntimeError: busy")}
    import os

    assert sorted(x for x in os.listdir(folder)) == ["0-0", "1-0", "1-1", "2-0", "2-1", "2-2"]


def test_stored_answers_are_not_asked_for_again(spark):
    asks_ = spark.range(30).select("id", claims.ask_key((F.col("id") % 10).alias("body")).alias("ask_key"), (F.col("id") % 10).alias("body"))
    store, seen = asking.AnswerStore(Work(spark), "noul double"), []

    def judge(new):
        seen.append(new.count())
        return new.withColumns({"noul": F.col("body") / 10, "error": F.when(F.col("body") == 9, "failed")})

    assert store.missing(asks_).count() == 10
    first = store.ask(asks_.filter("body < 4"), judge, "a").collect()
    assert seen == [4] and len(first) == 12
    store.ask(asks_, judge, "b")
    store.ask(asks_, judge, "c")
    assert seen == [4, 6, 1]  # only the one that failed is asked again
    store.ask(asks_.filter("body < 4"), judge, "a")  # the run again: it replaces its own answers
    assert seen[-1] == 4 and store.known().count() == 9
    got = {r.id: (r.noul, r.run) for r in store.ask(asks_, judge, "d").collect()}
    assert got[3] == (0.3, "a") and got[14] == (0.4, "b") and got[29] == (None, None)


def claim_rows(n):
    rng = random.Random(7)
    return [(f"g{rng.randrange(2)}", f"s{rng.randrange(3)}", "p", f"o{rng.randrange(3)}", rng.randrange(5) / 4, rng.choice(["", "q1", "q2"]), f"src{rng.randrange(2)}", "e", f"t{rng.randrange(4)}", "{}", i) for i in range(n)]


def table_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_streams_of_claims_evidence_and_nodes_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(claim_rows(90), RAW).coalesce(1)
    sightings = rows.select("graph_id", F.col("subject").alias("id"), F.lit("Gene").alias("type"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("l"), "seq")).alias("label"), F.lit("").alias("id_namespace"), F.create_map(F.lit("a"), F.when(F.col("seq") % 2 == 0, F.col("summary")), F.lit("b"), F.lit("x")).alias("attrs"), "seq")
    for k in range(3):
        for name, df in (("claims", rows), ("nodes", sightings)):
            df.filter(f"seq between {30 * k} and {30 * k + 29}").write.mode("append").parquet(str(tmp_path / "in" / name))
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / name))
            keep = streams.maintain_claims if name == "claims" else streams.maintain_nodes
            keep(stream, str(tmp_path / name), str(tmp_path / f"cp-{name}"), 4).awaitTermination()
    read = lambda where: spark.read.parquet(str(tmp_path / where)).drop("bucket")
    nodes, attrs = merge.merge_nodes(sightings)
    for where, want in (("claims/claims", merge.merge_claims(rows)), ("claims/evidence", merge.merge_evidence(rows)), ("nodes/nodes", nodes), ("nodes/attrs", attrs)):
        assert table_of(read(where)) == table_of(want), where


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_a_batch_that_broke_off_runs_again(spark, tmp_path, mode):
    rows = spark.createDataFrame(claim_rows(60), RAW)
    raw, merged = str(tmp_path / "raw"), {"claims": str(tmp_path / "c"), "evidence": str(tmp_path / "e")}
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)  # a session's own setting changes nothing
    try:
        broken = {"on": True}

        def breaks(known):
            tables = streams.merged_claims_and_evidence(known)
            return {"claims": tables["claims"], "evidence": tables["evidence"].withColumn("n", F.raise_error(F.lit("lost")).cast("long"))} if broken["on"] else tables

        streams.update(rows.filter("seq < 30"), 0, merge.TRIPLE, streams.merged_claims_and_evidence, raw, merged, 4)
        wider = rows.filter("seq >= 30").unionByName(rows.filter("seq = 3").withColumns({"graph_id": F.lit("elsewhere"), "seq": F.lit(99).cast("long")}))
        with pytest.raises(Exception, match="lost"):
            streams.update(wider, 1, merge.TRIPLE, breaks, raw, merged, 4)
        broken["on"] = False
        streams.update(rows.filter("seq >= 30"), 1, merge.TRIPLE, breaks, raw, merged, 4)  # other rows than before: nothing of the first attempt stays among the raw rows
        assert spark.read.parquet(raw).count() == 60
        streams.update(rows.filter("seq >= 30"), 1, merge.TRIPLE, breaks, raw, merged, 4)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    got = spark.read.parquet(merged["claims"]).drop("bucket").filter("graph_id <> 'elsewhere'")
    assert table_of(got) == table_of(merge.merge_claims(rows))
    assert table_of(spark.read.parquet(merged["evidence"]).drop("bucket").filter("graph_id <> 'elsewhere'")) == table_of(merge.merge_evidence(rows))


def test_lines_are_numbered_through_the_parts_of_a_file(spark, tmp_path):
    lines = {f"f{n}.txt": [f"{n} line {k} " + "x" * (k % 50) for k in range(2_000 + n)] for n in range(3)}
    for name, content in lines.items():
        (tmp_path / name).write_text("\n".join(content) + "\n")
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(b"a\n\nc"))
    lines["z.txt.gz"] = ["a", "", "c"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        got = matrices.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in got) == sorted((f, k, x) for f, content in lines.items() for k, x in enumerate(content))


def test_matrix_files(spark, tmp_path):
    soft = "^DATASET = GDS1\n!subset_description = control\n!subset_sample_id = GSM1, GSM3\n!subset_description = heat\n!subset_sample_id = GSM2,GSM1\n!dataset_table_begin\nID_REF\tIDENTIFIER\tGSM1\tGSM2\tGSM3\tother\n1\tAbc\t1\t2\tnull\t7\n2\tabc \t2\t5\t \t7\n3\tabcd\t9\t9\t9\t9\n!dataset_table_end\n4\tabc\t99\t99\t99\t9\n"
    (tmp_path / "GDS1.soft.gz").write_bytes(gzip.compress(soft.encode()))
    (tmp_path / "GDS2.soft").write_text("!dataset_table_begin\nID_REF\tname\tGSM7\n1\tabc\t4\n")
    got = sorted((r.dataset, r.sample, r.value, r.percentile) for r in matrices.load_soft(spark, str(tmp_path / "*soft*"), "ABC").collect())
    assert got == [("GDS1", "control", 1.5, 0.0), ("GDS1", "heat", 3.5, 100.0), ("GDS2", "GSM7", 4.0, None)]
    (tmp_path / "E-1.tsv").write_text("Gene ID\tGene Name\tg1\tg2\nENS0\tabcd\t1\t1\nENS1\tABC\t1,3\tx\nENS2\tabc\t8\t8\nshort\tabc\n")
    labels = spark.createDataFrame([("E-1", "g1", "root")], "dataset string, column string, label string")
    assert [tuple(r) for r in matrices.load_baseline(spark, str(tmp_path / "E-1.tsv"), "abc", labels).collect()] == [("E-1", "root", 2.0, None)]
    assert [r.sample for r in matrices.load_baseline(spark, str(tmp_path / "E-1.tsv"), "ens2").orderBy("sample").collect()] == ["g1", "g2"]
    (tmp_path / "E-2.tsv.gz").write_bytes(gzip.compress(b"Gene ID\tGene Name\tc.1.log2foldchange\tc.1.p-value\td.log2foldchange\td.p-value\ne.p\nENS1\tABC\t-1.5\tNA\tNA\t0.1\nENS1\tabc\t7\t7\t7\t7\n"))
    assert [tuple(r) for r in matrices.load_contrasts(spark, str(tmp_path / "E-2.tsv.gz"), "abc").collect()] == [("E-2", "c.1", -1.5, None)]
    assert matrices.load_contrasts(spark, str(tmp_path / "E-2.tsv.gz"), "nothing").count() == 0


def first_list(content, key="proposals"):
    decoder = json.JSONDecoder()
    for at in [i for i, c in enumerate(content or "") if c == "{"]:
        try:
            found, _ = decoder.raw_decode(content, at)
        except json.JSONDecodeError:
            continue
        for name in [key] if isinstance(found.get(key), list) else [k for k in found if k.startswith(key[:6])]:
            if isinstance(found[name], list):
                return found[name]
    return None


def test_lists_are_decoded_from_every_brace(spark):
    cases = ['{"proposals":[{"claim":"a","citations":[1]}]}', '```json\n{"note":"x [1] {","proposals":[{"claim":"b}"}]}\n``` {"x":1}', '{"{"proposals": [{"claim":"c"}]}', '{"a":1} then {"b":[1], "proposals":[2]}', '{"propososals":[{"claim":"d"}],"x":{"y":1}}', '{"x":{"proposals":[7]}}', "no", "", None, '{"proposals":"no list"} {"proposals":[]}', '{"propo":[1]} {"proposition":[5]}', "{'proposals':[1]}", '{"proposals":[1,2}', '[{"proposals":[3]}]', '{"a":"}{","propositals":[{"claim":"q"}]} tail ]}', '{"proposals":null,"proposed":[9]}', '{"a": {"b": "\\"{"}, "proposals": [4]} {"proposals":[5]}', '{"proposals":[1]} {"later":[{"proposals":[2]}]}']
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string").withColumn("o", text.outer_proposals(F.col("c"))).collect()
    for r in rows:
        got = json.JSONDecoder().raw_decode(r.o)[0]["proposals"] if r.o is not None else None
        assert got == first_list(r.c), r.c


def test_links_by_id_taxon_and_judge(spark):
    records = spark.createDataFrame([(1, 9, ["A1"], ["w"]), (2, 9, ["A2"], ["w"]), (3, 8, ["A3"], ["w", "v"]), (4, 7, ["B", "A4"], ["x"]), (5, 7, ["b"], ["x"]), (6, 5, ["c"], [None])], "record_id long, tax_id long, ids array<string>, found_by array<string>")
    rows = spark.createDataFrame([("exact", "a1 ", 5), ("taxon", "W", 8), ("many", "w", 9), ("none", "w", 1), ("lone", "v", 1), ("low", "v", 2), ("both", "b", 7), ("text", "x", 7), ("gone", "q", 7), ("unasked", "w", 3), ("blank", " ", 3)], "k string, term string, tax_id long")
    answers = spark.createDataFrame([("many", None, "1", 0.7), ("none", None, "none", 0.9), ("lone", 0.5, None, None), ("low", 0.49, None, None), ("both", None, "0", 0.6), ("text", None, "7", 0.6), ("exact", 0.1, "none", 0.1)], "k string, noul double, choice string, confidence double")
    pool = identity.link_pool(stages.link_candidates(rows, records, ["k"]), ["k"])
    asked = {r.k: r.candidates for r in identity.link_asks(pool, ["k"]).collect()}
    assert asked == {"many": [1, 2], "none": [1, 2, 3], "lone": [3], "low": [3], "both": [4, 5], "text": [4, 5], "unasked": [1, 2, 3]}
    got = {r.k: (r.outcome, r.record_id, r.confidence) for r in identity.linked(pool, answers, ["k"]).collect()}
    assert got == {"exact": ("exact", 1, 1.0), "taxon": ("taxon", 3, 1.0), "many": ("choice", 2, 0.7), "none": ("refused", None, 0.0), "lone": ("lone", 3, 0.5), "low": ("refused", None, 0.49), "both": ("choice", 4, 0.6), "text": ("refused", None, 0.0), "unasked": ("refused", None, 0.0)}
    made = stages.link_claims(identity.linked(pool, answers, ["k"]).withColumns({"graph_id": F.lit("g"), "subject": F.col("k")})).collect()
    assert {(r.subject, r.object, r.jev_question_id) for r in made} == {("exact", "ncbigene:1", ""), ("taxon", "ncbigene:3", ""), ("many", "ncbigene:2", "gene_match"), ("lone", "ncbigene:3", "gene_match"), ("both", "ncbigene:4", "gene_match")}


def test_found_records_need_the_judge(spark):
    genes = spark.createDataFrame([(str(k), f"S{k}", None, "1", "o", None, ["al"] if k < 2 else []) for k in range(4)], "gene_id string, symbol string, locus_tag string, tax_id string, organism string, assembly_accession string, aliases array<string>")
    queries = spark.createDataFrame([("id", "s2"), ("alias", "AL"), ("low", "word"), ("high", "word"), ("several", "words"), ("none", "zip")], "graph_id string, query string")
    search = spark.createDataFrame([("id", "3", 0), ("low", "1", 0), ("high", "1", 0), ("several", "3", 0), ("several", "1", 1)], "graph_id string, gene_id string, pos int")
    answers = spark.createDataFrame([("low", None, 0.4, None), ("high", None, 0.6, None), ("several", None, None, "1"), ("alias", None, None, "1")], "graph_id string, namespace string, noul double, choice string")
    got = {r.graph_id: (r.outcome, r.record_id, r.confidence) for r in match(queries, genes, answers, search=search).collect()}
    assert got["id"] == ("resolved", "2", 1.0) and got["alias"][:2] == ("resolved", "1")
    assert got["low"][:2] == ("refused", None) and got["high"] == ("resolved", "1", 0.6) and got["several"][:2] == ("resolved", "1") and got["none"][0] == "refused"


def test_nodes_of_a_resolution_have_types_labels_and_attributes(spark):
    genes = spark.createDataFrame([("672", "BRCA2", None, "9606", "Homo sapiens", "GCF_1.1", ["FANCD1"])], "gene_id string, symbol string, locus_tag string, tax_id string, organism string, assembly_accession string, aliases array<string>")
    entries = spark.createDataFrame([("672", [("GO:1", "F:binding", "IEA")], ["hsa:672"], [("PF1", "dom", "pfam")])], "gene_id string, go array<struct<id:string,term:string,code:string>>, kegg array<string>, domains array<struct<id:string,name:string,source:string>>")
    pathways = spark.createDataFrame([("hsa:672", "hsa03440", "path:Repair - Homo sapiens")], "kegg string, pathway string, name string")
    queries = spark.createDataFrame([("a", "BRCA2", 4)], "graph_id string, query string, depth int")
    sources = {"genes": genes, "entries": entries, "pathways": pathways, "citations": spark.createDataFrame([("672", "11")], "gene_id string, pmid string"), "groups": spark.createDataFrame([("672", "OG6")], "gene_id string, grp string"), "members": spark.createDataFrame([("OG6", "pf|1", "P f", True, 0)], "grp string, member string, species string, core boolean, pos int")}
    nodes, edges, _ = resolve(queries, sources, spark.createDataFrame([], "graph_id string, namespace string, noul double, choice string"))
    got = {r.id: (r.type, r.label, r.id_namespace, r.attrs) for r in nodes.collect()}
    assert got["ncbigene:672"] == ("Gene", "BRCA2", "ncbi_gene", {"gene_id": "672", "organism": "Homo sapiens"})
    assert got["kegg:hsa:672"][0] == "Gene" and got["kegg:hsa03440"][:2] == ("Pathway", "Repair") and got["go:GO:1"] == ("GOTerm", "binding", "go", {"aspect": "function"})
    assert got["taxon:9606"][:2] == ("Organism", "Homo sapiens") and got["pubmed:11"][:2] == ("Publication", "PMID 11") and got["omclseq:pf|1"][0] == "Protein" and got["orthogroup:OG6"][0] == "OrthologGroup"
    ends = {r.id for r in merge.endpoints(edges).collect()}
    assert ends | {"BRCA2"} == set(got)
    weak, strong, _ = resolve(queries, sources, spark.createDataFrame([], "graph_id string, namespace string, noul double, choice string"))
    assert weak.count() == nodes.count() and strong.count() == edges.count()


def test_documents_larger_than_a_row(spark, tmp_path):
    nodes = {f"n:{k}": {"id": f"n:{k}", "type": "Gene", "label": 'tricky "}{][\\ é ' + str(k), "url": None, "attrs": {"deep": [{"a": "}"}]}} for k in range(3_000)}
    edges = [{"subject": f"n:{k}", "predicate": "p", "object": f"n:{k + 1}", "confidence": k / 4000, "evidence": [{"payload": {"nodes": [{"x": "{"}]}}]} for k in range(2_999)]
    (tmp_path / "one.json").write_text(json.dumps({"metadata": {"nodes": {"not": {"this": 1}}}, "note": 'nodes "[{', "nodes": nodes, "edges": edges}))
    (tmp_path / "two.json").write_text(json.dumps({"edges": [], "nodes": list(nodes.values())[:5]}, indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = graph_json.read_large(spark, str(tmp_path / "*.json")).withColumn("graph_id", matrices.dataset_of(F.col("file"), r"([^/]+)\.json$")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    back, links = graph_json.from_lines(spark.createDataFrame([(r.graph_id, r.kind, r.value) for r in got], "graph_id string, kind string, value string"))
    assert {(r.graph_id, r.id, r.label) for r in back.collect()} == {("one", k, v["label"]) for k, v in nodes.items()} | {("two", f"n:{k}", nodes[f"n:{k}"]["label"]) for k in range(5)}
    assert {(r.subject, r.object, r.confidence) for r in links.collect()} == {(e["subject"], e["object"], e["confidence"]) for e in edges}


def test_a_reader_holds_one_element_at_a_time():
    reader, most, found = graph_json.ElementReader(), 0, 0
    body = "".join('{"id":"n%d","label":"%s"},' % (k, "x}" * 20) for k in range(20_000))
    whole = '{"nodes":[' + body[:-1] + '],"edges":[]}'
    for at in range(0, len(whole), 37):
        found += len(list(reader.feed(whole[at : at + 37])))
        most = max(most, sum(map(len, reader.held or [])))
    assert found == 20_000 and most < 200


def test_default_categories(spark):
    row = spark.range(1).select(asks.category(F.lit("n"), F.lit("claim"), F.lit("c")).alias("a")).first()
    assert [c.key for c in row.a.criteria] == [*CLAIM_CATEGORIES, "other"] and len(CLAIM_CATEGORIES) == 22


def test_runs_are_written_and_the_last_one_found(spark, tmp_path):
    from evigraph.sources import snapshots

    rows = [("case", "a", "resolved", True, "20260101-smoke"), ("config", None, None, None, "20260102-smoke"), ("case", "a", "refused", False, "20260102-smoke"), ("case", "b", "resolved", True, "smoke")]
    df = spark.createDataFrame(rows, "kind string, case string, outcome string, ok boolean, run string")
    snapshots.write_runs(df.filter("run <> 'smoke'"), str(tmp_path / "runs"))
    assert {(r.kind, r.outcome) for r in snapshots.load_run(spark, str(tmp_path / "runs"), "smoke").collect()} == {("config", None), ("case", "refused")}
    snapshots.write_runs(df.filter("run = 'smoke'"), str(tmp_path / "runs"))
    assert [r.case for r in snapshots.load_run(spark, str(tmp_path / "runs"), "smoke").collect()] == ["b"]
    assert snapshots.load_run(spark, str(tmp_path / "runs"), "nothing").count() == 0
    cases = spark.createDataFrame([("1", "t1", "x"), ("2", "t1", "y"), ("y", "t2", "z")], "id string, tier string, name string")
    assert {r.name for r in snapshots.picked_cases(cases, "t1").collect()} == {"x", "y"} and {r.name for r in snapshots.picked_cases(cases, case="y").collect()} == {"y", "z"}
    diffs = spark.createDataFrame([("s1", "q", 0.5), ("s2", "q", 0.1)], "stage string, qid string, delta double")
    snapshots.write_diffs(diffs, str(tmp_path / "diffs"))
    assert {(r.stage, r.delta) for r in spark.read.json(str(tmp_path / "diffs")).collect()} == {("s1", 0.5), ("s2", 0.1)}


def test_relatives_hang_from_the_own_entry(spark):
    rows = spark.createDataFrame([("g", "q", "ncbigene:1", "Id1"), ("h", "q", "ncbigene:2", "none"), ("i", "q", "ncbigene:3", None)], "graph_id string, query string, anchor string, used string")
    entries = spark.createDataFrame([("ID1", 9, "B", None, "s", "1"), ("id1", 5, "A", "canon", "s", "1"), ("id1", 1, None, "x", "s", "1")], "id string, entry_nr long, omaid string, canonical_id string, species string, tax_id string")
    got = stages.with_own_entry(rows, entries)
    assert {(r.graph_id, r.subject, r.label) for r in got.collect()} == {("g", "oma:A", "canon"), ("h", "ncbigene:2", None), ("i", "ncbigene:3", None)}
    assert [tuple(r) for r in stages.own_entry_claims(got).collect()] == [("g", "q", "same_as", "oma:A")]
