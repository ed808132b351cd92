"""The claim core, identity, links and texts on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import ids as I
from evigraph.functions import text as T
from evigraph.functions.links import safe_link
from evigraph.operators import claims, graph, identity, merge, reports
from evigraph.sources import graph_json, snapshots

RAW = "graph_id string, subject string, predicate string, object string, confidence double, jev_question_id string, seq long"


def fold(rows):
    """The sequential definition: a strictly better claim wins, a blank question id fills from later rows."""
    out = {}
    for g, s, p, o, c, q, _ in sorted(rows, key=lambda r: r[-1]):
        k = (g, s, p, o)
        if k not in out:
            out[k] = [c, q]
        elif c > out[k][0]:
            out[k] = [c, q]
        elif not out[k][1]:
            out[k][1] = q
    return {k: tuple(v) for k, v in out.items()}


def test_claim_merge_equals_the_fold_however_rows_are_dealt(spark):
    rng = random.Random(3)
    rows = [("g", f"s{rng.randrange(3)}", "p", f"o{rng.randrange(4)}", rng.randrange(5) / 4, rng.choice(["", "", "q1", "q2"]), i) for i in range(400)]
    want = fold(rows)
    for n in (1, 5):
        got = merge.merge_claims(spark.createDataFrame(rows, RAW).repartition(n, F.rand(n))).collect()
        assert {(r.graph_id, r.subject, r.predicate, r.object): (r.confidence, r.jev_question_id) for r in got} == want
    assert merge.merge_claims(spark.createDataFrame([], RAW)).count() == 0


def test_evidence_and_nodes(spark):
    e = spark.createDataFrame([("g", "s", "p", "o", "a", "e", "x", "{}", 2), ("g", "s", "p", "o", "a", "e", "x", "{}", 1), ("g", "s", "p", "o", "b", "e", "x", "{}", 0)], "graph_id string, subject string, predicate string, object string, source string, endpoint string, summary string, payload string, seq long")
    assert [(r.source, r.seq, r.n) for r in merge.merge_evidence(e).orderBy("n").collect()] == [("b", 0, 1), ("a", 1, 2)]
    n = spark.createDataFrame([("g", "i", "Gene", "", "", {"a": "1", "b": None}, 1), ("g", "i", "Protein", "L", "ns", {"a": None, "c": "3"}, 2), ("g", "i", "Gene", "M", "", {"a": "9"}, 3)], "graph_id string, id string, type string, label string, id_namespace string, attrs map<string,string>, seq long")
    nodes, attrs = merge.merge_nodes(n)
    assert nodes.first().asDict() == {"graph_id": "g", "id": "i", "type": "Gene", "label": "L", "id_namespace": "ns"}
    assert {r.key: r.value for r in attrs.collect()} == {"a": "9", "b": None, "c": "3"}


def test_confidence_filter_keeps_isolated_nodes_at_zero(spark):
    nodes = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "q"), ("g", "alone")], "graph_id string, id string")
    edges = spark.createDataFrame([("g", "a", "p", "b", 0.4)], "graph_id string, subject string, predicate string, object string, confidence double")
    queries = spark.createDataFrame([("g", "q")], "graph_id string, id string")
    ids = lambda least: {r.id for r in merge.confident_nodes(nodes, edges, queries, least).collect()}
    assert ids(0) == {"a", "b", "q", "alone"} and ids(0.4) == {"a", "b", "q"} and ids(0.5) == {"q"}


@pytest.mark.parametrize(
    ("identifier", "hints"),
    [("672", ["ncbi_gene"]), ("PF3D7_0710100", ["veupathdb"]), ("Tb927.10.1230", ["veupathdb"]), ("ENSG00000139618", ["ensembl", "gene_symbol"]), ("P12345", ["uniprot", "gene_symbol"]), ("NM_000000", ["refseq", "veupathdb"]), ("someGene42", ["locus_tag"]), ("?", [])],
)
def test_namespaces(spark, identifier, hints):
    assert spark.createDataFrame([(identifier,)], "x string").select(I.namespace_hints(F.col("x"))).first()[0] == hints


def test_links(spark):
    good = ["https://example.org/a", "https://example.org:8443/a", "https://[2001:db8::1]/a"]
    bad = ["http://example.org", "javascript:alert(1)", "https://", "https://[broken", "https://a b/c", "https://h:99999/", "https://h%20x/", "//example.org", "ftp://h/", "https:/x", "", None]
    rows = spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", safe_link("u").alias("v")).collect()
    assert [r.v for r in rows] == good + [None] * len(bad)


def test_species(spark):
    pairs = [("P. falciparum", "Plasmodium falciparum 3D7", True), ("Pseudomonas fluorescens", "Proteus fluorescens", False), ("Homo sapiens", "homo  sapiens x", True), ("", "Homo sapiens", False), (None, None, False), ("Homo", "Homo", True)]
    rows = spark.createDataFrame([(a, b, w) for a, b, w in pairs], "a string, b string, w boolean").select("w", I.same_species(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.g for r in rows] == [r.w for r in rows]


def test_sentences_quotes_and_citations(spark):
    text = "P. falciparum grows. It binds e.g. haem! Next one\nLast? 9 lives."
    row = spark.createDataFrame([(text, '[3,[1,"2"],99,"x",1]')], "t string, c string").select(T.sentences(F.col("t")).alias("u"), T.citations(F.col("c"), F.size(T.sentences(F.col("t")))).alias("c"), T.quote(T.sentences(F.col("t")), F.array(F.lit(3), F.lit(0), F.lit(1), F.lit(1))).alias("q")).first()
    assert row.u == ["P. falciparum grows.", "It binds e.g. haem!", "Next one", "Last?", "9 lives."]
    assert row.c == [2, 0, 1, 0]
    assert row.q == "P. falciparum grows. It binds e.g. haem! … Last?"


def test_answers(spark):
    raws = ['{"answer":"a","cited_nodes":["n"]}', 'Here: {"answer":"b"} ok', '{"answer":"{\\"answer\\":\\"c\\",\\"cited_nodes\\":[\\"m\\"]}"}', "just prose", "{broken"]
    got = [tuple(r.a) for r in spark.createDataFrame([(r,) for r in raws], "r string").select(T.answer(F.col("r")).alias("a")).collect()]
    assert got == [("a", ["n"]), ("b", []), ("c", ["m"]), ("just prose", []), ("{broken", [])]


def test_picks(spark):
    c = spark.createDataFrame([("a", 1, 10, True), ("a", 2, 11, False), ("b", 1, 12, False), ("c", 1, 13, False), ("c", 2, 14, False), ("d", 1, 15, False), ("d", 2, 16, False)], "graph_id string, pos long, record_id long, exact boolean")
    answers = spark.createDataFrame([("b", 0.4, None), ("c", 0.9, "1"), ("d", 0.9, "none")], "graph_id string, noul double, choice string")
    got = {r.graph_id: (r.outcome, r.record_id) for r in identity.pick_candidate(c, answers).collect()}
    assert got == {"a": ("resolved", 10), "b": ("refused", None), "c": ("resolved", 14), "d": ("refused", None)}


def test_supersession_ignores_the_prefix(spark):
    a = spark.createDataFrame([("GCA_1.1",), ("GCF_1.2",), ("GCF_2.1",), ("junk",), (None,)], "accession string")
    assert [tuple(r) for r in identity.superseded(a).collect()] == [("GCA_1.1", "GCF_1.2")]


def test_values(spark):
    rows = spark.createDataFrame([("d", "s1", "1"), ("d", "s1", "2"), ("d", "s2", "x"), ("d", "s3", "9")], "d string, s string, value string")
    got = claims.percentiles(claims.sample_means(rows, ["d", "s"]), ["d"], ["s"]).orderBy("s").collect()
    assert [(r.s, r.value, r.percentile) for r in got] == [("s1", 1.5, 0.0), ("s3", 9.0, 100.0)]
    many = spark.range(70).select(F.lit("d").alias("d"), F.col("id").alias("sample"), F.col("id").cast("double").alias("value"), F.lit(None).cast("double").alias("percentile"), F.lit(None).cast("double").alias("p_value"), F.col("id").alias("pos"))
    text = claims.rows_text(many, ["d"]).first().text.split("\n")
    assert text[0] == "sample | value" and text[1] == "69 | 69.0" and text[-1] == "... 10 more rows" and len(text) == 62


def test_caps_and_chunks(spark):
    rows = spark.range(310).select(F.lit("g").alias("g"), F.col("id"), (F.col("id") >= 270).alias("other"))
    kept = identity.capped_if_many(rows, ["g"], [F.col("other"), F.col("id")])
    assert kept.count() == 250 and kept.filter("other").count() == 0
    chunks = claims.chunked(kept, ["g"], ["id"]).agg(F.count_distinct("chunk"), F.max("local")).first()
    assert tuple(chunks) == (5, 49)


def test_mock_judge_rejects_unknown_types(spark):
    asks = spark.createDataFrame([("choice", ["x", "y"]), ("score", ["l0", "l1", "l2", "l3"]), ("noul", None)], "qtype string, criteria array<string>")
    got = claims.mock_answers(asks).collect()
    assert (got[0].choice, got[1].score, got[2].noul) == ("x", 1.5, 0.5)
    with pytest.raises(Exception, match="unknown question type"):
        claims.mock_answers(spark.createDataFrame([("odd", None)], "qtype string, criteria array<string>")).collect()


def test_judge_hook(spark):
    def fn(batches):
        for b in batches:
            yield b.assign(noul=0.25)[["qid", "noul"]]

    asks = spark.createDataFrame([("a",), ("b",)], "qid string")
    assert {r.noul for r in claims.judge(asks, fn, "qid string, noul double").collect()} == {0.25}


def test_graph_json_both_shapes(spark):
    nodes = spark.createDataFrame([("g", "a", "Gene", "A")], "graph_id string, id string, type string, label string")
    edges = spark.createDataFrame([("g", "a", "p", "b", 0.5)], "graph_id string, subject string, predicate string, object string, confidence double")
    docs = graph_json.to_documents(nodes, edges)
    assert graph_json.parse_edges(docs).first().confidence == 0.5 and graph_json.parse_nodes(docs).first().id == "a"
    listed = spark.createDataFrame([("g", '{"nodes":[{"id":"z","type":"Gene"}],"edges":[]}')], "graph_id string, document string")
    assert graph_json.parse_nodes(listed).first().id == "z"


def test_slice_keeps_query_and_ends(spark):
    nodes = spark.createDataFrame([("g", "q", "Gene", ""), ("g", "t", "GOTerm", ""), ("g", "x", "Publication", "")], "graph_id string, id string, type string, label string")
    edges = spark.createDataFrame([("g", "q", "has_go_term", "t", 1.0), ("g", "q", "cited_in", "x", 1.0)], "graph_id string, subject string, predicate string, object string, confidence double")
    asked = spark.createDataFrame([("g", "1", "function")], "graph_id string, question_id string, category string")
    n, e = graph.slice_graphs(nodes, edges, asked, spark.createDataFrame([("g", "q")], "graph_id string, id string"))
    assert {r.id for r in n.collect()} == {"q", "t"} and [r.predicate for r in e.collect()] == ["has_go_term"]


def test_latency_is_nearest_rank(spark):
    calls = spark.createDataFrame([("s", float(i), i) for i in range(10)], "stage string, ms double, ask_id long")
    row = reports.latency(calls).filter("stage = 's'").first()
    assert (row.p50, row.p90, row.longest) == (5.0, 9.0, 9.0)


def test_sources(spark, tmp_path):
    xml = tmp_path / "p.xml"
    xml.write_text("<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A <i>b</i> c</ArticleTitle><Abstract><AbstractText>x</AbstractText><AbstractText>y</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2001 Jan</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Smith</LastName><Initials>J</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle></S>")
    row = snapshots.load_publications(spark, str(xml)).first()
    assert (row.title, row.abstract, row.year, row.authors) == ("A b c", "x y", "2001 Jan", ["Smith J"])
    lines = ["^DATABASE", "!dataset_table_begin", "ID_REF\tIDENTIFIER\tGSM1\tGSM2", "p1\tABC\t1\t5", "p2\tabc\t3\tnull", "p3\tXYZ\t9\t9", "!dataset_table_end"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "dataset string, line_no int, line string")
    assert sorted((r.sample, r.value, r.percentile) for r in snapshots.soft_values(df, "Abc").collect()) == [("GSM1", 2.0, 0.0), ("GSM2", 5.0, 100.0)]
    words = tmp_path / "v.txt"
    words.write_text("# c\n\nalpha\n beta \n")
    assert {r.category for r in snapshots.load_vocabulary(spark, str(words)).collect()} == {"alpha", "beta"}
    assert {r.category for r in snapshots.vocabulary(spark, "a, b,,a ").collect()} == {"a", "b"}
    protein = '{"primaryAccession":"P1","entryType":"UniProtKB reviewed (Swiss-Prot)","uniProtKBCrossReferences":[{"database":"GO","id":"GO:1","properties":[{"key":"GoTerm","value":"F:binding"},{"key":"GoEvidenceType","value":"IDA:UniProtKB"}]},{"database":"KEGG","id":"hsa:1","properties":[]}]}'
    (tmp_path / "p.json").write_text(protein)
    row = snapshots.proteins(snapshots.read_json(spark, str(tmp_path / "p.json"), snapshots.PROTEIN)).first()
    assert row.reviewed and row.kegg == ["hsa:1"] and tuple(row.go_terms[0]) == ("GO:1", "binding", "function", "IDA")


def test_resolve_invariants(spark):
    from evigraph.plans.resolve import resolve

    genes = spark.createDataFrame([("672", "BRCA2", None, "9606", "Homo sapiens", "GCF_1.1", ["FANCD1", None])], "gene_id string, symbol string, locus_tag string, tax_id string, organism string, assembly_accession string, aliases array<string>")
    queries = spark.createDataFrame([("a", "brca2", 6), ("b", "nothing", 6), ("c", "FANCD1", 0)], "graph_id string, query string, depth int")
    answers = spark.createDataFrame([], "graph_id string, namespace string, noul double, choice string")
    sources = {"genes": genes, "assemblies": spark.createDataFrame([("GCF_1.2", "9606"), ("GCF_1.1", "9606")], "accession string, tax_id string")}
    nodes, edges, meta = resolve(queries, sources, answers)
    assert {r.graph_id: r.outcome for r in meta.collect()} == {"a": "resolved", "b": "refused", "c": "resolved"}
    got = {(r.graph_id, r.predicate) for r in edges.collect()}
    assert {("a", p) for p in ("is_a", "same_as", "has_alias", "in_organism", "in_assembly", "related_assembly", "superseded_by")} <= got
    assert {p for g, p in got if g in "bc"} == {"is_a"}
    report = {r["check"]: r.n for r in merge.integrity(nodes, edges.withColumn("n_evidence", F.lit(1))).collect()}
    assert set(report.values()) == {0}
    assert {r.predicate for r in edges.join(queries, "graph_id").filter("subject = query").collect()} <= {"is_a", "same_as"}


def test_stream_equals_batch(spark, tmp_path):
    from evigraph.streaming.claims import maintain

    rng = random.Random(5)
    rows = [("g", f"s{rng.randrange(3)}", "p", f"o{rng.randrange(3)}", rng.randrange(5) / 4, rng.choice(["", "q1", "q2"]), i) for i in range(60)]
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], RAW).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(source))
        maintain(stream, str(tmp_path / "raw"), str(tmp_path / "merged"), str(tmp_path / "cp"), 4).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "merged")).collect()
    assert {(r.graph_id, r.subject, r.predicate, r.object): (r.confidence, r.jev_question_id) for r in got} == fold(rows)
