"""Steps whose cost grew faster than the tables."""

import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F


from evigraph.llm import packing
from evigraph.operators import merge, stages
from evigraph.plans import graph_queries, mechanism_queries
from evigraph.plans.resolve import resolve
from evigraph.sources import matrices

from test_round4 import SHUFFLED, _most_rows


def test_bundles_hold_many_data_sets_in_few_files(spark, tmp_path):
    lines = spark.range(2000).selectExpr("concat('d', id % 500) as dataset", "id as line_no", "concat(id, '\t', id % 7) as line")
    odd = spark.createDataFrame([("odd", -5, "a\tb\r\nc"), ("odd", 3, None), ("odd", 2, " x\ty ")], "dataset string, line_no long, line string")
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        matrices.write_bundles(lines.unionByName(odd), path, compression)
        back = matrices.bundled_lines(spark, path)
        assert back.select(F.input_file_name().alias("f")).distinct().count() <= 8
        assert [r.line for r in back.filter("dataset = 'd7'").orderBy("line_no").collect()] == [f"{n}\t{n % 7}" for n in (7, 507, 1007, 1507)]
        assert [tuple(r) for r in back.filter("dataset = 'odd'").orderBy("line_no").collect()] == [("odd", 0, "a\tb"), ("odd", 1, "c"), ("odd", 2, " x\ty "), ("odd", 3, "")]


def test_loaders_read_few_files(spark):
    for name in ("loaded_soft", "loaded_baseline", "loaded_contrasts"):
        made = mechanism_queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        assert len(made.inputFiles()) <= 8, name
        assert made.count() == 200, name


def test_fan_out_takes_repeats_out_before_they_are_claims(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, gene string")
    one = spark.createDataFrame([(1, 7), (2, 7), (2, None), (3, 8)], "k int, x int")
    many = spark.createDataFrame([(1, [1.5, 1.5]), (2, [1.5]), (3, None)], "k int, y array<double>")
    made = stages.fan_out(rows, "k", "gene", [(one, "x", "p", "n"), (many, "y", "q", "m")])
    assert sorted(tuple(r) for r in made.collect()) == [("a", "p", "n:7"), ("a", "q", "m:1.5"), ("b", "p", "n:8")]
    again = stages.fan_out(rows, "k", "gene", [(one, "x", "p", "n"), (one.withColumnRenamed("x", "z"), "z", "p", "n")])
    assert sorted(tuple(r) for r in again.collect()) == [("a", "p", "n:7"), ("b", "p", "n:8")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    narrow = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(narrow) == 2 and all(re.search(r"Aggregate \[gene#\d+, _value#\d+\]", line) for line in narrow)


def test_sightings_are_shuffled_once(spark):
    plan = graph_queries.node_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sightings_of_any_attributes(spark):
    rows = [("g", "x", "t", "", "n", {"a": 1, "b": None}, 1), ("g", "x", "u", "l", "", None, 2), ("g", "x", "u", "m", "o", {"a": 3}, 3), ("g", "x", "u", None, None, {"a": None, "c": 5}, 4)]
    nodes, attrs = merge.merge_nodes(spark.createDataFrame(rows, "graph_id string, id string, type string, label string, id_namespace string, attrs map<string,int>, seq int"))
    assert [tuple(r) for r in nodes.select("label", "id_namespace", "type").collect()] == [("l", "n", "t")]
    assert sorted((r.key, r.value) for r in attrs.collect()) == [("a", 3), ("b", None), ("c", 5)]


def _asked_of_one_taxon(spark, graphs, accessions):
    genes = spark.range(graphs).selectExpr("cast(id as string) gene_id", "concat('S', id) symbol", "concat('L', id) locus_tag", "'5' tax_id", "'o' organism", "'GCF_1.1' assembly_accession", "array(concat('n', id)) aliases")
    queries = spark.range(graphs).selectExpr("concat('r', id) graph_id", "concat('S', id) query", "2 depth")
    answers = queries.selectExpr("graph_id", "'gene_symbol' namespace", "1.0D noul", "'0' choice")
    return queries, {"genes": genes, "assemblies": spark.createDataFrame([(x, "5") for x in accessions], "accession string, tax_id string")}, answers


def test_related_assemblies_come_as_often_as_they_are_listed(spark):
    queries, sources, answers = _asked_of_one_taxon(spark, 3, ["GCF_1.1", "GCF_1.3", "GCF_1.3", "GCA_1.2", "GCF_7.9", None])
    again = queries.filter("graph_id = 'r2'")  # a graph with two records of one meaning
    for asked, times in ((queries, 1), (queries.unionByName(again), 2)):
        nodes, edges, _ = resolve(asked, sources, answers)
        got = sorted(tuple(r) for r in edges.filter("object like 'assembly:%' and predicate <> 'in_assembly'").select("graph_id", "predicate", "object", "n_raw", F.size("evidence")).collect())
        want = []
        for g in range(3):
            n = times if g == 2 else 1
            want += [(f"r{g}", "related_assembly", "assembly:GCA_1.2", n, 1), (f"r{g}", "related_assembly", "assembly:GCF_1.3", 2 * n, 1), (f"r{g}", "related_assembly", "assembly:GCF_7.9", n, 1)]
            want += [(f"r{g}", "superseded_by", "assembly:GCA_1.2", n, 1), (f"r{g}", "superseded_by", "assembly:GCF_1.3", 2 * n, 1)]
        assert got == sorted(want)
        assert sorted(r.id for r in nodes.filter("graph_id = 'r2' and type = 'Assembly'").collect()) == [f"assembly:{x}" for x in ("GCA_1.2", "GCF_1.1", "GCF_1.3", "GCF_7.9")]


def test_related_assemblies_are_not_shuffled(spark):
    queries, sources, answers = _asked_of_one_taxon(spark, 200, [f"GCF_{n}.1" for n in range(2, 302)])
    edges = resolve(queries, sources, answers)[1].drop("evidence")
    assert len(edges.collect()) == 200 * 305
    assert _most_rows(edges, SHUFFLED) <= 5000


def test_packing_remembers_as_little_as_told():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([f"w{n}x y{n % 50}" for n in range(4000)], pa.large_string())
    want = packing.token_ids(texts, path, 2)
    for a in range(0, 4000, 500):
        got = packing.token_ids(texts.slice(a, 500), path, 2, 20_000)
        assert (got[0] == want[0][want[1][a] : want[1][a + 500]]).all()
    assert packing._bytes_of[path] < 200_000
