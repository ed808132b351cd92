"""The claim core: merging repeated claims, nodes and evidence; checks of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ("graph_id", "subject", "predicate", "object")


def merge_claims(raw: DataFrame, evidence: str | None = None) -> DataFrame:
    """One row per (graph_id, subject, predicate, object) of raw claims with confidence, jev_question_id and seq.

    The first row that reaches the highest confidence wins; its question id
    stays, and if that is blank the first one after it fills in. Window and
    aggregate share one shuffle on the triple. n_raw counts the repeats. With the
    name of an evidence column the distinct ones of all rows are kept as an array
    under that name, in order of seq: they share the shuffle.
    """
    w = Window.partitionBy(*TRIPLE)
    best = F.max(F.struct(F.col("confidence").alias("c"), (-F.col("seq")).alias("s"), F.col("jev_question_id").alias("q"))).over(w)
    marked = raw.withColumn("best", best)
    fill = F.when((F.col("jev_question_id") != "") & (F.col("seq") > -F.col("best.s")), F.struct("seq", "jev_question_id"))
    merged = marked.groupBy(*TRIPLE).agg(F.max("confidence").alias("confidence"), F.max("best.q").alias("own"), F.min(fill).alias("fill"), F.count("*").alias("n_raw"), *([F.array_sort(F.collect_set(F.struct("seq", evidence))).alias("_told")] if evidence else []))
    told = [F.array_distinct(F.transform("_told", lambda x: x[evidence])).alias(evidence)] if evidence else []
    return merged.select(*TRIPLE, "confidence", F.coalesce(F.nullif("own", F.lit("")), "fill.jev_question_id", F.lit("")).alias("jev_question_id"), "n_raw", *told)


def merge_evidence(raw: DataFrame) -> DataFrame:
    """Distinct evidence (source, endpoint, summary, payload) of every claim with its first place, n."""
    key = [*TRIPLE, "source", "endpoint", "summary", "payload"]
    first = raw.groupBy(*key).agg(F.min("seq").alias("seq"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(*TRIPLE).orderBy("seq", "source")).cast("long"))


def merge_sightings(raw: DataFrame) -> DataFrame:
    """(graph_id, id, key, label, id_namespace, type, value) of repeated sightings (graph_id, id, type, label, id_namespace, attrs map, seq): a row with a null key for each node, one more for each of its attributes.

    Label and namespace: the first that isn't empty; type: the first. Of each
    attribute the last value that isn't null stays; names seen only as null keep null.
    Sightings are dealt by node as they are, once: aggregates over structs sort
    their rows, which tasks over large files would have to spill before a shuffle.
    What follows on (graph_id, id) needs no other one.
    """
    kinds = raw.schema["attrs"].dataType
    itself = F.array(F.struct(F.lit(None).cast(kinds.keyType).alias("key"), F.lit(None).cast(kinds.valueType).alias("value")))
    rows = raw.repartition("graph_id", "id").select("graph_id", "id", "seq", "type", "label", "id_namespace", F.inline(F.concat(itself, F.map_entries(F.coalesce("attrs", F.create_map().cast(kinds))))))
    node = F.col("key").isNull()
    filled = lambda c: F.min(F.when(node & (F.coalesce(c, F.lit("")) != ""), F.struct(F.col("seq"), F.col(c).alias("v"))))["v"]
    told = lambda c: F.when(node, F.coalesce(c, F.lit("")))
    value = F.max(F.when(F.col("value").isNotNull(), F.struct("seq", "value")))["value"]
    return rows.groupBy("graph_id", "id", "key").agg(told(filled("label")).alias("label"), told(filled("id_namespace")).alias("id_namespace"), F.min_by("type", "seq").alias("type"), value.alias("value"))


def merge_nodes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, attrs) of repeated sightings, as tables of their own; see ``merge_sightings``."""
    both = merge_sightings(raw)
    return both.filter("key is null").select("graph_id", "id", "label", "id_namespace", "type"), both.filter("key is not null").select("graph_id", "id", "key", "value")


def node_columns() -> list:
    """Aggregates of ``merge_sightings`` by (graph_id, id): what a node itself has."""
    return [F.first(F.when(F.col("key").isNull(), F.col(c)), ignorenulls=True).alias(c) for c in ("label", "id_namespace", "type")]


def endpoints(edges: DataFrame) -> DataFrame:
    """(graph_id, id): subjects and objects of edges."""
    return edges.select("graph_id", F.col("subject").alias("id")).union(edges.select("graph_id", F.col("object").alias("id"))).distinct()


def confident_edges(edges: DataFrame, least: float) -> DataFrame:
    return edges if least <= 0 else edges.filter(F.col("confidence") >= least)


def confident_nodes(nodes: DataFrame, edges: DataFrame, queries: DataFrame, least: float, drop_isolated: bool = False) -> DataFrame:
    """Nodes that an edge of at least that confidence touches, and the queries (graph_id, id); all nodes for least <= 0."""
    if least <= 0 and not drop_isolated:
        return nodes
    touched = endpoints(confident_edges(edges, least)).union(queries.select("graph_id", "id")).distinct()
    return nodes.join(touched, ["graph_id", "id"], "left_semi")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): dangling ends, repeated triples, confidences outside 0..1, edges with neither evidence nor question."""
    dangling = endpoints(edges).join(nodes.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    repeated = edges.groupBy(*TRIPLE).count().filter("count > 1")
    flags = edges.select(F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("o"), F.count_if((F.coalesce("jev_question_id", F.lit("")) == "") & (F.coalesce("n_evidence", F.lit(0)) == 0)).alias("u"))
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    each = flags.select(F.explode(F.array(F.struct(F.lit("confidence_range").alias("check"), F.col("o").alias("n")), F.struct(F.lit("unsupported_edge").alias("check"), F.col("u").alias("n")))).alias("x")).select("x.*")
    return counted(dangling, "dangling_endpoint").unionByName(counted(repeated, "repeated_triple")).unionByName(each)
