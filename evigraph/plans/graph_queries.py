"""Queries of the claim core, slices and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, merge, stages
from ..operators import reports
from ..sources.adapters import MERGED, NODES, RAW, node_label, node_type, raw_edges, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_claims(raw_edges(spark, sf_dir))


def _nodes(edges: DataFrame) -> DataFrame:
    return graph.nodes_of(edges, node_type(F.col("id")), node_label(F.col("id")))


def _queries(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.min("subject").alias("id"))


@query(f"WITH {MERGED} SELECT * FROM edge")
def claim_merge(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {RAW}, f AS (SELECT graph_id, subject, predicate, object, source, endpoint, summary, payload, min(seq) AS seq FROM raw GROUP BY 1, 2, 3, 4, 5, 6, 7, 8) SELECT *, row_number() OVER (PARTITION BY graph_id, subject, predicate, object ORDER BY seq, source) AS n FROM f")
def claim_evidence_union(spark, sf_dir):
    return merge.merge_evidence(raw_edges(spark, sf_dir))


_SIGHTINGS = """sight AS (SELECT 'g' || (l_suppkey % 10) AS graph_id, 'part:' || l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag || l_linestatus END AS label, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE '' END AS id_namespace, l_linestatus AS type,
 CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS a, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS b,
 {seq} AS seq FROM lineitem)"""
_SEQ_SQL = "(l_orderkey, l_linenumber, l_shipdate, l_suppkey, l_extendedprice, l_quantity, l_tax)"


def _sightings(spark, sf_dir):
    one = F.lit(1)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("g"), F.pmod("l_suppkey", F.lit(10))).alias("graph_id"),
        F.concat(F.lit("part:"), "l_partkey").alias("id"),
        F.when(F.pmod("l_linenumber", F.lit(2)) == 0, "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("label"),
        F.when(F.pmod("l_linenumber", F.lit(3)) == 0, F.col("l_linestatus")).otherwise("").alias("id_namespace"),
        F.col("l_linestatus").alias("type"),
        F.create_map(F.lit("flag"), F.when(F.pmod("l_orderkey", F.lit(3)) != 0, F.col("l_returnflag")), F.lit("line"), F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.col("l_linenumber").cast("string"))).alias("attrs"),
        F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax").alias("seq"),
    ).filter(one == 1)


@query(
    f"""WITH {_SIGHTINGS.format(seq=_SEQ_SQL)}
 SELECT graph_id, id, coalesce(arg_min(label, seq) FILTER (WHERE label <> ''), '') AS label, coalesce(arg_min(id_namespace, seq) FILTER (WHERE id_namespace <> ''), '') AS id_namespace, arg_min(type, seq) AS type,
 arg_max(a, seq) FILTER (WHERE a IS NOT NULL) AS flag, arg_max(b, seq) FILTER (WHERE b IS NOT NULL) AS line FROM sight GROUP BY 1, 2"""
)
def node_merge(spark, sf_dir):
    values = [F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in ("flag", "line")]
    return merge.merge_sightings(_sightings(spark, sf_dir)).groupBy("graph_id", "id").agg(*merge.node_columns(), *values)


@query(f"WITH {MERGED} SELECT * FROM edge WHERE confidence >= 0.7")
def confidence_subgraph_edges(spark, sf_dir):
    return merge.confident_edges(_edges(spark, sf_dir), 0.7)


@query(f"""WITH {NODES}, q AS (SELECT graph_id, min(subject) AS id FROM edge GROUP BY 1), t AS (SELECT graph_id, subject AS id FROM edge WHERE confidence >= 0.99 UNION SELECT graph_id, object FROM edge WHERE confidence >= 0.99 UNION SELECT * FROM q)
 SELECT n.* FROM node n SEMI JOIN t USING (graph_id, id)""")
def confidence_subgraph_nodes(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return merge.confident_nodes(_nodes(edges), edges, _queries(edges), 0.99)


@query("""WITH e AS (SELECT 'g' || (user_id % 10) AS graph_id, 'user:' || user_id AS subject, event_type AS predicate, 'k:' || event_type AS object, value / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'q' END AS q, event_id % 2 AS ev FROM events),
 n AS (SELECT 'g' || (c_custkey % 10) AS graph_id, 'user:' || c_custkey AS id FROM customer), ends AS (SELECT graph_id, subject AS id FROM e UNION SELECT graph_id, object FROM e)
 SELECT 'dangling_endpoint' AS "check", count(*) AS n FROM ends ANTI JOIN n USING (graph_id, id) UNION ALL SELECT 'repeated_triple', count(*) FROM (SELECT 1 FROM e GROUP BY graph_id, subject, predicate, object HAVING count(*) > 1)
 UNION ALL SELECT 'confidence_range', count(*) FILTER (WHERE confidence < 0 OR confidence > 1) FROM e UNION ALL SELECT 'unsupported_edge', count(*) FILTER (WHERE q = '' AND ev = 0) FROM e""")
def integrity_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("g"), F.pmod("user_id", F.lit(10))).alias("graph_id"), F.concat(F.lit("user:"), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("k:"), "event_type").alias("object"),
        (F.col("value") / 100).alias("confidence"), F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise("q").alias("jev_question_id"), F.pmod("event_id", F.lit(2)).alias("n_evidence"),
    )
    n = table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), F.pmod("c_custkey", F.lit(10))).alias("graph_id"), F.concat(F.lit("user:"), "c_custkey").alias("id"))
    return merge.integrity(n, e)


@query(f"""WITH {NODES}, named AS (SELECT e.*, coalesce(nullif(s.label, ''), subject) AS sl, coalesce(nullif(o.label, ''), object) AS ol FROM edge e JOIN node s ON s.graph_id = e.graph_id AND s.id = subject JOIN node o ON o.graph_id = e.graph_id AND o.id = object),
 r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, predicate ORDER BY confidence DESC, subject, object) AS n, count(*) OVER (PARTITION BY graph_id, predicate) AS total FROM named),
 b AS (SELECT graph_id, predicate, '[' || predicate || ']' || chr(10) || string_agg('  ' || sl || ' -' || predicate || '-> ' || ol || ' (' || printf('%.2f', confidence) || ')', chr(10) ORDER BY n) || CASE WHEN max(total) > 80 THEN chr(10) || '  ... ' || (max(total) - 80) || ' more' ELSE '' END AS t FROM r WHERE n <= 80 GROUP BY 1, 2)
 SELECT graph_id, string_agg(t, chr(10) ORDER BY predicate) AS text FROM b GROUP BY 1""")
def graph_text(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    # two decimals of the decimal text: both engines then round alike
    return graph.graph_text(edges, _nodes(edges))


_ASKED = "asked AS (SELECT g AS graph_id, 'a' AS question_id, c AS category FROM (SELECT DISTINCT graph_id AS g FROM edge), (VALUES ('function'), ('literature')) t(c) UNION ALL SELECT DISTINCT graph_id, 'b', 'orthology' FROM edge)"
_SLICE = f"""WITH {NODES}, {_ASKED}, dim AS (SELECT 'function' AS category, ['has_go_term', 'has_domain', 'in_pathway'] AS p, ['GOTerm', 'Domain', 'Pathway'] AS t UNION ALL SELECT 'literature', ['cited_in'], ['Publication']
 UNION ALL SELECT 'orthology', ['ortholog_of', 'in_orthogroup', 'has_member', 'absent_in', 'ortholog_present', 'likely_present', 'has_candidate_gene'], ['OrthologGroup', 'Gene', 'Organism']),
 pr AS (SELECT DISTINCT graph_id, question_id, unnest(p) AS predicate FROM asked JOIN dim USING (category)), ty AS (SELECT DISTINCT graph_id, question_id, unnest(t) AS type FROM asked JOIN dim USING (category)),
 pe AS (SELECT question_id, e.* FROM edge e JOIN pr USING (graph_id, predicate)),
 kept AS (SELECT graph_id, question_id, subject AS id FROM pe UNION SELECT graph_id, question_id, object FROM pe UNION SELECT graph_id, question_id, id FROM node JOIN ty USING (graph_id, type) UNION SELECT graph_id, question_id, id FROM (SELECT DISTINCT graph_id, question_id FROM asked) JOIN (SELECT graph_id, min(subject) AS id FROM edge GROUP BY 1) USING (graph_id)),
 ins AS (SELECT q.question_id, e.* FROM edge e JOIN (SELECT DISTINCT graph_id, question_id FROM asked) q USING (graph_id) LEFT JOIN pr ON pr.graph_id = e.graph_id AND pr.question_id = q.question_id AND pr.predicate = e.predicate
  LEFT JOIN kept a ON a.graph_id = e.graph_id AND a.question_id = q.question_id AND a.id = subject LEFT JOIN kept b ON b.graph_id = e.graph_id AND b.question_id = q.question_id AND b.id = object WHERE pr.predicate IS NOT NULL OR (a.id IS NOT NULL AND b.id IS NOT NULL))"""


def _asked(edges):
    graphs = edges.select("graph_id").distinct()
    cats = F.explode(F.array(*(F.struct(F.lit(q).alias("question_id"), F.lit(c).alias("category")) for q, c in (("a", "function"), ("a", "literature"), ("b", "orthology")))))
    return graphs.select("graph_id", cats.alias("x")).select("graph_id", "x.*")


@query(_SLICE + """ SELECT graph_id, question_id, subject, predicate, object, confidence, edges_total FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, question_id ORDER BY confidence DESC, subject, predicate, object) AS n FROM
 (SELECT graph_id, question_id, subject, predicate, object, round(confidence, 3) AS confidence, count(*) OVER (PARTITION BY graph_id, question_id) AS edges_total FROM ins)) WHERE n <= 300""")
def slice_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    _, inside = graph.slice_graphs(_nodes(edges), edges, _asked(edges), _queries(edges))
    return graph.projection(inside.select("graph_id", "question_id", "subject", "predicate", "object", "confidence"), ["graph_id", "question_id"])


@query(_SLICE + " SELECT graph_id, question_id, id, type, label FROM kept JOIN node USING (graph_id, id)")
def slice_nodes(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.slice_graphs(_nodes(edges), edges, _asked(edges), _queries(edges))[0]


@query(f"WITH {MERGED} SELECT graph_id, subject, predicate, object, confidence, edges_total FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY confidence DESC, subject, predicate, object) AS n FROM (SELECT graph_id, subject, predicate, object, round(confidence, 3) AS confidence, count(*) OVER (PARTITION BY graph_id) AS edges_total FROM edge)) WHERE n <= 300")
def compact_edges(spark, sf_dir):
    return graph.projection(_edges(spark, sf_dir).select("graph_id", "subject", "predicate", "object", "confidence"), ["graph_id"])


@query(f"WITH {NODES}, c AS (SELECT graph_id, min(subject) AS centre FROM edge GROUP BY 1), a AS (SELECT e.*, centre FROM edge e JOIN c ON c.graph_id = e.graph_id AND centre IN (subject, object)), near AS (SELECT graph_id, centre, subject AS id FROM a UNION SELECT graph_id, centre, object FROM a) SELECT n.*, centre, (SELECT count(*) FROM a WHERE a.graph_id = n.graph_id) AS n_edges FROM node n JOIN near USING (graph_id, id)")
def ego_network(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    near, around = graph.ego(_nodes(edges), edges, _queries(edges).withColumnRenamed("id", "centre"))
    return stages.merge_join(near, around.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")


_ORDER_SQL = "list_position(['IdType', 'Gene', 'Organism', 'Assembly', 'OrthologGroup', 'Transcript', 'Protein', 'Domain', 'GOTerm', 'Pathway', 'Dataset', 'Condition', 'Publication'], type)"


@query(f"WITH {NODES} SELECT type, count(*) AS n, row_number() OVER (ORDER BY coalesce(nullif({_ORDER_SQL}, 0), 1000), type) AS place FROM node GROUP BY type")
def type_counts(spark, sf_dir):
    return graph.type_counts(_nodes(_edges(spark, sf_dir)))


@query(f"WITH {MERGED} SELECT predicate, n, place, CASE WHEN place <= 3 THEN predicate ELSE 'other' END AS colour FROM (SELECT predicate, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, predicate) AS place FROM edge GROUP BY 1)")
def predicate_rank(spark, sf_dir):
    return graph.predicate_rank(_edges(spark, sf_dir), own=3)


@query(f"WITH {NODES}, c AS (SELECT type, predicate, count(*) AS n FROM edge JOIN node ON node.graph_id = edge.graph_id AND id = subject GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY type ORDER BY n DESC, predicate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def stacked_counts(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.stacked_counts(_nodes(edges), edges)


@query(f"WITH {MERGED}, i AS (SELECT graph_id, subject AS id, predicate FROM edge UNION ALL SELECT graph_id, object, predicate FROM edge), c AS (SELECT graph_id, id, predicate, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT *, CAST(sum(n) OVER (PARTITION BY graph_id, id) AS BIGINT) AS degree FROM c")
def incident_rollup(spark, sf_dir):
    return graph.incident_counts(_edges(spark, sf_dir))


@query(f"""WITH {NODES}, l AS (SELECT e.graph_id, least(s.type, o.type) AS group_a, greatest(s.type, o.type) AS group_b, count(*) AS n, round(sum(confidence), 4) / count(*) AS mean_confidence, list(predicate) AS ps FROM edge e JOIN node s ON s.graph_id = e.graph_id AND s.id = subject JOIN node o ON o.graph_id = e.graph_id AND o.id = object WHERE s.type <> o.type GROUP BY 1, 2, 3),
 m AS (SELECT *, row_number() OVER (PARTITION BY graph_id, type ORDER BY id) AS k FROM node), c AS (SELECT graph_id, type, count(*) AS size, coalesce(string_agg(label, ',' ORDER BY k) FILTER (WHERE k <= 5), '') AS labels FROM m GROUP BY 1, 2)
 SELECT l.graph_id, group_a, group_b, n, mean_confidence, array_to_string(list_transform(list_sort(list_distinct(ps)), lambda p: p || ':' || len(list_filter(ps, lambda x: x = p))), ',') AS predicates, c.size AS size_a, c.labels AS labels_a, group_a || ':' || c.size AS types_a FROM l JOIN c ON c.graph_id = l.graph_id AND c.type = group_a""")
def group_rollup(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    nodes = _nodes(edges)
    groups = nodes.select("graph_id", "id", F.col("type").alias("grp"))
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    inside = graph.group_contents(nodes, groups).select("graph_id", F.col("grp").alias("group_a"), F.col("size").alias("size_a"), F.col("labels").alias("labels_a"), shown("types").alias("types_a"))
    return graph.group_links(edges, groups).withColumn("predicates", shown("predicates")).hint("shuffle_merge").join(inside.hint("shuffle_merge"), ["graph_id", "group_a"])


@query("""SELECT 'g' || (c_custkey % 10) AS graph_id, 'cust:' || c_custkey AS id, c_mktsegment AS type, CASE WHEN c_custkey % 4 = 0 THEN 'cust:' || c_custkey ELSE c_name END AS label,
 CASE WHEN c_custkey % 3 = 0 THEN 'https://example.org/c/' || c_custkey END AS url, CASE WHEN c_custkey % 5 = 0 THEN 'r' || c_custkey WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE CAST(c_custkey AS VARCHAR) END AS resolve_id FROM customer""")
def node_rows(spark, sf_dir):
    k = F.col("c_custkey")
    urls = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("https://example.org/c/"), k)).when(F.pmod(k, F.lit(3)) == 1, F.concat(F.lit("http://example.org/c/"), k)).otherwise("https://bad host/x")
    nodes = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("g"), F.pmod(k, F.lit(10))).alias("graph_id"), F.concat(F.lit("cust:"), k).alias("id"), F.col("c_mktsegment").alias("type"), F.when(F.pmod(k, F.lit(4)) == 0, "").otherwise(F.col("c_name")).alias("label"), urls.alias("url"),
        F.map_filter(F.create_map(F.lit("resolve_id"), F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("r"), k)), F.lit("gene_id"), F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("n"), "c_nationkey"))), lambda _, v: v.isNotNull()).alias("attrs"),
    )
    return graph.node_rows(nodes)


@query(f"WITH {NODES} SELECT e.graph_id, subject, predicate, object, confidence, jev_question_id, n_raw, coalesce(nullif(s.label, ''), subject) AS subject_label, coalesce(nullif(o.label, ''), object) AS object_label FROM edge e JOIN node s ON s.graph_id = e.graph_id AND s.id = subject JOIN node o ON o.graph_id = e.graph_id AND o.id = object")
def edge_rows(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.edge_rows(edges, _nodes(edges))


@query(f"WITH {MERGED}, f AS (SELECT graph_id, subject, predicate, object, confidence FROM edge WHERE contains(lower(subject), 'user:1') OR contains(lower(predicate), 'user:1') OR contains(lower(object), 'user:1')) SELECT f.*, (SELECT count(*) FROM f) AS total FROM f ORDER BY confidence DESC, graph_id, subject, predicate, object LIMIT 500")
def row_filter_top(spark, sf_dir):
    edges = _edges(spark, sf_dir).select("graph_id", "subject", "predicate", "object", "confidence")
    return graph.matching_rows(edges, "USER:1", ["subject", "predicate", "object"], [F.desc("confidence"), "graph_id", "subject", "predicate", "object"])


@query("""WITH r AS (SELECT event_type AS stage, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens_in, CAST(sum(event_id % 100) AS BIGINT) AS tokens_out, count(*) FILTER (WHERE round(value) = round(value * 1.001)) AS reproduced FROM events GROUP BY ROLLUP (event_type)) SELECT coalesce(stage, 'all') AS stage, calls, tokens_in, tokens_out, reproduced FROM r""")
def usage_rollup(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("input_tokens"), F.pmod("event_id", F.lit(100)).alias("output_tokens"), F.round("value").alias("before"), F.round(F.col("value") * 1.001).alias("after"))
    return reports.usage(calls)


@query("SELECT user_id, event_id, event_type AS stage, round(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 2) AS elapsed FROM events")
def stage_elapsed(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))
    return reports.elapsed(marks, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "stage", "elapsed")


@query(f"""WITH {NODES}, g AS (SELECT graph_id, count(*) AS n_edges, list_sort(list(DISTINCT predicate)) AS ps FROM edge GROUP BY 1), n AS (SELECT graph_id, count(*) AS n_nodes, count(*) FILTER (WHERE type = 'Gene') AS genes FROM node GROUP BY 1)
 SELECT graph_id, array_to_string(ps, ',') AS predicates, n_nodes, n_edges, n_nodes >= 18 AS enough_nodes, array_to_string(list_filter(['ortholog_of', 'in_pathway', 'has_go_term'], lambda x: NOT list_contains(ps, x)), ',') AS missing, genes > 0 AS anchored FROM g JOIN n USING (graph_id)""")
def eval_assertions(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return reports.assertions(_nodes(edges), edges, least_nodes=18, required=["ortholog_of", "in_pathway", "has_go_term"], anchor_type="Gene")


@query("""WITH s AS (SELECT event_type AS stage, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', list_sort(list(value)), count(*) FROM events)
 SELECT stage, n, v[CAST(floor(n * 0.5) AS INT) + 1] AS p50, v[CAST(floor(n * 0.9) AS INT) + 1] AS p90, v[n] AS longest FROM s""")
def latency_quantiles(spark, sf_dir):
    return reports.latency(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("event_id").alias("ask_id")))


@query(f"WITH {MERGED} SELECT graph_id, subject, predicate, object, confidence FROM edge")
def graph_json_roundtrip(spark, sf_dir):
    from ..sources import graph_json

    edges = _edges(spark, sf_dir)
    _, back = graph_json.from_lines(graph_json.to_lines(_nodes(edges), edges))
    return back


@query(f"WITH {RAW}, s AS (SELECT object, subject, graph_id, min(seq) AS seq FROM raw WHERE predicate = 'ortholog_of' GROUP BY 1, 2, 3), f AS (SELECT *, arg_min(subject, seq) OVER (PARTITION BY graph_id, object) AS first FROM s) SELECT graph_id, first AS subject, subject AS object, object AS shared FROM f WHERE subject <> first")
def shared_targets(spark, sf_dir):
    raw = raw_edges(spark, sf_dir).filter("predicate = 'ortholog_of'").groupBy("graph_id", "subject", "object").agg(F.min("seq").alias("seq"))
    return stages.shared_targets(raw).select("graph_id", F.col("first").alias("subject"), F.col("other").alias("object"), F.col("object").alias("shared"))
