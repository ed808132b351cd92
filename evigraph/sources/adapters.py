"""The star-schema tables as inputs of the model; each has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types stand for predicates.
PREDICATES = {"view": "has_go_term", "signup": "cited_in", "click": "ortholog_of", "purchase": "measured_in", "error": "described_in"}
USER_TYPES, KEY_TYPES = ("Gene", "Dataset", "Claim"), ("GOTerm", "Publication", "Organism", "Assembly", "Condition")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims from events, with one evidence each."""
    predicate = F.col("event_type")
    for name, p in PREDICATES.items():
        predicate = F.when(F.col("event_type") == name, F.lit(p)).otherwise(predicate)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("g"), F.pmod("user_id", F.lit(10))).alias("graph_id"),
        F.concat(F.lit("user:"), "user_id").alias("subject"),
        predicate.alias("predicate"),
        F.concat(F.lit("k:"), F.pmod(F.regexp_extract("props", "[0-9]+", 0).cast("long"), F.lit(5))).alias("object"),
        (F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))) / 100).alias("confidence"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("q"), F.pmod("event_id", F.lit(7)))).alias("jev_question_id"),
        F.concat(F.lit("src"), F.pmod("event_id", F.lit(4))).alias("source"),
        F.lit("events").alias("endpoint"),
        F.concat(F.lit("k="), F.pmod(F.regexp_extract("props", "[0-9]+", 0).cast("long"), F.lit(3))).alias("summary"),
        F.lit("{}").alias("payload"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("retrieved_at"),
    )


def node_type(node_id: Column) -> Column:
    n = F.regexp_extract(node_id, "[0-9]+", 0).cast("int")
    return F.when(node_id.startswith("user:"), F.element_at(F.array(*map(F.lit, USER_TYPES)), F.pmod(n, F.lit(3)) + 1)).otherwise(F.element_at(F.array(*map(F.lit, KEY_TYPES)), F.pmod(n, F.lit(5)) + 1))


def node_label(node_id: Column) -> Column:
    n = F.regexp_extract(node_id, "[0-9]+", 0).cast("int")
    return F.when(F.pmod(n, F.lit(4)) == 0, "").otherwise(F.concat(F.lit("Label "), F.upper(node_id)))


# The same adapters in DuckDB SQL.
RAW = """raw AS (SELECT 'g' || (user_id % 10) AS graph_id, 'user:' || user_id AS subject,
 CASE event_type WHEN 'view' THEN 'has_go_term' WHEN 'signup' THEN 'cited_in' WHEN 'click' THEN 'ortholog_of' WHEN 'purchase' THEN 'measured_in' WHEN 'error' THEN 'described_in' ELSE event_type END AS predicate,
 'k:' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 5) AS object,
 CAST(least(100, greatest(0, floor(value))) AS DOUBLE) / 100 AS confidence,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE 'q' || (event_id % 7) END AS jev_question_id,
 'src' || (event_id % 4) AS source, 'events' AS endpoint, 'k=' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 3) AS summary, '{}' AS payload, event_id AS seq, ts AS retrieved_at FROM events)"""
MERGED = RAW + """, won AS (SELECT *, first_value(seq) OVER w AS ws, first_value(jev_question_id) OVER w AS wq FROM raw WINDOW w AS (PARTITION BY graph_id, subject, predicate, object ORDER BY confidence DESC, seq)),
 edge AS (SELECT graph_id, subject, predicate, object, max(confidence) AS confidence, CASE WHEN max(wq) <> '' THEN max(wq) ELSE coalesce(arg_min(jev_question_id, seq) FILTER (WHERE jev_question_id <> '' AND seq > ws), '') END AS jev_question_id, count(*) AS n_raw FROM won GROUP BY ALL)"""
NODES = MERGED.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4") + """, ends AS (SELECT DISTINCT graph_id, id FROM (SELECT graph_id, subject AS id FROM edge UNION ALL SELECT graph_id, object FROM edge)),
 node AS (SELECT graph_id, id, CASE WHEN id LIKE 'user:%' THEN (['Gene', 'Dataset', 'Claim'])[CAST(regexp_extract(id, '[0-9]+') AS INT) % 3 + 1] ELSE (['GOTerm', 'Publication', 'Organism', 'Assembly', 'Condition'])[CAST(regexp_extract(id, '[0-9]+') AS INT) % 5 + 1] END AS type,
 CASE WHEN CAST(regexp_extract(id, '[0-9]+') AS INT) % 4 = 0 THEN '' ELSE 'Label ' || upper(id) END AS label FROM ends)"""
MERGED = MERGED.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4")
