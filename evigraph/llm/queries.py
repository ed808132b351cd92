"""The operators' queries, applied to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import similar_lines

    found = similar_lines(_table(spark, sf_dir, "documents"), k=1)
    return found.withColumn("removed", F.array_join("removed", ","))


def op2_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans_tree import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken_words

    return taken_words(_table(spark, sf_dir, "documents"))


def op4_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import digests, pack_powers

    return digests(pack_powers(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_net import held_out, score_documents, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, span_text

    found = find_secrets(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op10_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .norm_topk import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"), components=32)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents"), plant=True, texts=False).drop("runs", "collapsed")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression_bands import fit_limits, quality_rules

    docs = _table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_limits(docs, _table(spark, sf_dir, "labels")))


QUERIES = {q.__name__: q for q in (op1_ngram_jaccard_join, op2_kmeans_tree_search, op3_source_mixing, op4_power_packing, op5_line_dedup, op6_url_rules, op7_quality_net, op8_chained_passages, op9_secret_scan, op10_norm_topk, op11_embedding_whitening, op12_periodic_runs, op13_quality_rules)}

_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+')"

_OP1 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
entries AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM entries GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM entries x JOIN entries y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, coalesce(k.n, 0) AS n_links
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON d.doc_id = r.a
LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON d.doc_id = k.a
"""

_OP5 = f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
lines AS (SELECT doc_id AS d, unnest(range(0, len(t))) AS l, unnest(t) AS line FROM texts),
sets AS (SELECT d, l, list_sort(list_distinct({_WORDS.format("line")})) AS w FROM lines),
classes AS (SELECT w, len(w) AS n, row_number() OVER (ORDER BY w) AS c FROM (SELECT DISTINCT w FROM sets WHERE len(w) > 0)),
tokens AS (SELECT c, n, unnest(w) AS x FROM classes),
rarity AS (SELECT x, row_number() OVER (ORDER BY count(*), x) AS rare FROM tokens GROUP BY x),
ranked AS (SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY rare) AS k FROM tokens JOIN rarity USING (x)),
heads AS (SELECT c, n, x FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM heads a JOIN heads b ON a.x = b.x AND a.c <> b.c WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
alike AS (SELECT p.a, p.b FROM (SELECT a, b, x.n AS n, y.n AS m, len(list_intersect(x.w, y.w)) AS o FROM pairs JOIN classes x ON a = x.c JOIN classes y ON b = y.c) p
  WHERE o * 100 >= (n + m - o) * 80 UNION ALL SELECT c, c FROM classes),
placed AS (SELECT d, l, c FROM sets JOIN classes USING (w)),
firsts AS (SELECT c, min((d, l)) AS place FROM placed GROUP BY c),
earliest AS (SELECT a, min(place) AS place FROM alike JOIN firsts ON b = c GROUP BY a),
gone AS (SELECT d, l FROM placed JOIN earliest ON c = a WHERE place < (d, l))
SELECT s.d AS doc_id, count(*) AS n_lines, count(g.l) AS n_removed, coalesce(string_agg(g.l, ',' ORDER BY g.l), '') AS removed
FROM sets s LEFT JOIN gone g ON s.d = g.d AND s.l = g.l GROUP BY s.d
"""

_OP10 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

#: crc32 bit by bit, runs as maximal stretches of equal words q apart.
_OP12 = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
hashed AS (
  SELECT r, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) END AS h FROM texts),
turns AS (SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS turned, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM hashed),
placed AS (SELECT r, unnest(range(n)) AS i, n, w, turned, a, CASE WHEN turned THEN 1 + (n - a) // (3 + e) END AS p FROM turns),
words AS (SELECT r, i, n, CASE WHEN turned AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS x FROM placed),
equal AS (SELECT f.r, f.i, s.i - f.i AS q FROM words f JOIN words s ON f.r = s.r AND f.x = s.x AND s.i > f.i AND 3 * (s.i - f.i) <= f.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, sha256(string_agg(x, ' ' ORDER BY i)) AS sha FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
said AS (SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM runs GROUP BY r),
best AS (SELECT r, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
  coalesce(said.sha, sha256('')) AS runs_sha256, coalesce(kept.sha, sha256('')) AS collapsed_sha256
FROM texts t LEFT JOIN said USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept USING (r)
"""

#: DuckDB SQL of the queries that SQL can express: not of trained models, tokenizers, random draws or fuzzy alignment.
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op5_line_dedup": _OP5, "op10_norm_topk": _OP10, "op12_periodic_runs": _OP12}
