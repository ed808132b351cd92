"""Queries of texts, asks, claims, values and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLAIM_MATCH_LEAST
from ..functions import asks as A
from ..functions import text as T
from ..operators import claims, reports
from ..sources.adapters import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _mod(c, n):
    return F.pmod(c, F.lit(n))


_ITEMS = """item AS (SELECT source AS graph_id, doc_id AS node, CASE WHEN lang = 'en' THEN 'publication' ELSE 'dataset' END AS kind, substr(lang || chr(10) || text, 1, 600) AS text FROM documents),
 asked AS (SELECT *, ((node * 37) % 101) / 100.0::DOUBLE AS best FROM item QUALIFY row_number() OVER (PARTITION BY graph_id, kind ORDER BY ((node * 37) % 101) / 100.0::DOUBLE DESC, node) <= 400)"""


@query(f"WITH {_ITEMS}, s AS (SELECT a.*, (quality * 2 + 1 - toxic) / 3.0::DOUBLE AS score FROM asked a JOIN labels ON doc_id = node) SELECT graph_id, node, kind, round(score, 6) AS score, row_number() OVER (PARTITION BY graph_id, kind ORDER BY score DESC, node) AS place FROM s WHERE score >= 0.5 QUALIFY place <= 100")
def triage_survivors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = claims.triage_items(docs.select(F.col("source").alias("graph_id"), F.col("doc_id").alias("node"), F.when(F.col("lang") == "en", "publication").otherwise("dataset").alias("kind"), F.col("lang").alias("label"), F.col("text").alias("body")))
    confidence = docs.select(F.col("doc_id").alias("node"), (_mod(F.col("doc_id") * 37, 101) / 100).alias("confidence"))
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("score"))
    out = claims.triage_survivors(claims.triage_asked(items, confidence), scores)
    return out.select("graph_id", "node", "kind", F.round("score", 6).alias("score"), "place")


@query("WITH n AS (SELECT source AS graph_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) SELECT graph_id, doc_id, n // 50 AS chunk, n % 50 AS local, CASE WHEN (n // 50) % 3 = 2 THEN NULL ELSE (doc_id * 37 % 101) / 100.0::DOUBLE END AS noul FROM n")
def ask_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("graph_id"), "doc_id")
    asks = claims.chunked(docs, ["graph_id"], ["doc_id"])
    answers = asks.filter(_mod(F.col("chunk"), 3) != 2).select("graph_id", "doc_id", (_mod(F.col("doc_id") * 37, 101) / 100).alias("noul"))
    return claims.with_answers(asks, answers, ["graph_id", "doc_id"])


_ASK_SQL = " UNION ALL ".join(f"SELECT '{k}' AS ask, '{q}' AS qtype, '{A.WORDING[k].split('{value}')[0]}' || chr(39) || v || chr(39) || '{A.WORDING[k].split('{value}')[1]}' AS instructions, v FROM val" for k, q in A.KINDS.items())


@query(f"WITH val AS (SELECT c_name AS v FROM customer UNION ALL SELECT 'doc ' || doc_id FROM documents), a AS ({_ASK_SQL}) SELECT ask, qtype, instructions, sha256('{{\"qtype\":\"' || qtype || '\",\"instructions\":\"' || instructions || '\"}}') AS ask_key FROM a")
def ask_templates(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.col("c_name").alias("v")).union(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id"))))
    each = F.array(*(F.struct(F.lit(k).alias("ask"), F.lit(q).alias("qtype"), A.instructions(k, F.col("v")).alias("instructions")) for k, q in A.KINDS.items()))
    asks = values.select(F.inline(each))
    return asks.withColumn("ask_key", claims.ask_key(F.col("qtype"), F.col("instructions")))


_UNITS = r"""marked AS (SELECT doc_id, regexp_replace(regexp_replace({text}, '([.!?])\s+([^\sa-z])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([^\sa-z])', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
 units AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[' || chr(1) || chr(10) || ']+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS u FROM marked)"""


@query(f"WITH {_UNITS.format(text='text')}, l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, len(u) AS n, sha256(array_to_string(list_transform(u, lambda x, i: '[' || i || '] ' || x), chr(10))) AS display, len(l) AS n_lines FROM units JOIN l USING (doc_id)")
def sentence_units(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("u"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"))
    return u.select("doc_id", F.size("u").cast("long").alias("n"), F.sha2(T.numbered(F.col("u")), 256).alias("display"), "n_lines")


@query(f"WITH {_UNITS.format(text='substr(text, 1, 8000)')} SELECT doc_id, CASE WHEN n_chars > 8000 AND NOT regexp_matches(u[-1], '[.!?]$') THEN len(u) - 1 ELSE len(u) END AS n, sha256(array_to_string(CASE WHEN n_chars > 8000 AND NOT regexp_matches(u[-1], '[.!?]$') THEN u[1:len(u) - 1] ELSE u END, '|')) AS joined FROM units JOIN (SELECT doc_id, length(text) AS n_chars FROM documents) USING (doc_id)")
def truncated_units(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text")).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("n"), F.sha2(F.array_join("u", "|"), 256).alias("joined"))


@query(f"WITH {_UNITS.format(text='text')}, c AS (SELECT doc_id, u, list_sort(list_distinct(list_filter([doc_id % 4, doc_id % 4 + 1, doc_id % 7 + 2, doc_id % 50], lambda i: i >= 0 AND i < len(u)))) AS c FROM units) SELECT doc_id, sha256(array_to_string(list_transform(c, lambda i, k: CASE WHEN k = 1 THEN '' WHEN c[greatest(k - 1, 1)] = i - 1 THEN ' ' ELSE ' … ' END || u[i + 1]), '')) AS quote, len(c) AS n FROM c WHERE len(c) > 0")
def verbatim_quotes(spark, sf_dir):
    k = F.col("doc_id")
    raw = F.concat_ws("", F.lit("[["), _mod(k, 4) + 1, F.lit(","), _mod(k, 4) + 2, F.lit("],"), _mod(k, 7) + 3, F.lit(',"x",'), _mod(k, 50) + 1, F.lit("]"))
    answer = F.concat(F.lit('{"proposals":[{"claim":" a  claim ","type":"odd","citations":'), raw, F.lit("},{\"claim\":\"  \",\"citations\":[1]}]}"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("u"), answer.alias("answer"))
    got = docs.select("doc_id", "u", F.explode(T.proposals(F.col("answer"), F.size("u"))).alias("p"))
    return got.select("doc_id", F.sha2(T.quote(F.col("u"), F.col("p.cited")), 256).alias("quote"), F.size(F.array_distinct("p.cited")).cast("long").alias("n"))


@query(r"""WITH c AS (SELECT conv_id, count(*) AS n, list(CASE WHEN turn % 9 = 8 THEN '' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END ORDER BY turn, role) AS l FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN len(list_filter(l, lambda x: trim(x) = '')) > 0 THEN NULL ELSE sha256(array_to_string(list_transform(l, lambda x: trim(x)), '|')) END AS labels FROM c""")
def label_normalize(spark, sf_dir):
    label = F.when(_mod(F.col("turn"), 9) == 8, "").otherwise(T.collapsed(F.col("text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", label.alias("x")))).alias("l"), F.count("*").alias("n"))
    raw = F.to_json(F.transform("l", lambda x: x["x"]))
    asked = F.when(_mod(F.col("conv_id"), 5) == 0, F.col("n") + 1).otherwise(F.col("n"))
    return c.select("conv_id", F.sha2(F.array_join(T.labels_or_none(raw, asked), "|"), 256).alias("labels"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'plain ' || event_type ELSE event_type END AS answer, CASE event_id % 4 WHEN 3 THEN '' ELSE 'k:' || event_id % 10 END AS cited, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100)) AS noul FROM events""")
def tolerant_json(spark, sf_dir):
    k, name = F.col("event_id"), F.col("event_type")
    body = F.to_json(F.struct(name.alias("answer"), F.array(F.concat(F.lit("k:"), _mod(k, 10))).alias("cited_nodes")))
    raw = F.when(_mod(k, 4) == 0, body).when(_mod(k, 4) == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(_mod(k, 4) == 2, F.to_json(F.struct(body.alias("answer")))).otherwise(F.concat(F.lit("plain "), name))
    rows = table(spark, sf_dir, "events").select("event_id", T.answer(raw).alias("a"), T.clamped((F.col("value") / 100).cast("string")).alias("noul"))
    return rows.select("event_id", F.col("a.answer").alias("answer"), F.array_join("a.cited_nodes", ",").alias("cited"), "noul")


@query("WITH m AS (SELECT l_partkey AS gene, l_suppkey AS sample, round(avg(l_quantity), 3) AS value FROM lineitem GROUP BY 1, 2) SELECT gene, sample, value, CASE WHEN count(*) OVER (PARTITION BY gene) > 1 THEN round(100.0::DOUBLE * (row_number() OVER (PARTITION BY gene ORDER BY value, sample) - 1) / nullif(count(*) OVER (PARTITION BY gene) - 1, 0), 1) END AS percentile FROM m")
def sample_percentile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("string").alias("value"))
    return claims.percentiles(claims.sample_means(rows, ["gene", "sample"]), ["gene"], ["sample"])


@query("SELECT l_orderkey AS gene, l_linenumber AS column_no, l_suppkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN round((l_quantity + l_linenumber) / 2, 3) ELSE round(l_quantity, 3) END AS value FROM lineitem")
def replicate_mean(spark, sf_dir):
    cell = F.when(_mod(F.col("l_linenumber"), 2) == 0, F.concat_ws(",", F.col("l_quantity").cast("string"), F.lit("NA"), F.col("l_linenumber").cast("string"))).otherwise(F.concat_ws(",", F.lit("-"), F.col("l_quantity").cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gene"), F.col("l_linenumber").alias("column_no"), "l_suppkey", "l_partkey", claims.replicate_mean(cell).alias("value"))


@query("""WITH v AS (SELECT l_suppkey AS dataset, l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate, CAST(l_quantity AS INT) AS value, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_discount * 100 AS INT) END AS percentile FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(percentile, value) DESC, l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) AS n, count(*) OVER (PARTITION BY dataset) AS total FROM v)
 SELECT dataset, 'sample | value' || CASE WHEN dataset % 2 = 0 THEN ' | percentile' ELSE '' END || chr(10) || string_agg(l_orderkey || ' | ' || value || CASE WHEN dataset % 2 = 0 THEN ' | ' || percentile ELSE '' END, chr(10) ORDER BY n) || CASE WHEN max(total) > 60 THEN chr(10) || '... ' || (max(total) - 60) || ' more rows' ELSE '' END AS text FROM r WHERE n <= 60 GROUP BY dataset""")
def value_rows_text(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("dataset"), F.col("l_orderkey").alias("sample"), F.col("l_quantity").cast("int").alias("value"), F.when(_mod(F.col("l_suppkey"), 2) == 0, F.round(F.col("l_discount") * 100).cast("int")).alias("percentile"), F.lit(None).cast("double").alias("p_value"),
        F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("pos"),
    )
    return claims.rows_text(rows, ["dataset"])


@query("""WITH d AS (SELECT s_suppkey AS dataset, s_acctbal < 3000 AS differential FROM supplier), t AS (SELECT l_suppkey AS dataset, l_partkey AS gene, l_quantity AS value FROM lineitem), f AS (SELECT s_suppkey AS dataset, s_nationkey AS gene, s_acctbal AS value FROM supplier)
 SELECT dataset, gene, value, CASE WHEN differential THEN 'contrasts' ELSE 'tpms' END AS via FROM d JOIN t USING (dataset) WHERE (differential AND value > 25) OR (NOT differential AND value > 45) UNION ALL SELECT dataset, gene, value, 'fpkms' FROM d JOIN f USING (dataset) WHERE NOT differential AND dataset NOT IN (SELECT dataset FROM t WHERE value > 45)""")
def value_source_routing(spark, sf_dir):
    s, rows = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_partkey").cast("long").alias("gene"), F.col("l_quantity").alias("value"))
    datasets = s.select(F.col("s_suppkey").alias("dataset"), (F.col("s_acctbal") < 3000).alias("differential"))
    fpkms = s.select(F.col("s_suppkey").alias("dataset"), F.col("s_nationkey").cast("long").alias("gene"), F.col("s_acctbal").alias("value"))
    return claims.value_source(rows.filter("value > 45"), fpkms, rows.filter("value > 25"), datasets)


@query("WITH c AS (SELECT conv_id AS answer_id, unnest(list_distinct([conv_id * 3, conv_id * 3 + turn, turn * 100000])) AS id FROM conversations), d AS (SELECT DISTINCT answer_id, id FROM c) SELECT answer_id, count(*) AS cited, count(doc_id) AS valid, round(count(doc_id) / count(*), 6) AS fidelity FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM documents) ON doc_id = id GROUP BY 1")
def citation_fidelity(spark, sf_dir):
    k, t = F.col("conv_id") * 3, F.col("turn")
    answers = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("answer_id")).agg(F.flatten(F.collect_list(F.array(k, k + t, t * 100000))).alias("cited"))
    return claims.citation_fidelity(answers, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS u FROM documents) SELECT doc_id, u[doc_id % len(u) + 1] AS quote, (doc_id * 37 % 101) / 100.0::DOUBLE AS confidence FROM l WHERE len(u) > 0 AND doc_id % 11 <> 0")
def summary_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("u")).filter(F.size("u") > 0)
    answers = table(spark, sf_dir, "documents").select("doc_id", F.when(_mod(F.col("doc_id"), 11) != 0, _mod(F.col("doc_id") * 37, 101) / 100).alias("confidence"))
    claimed = docs.select("doc_id", T.quote(F.col("u"), F.array(F.pmod("doc_id", F.size("u")).cast("int"))).alias("quote"))
    return claimed.join(answers, "doc_id").filter("confidence is not null")


@query("WITH p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'claim' ELSE 'condition' END AS type, trim(replace(text, chr(10), ' ')) AS claim FROM documents) SELECT doc_id AS subject, CASE type WHEN 'claim' THEN 'reports' ELSE 'has_condition' END AS predicate, type || ':' || substr(sha256(claim), 1, 12) AS object, claim, (quality + toxic) / 2.0::DOUBLE AS confidence FROM p JOIN labels USING (doc_id)")
def claim_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.lit(0).alias("claim_no"), F.when(F.col("lang") == "en", "claim").otherwise("condition").alias("type"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("claim"), F.lit("").alias("quote"))
    answers = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node"), F.lit(0).alias("claim_no"), ((F.col("quality") + F.col("toxic")) / 2).alias("noul"))
    return claims.verified_claims(docs, answers).drop("quote")


_RUNS = """o AS (SELECT o_orderkey AS k, o_orderstatus AS outcome, o_totalprice > 100000 AS ok, o_totalprice / 1000 AS wall, o_custkey AS tokens FROM orders WHERE o_orderpriority <> '5-LOW'), n AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS outcome, o_totalprice > 150000 AS ok, o_totalprice / 900 AS wall, o_custkey + 1 AS tokens FROM orders WHERE o_orderpriority <> '1-URGENT'),
 j AS (SELECT coalesce(o.k, n.k) AS "case", CASE WHEN o.k IS NULL THEN 'only_new' WHEN n.k IS NULL THEN 'only_old' WHEN o.outcome <> n.outcome THEN 'flipped' WHEN o.ok AND NOT n.ok THEN 'regressed' ELSE 'same' END AS status, round(n.wall - o.wall, 2) AS wall_diff, n.tokens - o.tokens AS token_diff FROM o FULL JOIN n ON o.k = n.k)"""


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("case"), F.col("o_orderstatus").alias("outcome"), (F.col("o_totalprice") > 100000).alias("ok"), (F.col("o_totalprice") / 1000).alias("wall_s"), F.col("o_custkey").alias("tokens"))
    new = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("case"), F.when(_mod(F.col("o_custkey"), 7) == 0, "X").otherwise(F.col("o_orderstatus")).alias("outcome"), (F.col("o_totalprice") > 150000).alias("ok"), (F.col("o_totalprice") / 900).alias("wall_s"), (F.col("o_custkey") + 1).alias("tokens"))
    return reports.compare_runs(old, new)


@query(f"WITH {_RUNS} SELECT * FROM j")
def run_compare(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"WITH {_RUNS} SELECT count(*) FILTER (WHERE status = 'flipped') AS flips, count(*) FILTER (WHERE status = 'regressed') AS regressions, round(sum(wall_diff), 2) AS wall_diff, CAST(sum(token_diff) AS BIGINT) AS token_diff FROM j")
def run_compare_totals(spark, sf_dir):
    return reports.compare_totals(_runs(spark, sf_dir))


_DIFF = """a AS (SELECT d.doc_id, lang AS stage, (['b0', 'b1'])[doc_id % 2 + 1] AS backend, (['noul', 'choice', 'score'])[doc_id % 3 + 1] AS qtype, (doc_id * 37 % 101) / 100.0::DOUBLE AS ov, (doc_id * 53 % 101) / 100.0::DOUBLE AS nv, CAST(quality AS VARCHAR) AS oc, CAST(toxic AS VARCHAR) AS nc FROM documents d JOIN labels USING (doc_id)),
 diff AS (SELECT doc_id, stage, backend, qtype, CASE WHEN qtype <> 'choice' THEN round(abs(ov - nv), 4) END AS delta, CASE WHEN qtype = 'noul' THEN (ov >= 0.5) <> (nv >= 0.5) END AS flip, CASE WHEN qtype = 'choice' THEN oc = nc END AS agree FROM a)"""


def _diffs(spark, sf_dir):
    k = F.col("doc_id")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (_mod(k, n) + 1).cast("int"))
    a = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(k, F.col("lang").alias("stage"), pick(("b0", "b1"), 2).alias("backend"), pick(("noul", "choice", "score"), 3).alias("qtype"), (_mod(k * 37, 101) / 100).alias("old_value"), (_mod(k * 53, 101) / 100).alias("new_value"), F.col("quality").cast("string").alias("old_choice"), F.col("toxic").cast("string").alias("new_choice"))
    return reports.answer_diff(a).select("doc_id", "stage", "backend", "qtype", "delta", "flip", "agree")


@query(f"WITH {_DIFF} SELECT * FROM diff")
def answer_diff(spark, sf_dir):
    return _diffs(spark, sf_dir)


@query(f"""WITH {_DIFF} SELECT backend, coalesce(stage, 'all') AS stage, count(*) AS rows, count(*) FILTER (WHERE qtype = 'noul') AS noul_n, round(avg(delta) FILTER (WHERE qtype = 'noul'), 4) AS noul_mean_delta, round(avg(CAST(flip AS INT)), 4) AS noul_flip_rate, count(*) FILTER (WHERE qtype = 'choice') AS choice_n,
 round(avg(CAST(agree AS INT)), 4) AS choice_agree_rate, round(avg(delta) FILTER (WHERE qtype = 'score'), 4) AS score_mean_delta FROM diff GROUP BY GROUPING SETS ((backend, stage), (backend))""")
def answer_diff_summary(spark, sf_dir):
    return reports.answer_diff_summary(_diffs(spark, sf_dir))


_CLAIMS = """a AS (SELECT item_id AS ask_id, 'x' AS side, unnest(string_split(regexp_replace(text, '[^ -~]', '?', 'g'), '.')) AS c FROM benchmark), r AS (SELECT ask_id, lower(trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS c, row_number() OVER () AS i FROM a),
 g AS (SELECT ask_id, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS c, row_number() OVER () AS j FROM (SELECT item_id AS ask_id, unnest(string_split(replace(regexp_replace(text, '[^ -~]', '?', 'g'), 'the', 'a'), '.')) AS x FROM benchmark)),
 p AS (SELECT ask_id, i, j, round(1 - levenshtein(r.c, g.c) / greatest(length(r.c), length(g.c), 1), 6) AS sim FROM r JOIN g USING (ask_id))"""


def _sides(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", "?"))  # edit distances count bytes in SQL
    recorded = b.select(F.col("item_id").alias("ask_id"), F.posexplode(F.split("text", r"\.")).alias("claim_no", "claim"))
    generated = b.select(F.col("item_id").alias("ask_id"), F.posexplode(F.split(F.replace("text", F.lit("the"), F.lit("a")), r"\.")).alias("claim_no", "claim"))
    return recorded, generated


@query(f"WITH {_CLAIMS}, bi AS (SELECT ask_id, i, max(sim) AS b FROM p GROUP BY 1, 2), bj AS (SELECT ask_id, j, max(sim) AS b FROM p GROUP BY 1, 2), x AS (SELECT ask_id, round(sum(b), 4) / count(*) AS recall, count(*) FILTER (WHERE b >= 0.8) AS recorded_matched, count(*) AS n_recorded FROM bi GROUP BY 1) SELECT x.*, \"precision\", generated_matched, n_generated FROM x JOIN (SELECT ask_id, round(sum(b), 4) / count(*) AS \"precision\", count(*) FILTER (WHERE b >= 0.8) AS generated_matched, count(*) AS n_generated FROM bj GROUP BY 1) USING (ask_id)")
def claim_overlap(spark, sf_dir):
    return claims.claim_overlap(*_sides(spark, sf_dir), CLAIM_MATCH_LEAST)
