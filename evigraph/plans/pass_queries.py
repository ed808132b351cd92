"""Queries of the stage operators and of the compositions over model output, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CATEGORY_TEXTS, CLAIM_MATCH_LEAST
from ..functions import asks as A
from ..functions import ids as I
from ..operators import claims, passes, reports, stages
from ..sources.adapters import table
from .claim_queries import _sides

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


def _text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("""SELECT p_size AS graph_id, 'ncbigene:' || p_partkey AS subject, 'has_go_term' AS predicate, 'go:' || p_brand AS object, p_name AS label, 'function' AS detail FROM part
 UNION SELECT p_size, 'ncbigene:' || p_partkey, 'has_go_term', 'go:' || p_type, p_type, 'component' FROM part
 UNION SELECT p_size, 'ncbigene:' || p_partkey, 'in_pathway', 'kegg:p' || s_nationkey, s_name, 'k' || p_size FROM part JOIN supplier ON p_size = s_suppkey % 50
 UNION SELECT p_size, 'ncbigene:' || p_partkey, 'same_as', 'kegg:k' || p_size, 'k' || p_size, NULL FROM part
 UNION SELECT p_size, 'ncbigene:' || p_partkey, 'has_domain', 'domain:D' || (p_partkey % 10), 'D' || (p_partkey % 10), 'Pfam' FROM part""")
def annotation_claims(spark, sf_dir):
    k = F.col("p_partkey")
    go = lambda i, t, c: F.struct(F.col(i).alias("id"), t.alias("term"), F.lit(c).alias("code"))
    part = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("graph_id"),
        I.node_id("ncbigene", _text(k)).alias("gene"),
        F.array(go("p_brand", F.concat(F.lit("F:"), "p_name"), "IEA:x"), go("p_type", F.concat(F.lit("C:"), "p_type"), "")).alias("go"),
        F.array(F.concat(F.lit("k"), "p_size")).alias("kegg"),
        F.array(F.struct(F.concat(F.lit("D"), _mod(k, 10)).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("pfam").alias("source"))).alias("domains"),
    )
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), _mod(F.col("s_suppkey"), 50)).alias("kegg"), F.concat(F.lit("p"), "s_nationkey").alias("pathway"), F.concat(F.lit("path:"), "s_name", F.lit(" - Organism")).alias("name"))
    return stages.annotation_claims(part, paths)


@query("""WITH c AS (SELECT d.source AS graph_id, d.doc_id, lang, CASE WHEN l.quality IS NOT NULL AND d.source IS NOT NULL THEN ((d.doc_id * 37) % 101) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM documents d LEFT JOIN labels l USING (doc_id)),
 r AS (SELECT *, count(*) OVER (PARTITION BY graph_id) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY coalesce(lang, '') <> 'en', confidence DESC, 'GSE' || doc_id) AS k FROM c), t AS (SELECT * FROM r WHERE n <= 250 OR k <= 250)
 SELECT graph_id, 'g' AS subject, 'measured_in' AS predicate, 'dataset:GSE' || doc_id AS object, confidence FROM t UNION ALL SELECT DISTINCT graph_id, 'dataset:GSE' || doc_id, 'has_factor', 'condition:' || lower(f), 1.0::DOUBLE FROM (SELECT *, unnest([lang, graph_id]) AS f FROM t) WHERE trim(f) <> ''""")
def dataset_claims(spark, sf_dir):
    k, accession = F.col("doc_id"), F.concat(F.lit("GSE"), "doc_id")
    docs = table(spark, sf_dir, "documents")
    candidates = docs.select(F.col("source").alias("graph_id"), F.lit("g").alias("gene"), accession.alias("accession"), (F.coalesce("lang", F.lit("")) != "en").alias("other_species"), F.array("lang", "source", "lang").alias("factors"))
    judged = docs.join(table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id"), "doc_id")
    answers = judged.select(F.col("source").alias("graph_id"), accession.alias("accession"), (_mod(k * 37, 101) / 100).alias("noul"))
    return stages.dataset_claims(candidates, answers, 250)


@query("""WITH e AS (SELECT l_suppkey AS graph_id, 'u:' || l_linenumber AS subject, l_partkey AS gene_id, l_orderkey AS seq FROM lineitem WHERE l_linenumber <> 1), r AS (SELECT p_partkey AS gene_id, unnest(['GCF_' || p_size, CASE WHEN p_partkey % 2 = 1 THEN 'GCA_' || p_brand END]) AS accession FROM part)
 SELECT graph_id, accession, max({'q': seq, 's': subject}).s AS gene FROM e JOIN r USING (gene_id) WHERE accession IS NOT NULL GROUP BY 1, 2""")
def annotated_assemblies(spark, sf_dir):
    n = F.col("l_linenumber")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("graph_id"), F.when(n == 1, F.concat(F.lit("q:"), "l_suppkey")).otherwise(F.concat(F.lit("u:"), n)).alias("subject"), F.lit("same_as").alias("predicate"), I.node_id("ncbigene", _text("l_partkey")).alias("object"), F.col("l_orderkey").alias("seq"))
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("graph_id"), F.concat(F.lit("q:"), "s_suppkey").alias("query"))
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part").select(_text(k).alias("gene_id"), F.array(F.concat(F.lit("GCF_"), "p_size"), F.when(_mod(k, 2) == 1, F.concat(F.lit("GCA_"), "p_brand"))).alias("accessions"))
    return stages.annotated_assemblies(edges, queries, found)


@query("""WITH m AS (SELECT c_custkey AS graph_id, 'g:' || c_custkey AS gene, c_nationkey AS grp, 's' || (c_custkey % 7) AS known FROM customer), r AS (SELECT graph_id, grp, s_suppkey, row_number() OVER (PARTITION BY graph_id, grp ORDER BY known = 's' || (s_suppkey % 7) DESC, s_acctbal > 5000 DESC, s_suppkey) AS place FROM m JOIN supplier ON grp = s_nationkey)
 SELECT graph_id, gene AS subject, 'in_orthogroup' AS predicate, 'orthogroup:' || grp AS object, 0::BIGINT AS place FROM m UNION ALL SELECT graph_id, 'orthogroup:' || grp, 'has_member', 'omclseq:' || s_suppkey, place FROM r WHERE place <= 10""")
def group_claims(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    member_of = c.select(F.col("c_custkey").alias("graph_id"), F.concat(F.lit("g:"), "c_custkey").alias("gene"), _text("c_nationkey").alias("grp"))
    members = s.select(_text("s_nationkey").alias("grp"), _text("s_suppkey").alias("member"), F.concat(F.lit("s"), _mod(F.col("s_suppkey"), 7)).alias("species"), (F.col("s_acctbal") > 5000).alias("core"), F.col("s_suppkey").alias("pos"))
    known = c.select(F.col("c_custkey").alias("graph_id"), F.concat(F.lit("s"), _mod(F.col("c_custkey"), 7)).alias("species"))
    return stages.group_claims(member_of, members, known, 10)


@query("""WITH g AS (SELECT p_partkey AS gene, p_size AS tax_id, p_name AS species FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 5 <> 0), p AS (SELECT p_brand AS place, min(p_size) AS place_tax_id, upper(min(p_name)) || ' strain ' || p_brand AS place_species FROM part GROUP BY p_brand),
 o AS (SELECT * FROM p WHERE place NOT IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 1) AND place NOT IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 2)),
 k AS (SELECT gene, tax_id, split_part(lower(species), ' ', 1) AS gg, split_part(lower(species), ' ', 2) AS ge FROM g), l AS (SELECT place, place_tax_id, split_part(lower(place_species), ' ', 1) AS pg, split_part(lower(place_species), ' ', 2) AS pe FROM o)
 SELECT gene, place, CASE WHEN tax_id = place_tax_id THEN 'tax_id' ELSE 'species' END AS matched_on FROM k, l WHERE tax_id = place_tax_id OR (ge = pe AND (gg = pg OR (length(rtrim(gg, '.')) = 1 AND starts_with(pg, rtrim(gg, '.')))))""")
def candidate_genes(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    namespaces = F.array(*map(F.lit, ("oma", "veupathdb", "ncbigene")))
    genes = part.select(k.alias("gene"), F.col("p_size").alias("tax_id"), F.col("p_name").alias("species"), F.element_at(namespaces, (_mod(k, 3) + 1).cast("int")).alias("id_namespace"))
    brands = part.groupBy(F.col("p_brand").alias("place")).agg(F.min("p_size").alias("place_tax_id"), F.min("p_name").alias("n"))
    places = brands.select("place", "place_tax_id", F.concat(F.upper("n"), F.lit(" strain "), "place").alias("place_species"))
    edge = lambda rows, subject, predicate, obj: rows.select(_text(subject).alias("subject"), F.lit(predicate).alias("predicate"), _text(obj).alias("object"))
    edges = edge(part.filter(_mod(k, 50) == 1), k, "annotated_in", "p_brand").union(edge(part.filter(_mod(k, 50) == 2), "p_brand", "has_candidate_gene", k)).union(edge(part.filter(_mod(k, 5) == 0), k, "in_assembly", F.lit("a")))
    return stages.candidate_genes(genes.withColumn("gene", _text("gene")), places, edges).withColumn("gene", F.col("gene").cast("bigint"))


@query("""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'PMID ' || doc_id ELSE 'own' END AS label, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS title, CASE WHEN doc_id % 5 = 0 THEN source END AS journal FROM documents), r AS (SELECT CAST(page_id AS VARCHAR) AS pmid, url FROM pages),
 f AS (SELECT n.pmid, label, coalesce(nullif(title, ''), url) AS title, coalesce(nullif(journal, ''), CASE WHEN r.pmid IS NOT NULL THEN 'pages' END) AS journal FROM n LEFT JOIN r USING (pmid)) SELECT pmid, CASE WHEN (trim(label) = '' OR starts_with(label, 'PMID ')) AND title IS NOT NULL THEN title ELSE label END AS label, title, journal FROM f""")
def filled_publications(spark, sf_dir):
    k = F.col("doc_id")
    blank = F.lit(None).cast("string")
    label = F.when(_mod(k, 3) == 0, "").when(_mod(k, 3) == 1, F.concat(F.lit("PMID "), k)).otherwise("own")
    nodes = table(spark, sf_dir, "documents").select(_text(k).alias("pmid"), label.alias("label"), F.when(_mod(k, 2) == 0, F.col("lang")).otherwise("").alias("title"), blank.alias("abstract"), F.when(_mod(k, 5) == 0, F.col("source")).alias("journal"), blank.alias("year"))
    records = table(spark, sf_dir, "pages").select(_text("page_id").alias("pmid"), F.col("url").alias("title"), blank.alias("abstract"), F.lit("pages").alias("journal"), blank.alias("year"))
    return stages.filled_publications(nodes, records).select("pmid", "label", "title", "journal")


@query("""SELECT c_custkey AS graph_id, CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE 'c:' || c_custkey END AS symbol, organism FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS organism FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def match_of_graph(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    own = c.select(k.alias("graph_id"), F.concat(F.lit("c:"), k).alias("id"), F.lit("Gene").alias("type"), F.when(_mod(k, 2) == 1, F.col("c_name")).otherwise("").alias("label"), F.lit(0).cast("bigint").alias("seq"))
    rest = o.select(F.col("o_custkey").alias("graph_id"), F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.when(_mod(F.col("o_orderkey"), 3) == 0, "Organism").otherwise("Gene").alias("type"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").cast("bigint").alias("seq"))
    return stages.match_of_graph(c.select(k.alias("graph_id"), F.concat(F.lit("c:"), k).alias("query")), own.union(rest))


_LINES = """split AS (SELECT item_id AS ask_id, string_split(regexp_replace(text, '[^ -~]', '?', 'g'), '.') AS a, string_split(replace(regexp_replace(text, '[^ -~]', '?', 'g'), 'the', 'a'), '.') AS b FROM benchmark),
 r AS (SELECT ask_id, unnest(range(0, len(a))) AS i, lower(trim(regexp_replace(unnest(a), '\\s+', ' ', 'g'))) AS x FROM split), g AS (SELECT ask_id, unnest(range(0, len(b))) AS j, lower(trim(regexp_replace(unnest(b), '\\s+', ' ', 'g'))) AS y FROM split),
 p AS (SELECT ask_id, i, j, round(1 - levenshtein(x, y) / greatest(length(x), length(y), 1), 6) AS sim FROM r JOIN g USING (ask_id)),
 s AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY sim DESC, i, j) AS n FROM p WHERE sim >= 0.8),
 t AS (SELECT DISTINCT ask_id, 0::BIGINT AS n, []::BIGINT[] AS ui, []::BIGINT[] AS uj, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS sim FROM s
  UNION ALL SELECT ask_id, s.n, CASE WHEN free THEN list_append(ui, s.i) ELSE ui END, CASE WHEN free THEN list_append(uj, s.j) ELSE uj END, CASE WHEN free THEN s.i END, CASE WHEN free THEN s.j END, s.sim
  FROM (SELECT t.ask_id, t.ui, t.uj, s.n, s.i, s.j, s.sim, NOT list_contains(ui, s.i) AND NOT list_contains(uj, s.j) AS free FROM t JOIN s ON s.ask_id = t.ask_id AND s.n = t.n + 1) s)"""


def _matches(spark, sf_dir):
    r, g = _sides(spark, sf_dir)
    pairs = r.select("ask_id", F.col("claim").alias("a"), F.col("claim_no").cast("long").alias("i")).join(g.select("ask_id", F.col("claim").alias("b"), F.col("claim_no").cast("long").alias("j")).hint("shuffle_merge"), "ask_id")
    return claims.greedy_matches(pairs.select("ask_id", "i", "j", claims.similarity(F.col("a"), F.col("b")).alias("sim")), CLAIM_MATCH_LEAST)


@query(f"WITH RECURSIVE {_LINES} SELECT ask_id, i, j, sim FROM t WHERE i IS NOT NULL")
def claim_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"WITH RECURSIVE {_LINES} SELECT 'recorded' AS side, ask_id, i AS claim_no FROM r ANTI JOIN (SELECT ask_id, i FROM t WHERE i IS NOT NULL) USING (ask_id, i) UNION ALL SELECT 'generated', ask_id, j FROM g ANTI JOIN (SELECT ask_id, j FROM t WHERE i IS NOT NULL) USING (ask_id, j)")
def unmatched_claims(spark, sf_dir):
    r, g = _sides(spark, sf_dir)
    number = F.col("claim_no").cast("long").alias("claim_no")
    return reports.unmatched(r.select("ask_id", number), g.select("ask_id", number), _matches(spark, sf_dir))


@query("""WITH o AS (SELECT doc_id % 4 AS stage, doc_id % 5 AS n_recorded, doc_id % 3 AS n_generated, (doc_id * 37 % 101) / 100.0::DOUBLE AS recall, (doc_id * 53 % 101) / 100.0::DOUBLE AS prec, doc_id % 2 AS m FROM documents)
 SELECT stage, count(*) AS asks, round(round(sum(n_recorded), 4) / count(*), 4) AS mean_recorded, round(round(sum(n_generated), 4) / count(*), 4) AS mean_generated, round(round(sum(recall), 4) / count(*), 4) AS recall, round(round(sum(prec), 4) / count(*), 4) AS "precision", CAST(sum(m) AS BIGINT) AS matched, count(*) FILTER (WHERE n_generated = 0) AS empty FROM o GROUP BY 1""")
def generation_summary(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(_mod(k, 4).alias("stage"), _mod(k, 5).alias("n_recorded"), _mod(k, 3).alias("n_generated"), (_mod(k * 37, 101) / 100).alias("recall"), (_mod(k * 53, 101) / 100).alias("precision"), _mod(k, 2).alias("recorded_matched"))
    return reports.generation_summary(rows)


@query("SELECT 'recorded' AS side, lang AS type, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'generated', source, count(*) FROM documents GROUP BY 2")
def type_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reports.type_mix(docs.select(F.col("lang").alias("type")), docs.select(F.col("source").alias("type")))


_KINDS = {"refseq": "a sequence record", "uniprot": "a protein entry"}


@query(r"""WITH c AS (SELECT c_custkey AS k, c_name AS v, c_custkey % 3 AS n FROM customer), a AS (
 SELECT k, 'id_type' AS ask, 'choice' AS qtype, 'Which identifier namespace is ' || chr(39) || v || chr(39) || ' most likely from?' AS instructions, 'refseq,uniprot,other' AS criteria, '{"hints":["refseq","uniprot"],"value":"' || v || '"}' AS state FROM c UNION ALL
 SELECT k, 'match', CASE WHEN n > 1 THEN 'choice' ELSE 'noul' END, CASE WHEN n > 1 THEN 'Which candidate record is the gene that ' ELSE 'Is the one candidate record the gene that ' END || chr(39) || v || chr(39) || ' means?', CASE WHEN n > 1 THEN '0,1,none' ELSE '' END, '{"candidates":[' || array_to_string(list_transform(range(0, n), lambda i: '{"gene_id":"' || i || '"}'), ',') || '],"value":"' || v || '"}' FROM c UNION ALL
 SELECT k, 'triage', 'score', CASE WHEN n = 0 THEN 'Does the text of ' || chr(39) || v || chr(39) || ' name conditions, contrasts or sample groups that could be listed?' ELSE 'Does the text of ' || chr(39) || v || chr(39) || ' say what the gene does or when it is expressed?' END, '0,1,2,3', '{"kind":"' || CASE WHEN n = 0 THEN 'dataset' ELSE 'publication' END || '","node":"' || v || '","text":"t"}' FROM c UNION ALL
 SELECT k, 'category', 'choice', 'Which category describes the claim about ' || chr(39) || v || chr(39) || ' best?', 'role,place,other', '{"claim":"x","node":"' || v || '"}' FROM c WHERE n = 1)
 SELECT * FROM a""")
def ask_bodies(spark, sf_dir):
    v, n = F.col("c_name"), _mod(F.col("c_custkey"), 3)
    hints = F.array(F.lit("refseq"), F.lit("uniprot"))
    records = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < n), lambda i: F.struct(i.cast("string").alias("gene_id")))
    kind = F.when(n == 0, "dataset").otherwise("publication")
    asks = {"id_type": A.id_type(v, hints, _KINDS), "match": A.candidates("gene_match", v, records, lambda r: r["gene_id"]), "triage": A.triage(v, kind, F.lit("t")), "category": A.category(v, F.when(n == 1, "claim").otherwise("condition"), F.lit("x"), {"role": "what it does", "place": "where it is"})}
    each = F.array(*(F.struct(F.lit(name).alias("ask"), body.alias("body")) for name, body in asks.items()))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.inline(each)).filter(F.col("body").isNotNull())
    return rows.select("k", "ask", "body.qtype", "body.instructions", F.array_join(F.transform("body.criteria", lambda x: x["key"]), ",").alias("criteria"), "body.state")


@query("""WITH q AS (SELECT source AS graph_id, doc_id AS question_id, lang AS question, (doc_id * 37 % 101) / 100.0::DOUBLE AS a, (doc_id * 53 % 101) / 100.0::DOUBLE AS b FROM documents WHERE source IS NOT NULL),
 c AS (SELECT *, list_filter([CASE WHEN a >= 0.5 THEN 'identity' END, CASE WHEN b >= 0.5 THEN 'literature' END], lambda x: x IS NOT NULL) AS cats, [question_id, question_id + 1, -question_id - 1] AS cited FROM q),
 w AS (SELECT c.graph_id, question_id, list_filter(cited, lambda x: x < 0) AS neg, count(d.doc_id) AS has_next FROM c LEFT JOIN documents d ON d.source = c.graph_id AND d.doc_id = question_id + 1 GROUP BY ALL),
 x AS (SELECT c.*, CASE WHEN has_next = 0 THEN [question_id + 1] ELSE [] END || neg AS wrong FROM c JOIN w USING (graph_id, question_id)),
 y AS (SELECT *, len(cats) > 0 AS sliced, len(cats) > 0 AND question_id % 4 <> 0 AS scored FROM x)
 SELECT graph_id, question_id, question, 'about ' || question AS answer, array_to_string(cited, ',') AS cited_nodes, array_to_string(wrong, ',') AS invalid_cited_nodes, array_to_string(cats, ',') AS categories, scored, sliced AND NOT scored AS judge_failed, CASE WHEN sliced THEN round((3 - len(wrong)) / 3, 6) END AS citation_fidelity, CASE WHEN scored THEN a END AS accuracy, CASE WHEN scored THEN b END AS completeness FROM y""")
def ask_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    k = F.col("doc_id")
    a, b = _mod(k * 37, 101) / 100, _mod(k * 53, 101) / 100
    key = [F.col("source").alias("graph_id"), k.alias("question_id")]
    questions = docs.select(*key, F.col("lang").alias("question"))
    flags = docs.select(*key, F.inline(F.array(F.struct(F.lit("literature").alias("category"), b.alias("noul")), F.struct(F.lit("identity").alias("category"), a.alias("noul")))))
    body = F.to_json(F.struct(F.concat(F.lit("about "), "lang").alias("answer"), F.array(_text(k), _text(k + 1), _text(-k - 1)).alias("cited_nodes")))
    contents = docs.select(*key, F.when(_mod(k, 2) == 0, body).otherwise(F.concat(F.lit("Here:\n"), body)).alias("content"))
    scores = docs.filter(_mod(k, 4) != 0).select(*key, a.alias("accuracy"), b.alias("completeness"))
    nodes = docs.select(F.col("source").alias("graph_id"), _text(k).alias("id"))
    out = passes.answers(questions, flags, contents, scores, nodes)
    return out.select("graph_id", "question_id", "question", "answer", *(passes.listed(c).alias(c) for c in ("cited_nodes", "invalid_cited_nodes", "categories")), "scored", (F.col("warning") == passes.NO_JUDGE).alias("judge_failed"), F.round("citation_fidelity", 6).alias("citation_fidelity"), "accuracy", "completeness").withColumn("judge_failed", F.coalesce("judge_failed", F.lit(False)))


@query("""WITH v AS (SELECT l_suppkey AS dataset, l_orderkey, CAST(l_quantity AS INT) AS value, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS INT) DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem),
 t AS (SELECT dataset, list(l_orderkey || ' | ' || value ORDER BY n) AS u, max(total) AS total FROM v WHERE n <= 60 GROUP BY 1)
 SELECT dataset, 'claim ' || dataset AS claim, u[1] || CASE WHEN len(u) > 2 THEN ' … ' || u[3] ELSE '' END AS quote, total AS n_rows, CASE WHEN len(u) > 2 THEN 2 ELSE 1 END::BIGINT AS n_cited, (dataset * 37 % 101) / 100.0::DOUBLE AS confidence FROM t WHERE dataset % 6 <> 0""")
def data_claim_pass(spark, sf_dir):
    k = F.col("l_suppkey")
    values = table(spark, sf_dir, "lineitem").select(k.alias("dataset"), F.col("l_orderkey").alias("sample"), F.col("l_quantity").cast("int").alias("value"), F.lit(None).cast("int").alias("percentile"), F.lit(None).cast("double").alias("p_value"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("pos"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dataset"))
    d = F.col("dataset")
    contents = s.select(d, F.concat(F.lit('Sure {"propositals": [{"claim": "claim '), d, F.lit('", "citations": [1, 3, 99]}]}')).alias("content"))
    verdicts = s.select(d, F.lit(0).alias("claim_no"), F.when(_mod(d, 6) != 0, _mod(d * 37, 101) / 100).alias("noul"))
    return passes.data_claims(values, contents, verdicts)


@query("""SELECT 'g' || c_custkey AS graph_id, CASE WHEN c_custkey % 4 = 3 OR n IS NULL THEN '' ELSE 'it has orders/[cited_in]/' || ((c_custkey * 37) % 101) / 100.0::DOUBLE END AS claims FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def summary_pass(spark, sf_dir):
    k = F.col("c_custkey")
    graphs = table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), k).alias("graph_id"), k)
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("g"), "o_custkey").alias("graph_id"), F.concat(F.lit("c:"), "o_custkey").alias("subject"), F.lit("cited_in").alias("predicate"), F.concat(F.lit("o:"), "o_orderkey").alias("object"), F.lit(1.0).alias("confidence"))
    labels = graphs.select("graph_id", F.concat(F.lit("c:"), k).alias("id"), F.lit("").alias("label"))
    contents = graphs.select("graph_id", F.lit('{"proposals": [{"claim": "it has orders", "citations": [1]}]}').alias("content"))
    verdicts = graphs.select("graph_id", F.lit(0).alias("claim_no"), F.when(_mod(k, 4) != 3, _mod(k * 37, 101) / 100).alias("noul"))
    out = passes.summaries(graphs.select("graph_id"), edges, labels, contents, verdicts)
    return out.select("graph_id", F.array_join(F.transform("claims", lambda c: F.concat_ws("/", c["claim"], c["quote"], c["confidence"].cast("string"))), ",").alias("claims"))


@query("""WITH i AS (SELECT source AS graph_id, CAST(doc_id AS VARCHAR) AS node, 'publication' AS kind, doc_id, text FROM documents WHERE source IS NOT NULL), s AS (SELECT *, (doc_id % 4) / 3.0::DOUBLE AS score FROM i WHERE trim(coalesce(text, '')) <> ''),
 a AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node) AS n FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, node) AS k FROM a WHERE n <= 400 AND score >= 0.5)
 SELECT graph_id, node AS subject, CASE WHEN doc_id % 2 = 0 THEN 'has_condition' ELSE 'reports' END AS predicate, CASE WHEN doc_id % 2 = 0 THEN 'condition:' || substr(sha256('dry heat'), 1, 12) ELSE 'claim:' || substr(sha256('it grows ' || node), 1, 12) END AS object, CASE WHEN doc_id % 2 = 0 THEN 'dry heat' ELSE 'it grows ' || node END AS claim, (doc_id * 37 % 101) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'role' END AS category FROM b WHERE k <= 100 AND doc_id % 7 <> 0 AND (length(text) <= 8000 OR regexp_matches(substr(text, 1, 8000), '[.!?]\\s+[^\\sa-z]|\\n\\s*\\S|[.!?]$'))""")
def text_claim_pass(spark, sf_dir):
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    node = _text(k).alias("node")
    items = docs.select(F.col("source").alias("graph_id"), node, F.lit("publication").alias("kind"), F.lit("").alias("label"), F.col("text").alias("body"))
    none = docs.filter("false").select(node, F.lit(0.0).alias("confidence"))
    claim = F.when(_mod(k, 2) == 0, F.concat(F.lit("heat "), k)).otherwise(F.concat(F.lit("it  grows "), k))
    contents = docs.select(node, F.to_json(F.struct(F.array(F.struct(claim.alias("claim"), F.when(_mod(k, 2) == 0, "condition").otherwise("claim").alias("type"), F.array(F.lit(1)).alias("citations"))).alias("proposals"))).alias("content"))
    labels = docs.select(node, F.lit(0).alias("claim_no"), F.lit("dry  heat").alias("label"))
    verdicts = docs.select(node, F.lit(0).alias("claim_no"), F.when(_mod(k, 7) != 0, _mod(k * 37, 101) / 100).alias("noul"), F.lit("role").alias("category"))
    return passes.text_claims(items, none, docs.select(node, _mod(k, 4).alias("score")), contents, labels, verdicts).drop("quote")


@query("SELECT doc_id, category, 'noul' AS qtype FROM documents, (SELECT unnest(['identity', 'products', 'orthology', 'assemblies', 'function', 'datasets', 'literature', 'claims']) AS category)")
def question_categories(spark, sf_dir):
    each = A.question_categories(F.col("lang"), CATEGORY_TEXTS)
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(each)).select("doc_id", "category", "ask.qtype")


@query("SELECT doc_id, (['choice', 'score', 'noul'])[doc_id % 3 + 1] AS qtype, CASE doc_id % 3 WHEN 0 THEN lang END AS choice, CASE doc_id % 3 WHEN 1 THEN 1.0::DOUBLE END AS score, CASE doc_id % 3 WHEN 2 THEN 0.5::DOUBLE END AS noul, CASE doc_id % 3 WHEN 0 THEN 0.5::DOUBLE END AS confidence FROM documents")
def mock_judge(spark, sf_dir):
    qtype = F.element_at(F.array(*map(F.lit, ("choice", "score", "noul"))), (_mod(F.col("doc_id"), 3) + 1).cast("int"))
    asks = table(spark, sf_dir, "documents").select("doc_id", qtype.alias("qtype"), F.array("lang", F.lit("b"), F.lit("c")).alias("criteria"))
    return claims.mock_answers(asks).drop("criteria")


@query(r"""WITH c AS (SELECT c_custkey AS k, c_name AS v, c_custkey % 3 AS n, chr(39) || c_name || chr(39) AS w FROM customer), a AS (
 SELECT k, 'rank' AS ask, 'choice' AS qtype, 'At which taxonomic rank should relatives of ' || w || ' be grouped?' AS instructions, 'species,genus' AS criteria, '{"lineage":["a"],"taxon":"' || v || '"}' AS state FROM c WHERE n = 2
 UNION ALL SELECT k, 'protein', CASE WHEN n > 1 THEN 'choice' ELSE 'noul' END, CASE WHEN n > 1 THEN 'Which candidate record is the gene that ' || w || ' means?' ELSE 'Is the protein entry the product of ' || w || '?' END, CASE WHEN n > 1 THEN '0,1,none' ELSE '' END, '{"candidates":[' || array_to_string(list_transform(range(0, greatest(n, 1)), lambda i: '"e' || i || '"'), ',') || '],"value":"' || v || '"}' FROM c
 UNION ALL SELECT k, 'characterization', 'score', 'How well characterized is ' || w || '?', '0,1', '{"entry":' || n || ',"gene":"' || v || '"}' FROM c UNION ALL SELECT k, 'relevant', 'noul', 'Is the dataset likely to say something about ' || w || '?', '', '{"dataset":"d","gene":"' || v || '"}' FROM c
 UNION ALL SELECT k, 'verify', 'noul', 'Does the source text of ' || w || CASE WHEN n = 0 THEN ' state this condition, and does it say how the gene was measured?' ELSE ' support this claim, and could it be shown false?' END, '', '{"claim":"x","node":"' || v || '","quote":"q","text":"t"}' FROM c
 UNION ALL SELECT k, 'data_claim', 'noul', 'Do the values of ' || chr(39) || 'd' || chr(39) || ' support the claim?', '', '{"claim":"x","data":"1 | 2","dataset":"d","gene":"' || v || '"}' FROM c UNION ALL SELECT k, 'summary_claim', 'noul', 'Does the graph of ' || w || ' support the sentence?', '', '{"claim":"x","gene":"' || v || '","graph":"g"}' FROM c
 UNION ALL SELECT k, 'accuracy', 'noul', 'How accurate is the answer to ' || w || '?', '', '{"answer":"a","categories":["identity"],"graph":"g","question":"' || v || '"}' FROM c UNION ALL SELECT k, 'completeness', 'noul', 'How complete is the answer to ' || w || '?', '', '{"answer":"a","categories":["identity"],"graph":"g","question":"' || v || '"}' FROM c) SELECT * FROM a""")
def ask_bodies_of_stages(spark, sf_dir):
    v, n = F.col("c_name"), _mod(F.col("c_custkey"), 3)
    ranks = F.when(n == 2, F.array(F.lit("species"), F.lit("genus"))).otherwise(F.array(F.lit("species")))
    entries = F.when(n > 1, F.array(F.lit("e0"), F.lit("e1"))).otherwise(F.array(F.lit("e0")))
    kind = F.when(n == 0, "condition").otherwise("claim")
    asks = {
        "rank": A.rank(v, ranks, F.array(F.lit("a"))),
        "protein": A.candidates("protein_entry", v, entries, lambda r: r),
        "characterization": A.characterization(v, n),
        "relevant": A.relevant(v, F.lit("d")),
        "verify": A.verify(v, kind, F.lit("x"), F.lit("q"), F.lit("t")),
        "data_claim": A.data_claim(v, F.lit("d"), F.lit("1 | 2"), F.lit("x")),
        "summary_claim": A.summary_claim(v, F.lit("g"), F.lit("x")),
    }
    each = [F.struct(F.lit(name).alias("ask"), body.alias("body")) for name, body in asks.items()]
    scores = A.answer_scores(v, F.lit("a"), F.lit("g"), F.array(F.lit("identity")))
    each += [F.struct(scores[i]["score"].alias("ask"), scores[i]["ask"].alias("body")) for i in range(2)]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.inline(F.array(*each))).filter(F.col("body").isNotNull())
    return rows.select("k", "ask", "body.qtype", "body.instructions", F.array_join(F.transform("body.criteria", lambda x: x["key"]), ",").alias("criteria"), "body.state")


_JSON = "Answer in JSON only."


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS v, c_mktsegment AS m FROM customer) SELECT k, 'text' AS prompt, 'You extract conditions and claims about a gene from numbered sentences. {_JSON}' AS system, 'Node: ' || v || chr(10) || 'Sentences:' || chr(10) || '[0] s' || chr(10) || 'Return {{"proposals": [{{"claim", "type", "citations"}}]}}, citing sentence numbers.' AS "user" FROM c
 UNION ALL SELECT k, 'normalize', 'You make the wording of condition labels agree. {_JSON}', 'Labels: ["' || m || '"]' || chr(10) || 'Return {{"normalized": [...]}}, one for each label, in order.' FROM c UNION ALL SELECT k, 'data', 'You propose claims that measured values support. {_JSON}', 'Gene: ' || v || chr(10) || 'Dataset: d' || chr(10) || 'Summary: ' || CASE WHEN k % 2 = 0 THEN m ELSE 'n/a' END || chr(10) || 'Rows:' || chr(10) || 'r' FROM c
 UNION ALL SELECT k, 'summary', 'You sum up a gene' || chr(39) || 's graph in claims that cite its lines. {_JSON}', 'Gene: ' || CASE WHEN k % 2 = 0 THEN v ELSE 'this gene' END || ' (unknown organism)' || chr(10) || 'Lines:' || chr(10) || 'g' FROM c UNION ALL SELECT k, 'answer', 'You answer from an excerpt of a graph, so that what is missing may exist only and cite its nodes. {_JSON}', 'Graph: g' || chr(10) || 'Question: ' || v || chr(10) || 'Return {{"answer", "cited_nodes"}}.' FROM c""")
def prompts(spark, sf_dir):
    k, v, m = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    some = lambda c: F.when(_mod(k, 2) == 0, c)
    made = {"text": A.text_prompt(v, F.lit("[0] s")), "normalize": A.normalize_prompt(F.array(m)), "data": A.data_prompt(v, F.lit("d"), some(m), F.lit("r")), "summary": A.summary_prompt(some(v), F.lit(None).cast("string"), F.lit("g")), "answer": A.answer_prompt(v, F.lit("g"), True)}
    each = F.array(*(F.struct(F.lit(name).alias("prompt"), p.alias("p")) for name, p in made.items()))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.inline(each)).select("k", "prompt", "p.system", "p.user")


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'ncbigene:' || c_custkey WHEN 1 THEN 'ncbigene:' || c_name ELSE 'asked' END AS anchor, 'genes' AS source, 'lookup' AS endpoint, c_custkey || ' hits' AS summary, '{"n":' || c_custkey || ',"name":"' || c_name || '"}' AS payload FROM customer""")
def anchor_evidence(spark, sf_dir):
    k = F.col("c_custkey")
    anchor = stages.anchor_id("ncbigene", F.when(_mod(k, 3) == 0, k.cast("string")).otherwise(""), F.when(_mod(k, 3) == 1, F.col("c_name")), F.lit("asked"))
    told = stages.evidence("genes", "lookup", F.concat(k, F.lit(" hits")), name=F.col("c_name"), n=k)
    return table(spark, sf_dir, "customer").select(k.alias("k"), anchor.alias("anchor"), told.alias("e")).select("k", "anchor", "e.*")


@query("""WITH c AS (SELECT c_nationkey * 40 + c_custkey % 40 AS graph_id, c_custkey AS record_id, c_custkey % 11 = 0 AS ide, c_custkey % 7 = 0 AS sym FROM customer), n AS (SELECT *, count(*) FILTER (WHERE ide) OVER w AS ids, min(CASE WHEN ide THEN record_id END) OVER w AS first, count(*) FILTER (WHERE sym) OVER w AS syms, row_number() OVER (PARTITION BY graph_id ORDER BY record_id) - 1 AS k, count(*) OVER w AS pool FROM c WINDOW w AS (PARTITION BY graph_id)),
 j AS (SELECT graph_id, record_id, CASE WHEN pool = 1 THEN ((graph_id * 37) % 101) / 100.0::DOUBLE >= 0.5 ELSE k = graph_id % 4 END AS taken FROM n WHERE ids = 0 AND syms <> 1)
 SELECT graph_id, 'resolved' AS outcome, record_id, 1.0::DOUBLE AS confidence FROM n WHERE CASE WHEN ids > 0 THEN record_id = first ELSE syms = 1 AND sym END
 UNION ALL SELECT graph_id, CASE WHEN bool_or(taken) THEN 'resolved' ELSE 'refused' END, max(record_id) FILTER (WHERE taken), max(((graph_id * 37) % 101) / 100.0::DOUBLE) FILTER (WHERE taken) FROM j GROUP BY 1""")
def protein_pick(spark, sf_dir):
    from ..operators import identity

    k = F.col("c_custkey")
    candidates = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 40 + _mod(k, 40)).alias("graph_id"), k.alias("pos"), k.alias("record_id"), (_mod(k, 11) == 0).alias("id_exact"), (_mod(k, 7) == 0).alias("symbol_exact"))
    g = F.col("graph_id")
    answers = candidates.select("graph_id").distinct().select("graph_id", (_mod(g * 37, 101) / 100).alias("noul"), _mod(g, 4).cast("string").alias("choice"))
    return identity.pick_protein(candidates, answers)


@query("""SELECT 'g' AS graph_id, 'c:' || c_custkey AS id, '{' || CASE WHEN c_custkey % 2 = 0 THEN '"organism":"' || c_mktsegment || '",' ELSE '' END || '"type":"Gene","label":"' || CASE WHEN c_custkey % 3 = 0 THEN 'c:' || c_custkey ELSE c_name END || '"}' AS node FROM customer""")
def node_projection(spark, sf_dir):
    from ..operators import graph

    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(F.lit("g").alias("graph_id"), F.concat(F.lit("c:"), k).alias("id"), F.lit("Gene").alias("type"), F.when(_mod(k, 3) == 0, "").otherwise(F.col("c_name")).alias("label"), F.create_map(F.lit("organism"), F.when(_mod(k, 2) == 0, F.col("c_mktsegment"))).alias("attrs"))
    return graph.node_projection(nodes)


@query("""WITH r AS (SELECT p_size AS graph_id, p_partkey AS accession, row_number() OVER (PARTITION BY p_size ORDER BY p_type <> 'ECONOMY' DESC, p_partkey) AS rank FROM part) SELECT graph_id, accession FROM r WHERE rank > 1""")
def corroborating_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select(F.col("p_size").alias("graph_id"), F.col("p_partkey").alias("accession"), (F.col("p_type") != "ECONOMY").alias("reviewed"))
    picked = stages.reviewed_first(hits, ["graph_id"], ["accession"], 1)
    return stages.corroborating(hits, picked, ["graph_id"], "accession").select("graph_id", "accession")
