"""Queries of identity resolution and of the stage joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions.links import entity_link
from ..operators import identity, stages
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


_IDENT = """ident AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') WHEN 2 THEN 'NM_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 3 THEN 'P' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0')
 WHEN 4 THEN 'PF3D7_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') WHEN 5 THEN 'BRCA' || p_partkey ELSE replace(p_name, ' ', '-') || p_partkey END AS id FROM part),
 hinted AS (SELECT *, list_filter([CASE WHEN regexp_matches(id, '^[A-Z]{2,3}_[0-9]+\\.?[0-9]*$') THEN 'refseq' END, CASE WHEN regexp_matches(id, '^ENS[A-Z]{0,6}G[0-9]+$') THEN 'ensembl' END, CASE WHEN regexp_matches(id, '^[OPQ][0-9][A-Z0-9]{3}[0-9]$|^[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9]$') THEN 'uniprot' END,
 CASE WHEN regexp_matches(id, '^[A-Za-z][A-Za-z0-9]{1,9}[_.][0-9][\\w.]*$') THEN 'veupathdb' END, CASE WHEN regexp_matches(id, '^[0-9]{1,10}$') THEN 'ncbi_gene' END, CASE WHEN regexp_matches(id, '^[A-Z][A-Z0-9]{2,15}$') THEN 'gene_symbol' END, CASE WHEN regexp_matches(id, '^[A-Za-z][\\w.-]{2,}$') THEN 'locus_tag' END], lambda x: x IS NOT NULL) AS h0 FROM ident),
 hints AS (SELECT p_partkey, id, CASE WHEN len(h0) > 1 THEN list_filter(h0, lambda x: x <> 'locus_tag') ELSE h0 END AS h FROM hinted)"""


def _idents(spark, sf_dir):
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    m = _mod(k, 7)
    made = (
        F.when(m == 0, text).when(m == 1, F.concat(F.lit("ENSG"), F.lpad(text, 11, "0"))).when(m == 2, F.concat(F.lit("NM_"), F.lpad(text, 6, "0"))).when(m == 3, F.concat(F.lit("P"), F.lpad(_mod(k, 100000).cast("string"), 5, "0")))
        .when(m == 4, F.concat(F.lit("PF3D7_"), F.lpad(text, 7, "0"))).when(m == 5, F.concat(F.lit("BRCA"), text)).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), text))
    )
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("id"))


@query(f"WITH {_IDENT} SELECT id, array_to_string(h, ',') AS hints FROM hints")
def namespace_hints(spark, sf_dir):
    return _idents(spark, sf_dir).select("id", F.array_join(I.namespace_hints(F.col("id")), ",").alias("hints"))


@query(f"WITH {_IDENT} SELECT id, CASE WHEN len(h) <= 1 THEN coalesce(h[1], 'locus_tag') WHEN p_partkey % 11 = 0 THEN NULL ELSE h[p_partkey % len(h) + 1] END AS namespace, CASE WHEN len(h) <= 1 THEN 1.0::DOUBLE WHEN p_partkey % 11 = 0 THEN 0.0::DOUBLE ELSE ((p_partkey * 37) % 101) / 100.0::DOUBLE END AS confidence, 'is_a' AS predicate FROM hints")
def namespace_pick(spark, sf_dir):
    hinted = _idents(spark, sf_dir).withColumn("h", I.namespace_hints(F.col("id")))
    answers = hinted.filter(_mod(F.col("p_partkey"), 11) != 0).filter(F.size("h") > 1).select("p_partkey", F.element_at("h", (F.pmod(F.col("p_partkey"), F.size("h")) + 1).cast("int")).alias("choice"), (_mod(F.col("p_partkey") * 37, 101) / 100).alias("noul"))
    out = hinted.join(answers, "p_partkey", "left")
    alone = F.size("h") <= 1
    return out.select("id", I.namespace_choice(F.col("h"), F.col("choice")).alias("namespace"), F.when(alone, 1.0).otherwise(I.score_of(F.col("noul"), F.lit(None).cast("double"))).alias("confidence"), F.lit("is_a").alias("predicate"))


_KINDS = ("ncbigene", "assembly", "taxon", "go", "kegg", "domain", "dataset", "pubmed", "orthogroup", "alias")


@query("""WITH n AS (SELECT p_partkey AS k, (['ncbigene', 'assembly', 'taxon', 'go', 'kegg', 'domain', 'dataset', 'pubmed', 'orthogroup', 'alias'])[p_partkey % 10 + 1] AS pre, p_partkey % 13 = 0 AS safe, p_partkey % 17 = 0 AS unsafe, CASE WHEN p_partkey % 4 = 0 THEN 'pfam' ELSE '' END AS ns FROM part)
 SELECT pre || ':' || k AS id, CASE WHEN safe AND NOT unsafe THEN 'https://example.org:8443/' || k WHEN pre = 'ncbigene' THEN 'https://www.ncbi.nlm.nih.gov/gene/' || k WHEN pre = 'assembly' THEN 'https://www.ncbi.nlm.nih.gov/datasets/genome/' || k || '/' WHEN pre = 'taxon' THEN 'https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=' || k
 WHEN pre = 'go' THEN 'https://www.ebi.ac.uk/QuickGO/term/' || k WHEN pre = 'kegg' THEN 'https://www.kegg.jp/entry/' || k WHEN pre = 'domain' AND ns = 'pfam' THEN 'https://www.ebi.ac.uk/interpro/entry/pfam/' || k WHEN pre = 'domain' THEN 'https://www.ebi.ac.uk/interpro/entry/InterPro/' || k
 WHEN pre = 'dataset' THEN 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || k WHEN pre = 'pubmed' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || k || '/' WHEN pre = 'orthogroup' THEN 'https://orthomcl.org/orthomcl/app/record/group/' || k END AS url FROM n""")
def entity_url(spark, sf_dir):
    k = F.col("p_partkey")
    pre = F.element_at(F.array(*map(F.lit, _KINDS)), (_mod(k, 10) + 1).cast("int"))
    url = F.when(_mod(k, 17) == 0, F.concat(F.lit("https://example.org:99999/"), k)).when(_mod(k, 13) == 0, F.concat(F.lit("https://example.org:8443/"), k))
    rows = table(spark, sf_dir, "part").select(F.concat(pre, F.lit(":"), k).alias("id"), F.when(pre == "ncbigene", "Gene").otherwise("Other").alias("type"), F.when(_mod(k, 4) == 0, "pfam").otherwise("").alias("ns"), F.create_map(F.lit("url"), url).alias("attrs"))
    return rows.select("id", entity_link(F.col("type"), F.col("ns"), F.col("id"), F.col("attrs")).alias("url"))


@query("""WITH r AS (SELECT c_custkey AS record_id, unnest([lower(c_name), lower(c_mktsegment) || c_nationkey, CAST(c_custkey AS VARCHAR)]) AS key FROM customer), q AS (SELECT c_custkey AS graph_id, lower(trim(CASE c_custkey % 3 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN c_mktsegment || c_nationkey ELSE 'none' || c_custkey END)) AS key FROM customer)
 SELECT DISTINCT graph_id, record_id FROM q JOIN r USING (key)""")
def exact_id_match(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    records = c.select(k.alias("record_id"), F.array(F.col("c_name"), F.concat("c_mktsegment", "c_nationkey"), k.cast("string"), F.lit(None).cast("string")).alias("ids"))
    asked = F.when(_mod(k, 3) == 0, F.concat(F.lit(" "), F.upper("c_name"))).when(_mod(k, 3) == 1, F.concat("c_mktsegment", "c_nationkey")).otherwise(F.concat(F.lit("none"), k))
    return identity.exact_matches(c.select(k.alias("graph_id"), asked.alias("query")), records)


@query("""WITH c AS (SELECT c_nationkey * 40 + c_custkey % 40 AS graph_id, c_custkey AS record_id, c_custkey % 9 = 0 AS exact FROM customer), n AS (SELECT *, count(*) FILTER (WHERE exact) OVER (PARTITION BY graph_id) AS n_exact FROM c),
 p AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY record_id) - 1 AS k, count(*) OVER (PARTITION BY graph_id) AS pool FROM n WHERE n_exact = 0 OR exact),
 a AS (SELECT *, CASE WHEN graph_id % 11 <> 0 THEN ((graph_id * 37) % 101) / 100.0::DOUBLE END AS noul, CASE WHEN graph_id % 11 <> 0 THEN CASE WHEN graph_id % 5 = 0 THEN 'none' ELSE CAST(graph_id % 4 AS VARCHAR) END END AS choice FROM p),
 t AS (SELECT *, coalesce(CASE WHEN n_exact = 1 THEN true WHEN pool = 1 THEN noul >= 0.5 ELSE try_cast(choice AS INT) = k END, false) AS taken FROM a)
 SELECT graph_id, CASE WHEN bool_or(taken) THEN 'resolved' ELSE 'refused' END AS outcome, max(record_id) FILTER (WHERE taken) AS record_id, max(CASE WHEN n_exact = 1 THEN 1.0::DOUBLE ELSE coalesce(noul, 0.0::DOUBLE) END) FILTER (WHERE taken) AS confidence, max(n_exact) AS n_exact, max(pool) AS pool FROM t GROUP BY 1""")
def pick_candidate(spark, sf_dir):
    k = F.col("c_custkey")
    candidates = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 40 + _mod(k, 40)).alias("graph_id"), k.alias("pos"), k.alias("record_id"), (_mod(k, 9) == 0).alias("exact"))
    g = F.col("graph_id")
    answers = candidates.select("graph_id").distinct().filter(_mod(g, 11) != 0).select("graph_id", (_mod(g * 37, 101) / 100).alias("noul"), F.when(_mod(g, 5) == 0, "none").otherwise(_mod(g, 4).cast("string")).alias("choice"))
    return identity.pick_candidate(candidates, answers)


@query("""WITH q AS (SELECT n_nationkey, 'Q' || n_nationkey AS graph_id FROM nation), f AS (SELECT c_nationkey AS n_nationkey, c_name AS record FROM customer WHERE c_acctbal > 9500), s AS (SELECT s_nationkey AS n_nationkey, s_name AS record FROM supplier)
 SELECT graph_id, n_nationkey, record, 1 AS route FROM q JOIN f USING (n_nationkey) UNION ALL SELECT graph_id, n_nationkey, record, 2 FROM q JOIN s USING (n_nationkey) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM f)""")
def candidate_routing(spark, sf_dir):
    q = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Q"), "n_nationkey").alias("graph_id"))
    first = table(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("record"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("record"))
    return identity.routed(first, second, q, "n_nationkey")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS segment, CASE WHEN o_orderkey % 2 = 0 THEN 'own' END AS name FROM orders) SELECT o_orderkey, o_custkey, coalesce(segment, c_mktsegment) AS segment, coalesce(name, c_name) AS name FROM l LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def record_fill(spark, sf_dir):
    k = F.col("o_orderkey")
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(_mod(k, 3) == 0, F.col("o_orderpriority")).alias("segment"), F.when(_mod(k, 2) == 0, F.lit("own")).alias("name"))
    right = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return identity.fill(left, right, "o_custkey", ["segment", "name"])


@query("""WITH a AS (SELECT s_suppkey, s_nationkey, unnest([s_name, 'S' || s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN '' END]) AS alias FROM supplier) SELECT DISTINCT c_custkey, s_suppkey, 'has_alias' AS predicate, alias AS object FROM customer JOIN a ON c_nationkey = s_nationkey WHERE alias IS NOT NULL AND alias <> '' AND alias <> 'S' || c_custkey
 UNION ALL SELECT c_custkey, s_suppkey, 'cited_in', 'pubmed:9' || s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey""")
def bridge_records(spark, sf_dir):
    s = F.col("s_suppkey")
    aliases = F.array(F.col("s_name"), F.concat(F.lit("S"), s), F.col("s_name"), F.when(_mod(s, 2) == 0, F.lit("")))
    records = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), aliases.alias("aliases"), F.array(F.concat(F.lit("9"), s)).alias("pmids"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return stages.bridge(c, records, "nation", ["c_custkey", "s_suppkey"], F.concat(F.lit("S"), "c_custkey"), "pmids")


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders), l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) SELECT DISTINCT * FROM (SELECT o_custkey AS anchor, 'has_transcript' AS predicate, 'nuccore:' || l_partkey AS object FROM o JOIN l ON o_orderkey = l_orderkey UNION ALL SELECT o_custkey, 'has_protein', 'protein:' || l_suppkey FROM o JOIN l ON o_orderkey = l_orderkey
 UNION ALL SELECT o_custkey, 'in_organism', 'taxon:' || c_nationkey FROM o JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0)""")
def enrichment_fanout(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("anchor"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.array("l_suppkey").alias("l_suppkey"))
    made = stages.fan_out(o, "o_orderkey", "anchor", [(items, "l_partkey", "has_transcript", "nuccore"), (items, "l_suppkey", "has_protein", "protein")])
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").join(o.select(F.col("anchor").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    matches = c.select(F.lit("all").alias("graph_id"), F.col("c_custkey").alias("anchor"), F.col("c_nationkey").cast("string").alias("tax_id"), F.lit(None).cast("string").alias("assembly_accession"))
    return made.unionByName(stages.anchor_claims(matches).select(F.col("subject").alias("anchor"), "predicate", "object"))


@query("""WITH t AS (SELECT n_nationkey, n_name, n_regionkey, (['species', 'strain', 'subspecies'])[n_nationkey % 3 + 1] AS rank, CASE WHEN n_nationkey % 4 = 0 THEN 'subspecies' ELSE 'genus' END AS up FROM nation)
 SELECT n_nationkey, rank <> 'species' OR up = 'subspecies' AS needs_question, array_to_string(list_sort(list_distinct(list_filter([up, rank], lambda x: x IN ('species', 'subspecies', 'genus')))), ',') AS options, CASE WHEN rank = 'species' THEN n_nationkey WHEN up = 'species' THEN n_regionkey + 1000 ELSE n_nationkey + 2000 END AS species_tax FROM t""")
def rank_for_group(spark, sf_dir):
    k = F.col("n_nationkey")
    rank = F.element_at(F.array(F.lit("species"), F.lit("strain"), F.lit("subspecies")), _mod(k, 3) + 1)
    up = F.when(_mod(k, 4) == 0, "subspecies").otherwise("genus")
    t = table(spark, sf_dir, "nation").select(k, rank.alias("rank"), F.array(F.struct((F.col("n_regionkey") + 1000).alias("tax_id"), up.alias("rank"))).alias("lineage"), (k + 2000).alias("species_tax_id"))
    options = F.array_sort(stages.rank_options(F.col("rank"), F.col("lineage")))
    tax = stages.tax_at_rank(F.lit("species"), k, F.col("rank"), F.col("lineage"), F.col("species_tax_id"))
    return t.select("n_nationkey", stages.needs_rank(F.col("rank"), F.col("lineage")).alias("needs_question"), F.array_join(options, ",").alias("options"), tax.alias("species_tax"))


@query("SELECT a.s_suppkey AS source, b.s_suppkey AS related, n_name AS via FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey JOIN nation ON n_nationkey = a.s_nationkey")
def related_items(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("n_nationkey"))
    b = s.select(F.col("s_suppkey").alias("related"), F.col("s_nationkey").alias("n_nationkey"))
    met = stages.related(a, b, "n_nationkey", "source", "related")
    return met.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("via")), "n_nationkey").drop("n_nationkey")


@query("""WITH a AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'GCA_' ELSE 'GCF_' END || l_orderkey || '.' || l_linenumber AS accession, l_orderkey, l_linenumber FROM lineitem) SELECT a.accession AS old, b.accession AS new FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber""")
def supersession(spark, sf_dir):
    n = F.col("l_linenumber")
    made = F.concat(F.when(_mod(n, 2) == 0, "GCA_").otherwise("GCF_"), F.col("l_orderkey"), F.lit("."), n)
    return identity.superseded(table(spark, sf_dir, "lineitem").select(made.alias("accession")))


@query("""WITH q AS (SELECT p_partkey AS graph_id, [CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR), p_brand, CAST(p_partkey AS VARCHAR), p_type, 'x', 'y'] AS k FROM part),
 e AS (SELECT graph_id, unnest([CAST(graph_id AS VARCHAR), CAST(graph_id + 1 AS VARCHAR), k[4], k[6], 'x']) AS key, unnest([0, 1, 2, 3, 4]) AS rank FROM q), r AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS record_id FROM part WHERE p_size > 30 UNION ALL SELECT p_brand, min(p_name) FROM part WHERE p_type = 'ECONOMY' GROUP BY 1)
 SELECT graph_id, rank, key, record_id FROM (SELECT *, min(rank) OVER (PARTITION BY graph_id) AS best FROM e JOIN r USING (key)) WHERE rank = best""")
def priority_retry(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    own, nxt = k.cast("string"), (k + 1).cast("string")
    asked = part.select(k.alias("graph_id"), F.array(own, nxt, nxt, F.col("p_brand"), own, F.col("p_type"), F.lit("x"), F.lit("y")).alias("keys"))
    records = part.filter("p_size > 30").select(own.alias("key"), F.col("p_name").alias("record_id")).unionByName(part.filter("p_type = 'ECONOMY'").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_name").alias("record_id")))
    return identity.first_alternate(asked, "keys", records)


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_linenumber % 5 <> 0 THEN l_discount ELSE 0 END DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS rank FROM lineitem)
 SELECT l_suppkey, l_orderkey, l_partkey, score, rank, CASE WHEN l_partkey % 3 = 0 THEN 'src' || l_partkey WHEN l_partkey % 3 = 1 THEN 'can' || l_partkey ELSE 'oma' || l_partkey END AS ref FROM r WHERE rank <= 100""")
def ortholog_cap(spark, sf_dir):
    p = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("score", F.when(_mod(F.col("l_linenumber"), 5) != 0, F.col("l_discount")))
    top = identity.capped(rows, ["l_suppkey"], F.col("score"), ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"])
    refs = F.array(F.struct(F.lit("Other").alias("source"), F.lit("-").alias("id")), F.struct(F.when(_mod(p, 3) == 0, "SourceID").otherwise("None").alias("source"), F.concat(F.lit("src"), p).alias("id")))
    canonical = F.when(_mod(p, 3) == 1, F.concat(F.lit("can"), p))
    return top.select("l_suppkey", "l_orderkey", "l_partkey", "score", "rank", stages.reference_id(refs, canonical, F.concat(F.lit("oma"), p)).alias("ref"))


@query("""WITH h AS (SELECT p_partkey AS graph_id, c_custkey, c_nationkey FROM part JOIN customer ON c_custkey % 1300 = p_partkey % 1300), w AS (SELECT *, count(DISTINCT c_nationkey) OVER (PARTITION BY graph_id) AS taxa FROM h) SELECT graph_id, min(c_custkey) AS c_custkey, min(c_nationkey) AS tax FROM w WHERE taxa = 1 GROUP BY 1 HAVING count(*) = 1""")
def linked_hits(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("graph_id"), _mod(F.col("p_partkey"), 1300).alias("term"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("tax"), _mod(F.col("c_custkey"), 1300).alias("term"))
    return stages.linked_by_term(p, c, "term", "tax", "c_custkey")


@query("SELECT p_brand AS grp, p_partkey AS member, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 2 = 0 DESC, p_type = 'ECONOMY' DESC, p_partkey) AS place FROM part")
def group_members(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("member"), "p_size", "p_type")
    return stages.member_order(members, ["grp"], _mod(F.col("p_size"), 2) == 0, F.col("p_type") == "ECONOMY", ["member"]).select("grp", "member", "place")


@query("""WITH q AS (SELECT o_orderkey, o_custkey || '-' || o_orderkey % 10 || '.' || o_orderkey % 3 AS id FROM orders), e AS (SELECT o_orderkey, id, unnest([split_part(id, '-', 1), id, split_part(id, '.', 1)]) AS key, unnest([0, 1, 2]) AS rank FROM q), r AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey || '-' || c_custkey % 10 FROM customer WHERE c_custkey % 2 = 1)
 SELECT o_orderkey, arg_min(key, rank) AS hit, min(rank) AS rank FROM e JOIN r USING (key) GROUP BY 1""")
def suffix_probe(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    asked = table(spark, sf_dir, "orders").select(k, F.concat_ws("", "o_custkey", F.lit("-"), _mod(k, 10), F.lit("."), _mod(k, 3)).alias("id"))
    known = table(spark, sf_dir, "customer").select(F.when(_mod(c, 2) == 0, c.cast("string")).otherwise(F.concat(c, F.lit("-"), _mod(c, 10))).alias("key"))
    return stages.suffix_probe(asked, "o_orderkey", "id", known)


@query("""WITH f AS (SELECT p_size AS graph_id, p_partkey AS accession, 'symbol' AS by_what, p_type <> 'ECONOMY' AS reviewed FROM part WHERE p_brand < 'Brand#2'), s AS (SELECT p_size, p_partkey, 'id', p_type <> 'ECONOMY' FROM part WHERE p_brand >= 'Brand#14'), u AS (SELECT * FROM f UNION ALL SELECT * FROM s WHERE p_partkey NOT IN (SELECT accession FROM f)),
 r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY reviewed DESC, accession) AS rank FROM u) SELECT *, rank = 1 AS picked FROM r WHERE rank <= 3""")
def merge_hits(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("graph_id"), F.col("p_partkey").alias("accession"), "p_brand", (F.col("p_type") != "ECONOMY").alias("reviewed"))
    first = part.filter("p_brand < 'Brand#2'").drop("p_brand").withColumn("by_what", F.lit("symbol"))
    second = part.filter("p_brand >= 'Brand#14'").drop("p_brand").withColumn("by_what", F.lit("id"))
    both = identity.merged_hits(first, second, "accession")
    return stages.reviewed_first(both, ["graph_id"], ["accession"], 3)


@query("""WITH a AS (SELECT p_partkey, p_brand AS go_id, (['F:', 'P:', 'C:'])[p_size % 3 + 1] || p_name AS term, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'IEA:' || p_type END AS code, 'path:' || p_size || ' - ' || p_type AS path, lower(p_type) AS src FROM part)
 SELECT go_id, arg_min(substr(term, 3), p_partkey) AS label, arg_min(CASE left(term, 2) WHEN 'F:' THEN 'function' WHEN 'P:' THEN 'process' ELSE 'component' END, p_partkey) AS aspect, count(*) AS n_evidence, string_agg(DISTINCT nullif(split_part(code, ':', 1), ''), ',') AS codes, min(split_part(replace(path, 'path:', ''), ' - ', 1)) AS pathway, min(upper(left(src, 1)) || substr(src, 2)) AS source FROM a GROUP BY 1""")
def annotation_fanout(spark, sf_dir):
    aspect = F.element_at(F.array(F.lit("F:"), F.lit("P:"), F.lit("C:")), _mod(F.col("p_size"), 3) + 1)
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("go_id"), F.concat(aspect, "p_name").alias("term"), F.when(_mod(F.col("p_partkey"), 4) == 0, "").otherwise(F.concat(F.lit("IEA:"), "p_type")).alias("code"), F.concat_ws("", F.lit("path:"), "p_size", F.lit(" - "), "p_type").alias("path"), F.lower("p_type").alias("src"))
    groups = stages.go_groups(a, ["go_id"], "p_partkey")
    rest = a.groupBy("go_id").agg(F.min(stages.bare_pathway(F.col("path"))).alias("pathway"), F.min(F.initcap("src")).alias("source"))
    return groups.join(rest, "go_id")


@query("""WITH c AS (SELECT d.doc_id, d.source AS graph_id, d.lang <> 'en' AS other, CASE WHEN l.quality IS NOT NULL THEN ((d.doc_id * 37) % 101) / 100.0::DOUBLE END AS noul, CASE d.doc_id % 4 WHEN 0 THEN 'SNP array' WHEN 1 THEN 'RNA-Seq' WHEN 2 THEN 'Baseline' ELSE 'misc' END AS t FROM documents d LEFT JOIN labels l USING (doc_id)),
 r AS (SELECT *, count(*) OVER (PARTITION BY graph_id) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY other, coalesce(noul, 0) DESC, doc_id) AS k FROM c)
 SELECT graph_id, doc_id, coalesce(noul, 0.0::DOUBLE) AS score, CASE doc_id % 4 WHEN 0 THEN 'variant' WHEN 3 THEN 'other' ELSE 'expression' END AS kind, k AS place FROM r WHERE n <= 20 OR k <= 20""")
def dataset_relevance(spark, sf_dir):
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(k, F.col("source").alias("graph_id"), (F.col("lang") != "en").alias("other"), F.when(_mod(k, 4) == 0, "SNP array").when(_mod(k, 4) == 1, "RNA-Seq").when(_mod(k, 4) == 2, "Baseline").otherwise("misc").alias("t"))
    answers = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (_mod(k * 37, 101) / 100).alias("noul"))
    rows = docs.join(answers, "doc_id", "left").withColumn("score", I.score_of(F.col("noul"), F.lit(None).cast("double")))
    top = identity.capped_if_many(rows, ["graph_id"], [F.col("other"), F.desc("score"), F.col("doc_id")], most=20)
    return top.select("graph_id", "doc_id", "score", I.dataset_kind(F.col("t")).alias("kind"), F.col("rank").alias("place"))


@query("""WITH v AS (SELECT event_type AS dataset_id, 's' || user_id % 20 AS sample, value FROM events WHERE value > 0), r AS (SELECT (['view', 'signup', 'click', 'purchase', 'error'])[doc_id + 1] AS dataset_id, lang AS name, CASE WHEN doc_id % 2 = 0 THEN source END AS citation, CASE WHEN doc_id % 2 = 0 THEN 'pubmed:' || doc_id END AS described_in FROM documents WHERE doc_id < 5)
 SELECT dataset_id, array_to_string(list_sort(list(DISTINCT sample)), ',') AS samples, count(*) AS n_values, min(name) AS name, min(citation) AS citation, min(described_in) AS described_in FROM v LEFT JOIN r USING (dataset_id) GROUP BY 1""")
def dataset_samples(spark, sf_dir):
    v = table(spark, sf_dir, "events").filter("value > 0").select(F.col("event_type").alias("dataset_id"), F.concat(F.lit("s"), _mod(F.col("user_id"), 20)).alias("sample"), "value")
    each = stages.dataset_samples(v, ["dataset_id"]).withColumn("samples", F.array_join("samples", ","))
    d = F.col("doc_id")
    types = F.array(*map(F.lit, ("view", "signup", "click", "purchase", "error")))
    publications = F.when(_mod(d, 2) == 0, F.array(F.struct(d.cast("string").alias("pmid"), F.col("source").alias("citation"))))
    records = table(spark, sf_dir, "documents").filter("doc_id < 5").select(F.element_at(types, (d + 1).cast("int")).alias("dataset_id"), F.col("lang").alias("name"), F.lit("").alias("summary"), publications.alias("publications"))
    return stages.described_datasets(each, records, "dataset_id").select("dataset_id", "samples", "n_values", "name", "citation", "described_in")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS gene, 'GCA_' || l_suppkey || '.1' AS accession FROM lineitem), a AS (SELECT DISTINCT l_partkey AS gene, 'GCA_' || l_suppkey || '.1' AS accession FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT DISTINCT l_partkey AS gene, CASE WHEN l_orderkey % 2 = 0 THEN 'GCA_' ELSE 'GCF_' END || l_suppkey || '.1' AS seen FROM lineitem WHERE l_linestatus = 'F'),
 o AS (SELECT * FROM p ANTI JOIN a USING (gene, accession)) SELECT gene, accession, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.gene = o.gene AND seen = accession) THEN 'accession' ELSE 'core' END AS via FROM o WHERE EXISTS (SELECT 1 FROM s WHERE s.gene = o.gene AND substr(seen, 5) = substr(accession, 5))""")
def annotated_presence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), "l_suppkey", "l_orderkey", "l_returnflag", "l_linestatus")
    acc = F.concat(F.lit("GCA_"), "l_suppkey", F.lit(".1")).alias("accession")
    places = rows.select("gene", acc).distinct()
    annotated = rows.filter("l_returnflag = 'A'").select("gene", acc)
    seen = rows.filter("l_linestatus = 'F'").select("gene", F.concat(F.when(_mod(F.col("l_orderkey"), 2) == 0, "GCA_").otherwise("GCF_"), F.col("l_suppkey"), F.lit(".1")).alias("seen_accession"))
    return identity.presence(places, annotated, seen)


@query("""WITH g AS (SELECT p_partkey AS gene, p_size AS tax_id, CASE WHEN p_partkey % 3 = 0 THEN left(p_name, 1) || '. ' || split_part(p_name, ' ', 2) ELSE p_name END AS species FROM part), p AS (SELECT p_brand AS place, min(p_size) AS place_tax_id, upper(min(p_name)) || ' strain ' || p_brand AS place_species FROM part GROUP BY p_brand),
 k AS (SELECT gene, tax_id, split_part(lower(species), ' ', 1) AS gg, split_part(lower(species), ' ', 2) AS ge FROM g), l AS (SELECT place, place_tax_id, split_part(lower(place_species), ' ', 1) AS pg, split_part(lower(place_species), ' ', 2) AS pe FROM p)
 SELECT gene, place, CASE WHEN tax_id = place_tax_id THEN 'tax_id' ELSE 'species' END AS matched_on FROM k, l WHERE tax_id = place_tax_id OR (ge = pe AND (gg = pg OR (length(rtrim(gg, '.')) = 1 AND starts_with(pg, rtrim(gg, '.')))))""")
def candidate_species_join(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    short = F.concat(F.substring("p_name", 1, 1), F.lit(". "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    genes = part.select(k.alias("gene"), F.col("p_size").alias("tax_id"), F.when(_mod(k, 3) == 0, short).otherwise(F.col("p_name")).alias("species"))
    brands = part.groupBy(F.col("p_brand").alias("place")).agg(F.min("p_size").alias("place_tax_id"), F.min("p_name").alias("n"))
    places = brands.select("place", "place_tax_id", F.concat(F.upper("n"), F.lit(" strain "), "place").alias("place_species"))
    return identity.species_links(genes, places)
