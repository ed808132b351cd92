"""Queries of the source normalizers and of whole resolutions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import snapshots
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


@query("""WITH l AS (SELECT l_orderkey, list(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'GCF_' || l_suppkey END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS a, list('NC_' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS g FROM lineitem GROUP BY 1)
 SELECT CAST(o_orderkey AS VARCHAR) AS gene_id, o_orderpriority AS symbol, CAST(o_custkey AS VARCHAR) AS tax_id, a[1] AS assembly_accession, array_to_string(list_filter(a, lambda x: x IS NOT NULL), ',') AS assemblies, array_to_string(g, ',') AS genomic FROM orders JOIN l ON l_orderkey = o_orderkey""")
def flatten_records(spark, sf_dir):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    note = F.struct(F.when(_mod(F.col("l_linenumber"), 4) != 0, F.concat(F.lit("GCF_"), F.col("l_suppkey"))).alias("assembly_accession"), F.array(F.struct(F.concat(F.lit("NC_"), F.col("l_partkey")).alias("genomic_accession_version"))).alias("genomic_locations"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), note.alias("a")))), lambda x: x["a"]).alias("annotations"))
    raw = table(spark, sf_dir, "orders").join(items, "o_orderkey").select(F.struct(F.col("o_orderkey").cast("string").alias("gene_id"), F.col("o_orderpriority").alias("symbol"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("locus_tag"), F.col("o_custkey").cast("string").alias("tax_id"), F.lit("").alias("taxname"), "annotations").alias("gene"))
    flat = snapshots.gene_reports(raw)
    return flat.select("gene_id", "symbol", "tax_id", "assembly_accession", F.array_join("assembly_accessions", ",").alias("assemblies"), F.array_join("genomic_accessions", ",").alias("genomic"))


@query("""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain, list_sort(list_distinct(regexp_extract_all(html || ' NM_' || page_id || '.1 XP_' || page_id, '\\b[NX][MR]_[0-9]+(?:\\.[0-9]+)?'))) AS tx, list_sort(list_distinct(regexp_extract_all(html || ' NM_' || page_id || '.1 XP_' || page_id, '\\b[NXYW]P_[0-9]+(?:\\.[0-9]+)?'))) AS px FROM pages) SELECT page_id, sha256(plain) AS plain, array_to_string(tx, ',') AS transcripts, array_to_string(px, ',') AS proteins FROM t""")
def text_extracts(spark, sf_dir):
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.concat(F.col("html"), F.lit(" NM_"), k, F.lit(".1 XP_"), k).alias("report"))
    return pages.select("page_id", F.sha2(snapshots.without_tags(F.col("html")), 256).alias("plain"), F.array_join(snapshots.product_accessions(F.col("report"), "transcript"), ",").alias("transcripts"), F.array_join(snapshots.product_accessions(F.col("report"), "protein"), ",").alias("proteins"))


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE list_contains(list_transform(string_split('ECONOMY, STANDARD,, PROMO ', ','), lambda x: trim(x)), p_type) GROUP BY 1")
def vocabulary(spark, sf_dir):
    known = snapshots.vocabulary(spark, "ECONOMY, STANDARD,, PROMO ")
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("category")).join(F.broadcast(known), "category").groupBy("category").agg(F.count("*").alias("n"))


def _arr(*xs):
    return F.array(*xs)


def _st(**xs):
    return F.struct(*(v.alias(k) for k, v in xs.items()))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS gene_id, pmid, link FROM part, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT unnest(CASE k WHEN 0 THEN [CAST(p_size AS VARCHAR), '7'] ELSE [p_brand] END) AS pmid, CASE k WHEN 0 THEN 'cites' ELSE 'rif' END AS link)""")
def citation_links(spark, sf_dir):
    size = F.col("p_size").cast("string")
    sets = _arr(_st(linksetdbs=_arr(_st(linkname=F.lit("cites"), links=_arr(size, F.lit("7"), F.lit(None).cast("string"))), _st(linkname=F.lit("rif"), links=_arr(F.col("p_brand"))))), _st(linksetdbs=_arr(_st(linkname=F.lit("later"), links=_arr(F.lit("x"))))))
    return snapshots.citation_links(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("gene_id"), sets.alias("linksets")))


@query("""SELECT 'veupathdb' AS source, 'PF_' || s_suppkey AS gene_id, (['PlasmoDB', 'ToxoDB', 'OtherDB'])[s_suppkey % 3 + 1] AS project, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS symbol, CAST(s_nationkey AS VARCHAR) AS tax_id, CASE WHEN s_suppkey % 5 = 0 THEN 'https://x.org/' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'https://plasmodb.org/record/gene/PF_' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'https://toxodb.org/record/gene/PF_' || s_suppkey END AS url, 'a' || s_suppkey || ',b' AS alias_names FROM supplier""")
def pathogen_genes(spark, sf_dir):
    k = F.col("s_suppkey")
    alias = lambda x: _st(db=F.lit("d"), alias=x, type=F.lit("t"))
    raw = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("PF_"), k).alias("gene_id"),
        F.element_at(F.array(*map(F.lit, ("PlasmoDB", "ToxoDB", "OtherDB"))), (_mod(k, 3) + 1).cast("int")).alias("project"),
        F.when(_mod(k, 2) == 0, F.col("s_name")).otherwise("").alias("symbol"),
        F.col("s_nationkey").cast("string").alias("tax_id"),
        F.lit("o").alias("organism"),
        F.when(_mod(k, 5) == 0, F.concat(F.lit("https://x.org/"), k)).alias("url"),
        _arr(alias(F.concat(F.lit("a"), k)), alias(F.lit(" ")), alias(F.lit("b ")), alias(F.lit("b"))).alias("aliases"),
    )
    return snapshots.pathogen_genes(raw).select("source", "gene_id", "project", "symbol", "tax_id", "url", F.array_join("alias_names", ",").alias("alias_names"))


@query("SELECT 'g' || c_nationkey AS gene_id, 'o' || c_custkey AS ortholog, c_mktsegment AS organism, c_name AS product, c_custkey % 2 = 0 AS syntenic FROM customer")
def pathogen_orthologs(spark, sf_dir):
    k = F.col("c_custkey")
    one = _arr(_st(gene_id=F.concat(F.lit("o"), k), organism=F.col("c_mktsegment"), product=F.col("c_name"), syntenic=F.when(_mod(k, 2) == 0, "Yes").otherwise("no")))
    return snapshots.pathogen_orthologs(table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), "c_nationkey").alias("gene_id"), one.alias("orthologs")))


@query("SELECT 'g' || p_partkey AS gene_id, p_brand AS go_id, p_name AS term, p_type AS ontology, 'IEA' AS evidence_code, p_size % 3 = 0 AS is_not FROM part")
def pathogen_go(spark, sf_dir):
    one = _arr(_st(go_id=F.col("p_brand"), term=F.col("p_name"), ontology=F.col("p_type"), evidence_code=F.lit("IEA"), is_not=F.when(_mod(F.col("p_size"), 3) == 0, "NOT")))
    return snapshots.pathogen_go(table(spark, sf_dir, "part").select(F.concat(F.lit("g"), "p_partkey").alias("gene_id"), one.alias("terms")))


@query("SELECT 'g' || doc_id % 100 AS gene_id, CAST(doc_id AS VARCHAR) AS pmid, lang AS title, source AS authors, '10.1/' || doc_id AS doi FROM documents WHERE doc_id % 3 <> 0")
def curated_citations(spark, sf_dir):
    k = F.col("doc_id")
    one = _arr(_st(pubmed_id=F.when(_mod(k, 3) != 0, k.cast("string")).otherwise(""), title=F.col("lang"), authors=F.col("source"), doi=F.concat(F.lit("10.1/"), k)))
    return snapshots.curated_citations(table(spark, sf_dir, "documents").select(F.concat(F.lit("g"), _mod(k, 100)).alias("gene_id"), one.alias("publications")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, c_name AS name, c_mktsegment AS summary, 'RNA-seq' AS type, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey END AS pmid, CASE WHEN c_custkey % 2 = 0 THEN 'cited' END AS citation FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey")
def dataset_records(spark, sf_dir):
    k = F.col("c_custkey")
    cited = F.when(_mod(k, 2) == 0, _arr(_st(pmid=F.concat(F.lit("p"), k), citation=F.lit("cited")), _st(pmid=F.lit("q"), citation=F.lit("later"))))
    raw = table(spark, sf_dir, "customer").select(k.cast("string").alias("dataset_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary"), F.lit("RNA-seq").alias("type"), cited.alias("publications"))
    return snapshots.dataset_records(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("dataset_id")), raw)


@query("""WITH h AS (SELECT CAST(p_partkey AS VARCHAR) AS uid, p_brand AS name, lower(p_type) AS word FROM part), q AS (SELECT s_suppkey AS graph_id, CASE s_suppkey % 3 WHEN 0 THEN 'brand#' || (10 + s_suppkey % 20) WHEN 1 THEN 'economy' ELSE 'nothing' END AS k FROM supplier),
 e AS (SELECT graph_id, uid, 0 AS how FROM q JOIN h ON k = lower(name)), w AS (SELECT graph_id, uid, 1 AS how FROM q JOIN h ON k = word WHERE graph_id NOT IN (SELECT graph_id FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY how, uid) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM w)) SELECT graph_id, uid, how, n FROM r WHERE n <= 20""")
def gene_search(spark, sf_dir):
    k = F.col("s_suppkey")
    queries = table(spark, sf_dir, "supplier").select(k.alias("graph_id"), F.when(_mod(k, 3) == 0, F.concat(F.lit("Brand#"), _mod(k, 20) + 10)).when(_mod(k, 3) == 1, "Economy ").otherwise("nothing").alias("query"))
    hits = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uid"), F.col("p_brand").alias("name"), F.col("p_type").alias("description"), F.lit("").alias("otheraliases"))
    return snapshots.gene_search(queries, hits).select("graph_id", "uid", "how", "n")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS tax_id, CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_regionkey WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey AS VARCHAR) END AS species_tax_id, CASE WHEN n_nationkey % 3 = 0 THEN 'up' WHEN n_nationkey % 3 = 1 THEN n_name END AS species_name FROM nation""")
def taxon_species(spark, sf_dir):
    k = F.col("n_nationkey")
    up = _arr(_st(tax_id=F.concat(F.lit("r"), "n_regionkey"), name=F.lit("up"), rank=F.when(_mod(k, 3) == 0, "species").otherwise("genus")))
    raw = table(spark, sf_dir, "nation").select(k.cast("string").alias("tax_id"), F.col("n_name").alias("name"), F.when(_mod(k, 3) == 1, "species").otherwise("strain").alias("rank"), F.when(_mod(k, 3) != 1, up).alias("lineage"))
    return snapshots.taxa(raw).select("tax_id", "species_tax_id", "species_name")


@query("SELECT 'GCF_' || s_suppkey AS accession, s_name AS name, 'Complete' AS level, s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 AS refseq, 'd' || s_nationkey AS submission_date FROM supplier")
def assembly_records(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(F.concat(F.lit("GCF_"), k).alias("accession"), F.col("s_name").alias("name"), F.lit("o").alias("organism"), F.lit("1").alias("tax_id"), F.lit("Complete").alias("level"), F.when(_mod(k, 3) == 0, "reference").alias("category"), F.when(_mod(k, 4) == 0, True).alias("refseq"), F.concat(F.lit("d"), "s_nationkey").alias("submission_date"))
    return snapshots.assemblies(raw).select("accession", "name", "level", "refseq", "submission_date")


@query("""WITH c AS (SELECT 'GSE' || o_orderkey AS accession, o_custkey, o_orderstatus AS taxon FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT c_custkey AS graph_id, accession, row_number() OVER (PARTITION BY c_custkey ORDER BY accession) AS n FROM customer JOIN c ON o_custkey = c_custkey AND taxon = 'O') SELECT graph_id, accession FROM r WHERE n <= 20""")
def catalogue_datasets(spark, sf_dir):
    genes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_custkey").cast("string").alias("symbol"), F.lit("O").alias("organism"))
    k = F.col("o_orderkey")
    catalogue = table(spark, sf_dir, "orders").select(F.concat(F.when(_mod(k, 5) == 0, "GPL").otherwise("GSE"), k).alias("accession"), F.col("o_custkey").cast("string").alias("gene"), F.col("o_orderstatus").alias("taxon"))
    return snapshots.datasets_for(genes, catalogue).select("graph_id", "accession")


@query("""WITH v AS (SELECT l_orderkey AS dataset, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 3), m AS (SELECT dataset, round(avg(l_quantity), 3) AS x, round(avg(l_quantity + 1), 3) AS y FROM v WHERE l_linenumber <> 2 GROUP BY 1), s AS (SELECT dataset, 's1' AS sample, x AS value, 0 AS p FROM m UNION ALL SELECT dataset, 's2', y, 1 FROM m)
 SELECT dataset, sample, value, round(100.0::DOUBLE * (row_number() OVER (PARTITION BY dataset ORDER BY value, p) - 1), 1) AS percentile FROM s""")
def soft_matrix(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("dataset"), (n + 1).alias("line_no"), F.concat_ws("\t", F.concat(F.lit("p"), n), F.when(n != 2, "ABC").otherwise("xyz"), F.col("l_quantity").cast("string"), (F.col("l_quantity") + 1).cast("string")).alias("line"))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset"), F.inline(_arr(_st(line_no=F.lit(0), line=F.lit("!dataset_table_begin")), _st(line_no=F.lit(1), line=F.lit("ID_REF\tIDENTIFIER\ts1\ts2")))))
    return snapshots.soft_values(heads.unionByName(rows), "abc")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS gene_id, 'd' AS dataset_id, coalesce(array_to_string(list_sort(list_distinct(list('s' || l_linenumber % 3) FILTER (WHERE l_linenumber % 4 <> 0))), ','), '') AS samples, count(*) FILTER (WHERE l_linenumber % 4 <> 0) AS n FROM lineitem GROUP BY 1""")
def gene_measurements(spark, sf_dir):
    n = F.col("l_linenumber")
    one = _st(sample=F.concat(F.lit("s"), _mod(n, 3)), value=F.when(_mod(n, 4) != 0, F.lit("1")), percentile=F.lit("2"))
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("gene_id")).agg(F.collect_list(one).alias("rows")).withColumn("dataset_id", F.lit("d"))
    return snapshots.measurements(raw).select("gene_id", "dataset_id", F.array_join("sample_names", ",").alias("samples"), F.size("values").cast("long").alias("n"))


@query("SELECT p_brand AS name, 1 AS n_members, 'm' || p_partkey AS id, p_type AS species, p_size > 25 AS core FROM part")
def orthogroup_members(spark, sf_dir):
    one = _arr(_st(id=F.concat(F.lit("m"), "p_partkey"), species=F.col("p_type"), core=F.col("p_size") > 25))
    return snapshots.group_members(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit(1).alias("n_members"), one.alias("members")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS gene_id, o_orderkey AS entry_nr, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS species, CAST(o_custkey % 9 AS VARCHAR) AS tax_id, 'm:n' AS rel_type, o_totalprice AS score FROM orders")
def ortholog_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    species = _st(name=F.when(_mod(k, 2) == 0, F.col("o_orderstatus")), species=F.col("o_orderpriority"), taxon_id=_mod(F.col("o_custkey"), 9).cast("string"))
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("gene_id"), k.alias("entry_nr"), F.lit("o").alias("omaid"), F.lit("c").alias("canonical_id"), species.alias("species"), F.lit("m:n").alias("rel_type"), F.lit(1.0).alias("distance"), F.col("o_totalprice").alias("score"))
    return snapshots.orthologs(raw).select("gene_id", "entry_nr", "species", "tax_id", "rel_type", "score")


_ENTRY = """e AS (SELECT 'A' || p_partkey AS accession, p_brand AS gene_name, 'o' || p_size % 3 AS organism, p_partkey % 2 = 0 AS reviewed FROM part)"""


def _entries(spark, sf_dir):
    k = F.col("p_partkey")
    ref = lambda db, id_, **props: _st(database=F.lit(db), id=id_, properties=_arr(*(_st(key=F.lit(a), value=b) for a, b in props.items())))
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit("A"), k).alias("primaryAccession"),
        F.concat(F.lit("E_"), k).alias("uniProtkbId"),
        F.when(_mod(k, 2) == 0, "UniProtKB reviewed (Swiss-Prot)").otherwise("UniProtKB unreviewed (TrEMBL)").alias("entryType"),
        F.col("p_brand").alias("gene"),
        F.col("p_name").alias("protein"),
        F.concat(F.lit("o"), _mod(F.col("p_size"), 3)).alias("organism"),
        F.lit("1").alias("tax_id"),
        _arr(ref("GO", F.lit("GO:1"), GoTerm=F.concat(F.lit("P:"), "p_type"), GoEvidenceType=F.lit("IEA:UniProt")), ref("KEGG", F.concat(F.lit("k:"), k), x=F.lit("y")), ref("Pfam", F.lit("PF1"), EntryName=F.lit("dom"))).alias("uniProtKBCrossReferences"),
        _arr(F.lit("kw")).alias("keywords"),
    )
    return snapshots.proteins(raw)


@query(f"WITH {_ENTRY} SELECT accession, gene_name, organism, reviewed, 'process' AS aspect, p_type AS term, 'IEA' AS evidence, 'k:' || p_partkey AS kegg, 'dom' AS domain FROM e JOIN part ON 'A' || p_partkey = accession")
def protein_entries(spark, sf_dir):
    go = F.col("go_terms")[0]
    return _entries(spark, sf_dir).select("accession", "gene_name", "organism", "reviewed", go["aspect"].alias("aspect"), go["term"].alias("term"), go["evidence"].alias("evidence"), F.array_join("kegg", ",").alias("kegg"), F.col("pfam")[0]["name"].alias("domain"))


@query(f"WITH {_ENTRY}, q AS (SELECT s_suppkey AS graph_id, 'brand#' || (10 + s_suppkey % 30) AS symbol, 'o' || s_suppkey % 3 AS organism FROM supplier), r AS (SELECT graph_id, accession, row_number() OVER (PARTITION BY graph_id ORDER BY reviewed DESC, accession) AS n FROM q JOIN e ON symbol = lower(gene_name) AND q.organism = e.organism) SELECT * FROM r WHERE n <= 3")
def protein_search(spark, sf_dir):
    k = F.col("s_suppkey")
    queries = table(spark, sf_dir, "supplier").select(k.alias("graph_id"), F.concat(F.lit("BRAND#"), _mod(k, 30) + 10).alias("symbol"), F.concat(F.lit("o"), _mod(k, 3)).alias("organism"))
    return snapshots.protein_search(queries, _entries(spark, sf_dir)).select("graph_id", "accession", "n")


@query("SELECT s_suppkey AS graph_id, 'A' || s_suppkey AS accession, p_brand AS gene_name FROM supplier JOIN part ON p_partkey = s_suppkey")
def protein_by_accession(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("graph_id"), F.concat(F.lit("a"), "s_suppkey").alias("accession"))
    return snapshots.entries_by_accession(wanted, _entries(spark, sf_dir)).select("graph_id", "accession", "gene_name")


@query("SELECT 'hsa:' || p_partkey AS gene, 'p' || p_size AS pathway_id, s_name AS name FROM part LEFT JOIN supplier ON s_suppkey = p_size")
def pathway_links(spark, sf_dir):
    links = table(spark, sf_dir, "part").select(F.concat(F.lit("hsa:"), "p_partkey").alias("gene"), F.concat(F.lit("path:p"), "p_size").alias("pathway"))
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("path:p"), "s_suppkey").alias("pathway"), F.concat("s_name", F.lit(" - Homo sapiens")).alias("name"))
    return snapshots.pathways(links, names)


@query("SELECT s_suppkey AS graph_id, 'E' || p_partkey AS accession FROM supplier JOIN part ON p_size = s_suppkey")
def catalogue_experiments(spark, sf_dir):
    genes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("graph_id"), F.concat(F.lit("SZ"), "s_suppkey").alias("symbol"), F.lit("Homo sapiens").alias("organism"))
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit("E"), "p_partkey").alias("accession"), F.concat(F.col("p_name"), F.lit(" in sz"), "p_size").alias("experimentDescription"), F.lit("H. sapiens").alias("species"))
    return snapshots.experiments_for(genes, raw).select("graph_id", "accession")


@query("""WITH f AS (SELECT l_suppkey AS dataset, min(l_orderkey) AS o FROM lineitem GROUP BY 1), m AS (SELECT dataset, l_linenumber, round(avg(l_quantity), 3) AS value FROM lineitem JOIN f ON l_suppkey = dataset AND l_orderkey = o GROUP BY 1, 2)
 SELECT dataset, 's' || l_linenumber AS sample, value, CASE WHEN count(*) OVER (PARTITION BY dataset) > 1 THEN round(100.0::DOUBLE * (row_number() OVER (PARTITION BY dataset ORDER BY value, l_linenumber) - 1) / (count(*) OVER (PARTITION BY dataset) - 1), 1) END AS percentile FROM m""")
def baseline_matrix(spark, sf_dir):
    n = F.col("l_linenumber")
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("dataset"), F.col("l_orderkey").alias("line_no"), n.alias("pos")).agg(F.array_join(F.collect_list(F.col("l_quantity").cast("string")), ",").alias("cell"))
    cells = one.select("dataset", "line_no", F.lit("ENSG1").alias("id"), F.lit("Abc").alias("name"), F.concat(F.lit("s"), "pos").alias("sample"), "pos", "cell")
    return snapshots.baseline_values(snapshots.matrix_row(cells, "ABC"))


@query("SELECT l_suppkey AS dataset, min(l_orderkey) AS row_no, 'c' || l_linenumber AS contrast, min(l_quantity) AS value, CASE WHEN l_linenumber % 2 = 0 THEN min(l_discount) END AS p_value FROM lineitem GROUP BY l_suppkey, l_linenumber")
def contrast_matrix(spark, sf_dir):
    n = F.col("l_linenumber")
    one = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_orderkey").alias("row_no"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    each = one.select(F.col("l_suppkey").alias("dataset"), "row_no", F.inline(_arr(_st(pos=n * 2, column=F.concat(F.lit("c"), n, F.lit(".log2foldchange")), cell=F.col("q").cast("string")), _st(pos=n * 2 + 1, column=F.concat(F.lit("c"), n, F.lit(".p-value")), cell=F.when(_mod(n, 2) == 0, F.col("d").cast("string")).otherwise("NA")))))
    header = each.select("dataset", "pos", "column").distinct()
    values = snapshots.contrast_values(header, each.select("dataset", "pos", "cell"))
    rows = one.select(F.col("l_suppkey").alias("dataset"), F.concat(F.lit("c"), n).alias("contrast"), "row_no")
    return values.hint("shuffle_merge").join(rows.hint("shuffle_merge"), ["dataset", "contrast"])


@query("SELECT lang AS gene, 's' || doc_id % 3 AS stage, 'q' || doc_id AS qid, 'ask ' || doc_id AS question, CASE WHEN doc_id % 2 = 0 THEN 'yes' END AS answer FROM documents")
def recorded_asks(spark, sf_dir):
    k = F.col("doc_id")
    q = F.concat(F.lit("q"), k)
    answers = F.create_map(F.when(_mod(k, 2) == 0, q).otherwise("other"), F.lit("yes"))
    raw = table(spark, sf_dir, "documents").select(F.col("lang").alias("gene"), F.concat(F.lit("s"), _mod(k, 3)).alias("stage"), F.lit("state").alias("state"), F.create_map(q, F.concat(F.lit("ask "), k)).alias("questions"), answers.alias("jev_answers"))
    return snapshots.asked_questions(raw).select("gene", "stage", "qid", "question", "answer")


@query("SELECT o_orderstatus AS name, max(o_orderpriority || o_orderkey) AS file FROM orders GROUP BY 1")
def latest_runs(spark, sf_dir):
    return snapshots.latest(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"), F.concat("o_orderpriority", "o_orderkey").alias("file")))


@query("""WITH c AS (SELECT c_custkey AS k, 'r' || c_custkey AS graph_id, c_custkey % 7 AS depth, 'ncbigene:' || c_custkey AS gene, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'SYM' || c_custkey ELSE c_name END AS query, c_name, c_nationkey, 'GCF_' || c_custkey % 97 || '.1' AS own, c_custkey % 97 AS num FROM customer),
 a AS (SELECT DISTINCT 'GCF_' || s_suppkey % 97 || '.' || s_suppkey % 4 AS other, s_nationkey, s_suppkey % 97 AS num, s_suppkey % 4 AS ver FROM supplier), rel AS (SELECT c.*, a.other, a.ver, a.num AS num_1 FROM c JOIN a ON s_nationkey = c_nationkey AND other <> own WHERE depth >= 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 1e6 DESC, o_orderkey, CAST(o_orderkey AS VARCHAR)) AS n FROM orders),
 raw AS (SELECT graph_id, query AS subject, 'is_a' AS predicate, 'idtype:' || (['ncbi_gene', 'gene_symbol', 'locus_tag'])[k % 3 + 1] AS object, 1.0::DOUBLE AS confidence, 'id_type' AS q FROM c
 UNION ALL SELECT graph_id, query, 'same_as', gene, 1.0, 'gene_match' FROM c WHERE depth >= 1 UNION ALL SELECT graph_id, gene, 'has_alias', 'alias:' || c_name, 1.0, '' FROM c WHERE depth >= 1 AND lower(c_name) <> lower(query)
 UNION ALL SELECT graph_id, gene, 'in_organism', 'taxon:' || c_nationkey, 1.0, 'gene_match' FROM c WHERE depth >= 1 UNION ALL SELECT graph_id, gene, 'in_assembly', 'assembly:' || own, 1.0, 'gene_match' FROM c WHERE depth >= 1
 UNION ALL SELECT graph_id, 'assembly:' || own, 'related_assembly', 'assembly:' || other, 1.0, '' FROM rel UNION ALL SELECT graph_id, 'assembly:' || own, 'superseded_by', 'assembly:' || other, 1.0, '' FROM rel WHERE rel.num = rel.num_1 AND ver > 1
 UNION ALL SELECT graph_id, gene, 'ortholog_of', 'gene:' || o_orderkey, 1.0, '' FROM c JOIN o ON o_custkey = k WHERE depth >= 3 AND n <= 100 UNION ALL SELECT graph_id, gene, 'measured_in', 'dataset:GSE' || o_orderkey, o_totalprice / 1e6, 'relevant' FROM c JOIN o ON o_custkey = k WHERE depth >= 5
 UNION ALL SELECT graph_id, gene, 'annotated_in', 'assembly:' || own, 1.0, '' FROM c WHERE depth >= 6)
 SELECT graph_id, subject, predicate, object, max(confidence) AS confidence, max(q) AS jev_question_id, count(*) AS n_raw FROM raw GROUP BY 1, 2, 3, 4""")
def resolve_all(spark, sf_dir):
    from .resolve import resolve

    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = k.cast("string")
    genes = c.select(text.alias("gene_id"), F.concat(F.lit("SYM"), k).alias("symbol"), F.concat(F.lit("LT_"), k).alias("locus_tag"), F.col("c_nationkey").cast("string").alias("tax_id"), F.col("c_mktsegment").alias("organism"), F.concat(F.lit("GCF_"), _mod(k, 97), F.lit(".1")).alias("assembly_accession"), F.array(F.col("c_name"), F.lit("")).alias("aliases"))
    queries = c.select(F.concat(F.lit("r"), k).alias("graph_id"), F.when(_mod(k, 3) == 0, text).when(_mod(k, 3) == 1, F.concat(F.lit("SYM"), k)).otherwise(F.col("c_name")).alias("query"), (_mod(k, 7)).cast("int").alias("depth"))
    answers = c.select(F.concat(F.lit("r"), k).alias("graph_id"), F.lit("locus_tag").alias("namespace"), (_mod(k * 37, 101) / 100).alias("noul"), F.lit("0").alias("choice"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("gene_id"), F.col("o_orderkey").cast("string").alias("ortholog"), F.lit("0").alias("ortholog_tax"), (F.col("o_totalprice") / 1e6).alias("score"), F.col("o_orderkey").alias("pos"))
    s = table(spark, sf_dir, "supplier")
    sources = {
        "genes": genes,
        "assemblies": s.select(F.concat(F.lit("GCF_"), _mod(F.col("s_suppkey"), 97), F.lit("."), _mod(F.col("s_suppkey"), 4)).alias("accession"), F.col("s_nationkey").cast("string").alias("tax_id")).distinct(),
        "orthologs": orders,
        "datasets": orders.select("gene_id", F.concat(F.lit("GSE"), "ortholog").alias("accession"), "score", F.lit(False).alias("other_species")),
        "annotated": genes.select("gene_id", F.col("assembly_accession").alias("accession")),
    }
    _, edges, _ = resolve(queries, sources, answers)
    return edges.drop("evidence")
