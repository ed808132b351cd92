"""Resolve many identifiers at once: the staged composition over snapshot tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DATASET_CAP, LONE_HIT_LEAST, ORTHOLOG_CAP
from ..functions import ids as I
from ..operators import identity, merge, stages

EDGE = ("graph_id", "subject", "predicate", "object", "confidence", "jev_question_id", "evidence")


@dataclass(frozen=True)
class Config:
    """Limits of a run."""

    ortholog_cap: int = ORTHOLOG_CAP
    dataset_cap: int = DATASET_CAP
    least_confidence: float = 0.0
    least_score: float = LONE_HIT_LEAST


def _seen(kind: str, label: Column, namespace: str | Column = "", **attrs: Column) -> Column:
    """How a stage saw a node: type, label, namespace and attributes."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    known = F.create_map(*(x for k, v in attrs.items() for x in (F.lit(k), v.cast("string")))) if attrs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(kind).alias("type"), F.coalesce(label.cast("string"), F.lit("")).alias("label"), F.coalesce(ns, F.lit("")).alias("id_namespace"), known.alias("attrs"))


def _edge(rows: DataFrame, subject: Column, predicate: str, obj: Column, source: str, confidence: Column | float = 1.0, question: Column | str = "", seen: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Raw claims with one evidence each and how the object was seen, and the columns to keep; rows without a subject or object give none."""
    q = F.lit(question) if isinstance(question, str) else question
    seen = _seen("Gene", F.lit("")) if seen is None else seen
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    told = stages.evidence(source, predicate, F.concat_ws(" ", subject, F.lit(predicate), obj), subject=subject, object=obj)
    out = rows.select("graph_id", subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), c.cast("double").alias("confidence"), q.alias("jev_question_id"), told.alias("evidence"), seen.alias("seen"), *keep)
    return out.filter("subject is not null and object is not null")


def classify(queries: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with namespace, is_a edges)."""
    hinted = queries.withColumn("hints", I.namespace_hints(F.col("query"))).join(answers.select("graph_id", F.col("namespace").alias("answer")), "graph_id", "left")
    known = hinted.withColumn("namespace", I.namespace_choice(F.col("hints"), F.col("answer"))).drop("answer")
    confidence = F.when(F.size("hints") <= 1, 1.0).otherwise(0.5)
    return known, _edge(known, F.col("query"), "is_a", I.node_id("idtype", F.col("namespace")), "classifier", confidence, "id_type", _seen("IdType", F.col("namespace"), "idtype"))


def match(queries: DataFrame, genes: DataFrame, answers: DataFrame, least_score: float = LONE_HIT_LEAST, search: DataFrame | None = None) -> DataFrame:
    """One row per graph: the gene record that the query means, or a refusal.

    genes has gene_id, symbol, locus_tag, tax_id, organism, assembly_accession
    and aliases. Candidates meet queries by an equi-join on any id; those carry
    the query, so one alone is taken. ``search`` (graph_id, gene_id, pos) adds what
    a search found without agreeing on an id: where no record carries the query,
    a lone hit needs the judge's score, several need its choice.
    """
    keyed = genes.withColumn("key", F.explode(F.array_distinct(F.transform(F.array_compact(F.concat(F.array("gene_id", "symbol", "locus_tag"), "aliases")), F.lower))))
    asked = queries.select("graph_id", F.lower(F.trim("query")).alias("key")).filter("key <> ''")
    found = stages.merge_join(asked, keyed.select("key", "gene_id"), "key").distinct()
    pool = found.select("graph_id", F.lit(0).cast("long").alias("rank"), F.col("gene_id").alias("record_id"), F.lit(True).alias("exact"))
    if search is not None:
        pool = pool.unionByName(search.select("graph_id", F.col("pos").cast("long").alias("rank"), F.col("gene_id").alias("record_id"), F.lit(False).alias("exact")))
        pool = pool.groupBy("graph_id", "record_id").agg(F.min("rank").alias("rank"), F.max("exact").alias("exact"))
    picked = identity.pick_candidate(pool.withColumn("pos", F.struct("rank", "record_id")), answers.select("graph_id", "noul", "choice"), least_score)
    out = stages.merge_join(queries, picked.select("graph_id", "outcome", "record_id", "confidence"), "graph_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("refused")))
    return stages.merge_join(out, genes.withColumnRenamed("gene_id", "record_id"), "record_id", "left")


def resolve(queries: DataFrame, sources: dict[str, DataFrame], answers: DataFrame, config: Config = Config(), work: Callable[[DataFrame, str], DataFrame] | None = None, link_answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta) of graphs (graph_id, query, depth); nodes have type, label, id_namespace and attrs.

    sources: genes; products (gene_id, transcript, protein); citations (gene_id,
    pmid); bridges (locus_tag, record, aliases, pmids); assemblies (accession,
    tax_id); orthologs (gene_id, ortholog, ortholog_tax, score, pos); groups
    (gene_id, grp) with members (grp, member, species, core, pos); proteins
    (gene_id, accession, go_id, pathway); entries (gene_id, go, kegg, domains)
    with pathways (kegg, pathway, name); datasets (gene_id, accession, score,
    other_species); annotated (gene_id, accession); seen (gene_id, accession);
    search (graph_id, gene_id, pos), see ``match``. With ``link_answers`` (graph_id,
    subject, noul, choice, confidence) every ortholog is linked to the gene record
    that its id means, the judge deciding where ids and taxa don't.
    A stage runs for the graphs that are matched and deep enough; claims of all
    stages merge once, the first of the most confident of a triple wins, and the
    edges carry the distinct evidence of all; related assemblies of a graph with
    one record come once each, so they skip the merge. Every stage also tells how it saw
    the nodes; these sightings merge in the same order (see merge_nodes). ``work`` may write and reread the
    matches, as every stage starts from them: (df, name) -> df.
    """
    known, edges0 = classify(queries, answers)
    matched = match(known, sources["genes"], answers, config.least_score, sources.get("search"))
    if work is not None:
        matched = work(matched, "matched")
    hit = matched.filter("outcome = 'resolved'")
    deep = lambda k: hit.filter(F.col("depth") >= k)
    gene = I.node_id("ncbigene", F.col("record_id"))
    asserted = F.coalesce(F.col("confidence"), F.lit(0.0))
    one, settled = deep(1), []
    by_gene = lambda rows, name: stages.merge_join(rows, sources[name].withColumnRenamed("gene_id", "record_id"), "record_id")
    record = _seen("Gene", F.coalesce("symbol", "record_id"), "ncbi_gene", gene_id=F.col("record_id"), organism=F.col("organism"))
    as_assembly = lambda c: _seen("Assembly", c, "assembly")
    as_publication = lambda c: _seen("Publication", F.concat(F.lit("PMID "), c), "pubmed")
    parts = [
        edges0,
        _edge(one, F.col("query"), "same_as", gene, "genes", asserted, "gene_match", record),
        _edge(one.withColumn("alias", F.explode("aliases")).filter("alias <> '' and lower(alias) <> lower(query)"), gene, "has_alias", I.node_id("alias", F.col("alias")), "genes", seen=_seen("Gene", F.col("alias"), "alias")),
        _edge(one, gene, "in_organism", I.node_id("taxon", F.col("tax_id")), "genes", 1.0, "gene_match", _seen("Organism", F.coalesce("organism", "tax_id"), "taxon")),
        _edge(one, gene, "in_assembly", I.node_id("assembly", F.col("assembly_accession")), "genes", 1.0, "gene_match", as_assembly(F.col("assembly_accession"))),
    ]
    if "products" in sources:
        products = by_gene(one, "products")
        parts += [_edge(products, gene, f"has_{kind.lower()}", I.node_id(prefix, F.col(kind.lower())), "products", seen=_seen(kind, F.col(kind.lower()), prefix)) for kind, prefix in (("Transcript", "nuccore"), ("Protein", "protein"))]
    if "citations" in sources:
        parts.append(_edge(by_gene(one, "citations"), gene, "cited_in", I.node_id("pubmed", F.col("pmid")), "citations", seen=as_publication(F.col("pmid"))))
    if "bridges" in sources:
        met = stages.merge_join(one.select("graph_id", "locus_tag", "record_id"), sources["bridges"], "locus_tag")
        parts.append(_edge(met, gene, "same_as", I.node_id("veupathdb", F.col("record")), "bridges", seen=_seen("Gene", F.col("record"), "veupathdb")))
        rows = stages.bridge(one.select("graph_id", "locus_tag", "record_id").withColumn("anchor", gene), sources["bridges"], "locus_tag", ["graph_id", "anchor"], F.col("locus_tag"), "pmids")
        parts += [_edge(rows.filter("predicate = 'has_alias'"), F.col("anchor"), "has_alias", I.node_id("alias", F.col("object")), "bridges", seen=_seen("Gene", F.col("object"), "alias")), _edge(rows.filter("predicate = 'cited_in'"), F.col("anchor"), "cited_in", F.col("object"), "bridges", seen=as_publication(I.local_id(F.col("object"))))]
    if "assemblies" in sources:
        two = deep(2).withColumn("_times", F.count("*").over(Window.partitionBy("graph_id")))
        places = sources["assemblies"].select(F.col("accession").alias("other"), "tax_id")
        start = F.coalesce(I.node_id("assembly", F.col("assembly_accession")), gene)
        of = lambda rows, c, version: rows.withColumns({"_number": I.accession_number(F.col(c)), version: I.accession_version(F.col(c))})

        def told(rows: DataFrame, places: DataFrame, *keep: str) -> list[DataFrame]:
            related = stages.related(rows, places, "tax_id", "assembly_accession", "other")
            newer = stages.merge_join(of(rows, "assembly_accession", "_version"), of(places, "other", "_other"), ["tax_id", "_number"]).filter("_other > _version")
            return [_edge(some, start, predicate, I.node_id("assembly", F.col("other")), "assemblies", seen=as_assembly(F.col("other")), keep=keep) for predicate, some in (("related_assembly", related), ("superseded_by", newer))]

        # no other stage says so, and of a graph with one record each claim comes once: these outnumber all others and need no merge
        repeats = places.groupBy("other", "tax_id").agg(F.count("*").alias("n_raw"))
        settled = [some.withColumn("seq", F.lit(len(parts) + n).cast("bigint")) for n, some in enumerate(told(two.filter("_times = 1"), repeats, "n_raw"))]
        parts += told(two.filter("_times > 1"), places)
    if "orthologs" in sources:
        found = identity.capped(by_gene(deep(3), "orthologs"), ["graph_id"], F.col("score"), ["pos", "ortholog"], config.ortholog_cap)
        parts.append(_edge(found, gene, "ortholog_of", I.node_id("gene", F.col("ortholog")), "orthologs", seen=_seen("Gene", F.col("ortholog"), "oma", tax_id=F.col("ortholog_tax"))))
        if link_answers is not None:
            keys = ["graph_id", "subject"]
            records = sources["genes"].select(F.col("gene_id").alias("record_id"), "tax_id", F.concat(F.array("gene_id", "locus_tag"), "aliases").alias("ids"), F.array("symbol").alias("found_by"))
            asked = found.select("graph_id", I.node_id("gene", F.col("ortholog")).alias("subject"), F.col("ortholog").alias("term"), F.col("ortholog_tax").alias("tax_id")).distinct()
            questions, terms = stages.link_questions(asked, keys)
            pool = identity.link_pool(stages.link_candidates(terms, records, ["ask"]), ["ask"])
            made = stages.link_claims(identity.linked_by_ask(questions, pool, link_answers, keys, config.least_score))
            named = stages.merge_join(made.withColumn("record_id", I.local_id(F.col("object"))), sources["genes"].select(F.col("gene_id").alias("record_id"), "symbol", "organism"), "record_id")
            parts.append(_edge(named, F.col("subject"), "same_as", F.col("object"), "links", F.col("confidence"), F.col("jev_question_id"), record))
    if "groups" in sources:
        member_of = by_gene(deep(3), "groups").select("graph_id", gene.alias("gene"), "grp")
        made = stages.group_claims(member_of, sources["members"], hit.select("graph_id", F.col("organism").alias("species")), config.ortholog_cap)
        local = I.local_id(F.col("object"))
        parts += [_edge(made.filter(F.col("predicate") == p), F.col("subject"), p, F.col("object"), "groups", seen=seen) for p, seen in (("in_orthogroup", _seen("OrthologGroup", local, "orthomcl")), ("has_member", _seen("Protein", local, "orthomcl")))]
    if "proteins" in sources:
        entries = by_gene(deep(4), "proteins")
        parts += [
            _edge(entries, gene, "same_as", I.node_id("uniprot", F.col("accession")), "proteins", seen=_seen("Gene", F.col("accession"), "uniprot", organism=F.col("organism"))),
            _edge(entries, gene, "has_go_term", I.node_id("go", F.col("go_id")), "proteins", seen=_seen("GOTerm", F.col("go_id"), "go")),
            _edge(entries, gene, "in_pathway", I.node_id("kegg", F.col("pathway")), "proteins", seen=_seen("Pathway", F.col("pathway"), "kegg")),
        ]
    if "entries" in sources:
        made = stages.annotation_claims(by_gene(deep(4), "entries").withColumn("gene", gene), sources["pathways"])
        label = F.col("label")
        seen = {"has_go_term": _seen("GOTerm", label, "go", aspect=F.col("detail")), "in_pathway": _seen("Pathway", label, "kegg"), "same_as": _seen("Gene", label, "kegg"), "has_domain": _seen("Domain", label, F.lower("detail"))}
        parts += [_edge(made.filter(F.col("predicate") == p), F.col("subject"), p, F.col("object"), "entries", seen=told) for p, told in seen.items()]
    if "datasets" in sources:
        wide = identity.capped_if_many(by_gene(deep(5), "datasets"), ["graph_id"], [F.col("other_species"), F.desc(F.coalesce("score", F.lit(0.0))), F.col("accession")], config.dataset_cap)
        parts.append(_edge(wide.filter("accession is not null"), gene, "measured_in", I.node_id("dataset", F.col("accession")), "datasets", F.coalesce("score", F.lit(0.0)), "relevant", _seen("Dataset", F.col("accession"), "dataset", other_species=F.col("other_species"))))
    if "annotated" in sources:
        annotated = by_gene(deep(6), "annotated")
        parts.append(_edge(annotated, gene, "annotated_in", I.node_id("assembly", F.col("accession")), "annotated", seen=as_assembly(F.col("accession"))))
        if "seen" in sources and "assemblies" in sources:
            places = stages.merge_join(deep(6).select(gene.alias("gene"), "tax_id"), sources["assemblies"].select("accession", "tax_id"), "tax_id").select("gene", "accession").distinct()
            there = identity.presence(places, annotated.select(gene.alias("gene"), "accession").distinct(), sources["seen"].select(I.node_id("ncbigene", F.col("gene_id")).alias("gene"), F.col("accession").alias("seen_accession")))
            graphs = stages.merge_join(deep(6).select("graph_id", gene.alias("gene")), there, "gene")
            parts.append(_edge(graphs, F.col("gene"), "ortholog_present", I.node_id("assembly", F.col("accession")), "seen", seen=as_assembly(F.col("accession"))))
    raw = reduce(DataFrame.unionByName, (part.withColumn("seq", F.lit(n).cast("bigint")) for n, part in enumerate(parts)))
    if work is not None:
        raw = work(raw, "raw")
    merged = merge.merge_claims(raw.drop("seen"), "evidence")
    edges = reduce(DataFrame.unionByName, [merged, *(some.withColumn("evidence", F.array("evidence")).select(*merged.columns) for some in settled)])
    edges = edges.filter(F.col("confidence") >= config.least_confidence)
    meta = matched.select("graph_id", "query", "namespace", "depth", "outcome")
    asked = known.select("graph_id", F.col("query").alias("id"), _seen("Gene", F.col("query"), F.col("namespace")).alias("seen"), F.lit(-1).cast("long").alias("seq"))
    # of settled claims the first kind has seen all objects
    seen = reduce(DataFrame.unionByName, [asked, *(some.select("graph_id", F.col("object").alias("id"), "seen", "seq") for some in [raw, *settled[:1]])])
    nodes, attrs = merge.merge_nodes(seen.select("graph_id", "id", "seq", "seen.*"))
    named = attrs.groupBy("graph_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    if config.least_confidence > 0:  # what only weaker claims touched goes with them
        touched = merge.endpoints(edges).union(queries.select("graph_id", F.col("query").alias("id"))).distinct()
        nodes = stages.merge_join(nodes, touched, ["graph_id", "id"], "left_semi")
    nodes = stages.merge_join(nodes, named, ["graph_id", "id"], "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    return nodes.select("graph_id", "id", "type", "label", "id_namespace", "attrs"), edges, meta
