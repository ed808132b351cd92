"""Stage joins of a resolution: bridges, enrichment, assemblies, orthologs, groups, annotation, datasets, candidates.

Every function takes rows of any number of graphs. Joins whose side comes from
explode carry a hint, as Spark can't estimate such sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I

# Ranks at which relatives may be grouped; databases whose genes are candidates.
RANKS = ("species", "subspecies", "genus")
CANDIDATE_NAMESPACES = ("oma", "veupathdb")
MERGE = "shuffle_merge"
# Parts that the rows of one key are dealt to where both sides share it.
SPREAD = 8
# Right rows of one key, about, that each of its left rows meets at a time: what is written then repeats within what a file's compression looks back on.
TOGETHER = 256


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join: for sides whose size Spark can't know."""
    return left.hint(MERGE).join(right.hint(MERGE), on, how)


def spread_join(left: DataFrame, right: DataFrame, on: str, together: int | None = None) -> DataFrame:
    """An inner join on a key that many rows of both sides may share, so that its pairs outnumber the rows by far.

    Left rows are dealt to SPREAD parts of their key, right ones go to each, so
    no key falls to one task; the count of partitions is told, as Spark would
    join small partitions whatever they give. With ``together`` the right rows of
    keys with more are dealt to chunks of about so many, which left rows meet one
    after the other; such keys, fewer than one in ``together`` right rows, are
    told to every task. Files of such pairs take less space, the join more time.
    """
    n, keys = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [on, "_part"]
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int"))
    told = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    if together:
        many = F.broadcast(right.groupBy(on).agg(F.ceil(F.count("*") / together).cast("int").alias("_chunks")).filter("_chunks > 1"))
        chunks, keys = F.coalesce("_chunks", F.lit(1)), [*keys, "_chunk"]
        dealt = dealt.join(many, on, "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_chunks")
        told = told.join(many, on, "left").withColumn("_chunk", F.pmod(F.xxhash64(*right.columns), chunks).cast("int")).drop("_chunks")
    return merge_join(dealt.repartition(n, *keys), told.repartition(n, *keys), keys).drop("_part", "_chunk")


def evidence(source: str, endpoint: str, summary: Column, **payload: Column) -> Column:
    """One evidence: constants, a text made from counts and ids, and the payload as JSON with keys in order."""
    body = F.to_json(F.struct(*(payload[k].alias(k) for k in sorted(payload)))) if payload else F.lit("{}")
    return F.struct(F.lit(source).alias("source"), F.lit(endpoint).alias("endpoint"), summary.alias("summary"), body.alias("payload"))


def anchor_id(namespace: Column, gene_id: Column, symbol: Column, query: Column) -> Column:
    """The node that a match stands for: its own id, else its symbol's, else the query itself."""
    return F.coalesce(I.node_id(namespace, F.nullif(gene_id, F.lit(""))), I.node_id(namespace, F.nullif(symbol, F.lit(""))), query)


def own_aliases(rows: DataFrame, keys: Sequence[str], own: Sequence[Column], aliases: str = "aliases") -> DataFrame:
    """(keys, alias): aliases of each row, blank ones, its own names and repeats left out."""
    each = rows.select(*keys, *(o.cast("string").alias(f"_own{n}") for n, o in enumerate(own)), F.explode(F.array_distinct(F.array_compact(aliases))).alias("alias"))
    for n in range(len(own)):
        each = each.filter((F.trim("alias") != "") & ~F.col("alias").eqNullSafe(F.col(f"_own{n}")))
    return each.select(*keys, "alias")


def bridge(rows: DataFrame, records: DataFrame, on: str, keys: Sequence[str], own: Column, citations: str | None = None) -> DataFrame:
    """(keys, predicate, object) of records met on an id: an alias or a cited publication each, every claim once.

    Repeats are taken out of rows and of records' claims before they meet, so
    pairs of keys that come in one row only are never shuffled. own is a column of rows.
    """
    own_keys = [k for k in keys if k in rows.columns]
    record_keys = [k for k in keys if k not in own_keys]
    left = rows.select(*dict.fromkeys([*own_keys, on]), own.cast("string").alias("_own")).filter(F.col(on).isNotNull()).distinct()
    left = left.withColumn("_times", F.count("*").over(Window.partitionBy(*own_keys)))
    claims = own_aliases(records, [*record_keys, on], []).filter(F.trim("alias") != "").select(*record_keys, on, F.lit("has_alias").alias("predicate"), F.col("alias").alias("object"))
    if citations:
        cited = records.select(*record_keys, on, F.explode(citations).alias("object")).filter(F.col("object").isNotNull())
        claims = claims.unionByName(cited.select(*record_keys, on, F.lit("cited_in").alias("predicate"), I.node_id("pubmed", F.col("object")).alias("object")))
    claims = claims.distinct()

    def told(some: DataFrame) -> DataFrame:
        met = spread_join(some.drop("_times"), claims, on, TOGETHER)
        return met.filter((F.col("predicate") != "has_alias") | ~F.col("object").eqNullSafe(F.col("_own"))).select(*keys, "predicate", "object")

    return told(left.filter("_times = 1")).unionByName(told(left.filter("_times > 1")).distinct())


def linked_by_term(rows: DataFrame, records: DataFrame, term: str, tax: str, record: str) -> DataFrame:
    """(graph_id, record, tax) where a term meets one record only, of one taxon only."""
    hits = merge_join(rows.select("graph_id", term), records.select(term, record, tax), term)
    return hits.groupBy("graph_id").agg(F.count("*").alias("_n"), F.count_distinct(tax).alias("_taxa"), F.min(record).alias(record), F.min(tax).alias(tax)).filter("_taxa = 1 and _n = 1").drop("_n", "_taxa")


def link_candidates(rows: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, record_id, exact, same_taxon) of rows (keys, term, tax_id): records that carry a term among their ids, or were found by it.

    records: record_id, tax_id, ids array<string>, found_by array<string> (the
    words a search would find them by). Terms meet in one equi-join, whatever the case.
    """
    lowered = lambda c: F.transform(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)))
    both = records.select("record_id", F.col("tax_id").alias("_tax"), lowered(F.col("ids")).alias("_ids"), lowered(F.col("found_by")).alias("_words"))
    each = both.select("record_id", "_tax", "_ids", F.explode(F.array_distinct(F.concat("_ids", "_words"))).alias("_key"))
    asked = rows.withColumn("_key", F.lower(F.trim("term"))).filter("_key <> ''")
    met = merge_join(asked, each, "_key").select(*keys, F.col("record_id").alias("pos"), "record_id", F.array_contains("_ids", F.col("_key")).alias("exact"), F.coalesce(F.col("tax_id") == F.col("_tax"), F.lit(False)).alias("same_taxon"))
    # one shuffle for what is distinct and for the pools that follow
    return met.repartition(*keys).distinct()


def link_questions(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(questions, terms) of rows (keys, term, tax_id): what each key asks as one value, ``ask``, and its terms (ask, term, tax_id), once for all keys that ask the same.

    Candidates depend on the terms and taxa alone, so they are looked up for
    terms with ``ask`` as the key; keys meet them in ``identity.linked_by_ask``.
    """
    cut = F.struct(F.lower(F.trim("term")).alias("term"), F.col("tax_id").alias("tax_id"))
    questions = rows.filter(F.trim("term") != "").groupBy(*keys).agg(F.array_sort(F.collect_set(cut)).alias("ask"))
    return questions, questions.select("ask").distinct().select("ask", F.inline("ask"))


def link_claims(decided: DataFrame, subject: str = "subject") -> DataFrame:
    """(graph_id, subject, predicate, object, confidence, jev_question_id) of decided links: same_as edges to gene records; refused ones give none."""
    asked = F.when(F.col("outcome").isin("lone", "choice"), "gene_match").otherwise("")
    return decided.filter("record_id is not null").select("graph_id", F.col(subject).alias("subject"), F.lit("same_as").alias("predicate"), I.node_id("ncbigene", F.col("record_id")).alias("object"), "confidence", asked.alias("jev_question_id"))


def fan_out(rows: DataFrame, key: str, subject: str, branches: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(subject, predicate, object): every branch (records with key, column, predicate, prefix) joined to rows; arrays are exploded.

    Repeats are taken out of a branch's bare values, before they become claims:
    whole numbers and strings as they are, others as strings.
    """
    parts = []
    for records, column, predicate, prefix in branches:
        one = records.select(key, F.col(column).alias("_value"))
        if one.schema["_value"].dataType.typeName() == "array":
            one = one.select(key, F.explode("_value").alias("_value"))
        if one.schema["_value"].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
            one = one.withColumn("_value", F.col("_value").cast("string"))
        met = merge_join(rows.select(key, subject), one.filter("_value is not null"), key).select(subject, "_value").distinct()
        parts.append(met.select(subject, F.lit(predicate).alias("predicate"), I.node_id(prefix, F.col("_value").cast("string")).alias("object")))
    out = reduce(DataFrame.unionByName, parts)
    return out if len({b[2] for b in branches}) == len(branches) else out.distinct()


def anchor_claims(matches: DataFrame) -> DataFrame:
    """(graph_id, subject, predicate, object) of matches (graph_id, anchor, tax_id, assembly_accession): only what is known."""
    rows = [("in_organism", I.node_id("taxon", F.col("tax_id"))), ("in_assembly", I.node_id("assembly", F.col("assembly_accession")))]
    out = [matches.select("graph_id", F.col("anchor").alias("subject"), F.lit(p).alias("predicate"), o.alias("object")) for p, o in rows]
    return reduce(DataFrame.unionByName, out).filter(F.col("object").isNotNull())


def needs_rank(rank: Column, lineage: Column) -> Column:
    """Whether the rank to group by must be asked for: the taxon is no species, or a subspecies is above it."""
    return (F.coalesce(rank, F.lit("species")) != "species") | F.exists(lineage, lambda e: e["rank"] == "subspecies")


def rank_options(rank: Column, lineage: Column) -> Column:
    """Ranks of interest in the lineage and of the taxon itself, each once, in order of RANKS."""
    there = F.array_distinct(F.concat(F.transform(lineage, lambda e: e["rank"]), F.array(rank)))
    return F.filter(F.array(*map(F.lit, RANKS)), lambda r: F.array_contains(there, r))


def tax_at_rank(asked: Column, tax_id: Column, rank: Column, lineage: Column, species_tax_id: Column) -> Column:
    """The taxon's id at a rank: its own, its lineage's, for species its recorded species'; else null."""
    up = F.try_element_at(F.filter(lineage, lambda e: e["rank"] == asked), F.lit(1))["tax_id"]
    return F.when(rank == asked, tax_id).otherwise(F.coalesce(up, F.when(asked == "species", species_tax_id)))


def related(rows: DataFrame, places: DataFrame, group: str, own: str, other: str) -> DataFrame:
    """rows with the other places of their group, their own left out; a group's rows are dealt to several tasks."""
    return spread_join(rows, places, group).filter(~F.col(own).eqNullSafe(F.col(other)))


def reference_id(xrefs: Column, canonical: Column, fallback: Column) -> Column:
    """An ortholog's id: its first SourceID in list order, else the canonical, else the database's own."""
    return F.coalesce(F.try_element_at(F.filter(xrefs, lambda x: x["source"] == "SourceID"), F.lit(1))["id"], canonical, fallback)


def with_own_entry(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (graph_id, query, anchor, used) with the ortholog database's entry for the id that found relatives, and the node they hang from.

    entries: id, entry_nr, omaid, canonical_id, species, tax_id; ids meet whatever
    the case, the entry of the least number counts. ``subject`` is the entry's
    node, for rows without one the anchor, as its claims aren't the entry's.
    """
    side = entries.filter("omaid is not null and omaid <> ''").groupBy(F.lower("id").alias("_used")).agg(F.min(F.struct("entry_nr", "omaid", "canonical_id", "species", "tax_id")).alias("_e"))
    met = merge_join(rows.withColumn("_used", F.lower("used")), side, "_used", "left")
    own = I.node_id("oma", F.col("_e.omaid"))
    told = met.select(*rows.columns, "_e.*", own.alias("entry"), F.coalesce("_e.canonical_id", "_e.omaid").alias("label"))
    return told.withColumn("subject", F.coalesce("entry", "anchor"))


def own_entry_claims(rows: DataFrame) -> DataFrame:
    """(graph_id, subject, predicate, object): each query is the same as its own entry, of rows from ``with_own_entry``."""
    return rows.filter("entry is not null").select("graph_id", F.col("query").alias("subject"), F.lit("same_as").alias("predicate"), F.col("entry").alias("object")).distinct()


def member_order(members: DataFrame, keys: Sequence[str], related: Column, core: Column, place: Sequence) -> DataFrame:
    """Members with their place: those of a species with a related assembly first, then core ones, then as listed."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce(related, F.lit(False))), F.desc(F.coalesce(core, F.lit(False))), *place)
    return members.withColumn("place", F.row_number().over(w).cast("long"))


def group_claims(memberships: DataFrame, members: DataFrame, known_species: DataFrame, most: int) -> DataFrame:
    """(graph_id, subject, predicate, object, place) of ortholog groups: the query's membership and its first members.

    memberships: graph_id, gene, grp; members: grp, member, species, core, pos;
    known_species: graph_id, species (with a related assembly). Members are ranked
    before they meet graphs: those of a known species that a graph takes are among
    the first of their group and species, and where these leave places free, the
    others it takes are among the first of the group.
    """
    listed = ["pos", "member"]
    first = member_order(members, ["grp", "species"], F.lit(False), F.col("core"), listed).filter(F.col("place") <= most).drop("place")
    any_ = member_order(members, ["grp"], F.lit(False), F.col("core"), listed).filter(F.col("place") <= most).drop("place")
    asked, known = memberships.select("graph_id", "grp"), known_species.select("graph_id", "species").distinct()
    seen = merge_join(merge_join(asked, known, "graph_id"), first, ["grp", "species"]).withColumn("_seen", F.lit(True))
    other = merge_join(merge_join(asked, any_, "grp"), known, ["graph_id", "species"], "left_anti").withColumn("_seen", F.lit(False))
    ranked = member_order(seen.unionByName(other), ["graph_id", "grp"], F.col("_seen"), F.col("core"), listed).filter(F.col("place") <= most)
    group = I.node_id("orthogroup", F.col("grp"))
    own = memberships.select("graph_id", F.col("gene").alias("subject"), F.lit("in_orthogroup").alias("predicate"), group.alias("object"), F.lit(0).cast("long").alias("place"))
    return own.unionByName(ranked.select("graph_id", group.alias("subject"), F.lit("has_member").alias("predicate"), I.node_id("omclseq", F.col("member")).alias("object"), "place"))


def suffix_probe(rows: DataFrame, key: str, id_: str, known: DataFrame) -> DataFrame:
    """(key, hit, rank): the first of an id's forms that is known: before a dash, whole, before a dot."""
    forms = F.array_distinct(F.array(F.split_part(id_, F.lit("-"), F.lit(1)), F.col(id_), F.split_part(id_, F.lit("."), F.lit(1))))
    each = rows.select(key, F.posexplode(forms).alias("rank", "_form"))
    met = merge_join(each, known.select(F.col(known.columns[0]).alias("_form")).distinct(), "_form")
    return met.groupBy(key).agg(F.min_by("_form", "rank").alias("hit"), F.min("rank").alias("rank"))


def aspect(term: Column) -> Column:
    """What a term's prefix says it is about; null without one."""
    head = F.substring(term, 1, 2)
    return F.when(head == "F:", "function").when(head == "P:", "process").when(head == "C:", "component")


def evidence_code(code: Column) -> Column:
    """CODE of CODE:source; null if blank."""
    return F.nullif(F.split_part(F.coalesce(code, F.lit("")), F.lit(":"), F.lit(1)), F.lit(""))


def bare_pathway(name: Column) -> Column:
    """A pathway's name without its path: prefix and the organism after it."""
    return F.element_at(F.split(F.regexp_replace(name, "^path:", ""), " - "), 1)


def go_groups(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Annotation rows (keys, term, code) by GO id: label and aspect of the first row, the codes, one evidence for each row."""
    return rows.groupBy(*keys).agg(
        F.min_by(F.regexp_replace("term", "^[FPC]:", ""), order).alias("label"),
        F.min_by(aspect(F.col("term")), order).alias("aspect"),
        F.count("*").alias("n_evidence"),
        F.array_join(F.array_sort(F.collect_set(evidence_code(F.col("code")))), ",").alias("codes"),
    )


def go_evidence(rows: DataFrame, keys: Sequence[str], source: str = "uniprot") -> DataFrame:
    """Raw claims with one evidence for each annotation row (keys, accession, go_id, term, code, seq): has_go_term of each key's subject.

    The payload keeps the row: its code, and the source after the code's colon;
    ``merge.merge_evidence`` then keeps the distinct ones of every claim in order.
    """
    code = evidence_code(F.col("code"))
    origin = F.nullif(F.regexp_extract(F.coalesce("code", F.lit("")), ":(.*)$", 1), F.lit(""))
    told = evidence(source, "go", F.concat(F.lit("annotated with "), F.col("go_id"), F.lit(", "), F.coalesce(code, F.lit("no code"))), accession=F.col("accession"), go_id=F.col("go_id"), code=code, code_source=origin, term=F.regexp_replace("term", "^[FPC]:", ""), aspect=aspect(F.col("term")))
    return rows.filter("go_id is not null").select(*keys, F.lit("has_go_term").alias("predicate"), I.node_id("go", F.col("go_id")).alias("object"), told.alias("e"), "seq").select(*keys, "predicate", "object", "e.*", "seq")


def nested_evidence(merged: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """(keys, evidence array<struct<source, endpoint, summary, payload>>, n_evidence) of merged evidence rows, in their order; the first ``most`` if given, with all counted."""
    kept = F.array_sort(F.collect_list(F.when(F.lit(True) if most is None else F.col("n") <= most, F.struct("n", "source", "endpoint", "summary", "payload"))))
    return merged.groupBy(*keys).agg(F.transform(kept, lambda x: x.dropFields("n")).alias("evidence"), F.count("*").alias("n_evidence"))


def annotation_claims(entries: DataFrame, pathways: DataFrame) -> DataFrame:
    """(graph_id, subject, predicate, object, label, detail) of proteins: GO terms, KEGG genes with their pathways, domains.

    entries: graph_id, gene, go array<struct<id, term, code>>, kegg array<string>,
    domains array<struct<id, name, source>>; pathways: kegg, pathway, name. Each
    claim comes once: KEGG genes and pathways are made distinct before they meet,
    as a gene's id is part of its pathways' claims.
    """
    go = entries.select("graph_id", "gene", F.explode("go").alias("x")).select("graph_id", "gene", I.node_id("go", F.col("x.id")).alias("object"), F.regexp_replace("x.term", "^[FPC]:", "").alias("label"), aspect(F.col("x.term")).alias("detail"))
    genes = entries.select("graph_id", "gene", F.explode("kegg").alias("kegg")).distinct()
    named = pathways.select("kegg", I.node_id("kegg", F.col("pathway")).alias("object"), bare_pathway(F.col("name")).alias("label")).filter("object is not null").distinct()
    paths = spread_join(genes.filter("kegg is not null"), named, "kegg").select("graph_id", F.col("gene").alias("subject"), F.lit("in_pathway").alias("predicate"), "object", "label", F.col("kegg").alias("detail"))
    same = genes.select("graph_id", "gene", I.node_id("kegg", F.col("kegg")).alias("object"), F.col("kegg").alias("label"), F.lit(None).cast("string").alias("detail"))
    domains = entries.select("graph_id", "gene", F.explode("domains").alias("x")).select("graph_id", "gene", I.node_id("domain", F.col("x.id")).alias("object"), F.coalesce("x.name", "x.id").alias("label"), F.initcap("x.source").alias("detail"))
    kinds = (("has_go_term", go), ("same_as", same), ("has_domain", domains))
    parts = [df.select("graph_id", F.col("gene").alias("subject"), F.lit(p).alias("predicate"), "object", "label", "detail") for p, df in kinds]
    return reduce(DataFrame.unionByName, parts).filter(F.col("object").isNotNull()).distinct().unionByName(paths)


def dataset_claims(candidates: DataFrame, answers: DataFrame, most: int) -> DataFrame:
    """(graph_id, subject, predicate, object, confidence) of dataset candidates: relevance as answered, and their factors.

    candidates: graph_id, gene, accession, other_species, factors array<string>;
    answers: graph_id, accession, noul. Unanswered ones count as 0.
    """
    from .identity import capped_if_many

    scored = merge_join(candidates, answers, ["graph_id", "accession"], "left").withColumn("confidence", F.coalesce("noul", F.lit(0.0)))
    top = capped_if_many(scored, ["graph_id"], [F.col("other_species"), F.desc("confidence"), F.col("accession")], most)
    at = I.node_id("dataset", F.col("accession"))
    measured = top.select("graph_id", F.col("gene").alias("subject"), F.lit("measured_in").alias("predicate"), at.alias("object"), "confidence")
    factors = top.select("graph_id", at.alias("subject"), F.lit("has_factor").alias("predicate"), F.explode(F.array_distinct("factors")).alias("f"), F.lit(1.0).alias("confidence")).filter(F.trim("f") != "")
    return measured.unionByName(factors.select("graph_id", "subject", "predicate", I.node_id("condition", F.lower("f")).alias("object"), "confidence"))


def dataset_samples(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per dataset the sorted distinct samples and the values of rows (keys, sample, value) that have both."""
    whole = values.filter(F.col("sample").isNotNull() & F.col("value").isNotNull())
    return whole.groupBy(*keys).agg(F.array_sort(F.collect_set("sample")).alias("samples"), F.count("*").alias("n_values"))


def described_datasets(datasets: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """datasets with name, summary and first publication of their record, and the edge to that publication where there is one.

    records: key, name, summary, publications array<struct<pmid, citation>>.
    """
    first = F.try_element_at("publications", F.lit(1))
    side = records.select(key, "name", "summary", first["pmid"].alias("pmid"), first["citation"].alias("citation"))
    met = merge_join(datasets, side, key, "left")
    return met.withColumn("described_in", F.when(F.coalesce("pmid", F.lit("")) != "", I.node_id("pubmed", F.col("pmid"))))


def annotated_assemblies(edges: DataFrame, queries: DataFrame, reports: DataFrame) -> DataFrame:
    """(graph_id, accession, gene): assemblies that annotate a gene of the graph; the last edge of an assembly wins.

    Genes are the ncbigene ids at the end of same_as edges that don't start from
    the query. edges have seq; reports are (gene_id, accessions array).
    """
    asked = queries.select("graph_id", F.col("query").alias("subject"), F.lit(True).alias("_asked"))
    same = edges.filter("predicate = 'same_as' and object like 'ncbigene:%'")
    genes = merge_join(same, asked, ["graph_id", "subject"], "left").filter("_asked is null")
    genes = genes.select("graph_id", "subject", "seq", I.local_id(F.col("object")).alias("gene_id"))
    each = reports.select("gene_id", F.explode("accessions").alias("accession")).filter(F.col("accession").isNotNull())
    met = merge_join(genes, each, "gene_id")
    return met.groupBy("graph_id", "accession").agg(F.max_by("subject", F.struct("seq", "subject")).alias("gene"))


def shared_targets(edges: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """(graph_id, subject, object, first, other): subjects of one object, linked to the first of them; no pairs among the rest."""
    w = Window.partitionBy("graph_id", "object")
    first = F.first("subject").over(w.orderBy(*order, "subject").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return edges.withColumn("first", first).filter(F.col("subject") != F.col("first")).select("graph_id", "object", "first", F.col("subject").alias("other")).distinct()


def candidate_genes(genes: DataFrame, places: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene, place, matched_on): genes that may lie in a place by taxon or species, but for pairs and places settled already.

    Excluded are places that annotate a gene or where it was seen (the union of
    two sets of edges), and genes that have a place of their own.
    """
    from .identity import species_links

    some = genes.filter(F.col("id_namespace").isin(*CANDIDATE_NAMESPACES) & (F.coalesce("species", F.lit("")) != ""))
    settled = edges.filter(F.col("predicate").isin("annotated_in", "ortholog_present")).select(F.col("object").alias("place")).union(
        edges.filter(F.col("predicate") == "has_candidate_gene").select(F.col("subject").alias("place"))
    ).distinct()
    placed = edges.filter(F.col("predicate") == "in_assembly").select(F.col("subject").alias("gene")).distinct()
    open_ = merge_join(places, settled, "place", "left_anti")
    return species_links(merge_join(some, placed, "gene", "left_anti"), open_)


def filled_publications(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Publication nodes (pmid, label, title, abstract, journal, year) with what they lack from records; the label only where it is blank or PMID …."""
    columns = ["title", "abstract", "journal", "year"]
    side = records.select("pmid", *(F.col(c).alias(f"_{c}") for c in columns))
    met = merge_join(nodes, side, "pmid", "left").withColumns({c: F.coalesce(F.nullif(c, F.lit("")), f"_{c}") for c in columns})
    bare = (F.coalesce(F.trim("label"), F.lit("")) == "") | F.col("label").startswith("PMID ")
    return met.withColumn("label", F.when(bare & F.col("title").isNotNull(), F.col("title")).otherwise(F.col("label"))).drop(*(f"_{c}" for c in columns))


def match_of_graph(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, symbol, organism): the query node's label and the first organism's, for graphs that come without a match."""
    named = merge_join(queries.select("graph_id", F.col("query").alias("id")), nodes.select("graph_id", "id", "label"), ["graph_id", "id"], "left")
    organisms = nodes.filter("type = 'Organism'").groupBy("graph_id").agg(F.min_by("label", F.struct("seq", "id")).alias("organism"))
    return merge_join(named, organisms, "graph_id", "left").select("graph_id", F.coalesce(F.nullif("label", F.lit("")), "id").alias("symbol"), "organism")


def reviewed_first(hits: DataFrame, keys: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """The first hits of each graph, reviewed ones before others; the first is picked, the rest corroborate."""
    w = Window.partitionBy(*keys).orderBy(F.desc("reviewed"), *order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).withColumn("picked", F.col("rank") == 1)


def corroborating(hits: DataFrame, picked: DataFrame, keys: Sequence[str], record: str) -> DataFrame:
    """Records of each graph other than the picked one."""
    return merge_join(hits, picked.select(*keys, record), [*keys, record], "left_anti")
