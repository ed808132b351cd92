"""Links: which urls are safe, and the page of an entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page of an entity by id prefix; {} is the local id.
PAGES = (
    ("assembly", "https://www.ncbi.nlm.nih.gov/datasets/genome/{}/"),
    ("taxon", "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id={}"),
    ("go", "https://www.ebi.ac.uk/QuickGO/term/{}"),
    ("kegg", "https://www.kegg.jp/entry/{}"),
    ("domain", "https://www.ebi.ac.uk/interpro/entry/InterPro/{}"),
    ("orthogroup", "https://orthomcl.org/orthomcl/app/record/group/{}"),
    ("omclseq", "https://orthomcl.org/orthomcl/app/record/sequence/{}"),
    ("dataset", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc={}"),
    ("nuccore", "https://www.ncbi.nlm.nih.gov/nuccore/{}"),
    ("protein", "https://www.ncbi.nlm.nih.gov/protein/{}"),
    ("pubmed", "https://pubmed.ncbi.nlm.nih.gov/{}/"),
)
# Page of a gene by namespace.
GENE_PAGES = (
    ("uniprot", "https://www.uniprot.org/uniprotkb/{}"),
    ("oma", "https://omabrowser.org/oma/info/{}"),
    ("veupathdb", "https://veupathdb.org/veupathdb/app/record/gene/{}"),
    ("kegg", "https://www.kegg.jp/entry/{}"),
)


def _page(template: str, local: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), local, F.lit(tail))


def safe_link(url: Column | str) -> Column:
    """The url if it is https with a plain host and a valid port, else null."""
    url = F.col(url) if isinstance(url, str) else url
    authority = F.regexp_extract(url, r"^(?i:https)://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    named, ipv6 = host.rlike(r"^[a-z0-9._-]+$"), host.rlike(r"^\[[0-9a-f:.]+\]$")
    good = url.rlike(r"^(?i:https)://") & (named | ipv6) & ((port == "") | (F.try_to_number(port, F.lit("999999")) <= 65535))
    return F.when(good, url)


def entity_link(type_: Column, namespace: Column, node_id: Column, attrs: Column | None = None) -> Column:
    """A safe explicit url, else the page by namespace (genes) or by the id's prefix."""
    prefix = F.when(node_id.contains(":"), F.substring_index(node_id, ":", 1)).otherwise("")
    local = F.regexp_replace(node_id, "^[^:]*:", "")
    gene_id = F.when(local.rlike("^[0-9]+$"), local)
    if attrs is not None:
        gene_id = F.coalesce(F.nullif(F.try_element_at(attrs, F.lit("gene_id")), F.lit("")), gene_id)
    gene = F.lit(None).cast("string")
    for ns, template in GENE_PAGES:
        gene = F.when(namespace == ns, _page(template, local)).otherwise(gene) if gene is not None else gene
    listed = F.lit(False)
    for ns, _ in GENE_PAGES:
        listed = listed | (namespace == ns)
    gene = F.when(listed, gene).otherwise(_page("https://www.ncbi.nlm.nih.gov/gene/{}", gene_id))
    other = F.lit(None).cast("string")
    for name, template in PAGES:
        other = F.when(prefix == name, _page(template, local)).otherwise(other)
    other = F.when((prefix == "domain") & (namespace == "pfam"), _page("https://www.ebi.ac.uk/interpro/entry/pfam/{}", local)).otherwise(other)
    other = F.when((prefix == "dataset") & (namespace == "veupathdb"), _page("https://veupathdb.org/veupathdb/app/record/dataset/{}", local)).when((prefix == "dataset") & local.startswith("E-"), _page("https://www.ebi.ac.uk/gxa/experiments/{}", local)).otherwise(other)
    page = F.when(type_ == "Gene", gene).otherwise(other)
    if attrs is not None:
        page = F.coalesce(safe_link(F.try_element_at(attrs, F.lit("url"))), page)
    return page
