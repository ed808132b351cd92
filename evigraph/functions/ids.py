"""Identifiers: namespaces, exact agreement, species names, accessions, dataset kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NAMESPACES


def namespace_hints(identifier: Column) -> Column:
    """Namespaces whose pattern matches, most specific first; locus_tag only if alone."""
    hits = F.array_compact(F.array(*(F.when(identifier.rlike("(?U)" + p), F.lit(ns)) for ns, p in NAMESPACES)))
    return F.when(F.size(hits) > 1, F.array_remove(hits, "locus_tag")).otherwise(hits)


def namespace_choice(hints: Column, answer: Column) -> Column:
    """The only hint, locus_tag without any, else the judge's choice."""
    return F.when(F.size(hits := hints) <= 1, F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("locus_tag"))).otherwise(answer)


def node_id(prefix: str, local: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), local)


def local_id(id_: Column) -> Column:
    return F.regexp_replace(id_, "^[^:]*:", "")


def species_key(name: Column) -> Column:
    """Genus and epithet, lower-cased."""
    return F.array_join(F.slice(F.split(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s+"), 1, 2), " ")


def genus(name: Column) -> Column:
    return F.regexp_replace(F.split_part(species_key(name), F.lit(" "), F.lit(1)), r"\.+$", "")


def epithet(name: Column) -> Column:
    return F.split_part(species_key(name), F.lit(" "), F.lit(2))


def same_species(a: Column, b: Column) -> Column:
    """Equal keys, or equal epithets and a one-letter genus that begins the other's."""
    ka, kb, ga, gb = species_key(a), species_key(b), genus(a), genus(b)
    short = ((F.length(ga) == 1) & F.split_part(kb, F.lit(" "), F.lit(1)).startswith(ga)) | ((F.length(gb) == 1) & F.split_part(ka, F.lit(" "), F.lit(1)).startswith(gb))
    return (ka != "") & (kb != "") & ((ka == kb) | ((epithet(a) != "") & (epithet(a) == epithet(b)) & short))


def accession_number(accession: Column) -> Column:
    """What stands between the first underscore and the last dot."""
    return F.regexp_extract(F.regexp_replace(accession, "^[^_]*_", ""), r"^(.*)\.[^.]*$", 1)


def accession_core(accession: Column) -> Column:
    return F.regexp_replace(accession, "^[^_]*_", "")


def accession_version(accession: Column) -> Column:
    return F.regexp_extract(accession, r"\.([^.]*)$", 1).try_cast("int")


def dataset_kind(type_text: Column) -> Column:
    """variant, expression or other, by the words that a type text contains."""
    t = F.lower(F.coalesce(type_text, F.lit("")))
    return F.when(t.rlike("variation|snp|genotyp"), "variant").when(t.rlike("expression|rna|transcript|baseline|differential"), "expression").otherwise("other")


def score_of(noul: Column, confidence: Column) -> Column:
    return F.coalesce(noul, confidence, F.lit(0.0))
