"""Text units, verbatim quotes, and tolerant parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PROMPT_CHARS, PROPOSALS_PER_ANSWER

# Fixed value: where sentences end.
SENTENCE_END = r"(?<=[.!?])\s+(?=[^\sa-z])|\n+"


def sentences(text: Column) -> Column:
    """Trimmed sentences, blank ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def lines(text: Column) -> Column:
    """Lines that aren't blank, untrimmed."""
    return F.filter(F.split(text, r"\R"), lambda x: F.trim(x) != "")


def numbered(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def unnumbered(line: Column) -> Column:
    return F.regexp_replace(line, r"^\[\d+\]\s*", "")


def truncated(text: Column, most: int = PROMPT_CHARS) -> Column:
    """Sentences of the first ``most`` characters; a last one that the cut left hanging is dropped."""
    units = sentences(F.substring(text, 1, most))
    hanging = (F.length(text) > most) & (F.size(units) > 0) & ~F.coalesce(F.try_element_at(units, F.lit(-1)), F.lit("")).rlike(r"[.!?]$")
    return F.when(hanging, F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0)))).otherwise(units)


def citations(raw: Column, n_units: Column) -> Column:
    """0-based units that a JSON list cites: nested groups flattened, numbers out of range or unreadable dropped, null kept."""
    outer = F.from_json(raw, "array<string>")
    flat = F.flatten(F.transform(outer, lambda x: F.when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(x))))
    at = F.transform(flat, lambda x: x.try_cast("int") - 1)
    return F.filter(at, lambda i: i.isNotNull() & (i >= 0) & (i < n_units))


def quote(units: Column, cited: Column) -> Column:
    """Cited units in source order: neighbours joined by a space, gaps shown by an ellipsis."""
    order = F.array_sort(F.array_distinct(cited))
    step = lambda i, k: F.concat(F.when(k == 0, "").when(F.element_at(order, F.greatest(k, F.lit(1))) == i - 1, " ").otherwise(" … "), F.element_at(units, i + 1))
    return F.array_join(F.transform(order, step), "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def proposals(raw: Column, n_units: Column) -> Column:
    """array<struct<claim, type, cited>> of an answer's first proposals: claims not blank, types known, citations valid and some."""
    parsed = F.from_json(raw, "proposals array<struct<claim:string,type:string,citations:string>>")["proposals"]
    first = F.slice(parsed, 1, PROPOSALS_PER_ANSWER)
    clean = F.transform(first, lambda p: F.struct(collapsed(F.coalesce(p["claim"], F.lit(""))).alias("claim"), F.when(p["type"].isin("condition", "claim"), p["type"]).otherwise("claim").alias("type"), citations(p["citations"], n_units).alias("cited")))
    return F.filter(clean, lambda p: (p["claim"] != "") & (F.size(p["cited"]) > 0))


def outer_object(text: Column) -> Column:
    """The outermost {...} of a text that surrounds JSON."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


#: JSON as strict decoders read it: names and texts in double quotes.
STRICT = {"allowSingleQuotes": "false"}


def outer_proposals(text: Column, key: str = "proposals") -> Column:
    """The first JSON object of a text that holds a list under key, or under a name with the same first six characters, put under key.

    Objects are decoded from each opening brace on, in order, whatever stands
    before and after them: fences, stray braces, prose, other objects. So other
    names may come before the list, lists may follow in later objects, and braces
    inside texts mean nothing. Null where no object holds such a list.
    """
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == "{")
    shape = f"{key} array<string>"

    def decoded(i: Column) -> Column:
        rest = F.substr(text, i)
        whole = F.from_json(rest, "map<string,string>", STRICT)
        named = F.try_element_at(F.filter(F.map_entries(whole), lambda e: e["key"].startswith(key[:6]) & e["value"].startswith("[")), F.lit(1))["value"]
        renamed = F.concat(F.lit('{"' + key + '":'), named, F.lit("}"))
        listed = lambda t: F.from_json(t, shape, STRICT)[key].isNotNull()
        return F.when(whole.isNotNull(), F.when(listed(rest), rest).when(listed(renamed), renamed))

    return F.try_element_at(F.filter(F.transform(starts, decoded), lambda x: x.isNotNull()), F.lit(1))


def answer(text: Column) -> Column:
    """struct<answer, cited_nodes> of a model's answer: strict JSON, else the outermost object, JSON inside JSON unwrapped, else the prose itself."""
    shape = "answer string, cited_nodes array<string>"
    strict = lambda t: F.when(F.get_json_object(t, "$.answer").isNotNull(), F.from_json(t, shape))
    once = F.coalesce(strict(text), strict(outer_object(text)))
    inner = strict(once["answer"])
    plain = F.struct(text.alias("answer"), F.array().cast("array<string>").alias("cited_nodes"))
    found = F.coalesce(inner, once, plain)
    return F.struct(found["answer"].alias("answer"), F.coalesce(found["cited_nodes"], F.array().cast("array<string>")).alias("cited_nodes"))


def clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.try_cast("double")))


def labels_or_none(raw: Column, n: Column) -> Column:
    """A JSON list of labels if it has exactly n, none blank; else null."""
    got = F.transform(F.from_json(raw, "array<string>"), collapsed)
    return F.when((F.size(got) == n) & F.forall(got, lambda x: F.coalesce(x, F.lit("")) != ""), got)


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
