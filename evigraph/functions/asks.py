"""Asks of the judge and prompts of the proposer, as column expressions.

An ask is what the judge sees: its kind of answer, instructions, the criteria
that an answer is one of (with what each means), and a JSON state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLAIM_CATEGORIES

# How each ask is answered.
KINDS = {
    "id_type": "choice", "gene_match": "noul", "gene_choice": "choice", "rank": "choice", "protein_entry": "noul", "characterization": "score", "relevant": "noul", "triage": "score",
    "verify": "noul", "category": "choice", "data_claim": "noul", "summary_claim": "noul", "question_category": "noul", "accuracy": "noul", "completeness": "noul",
}
WORDING = {
    "id_type": "Which identifier namespace is {value} most likely from?",
    "gene_match": "Is the one candidate record the gene that {value} means?",
    "gene_choice": "Which candidate record is the gene that {value} means?",
    "rank": "At which taxonomic rank should relatives of {value} be grouped?",
    "protein_entry": "Is the protein entry the product of {value}?",
    "characterization": "How well characterized is {value}?",
    "relevant": "Is the dataset likely to say something about {value}?",
    "triage": "How likely does the text of {value} hold what is asked?",
    "verify": "Does the source text of {value} support the proposal?",
    "category": "Which category describes the claim about {value} best?",
    "data_claim": "Do the values of {value} support the claim?",
    "summary_claim": "Does the graph of {value} support the sentence?",
    "question_category": "Does answering {value} need this kind of information?",
    "accuracy": "How accurate is the answer to {value}?",
    "completeness": "How complete is the answer to {value}?",
}
#: Further wording by kind of item or proposal.
TRIAGE_WORDING = {"dataset": "Does the text of {value} name conditions, contrasts or sample groups that could be listed?", "publication": "Does the text of {value} say what the gene does or when it is expressed?"}
VERIFY_WORDING = {"condition": "Does the source text of {value} state this condition, and does it say how the gene was measured?", "claim": "Does the source text of {value} support this claim, and could it be shown false?"}
#: What ends of a scale mean, lowest first.
CHARACTERIZATION_LEVELS = ("merely predicted, nothing measured", "what the molecule does is known in detail")
TRIAGE_LEVELS = ("says nothing of it", "touches on it", "says something of it", "says much of it")
#: Escapes: what an answer is when no criterion fits.
NONE, OTHER = "none", "other"

ASK = "struct<qtype:string,instructions:string,criteria:array<struct<key:string,text:string>>,state:string>"
_CRITERIA = "array<struct<key:string,text:string>>"


def instructions(kind: str, value: Column) -> Column:
    return _worded(WORDING[kind], value)


def _worded(wording: str, value: Column) -> Column:
    head, tail = wording.split("{value}")
    return F.concat(F.lit(head), F.lit("'"), value, F.lit("'"), F.lit(tail))


def match_kind(n_candidates: Column) -> Column:
    """A lone candidate is confirmed, several are chosen from."""
    return F.when(n_candidates == 1, "gene_match").otherwise("gene_choice")


def criterion(key: Column | str, text: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.struct(as_col(key).alias("key"), F.coalesce(as_col(text), F.lit("")).alias("text"))


def fixed(criteria: Mapping[str, str]) -> Column:
    return F.array(*(criterion(k, v) for k, v in criteria.items())) if criteria else F.array().cast(_CRITERIA)


def state(**parts: Column) -> Column:
    """What the judge is told, as JSON with keys in order; nulls are left out."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))))


def _ask(qtype: Column | str, text: Column, criteria: Column | None, told: Column) -> Column:
    kind = F.lit(qtype) if isinstance(qtype, str) else qtype
    return F.struct(kind.alias("qtype"), text.alias("instructions"), (F.array() if criteria is None else criteria).cast(_CRITERIA).alias("criteria"), told.alias("state"))


def id_type(value: Column, hints: Column, described: Mapping[str, str]) -> Column:
    """The namespaces whose pattern fits, and other."""
    known = F.create_map(*(F.lit(x) for pair in described.items() for x in pair))
    options = F.transform(hints, lambda h: criterion(h, F.try_element_at(known, h)))
    return _ask("choice", instructions("id_type", value), F.concat(options, F.array(criterion(OTHER, "another namespace, or no identifier"))), state(value=value, hints=hints))


def candidates(kind: str, value: Column, records: Column, label, told: Mapping[str, Column] = {}) -> Column:
    """One record is confirmed (noul), several are chosen from by their number, or none; ``label`` words a record."""
    many = F.size(records) > 1
    options = F.concat(F.transform(records, lambda r, i: criterion(i, label(r))), F.array(criterion(NONE, "none of them")))
    text = F.when(many, instructions("gene_choice", value)).otherwise(instructions(kind, value))
    return _ask(F.when(many, "choice").otherwise("noul"), text, F.when(many, options).otherwise(F.array().cast(_CRITERIA)), state(value=value, candidates=records, **told))


def rank(value: Column, options: Column, lineage: Column) -> Column:
    """Ranks to group relatives by; null where there are fewer than two to choose from."""
    return F.when(F.size(options) >= 2, _ask("choice", instructions("rank", value), F.transform(options, lambda r: criterion(r, r)), state(taxon=value, lineage=lineage)))


def characterization(value: Column, entry: Column) -> Column:
    """A score between two levels, from counts of an entry's annotations."""
    return _ask("score", instructions("characterization", value), _levels(CHARACTERIZATION_LEVELS), state(gene=value, entry=entry))


def _levels(texts: tuple[str, ...]) -> Column:
    return F.array(*(criterion(str(n), t) for n, t in enumerate(texts)))


def relevant(value: Column, dataset: Column) -> Column:
    return _ask("noul", instructions("relevant", value), None, state(gene=value, dataset=dataset))


def triage(value: Column, kind: Column, text: Column) -> Column:
    """A score on four levels, worded by the kind of item."""
    worded = F.when(kind == "dataset", _worded(TRIAGE_WORDING["dataset"], value)).otherwise(_worded(TRIAGE_WORDING["publication"], value))
    return _ask("score", worded, _levels(TRIAGE_LEVELS), state(node=value, kind=kind, text=text))


def verify(node: Column, kind: Column, claim: Column, quote: Column, text: Column) -> Column:
    """Whether the source supports a proposal, worded by its type; unknown types are claims."""
    worded = F.when(kind == "condition", _worded(VERIFY_WORDING["condition"], node)).otherwise(_worded(VERIFY_WORDING["claim"], node))
    return _ask("noul", worded, None, state(node=node, claim=claim, quote=quote, text=text))


def category(node: Column, kind: Column, claim: Column, vocabulary: Mapping[str, str] = CLAIM_CATEGORIES) -> Column:
    """A category of the vocabulary, or other; null for what is no claim."""
    options = {**vocabulary, OTHER: vocabulary.get(OTHER, "no category fits")}
    return F.when(kind == "claim", _ask("choice", instructions("category", node), fixed(options), state(node=node, claim=claim)))


def data_claim(gene: Column, dataset: Column, data: Column, claim: Column) -> Column:
    return _ask("noul", instructions("data_claim", dataset), None, state(gene=gene, dataset=dataset, data=data, claim=claim))


def summary_claim(gene: Column, graph: Column, claim: Column) -> Column:
    return _ask("noul", instructions("summary_claim", gene), None, state(gene=gene, graph=graph, claim=claim))


def question_categories(question: Column, described: Mapping[str, str]) -> Column:
    """One ask for each category of questions, by its name."""
    asks = [F.struct(F.lit(k).alias("category"), _ask("noul", F.concat(instructions("question_category", question), F.lit(" " + text)), None, state(question=question, category=F.lit(k))).alias("ask")) for k, text in described.items()]
    return F.array(*asks)


def answer_scores(question: Column, answer: Column, graph: Column, categories: Column) -> Column:
    """The two asks about an answer, by name."""
    told = state(question=question, answer=answer, graph=graph, categories=categories)
    return F.array(*(F.struct(F.lit(k).alias("score"), _ask("noul", instructions(k, question), None, told).alias("ask")) for k in ("accuracy", "completeness")))


def prompt(system: str, user: Column) -> Column:
    """What the proposer is told: its role, then the text."""
    return F.struct(F.lit(system).alias("system"), user.alias("user"))


_JSON = "Answer in JSON only."


def text_prompt(node: Column, shown: Column) -> Column:
    return prompt(f"You extract conditions and claims about a gene from numbered sentences. {_JSON}", F.concat(F.lit("Node: "), node, F.lit("\nSentences:\n"), shown, F.lit('\nReturn {"proposals": [{"claim", "type", "citations"}]}, citing sentence numbers.')))


def normalize_prompt(labels: Column) -> Column:
    return prompt(f"You make the wording of condition labels agree. {_JSON}", F.concat(F.lit("Labels: "), F.to_json(labels), F.lit('\nReturn {"normalized": [...]}, one for each label, in order.')))


def data_prompt(gene: Column, dataset: Column, summary: Column, rows: Column) -> Column:
    return prompt(f"You propose claims that measured values support. {_JSON}", F.concat(F.lit("Gene: "), gene, F.lit("\nDataset: "), dataset, F.lit("\nSummary: "), F.coalesce(summary, F.lit("n/a")), F.lit("\nRows:\n"), rows))


def summary_prompt(gene: Column, organism: Column, graph: Column) -> Column:
    return prompt(f"You sum up a gene's graph in claims that cite its lines. {_JSON}", F.concat(F.lit("Gene: "), F.coalesce(gene, F.lit("this gene")), F.lit(" ("), F.coalesce(organism, F.lit("unknown organism")), F.lit(")\nLines:\n"), graph))


def answer_prompt(question: Column, graph: Column, excerpt: bool) -> Column:
    scope = "an excerpt of a graph, so that what is missing may exist" if excerpt else "a graph"
    return prompt(f"You answer from {scope} only and cite its nodes. {_JSON}", F.concat(F.lit("Graph: "), graph, F.lit("\nQuestion: "), question, F.lit('\nReturn {"answer", "cited_nodes"}.')))
