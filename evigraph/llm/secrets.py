"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hashed_sample

# The base patterns, in Java's syntax. Maximal runs that are too
# short fail as a whole, so a least length inside the pattern is the same for
# access and hex; a short assignment is found first and dropped then.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the models judge: runs of letters, digits and signs of at least this length.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
#: Values of a block of running sums.
BLOCK = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,found:string>>"
#: Rows of each table that the models are trained on, at most (by hash).
SAMPLE = 4_000
#: Natural-log likelihood ratio per character pair from which a string counts as random.
THRESHOLD = 0.25


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """array<int>: values folded from the left by an associative ``plus``, up to each place.

    By blocks of BLOCK values, so that no array is copied value by value: appending
    is quadratic in its length.
    """
    empty = F.array().cast("array<int>")
    fold = lambda xs: F.aggregate(xs, empty, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, plus(F.element_at(acc, -1), x)).otherwise(x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: fold(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))
    # one lambda argument binds the blocks, so they are folded once
    whole = F.transform(F.array(blocks), lambda bs: F.transform(F.array(fold(F.transform(bs, lambda b: F.element_at(b, -1)))), lambda before: F.flatten(F.transform(bs, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: plus(F.element_at(before, F.greatest(k, F.lit(1))), x))))))[0])[0]
    return F.when(F.size(values) > 0, whole).otherwise(empty)


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, rank, end, kind, found>> of a pattern's leftmost, non-overlapping matches.

    Starts follow from the lengths of the pieces between the matches. With
    ``least``, matches whose ``group`` is shorter are dropped afterwards.
    """
    rank = {"assign": 0, "access": 1, "hex": 2, "markov": 3}[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("found"))), sized, lambda s, x: F.struct(s["g"].alias("g"), s["m"].alias("m"), s["found"].alias("found"), F.length(x).alias("x")))
    placed = F.transform(F.array(steps), lambda ss: F.zip_with(ss, running(F.transform(ss, lambda s: s["g"] + s["m"]), lambda a, b: a + b), lambda s, end: F.struct((end - s["m"]).alias("start"), end.alias("end"), s["x"].alias("x"), s["found"].alias("found"))))[0]
    kept = F.transform(F.filter(placed, lambda s: s["x"] >= least), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["found"].alias("found")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPANS))


def apart(candidates: str, base: str) -> Column:
    """The candidates that no base span touches, both by start: one sort and two running passes."""
    marked = lambda name, is_base: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found"), F.lit(is_base).alias("base")))
    both = F.array_sort(F.concat(marked(candidates, 0), marked(base, 1)))
    far = 2_147_483_647
    ends = lambda xs: running(F.transform(xs, lambda s: F.when(s["base"] == 1, s["end"]).otherwise(F.lit(0))), F.greatest)
    starts = lambda xs: F.reverse(running(F.reverse(F.transform(xs, lambda s: F.when(s["base"] == 1, s["start"]).otherwise(F.lit(far)))), F.least))
    # a base span of the same start may sort on either side: its end or start shows in one of the two
    free = F.transform(F.array(both), lambda xs: F.zip_with(xs, F.arrays_zip(ends(xs).alias("e"), starts(xs).alias("s")), lambda x, r: F.when((x["base"] == 0) & (r["e"] <= x["start"]) & (r["s"] >= x["end"]), F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["found"].alias("found")))))[0]
    return F.when(F.size(base) == 0, F.col(candidates)).otherwise(F.filter(free, lambda x: x.isNotNull()))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of character pairs (codes up to 127) in a column s of strings."""
    chars = F.transform(F.split("s", ""), lambda c: F.ascii(c))
    pairs = strings.select(chars.alias("c")).select(F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    return pairs.select("p.a", "p.b").filter("a < 128 and b < 128").groupBy("a", "b").count()


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratio of random over ordinary for each character pair, as 128 x 128 values.

    strings is (s, random boolean). Both models are first-order chains with
    add-half smoothing over the printable alphabet. The counts that reach the
    driver are at most 128 x 128 for each model.
    """
    models = []
    for random in (True, False):
        counts = {(r["a"], r["b"]): r["count"] for r in _pairs(strings.filter((F.col("random") == random) & (F.length("s") >= 2))).collect()}
        total: dict[int, float] = {}
        for (a, _), n in counts.items():
            total[a] = total.get(a, 0) + n
        models.append([math.log((counts.get((a, b), 0) + 0.5) / (total.get(a, 0) + 0.5 * 96)) for a in range(128) for b in range(128)])
    return [round(r - o, 4) for r, o in zip(*models, strict=True)]


def labelled_strings(texts: DataFrame) -> DataFrame:
    """(s, random) from the base patterns: their values are random, other words of letters ordinary.

    texts: column text. Ordinary strings are words and paths of several words
    with signs; hits of the base patterns are cut out first.
    """
    secret = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.regexp_extract_all(rest, F.lit(r"[A-Za-z][A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    random = texts.select(F.explode(secret).alias("s")).filter(F.length("s") >= 16).withColumn("random", F.lit(True))
    return random.union(texts.select(F.explode(plain).alias("s")).withColumn("random", F.lit(False)))


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most size rows with texts, by hash."""
    return hashed_sample(docs.select("doc_id", "text").filter(F.col("text").isNotNull()), ["doc_id", "text"], size)


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, base, spans): secrets in every whole text, DataFrame functions only.

    base and spans are arrays of struct<start, rank, end, kind, found> in code points,
    end exclusive, found being the matched text, sorted by start, then kind (assign, access, hex, markov).
    base has the fixed patterns' matches; spans adds those candidates, of 20
    characters or more, whose log-likelihood ratio per character pair reaches
    the threshold and that no base span touches. ratios come from ``train``;
    without them they are trained on a bounded sample of docs.

    Work is about linear in a text, however long its runs and however many its matches.
    Null texts count as empty, without spans. Rows that repeat are each
    scanned. Other columns are ignored. An empty table gives no rows.
    """
    if ratios is None:
        ratios = train(labelled_strings(sample(docs)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.array_sort(F.concat(spans(text, ASSIGN, "assign", 1, 8), spans(text, ACCESS, "access"), spans(text, HEX, "hex")))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # a constant: folded once

    def score(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        total = F.transform(
            F.array(codes),
            lambda cs: F.aggregate(F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.element_at(table, a * 128 + b + 1)), F.lit(0.0), lambda s, x: s + x),
        )[0]
        return total / (F.length(token) - 1)

    judged = F.filter(apart("candidates", "base"), lambda c: score(c["found"]) >= threshold)
    found = rows.withColumns({"base": base, "candidates": spans(text, CANDIDATE, "markov")})
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", judged)).alias("spans"))


def span_text(spans_: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
