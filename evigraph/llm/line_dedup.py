"""Line dedup: exact set-similarity join of lines over the whole corpus."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .shared import Workspace
from .textops import Words, distinct_sets, fingerprints, mix, pieces

#: Frequent tokens told to every task, at most: 1.8 MB.
COMMON = 200_000
#: Bytes of text for each bucket of lines.
BUCKET_BYTES = 6_000_000
#: Columns of a packed line, and those that only the first line of each set has.
KINDS = {"d": np.int64, "l": np.int32, "n": np.int32, "fp1": np.int64, "fp2": np.int64}
WIDE = {**dict.fromkeys(setjoin.SIGNED, np.int64), "short": np.uint16, "prefix": np.int64}


def _firsts(t: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Of the lines ``at`` the first of each set, by place."""
    order = at[np.lexsort((t["l"][at], t["d"][at], t["n"][at], t["fp2"][at], t["fp1"][at]))]
    return np.sort(order[setjoin._run_bounds(*(t[c][order] for c in ("fp1", "fp2", "n")))[:-1]]) if len(order) else order


def _lines(batch: pa.RecordBatch, k: int):
    """The lines of a batch's texts, and (token, line) of their k-word shingles."""
    words = Words(batch.column("text"), lines=True)
    return words, *words.shingles(k)


def similar_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_lines long, n_removed long, removed array<int>): lines that repeat earlier ones.

    Texts are cut at newlines. A line's tokens are its distinct k-word shingles
    (words: runs of characters other than space and 0x09-0x0D, A-Z lower-cased;
    fewer words than k give one token). A line goes if a line at an earlier
    place, by (doc_id, line number from 0), has Jaccard similarity >= num/den
    with it, whether that one stays or goes itself.

    Equal sets are one class at its first place. Tokens are ordered by rarity;
    the prefix filter keeps only those of which a similar line must share one,
    then length and positional filters, a bound from 256-bit signatures and a count
    on the whole sets decide.

    Lines without words stay. A null text is one line without words. Rows with a
    null doc_id keep all lines and are reported as one row. Rows that repeat a
    doc_id share their places: a place loses its line in all of them, and their
    lines are counted together. Other columns are ignored.
    """
    work = work or Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                if k == 1:
                    yield setjoin.repeats(Words(part.column("text")).hash)  # counting a line's repeats too
                else:
                    words, tokens, line = _lines(part, k)
                    yield setjoin.repeats(distinct_sets(tokens, line, len(words.unit_start))[0])

    common = setjoin.common_elements(docs.mapInArrow(count, "h long, c long"), COMMON)

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))

    def sketch(batches):
        """All lines (bucket -1, -2 without doc_id), and with all that is told of them the first lines of each set in a chunk, by bucket."""
        for batch in batches:
            for part in pieces(batch):
                words, tokens, line = _lines(part, k)
                values, first = distinct_sets(tokens, line, len(words.unit_start), common)
                ids = part.column("doc_id").take(pa.array(words.unit_text))
                known, n = ids.is_valid().to_numpy(zero_copy_only=False), np.diff(first).astype(np.int32)
                fp1, fp2 = fingerprints(values, first)
                t = {"d": ids.fill_null(0).to_numpy(), "l": words.unit_no.astype(np.int32), "n": n, "fp1": fp1, "fp2": fp2}
                none = np.zeros(len(n), np.int64)
                yield setjoin.packed(np.where(known, -1, -2), {c: (none[:0], none, none) for c in WIDE}, **t)
                rows = _firsts(t, np.flatnonzero(known & (n > 0)))
                size = n[rows].astype(np.int64)
                values, first = values[setjoin.ragged(first[:-1][rows], size)], np.append(0, np.cumsum(size))
                at, each = first[:-1], np.arange(len(rows))
                lists = {"short": (setjoin.low_bits(values), at, np.where(size <= setjoin.SHORT, size, 0)), "prefix": (values.view(np.int64), at, setjoin.prefix_length(size, num, den))}
                signed = {c: (x, each, np.ones(len(rows), np.int64)) for c, x in zip(setjoin.SIGNED, setjoin.signatures(values, first), strict=True)}
                yield setjoin.packed((mix(fp1[rows].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), signed | lists, **{c: x[rows] for c, x in t.items()})

    def classify(batches):
        """The first line of each set, from all chunks."""
        for _, t in setjoin.unpacked(batches, **KINDS, **WIDE):
            rows = _firsts(t, np.arange(len(t["d"])))
            n = t["n"].astype(np.int64)
            short, length = np.where(n <= setjoin.SHORT, n, 0), setjoin.prefix_length(n, num, den)
            flat = [x[setjoin.ragged((np.cumsum(size) - size)[rows], size[rows])] for x, size in ((t["short"], short), (t["prefix"], length))]
            ends = [np.append(0, np.cumsum(size[rows])).astype(np.int32) for size in (short, length)]
            lists = [pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends[0] * np.int32(2)), pa.py_buffer(flat[0].tobytes())]), pa.ListArray.from_arrays(ends[1], pa.array(flat[1]))]
            columns = ["fp1", "fp2", "n", "d", "l", *setjoin.SIGNED]
            yield pa.RecordBatch.from_arrays([*(pa.array(t[c][rows]) for c in columns), *lists], [*columns, "short", "prefix"])

    def narrow(batches):
        for batch in batches:
            for bucket, *values in zip(*(batch.column(c).to_pylist() for c in ("bucket", *KINDS)), strict=True):
                t = [np.frombuffer(x, kind) for x, kind in zip(values, KINDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(t[0], mask=np.full(len(t[0]), bucket == -2)), *map(pa.array, t[1:])], list(KINDS))

    sketches = work.written(docs.mapInArrow(sketch, "bucket long, " + ", ".join(f"{c} binary" for c in (*KINDS, *WIDE))), "sketches")
    key = ["fp1", "fp2", "n"]
    told = "fp1 long, fp2 long, n int, d long, l int, s0 long, s1 long, s2 long, s3 long, short binary, prefix array<long>"
    by_bucket = lambda turn: sketches.filter(f"bucket >= 0 and bucket % {setjoin.PARTS} = {turn}").repartition("bucket").sortWithinPartitions("bucket")
    classes = reduce(DataFrame.union, [work.written(by_bucket(turn).mapInArrow(classify, told), f"classes-{turn}") for turn in range(setjoin.PARTS)])
    firsts = classes.select(*key, F.col("d").alias("d0"), F.col("l").alias("l0"))
    members = work.written(sketches.filter("bucket < 0").select("bucket", *KINDS).mapInArrow(narrow, "d long, l int, n int, fp1 long, fp2 long"), "members")
    work.drop("sketches")

    def load(bitmap):
        def some(batches):
            for batch in batches:
                batch = batch.filter(batch.column("doc_id").is_valid())
                ids = batch.column("doc_id").to_numpy()
                batch = batch.filter(pa.array(setjoin.is_wanted(bitmap, ids, np.full(len(ids), setjoin.WHOLE, np.int32))))
                for part in pieces(batch):
                    words, tokens, line = _lines(part, k)
                    d = part.column("doc_id").to_numpy()[words.unit_text]
                    hit = setjoin.is_wanted(bitmap, d, words.unit_no.astype(np.int32))
                    at = hit[line]
                    values, first = distinct_sets(tokens[at], line[at], len(hit))
                    rows = np.flatnonzero(hit)
                    ends = np.append(first[:-1][hit], first[-1])
                    sets = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(d[rows]), pa.array(words.unit_no[rows].astype(np.int32)), sets], ["d", "l", "tokens"])

        return docs.mapInArrow(some, "d long, l int, tokens array<long>")

    later = work.written(setjoin.later_matches(classes.select("d", "l", "n", *setjoin.SIGNED, "short", "prefix"), load, num, den, work, buckets), "later")
    lines = members.hint("shuffle_merge").join(firsts.hint("shuffle_merge"), key, "left")
    copies = lines.withColumn("copy", F.col("d0").isNotNull() & ((F.col("d") != F.col("d0")) | (F.col("l") != F.col("l0"))))
    again = later.select(F.col("d").alias("d0"), F.col("l").alias("l0"), F.lit(True).alias("again"))
    judged = copies.hint("shuffle_merge").join(again.hint("shuffle_merge"), ["d0", "l0"], "left")
    gone = (F.col("copy") | F.coalesce("again", F.lit(False))) & F.col("d").isNotNull()
    return judged.groupBy(F.col("d").alias("doc_id")).agg(
        F.count("*").alias("n_lines"),
        F.count_if(gone).alias("n_removed"),
        F.array_sort(F.collect_set(F.when(gone, F.col("l")))).alias("removed"),
    )


def line_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the lines that similar_lines removes; n_chars, if there, follows the text.

    A document that loses its last line with words goes. One that had none
    stays. Rows with a null doc_id stay as they are.
    """
    found = similar_lines(docs, k, num, den).filter("n_removed > 0").select(F.col("doc_id").alias("_doc_id"), F.col("removed").alias("_removed"))
    joined = docs.hint("shuffle_merge").join(found.hint("shuffle_merge"), F.col("doc_id") == F.col("_doc_id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept))
    out = out.filter(F.col("_removed").isNull() | F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
