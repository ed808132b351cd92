"""N-gram Jaccard join: blocked sparse product of documents by n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .shared import Workspace
from .textops import Words, block_sizes, distinct_sets, fingerprints, heads, pieces

#: Frequent n-grams told to every task, at most: 1.6 MB.
COMMON = 200_000
#: Column blocks whose sizes bound the overlap of two rows.
BLOCKS = 256
#: Classes of one component whose links are counted in one task, about; more are split into blocks.
COUNTED = 256
#: Columns of the dense pieces of the product that counts links.
WIDTH = 8_192


def _id(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _sets(batch: pa.RecordBatch, k: int, common=None):
    values, unit = Words(batch.column("text")).shingles(k)
    return distinct_sets(values, unit, batch.num_rows, common)


def _degrees(t: pa.Table, num: int, den: int) -> pa.Table:
    """(fp1, fp2, n, links) of the classes of two blocks of a component: copies of the others that are similar."""
    t = t.combine_chunks()
    fp1, fp2, n, d, copies, blk = (t.column(c).to_numpy() for c in ("fp1", "fp2", "n", "d", "copies", "blk"))
    tokens = t.column("tokens").combine_chunks()
    row = np.repeat(np.arange(len(n)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    _, column, count = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = count > 1
    at = shared[column]
    row, column = row[at], (np.cumsum(shared) - 1)[column[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(n), len(n)), np.int64)
    for c in range(0, int(shared.sum()), WIDTH):
        x, y = np.searchsorted(column, (c, c + WIDTH))
        part = np.zeros((len(n), min(WIDTH, int(shared.sum()) - c)), np.float32)
        part[row[x:y], column[x:y] - c] = 1
        overlap += (part @ part.T).astype(np.int64)
    linked = (overlap * den >= (n[:, None].astype(np.int64) + n - overlap) * num) & (d[:, None] != d)
    if t.column("b1")[0].as_py() != t.column("b2")[0].as_py():
        linked &= blk[:, None] != blk  # those of one block are counted where it meets itself
    return pa.table({"fp1": fp1, "fp2": fp2, "n": n, "links": linked @ copies})


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, work: Workspace | None = None, count_links: bool = True) -> DataFrame:
    """Near-duplicate documents: (doc_id, n_shingles, component_id, n_links).

    A document's set holds the distinct k-word shingles of its whole text, words
    being runs of characters other than space and 0x09-0x0D with A-Z lower-cased;
    fewer words than k give one shingle. Documents link when intersection * den
    >= union * num. component_id is the least doc_id that links reach.

    Equal sets are one class, joined once. The product of documents by n-grams
    is restricted to each row's first entries in one global order, rare n-grams
    first, as a pair that shares none of them stays below the least overlap for
    its sizes; see setjoin. n_links is the number of other documents that the
    document links with, copies included: each component's classes meet in pairs
    of blocks, where a product of whole sets counts, so no pair becomes a row.
    Without ``count_links`` it is left out.

    Null and empty texts and texts of white space have no shingles and link with
    nothing. A null doc_id links with nothing and is its own component (null).
    Rows that repeat a doc_id each count, as one document. Other columns are
    ignored. An empty table gives no rows.
    """
    work = work or Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                yield setjoin.repeats(_sets(part, k)[0])

    common = setjoin.common_elements(docs.mapInArrow(count, "h long, c long"), COMMON)

    def sketch(batches):
        for batch in batches:
            for part in pieces(batch):
                values, first = _sets(part, k, common)
                n = np.diff(first)
                fp1, fp2 = fingerprints(values, first)
                length = np.where(n > 0, setjoin.prefix_length(n, num, den), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(fp1), pa.array(fp2), block_sizes(values, first, BLOCKS), heads(values, first, length)], ["doc_id", "n", "fp1", "fp2", "sizes", "prefix"])

    sketches = work.written(docs.mapInArrow(sketch, "doc_id long, n int, fp1 long, fp2 long, sizes binary, prefix array<long>"), "sketches")
    key = ["fp1", "fp2", "n"]
    one = sketches.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "sizes", "prefix")).alias("x"), F.count("*").alias("copies"))
    classes = work.written(one.select(*key, F.col("x.doc_id").alias("rep"), "copies", "x.sizes", "x.prefix"), "classes")
    members = work.written(sketches.select("doc_id", "n", "fp1", "fp2"), "members")
    work.drop("sketches")
    sets = classes.select(F.col("rep").alias("d"), F.lit(0).alias("l"), "n", "sizes", "prefix")
    classes = classes.drop("sizes", "prefix")

    def load(bitmap):
        def some(batches):
            for batch in batches:
                batch = batch.filter(pa.array(batch.column("doc_id").is_valid()))
                ids = _id(batch)
                batch = batch.filter(pa.array(setjoin.is_wanted(bitmap, ids, np.zeros(len(ids), np.int32))))
                for part in pieces(batch):
                    values, first = _sets(part, k)
                    tokens = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values.view(np.int64)))
                    fp1, fp2 = fingerprints(values, first)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.zeros(part.num_rows, np.int32)), tokens, pa.array(fp1), pa.array(fp2)], ["d", "l", "tokens", "fp1", "fp2"])

        return docs.mapInArrow(some, "d long, l int, tokens array<long>, fp1 long, fp2 long")

    _, parts = setjoin.component_links(sets, load, num, den, work)
    known = classes.hint("shuffle_merge").join(parts.withColumnRenamed("id", "rep").hint("shuffle_merge"), "rep", "left")
    known = work.written(known.select(*key, "rep", "copies", "component"), "known")
    if count_links:
        known = known.hint("shuffle_merge").join(_links(known.filter("component is not null"), load, num, den, key).hint("shuffle_merge"), key, "left")
    else:
        known = known.withColumn("links", F.lit(0))
    known = known.select(*key, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = work.written(known, "linked")  # so that the join below has no aggregate beside it, and Spark may split a large group of copies
    out = members.hint("shuffle_merge").join(known.hint("shuffle_merge"), key, "left")
    linked = F.col("doc_id").isNotNull() & F.col("component").isNotNull()
    out = out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return out if count_links else out.drop("n_links")


def _links(known: DataFrame, load, num: int, den: int, key: list[str]) -> DataFrame:
    """(fp1, fp2, n, links) of the classes (fp1, fp2, n, rep, copies, component) that are not alone."""
    large = known.groupBy("component").count().filter(F.col("count") > COUNTED)
    blocks = F.coalesce(F.ceil(F.col("count") / COUNTED), F.lit(1)).cast("int")
    dealt = known.hint("shuffle_merge").join(large.hint("shuffle_merge"), "component", "left").withColumn("nb", blocks).drop("count")
    zero = F.lit(0).cast("int")
    whole = load(setjoin.wanted(known.select(F.col("rep").alias("d1"), zero.alias("l1"), F.col("rep").alias("d2"), zero.alias("l2"))))
    whole = whole.select("d", "tokens", "fp1", "fp2", F.size("tokens").alias("n"))
    met = dealt.withColumnRenamed("rep", "d").hint("shuffle_merge").join(whole.hint("shuffle_merge"), ["d", *key]).dropDuplicates(["d", *key])
    met = met.withColumn("blk", F.expr("cast(pmod(xxhash64(fp1, fp2), nb) as int)")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    met = met.withColumns({"b1": F.least("blk", "other"), "b2": F.greatest("blk", "other")})
    found = met.groupBy("component", "b1", "b2").applyInArrow(lambda t: _degrees(t, num, den), "fp1 long, fp2 long, n int, links long")
    return found.groupBy(*key).agg(F.sum("links").alias("links"))


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those linked to a smaller doc_id: one document of each group stays.

    Of rows that repeat a doc_id with equal text one stays. Rows without words
    or without doc_id all stay.
    """
    groups = ngram_jaccard_join(docs, k, num, den, count_links=False)
    gone = groups.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.hint("shuffle_merge").join(gone.hint("shuffle_merge"), F.col("doc_id") == F.col("_gone"), "left_anti")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rest = kept.filter(~alone).withColumn("_text", F.sha2("text", 256)).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return rest.unionByName(kept.filter(alone))
