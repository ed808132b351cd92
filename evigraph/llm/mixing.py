"""Mixing sources to target weights: fixed-length blocks, drawn slots, permuted indexes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .textops import mix

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, in turn, and the most that a source is repeated.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Slots of an output shard; sources that may be broadcast; rows of a bucket of the running sums.
SHARD, BROADCAST, BUCKET = 1_024, 50_000, 20_000
ROUNDS = 4


def word_count(text: Column) -> Column:
    """Words of a text as long: runs of characters other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) of (source, source_size).

    Sources, in code point order with null last, weigh ``weights`` in turn and
    share the sum of all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight. With sources ordered by
    most * size / weight, the stopped ones are a prefix, so one pass of running
    sums finds the common level of the rest. One row per source.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("top", (F.col("source_size") * most).cast("double")).withColumn("level", F.col("top") / F.col("w"))
    order = Window.orderBy("level", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"total": total.cast("double"), "weight": F.sum("w").over(Window.partitionBy()), "stopped": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "place": F.row_number().over(order)})
    ranked = ranked.withColumn("share", (F.col("total") - F.col("stopped")) / (F.col("weight") - F.col("gone")))
    free = F.when(F.col("level") >= F.col("share"), F.struct("place", "share"))
    ranked = ranked.withColumn("least", F.min(free).over(Window.partitionBy())["share"])
    return ranked.select("source", "sid", "source_size", F.least("top", F.coalesce(F.col("least") * F.col("w"), F.col("top"))).alias("target"))


def _round(x: np.ndarray, key: np.ndarray, r: int) -> np.ndarray:
    return mix(x ^ (key + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network that walks until it is inside."""
    half = np.array([(max(1, int(s - 1).bit_length()) + 1) // 2 for s in np.unique(size)], np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask, out = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(ROUNDS):
            if back:
                left, right = right ^ (_round(left, k, ROUNDS - 1 - r) & m), left
            else:
                left, right = right, left ^ (_round(right, k, r) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _key(seed: int, sid: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return mix(np.uint64(seed) + mix(sid.astype(np.uint64) * np.uint64(1_000_003) + epoch.astype(np.uint64)))


def plan(size: np.ndarray, target: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, slots, last) of each source: its blocks, the slots that take its target, the words of its last slot.

    A source is taken in epochs, each a permutation of all its blocks; the last
    slot takes the beginning of its block, so that round(target) words are taken.
    """
    size, want = size.astype(np.int64), np.round(target).astype(np.int64)
    blocks = -(-size // block)
    slots, last = np.zeros_like(size), np.zeros_like(size)
    for i in np.flatnonzero((size > 0) & (want > 0)):
        epochs, rest = divmod(int(want[i]), int(size[i]))
        short = int(size[i] - (blocks[i] - 1) * block)
        n = int(blocks[i])
        if not rest:
            epochs, rest = epochs - 1, int(size[i])
        key = _key(seed, np.array([i]), np.array([epochs]))
        at = int(permuted(np.array([n - 1]), np.array([n]), key, back=True)[0])  # where the short block comes
        if at >= -(-rest // block):
            used, words = -(-rest // block), rest - (-(-rest // block) - 1) * block
        elif rest <= at * block + short:
            used, words = at + 1, rest - at * block
        else:
            used = 1 - (-(rest - short) // block)
            words = rest - short - (used - 2) * block
        slots[i], last[i] = epochs * n + used, words
    return blocks, slots, last


def drawn(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are in a uniform choice of n of all slots; of any size.

    Independent binomial draws make a uniform choice of another size. The
    difference, about its root, is drawn in the same way from the slots that are
    not chosen (or given back from those that are), until it is met; the last few
    slots one by one.
    """
    out = np.zeros_like(counts)
    while rest := n - int(out.sum()):
        sign, pool = (1, counts - out) if rest > 0 else (-1, out.copy())
        if abs(rest) > 32:
            out += sign * rng.binomial(pool, abs(rest) / int(pool.sum()))
            continue
        for _ in range(abs(rest)):
            i = int(np.searchsorted(np.cumsum(pool), rng.integers(int(pool.sum())), "right"))
            out[i] += sign
            pool[i] -= 1
    return out


def draws(slots: np.ndarray, shards: range, seed: int):
    """(shard, counts, offsets) of some shards: how many slots each source gets there, and how many before.

    Source counts are multinomial draws given that they add up to ``slots``. All
    shards are halved again and again, each half drawn by its own generator, so
    any shard's counts and offsets follow in a few steps, the same everywhere.
    """
    total = -(-int(slots.sum()) // SHARD)
    stack = [(0, total, slots.astype(np.int64), np.zeros(len(slots), np.int64))]
    while stack:
        low, high, counts, offset = stack.pop()
        if low >= shards.stop or high <= shards.start or low >= high:
            continue
        if high - low == 1:
            yield low, counts, offset
            continue
        middle = (low + high) // 2
        left = drawn(counts, (middle - low) * SHARD, np.random.default_rng([seed, low, high]))
        stack += [(middle, high, counts - left, offset + left), (low, middle, left, offset)]


def slot_table(spark, size: np.ndarray, target: np.ndarray, block: int, seed: int) -> DataFrame:
    """(shard, slot, sid, block, words): every slot of the mix, drawn and permuted."""
    blocks, slots, last = plan(size, target, block, seed)
    shards = -(-int(slots.sum()) // SHARD)

    def fill(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            if not len(ids):
                continue
            for shard, counts, offset in draws(slots, range(int(ids[0]), int(ids[-1]) + 1), seed):
                sid = np.repeat(np.arange(len(counts)), counts)
                nth = np.arange(len(sid)) - np.repeat(np.cumsum(counts) - counts, counts) + offset[sid]
                epoch, index = nth // blocks[sid], nth % blocks[sid]
                found = permuted(index, blocks[sid], _key(seed, sid, epoch))
                words = np.minimum(block, size[sid] - found * block)
                words = np.where(nth == slots[sid] - 1, last[sid], words)
                order = np.random.default_rng([seed, shard]).permutation(len(sid))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard)), pa.array(order), pa.array(sid.astype(np.int32)), pa.array(found), pa.array(words)], ["shard", "slot", "sid", "block", "words"])

    tasks = max(1, min(-(-shards // 64), 10_000))
    return spark.range(0, shards, 1, tasks).mapInArrow(fill, "shard long, slot long, sid int, block long, words long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = 64, seed: int = 17, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, sized): the mixed stream, and documents with their sizes and targets.

    sized: (doc_id, source, hash, size, source_size, target, sid, begin), a row
    per document; begin is its first word's place in its source. mix: (shard,
    slot, sid, doc_id, hash, begin, start, words): in each output slot, words
    ``start`` on, so many, of a document.

    A source's words, by bucket of doc_id, then doc_id, size and hash of the
    text, are cut into blocks of ``block`` words. See ``targets`` for how much
    of each source is taken and ``plan`` for how: round(target) words in whole
    epochs and a part of one, so no document exceeds ``most`` times its size.
    Reruns agree.

    Null texts have size 0 and are never taken. A null source is a source of its
    own, after all others. Rows that repeat count each. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("hash"), word_count(F.col("text").cast("string")).alias("size"))
    sized = work.written(sized, "sized")
    sources = work.written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    rows = sources.orderBy("sid").select("source_size", "target").toPandas()  # one row per source
    small = len(rows) <= BROADCAST
    known = sized.join(sources.hint("broadcast" if small else "shuffle_merge"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    buckets = max(1, -(-sized.count() // BUCKET))
    known = work.written(known.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id), {buckets}) as int)")), "known")
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.hint("shuffle_merge").join(sums.select("sid", "bucket", "base").hint("shuffle_merge"), ["sid", "bucket"])
    placed = work.written(placed.select("doc_id", "source", "hash", "size", "source_size", "target", "sid", (F.col("base") + F.col("inside")).alias("begin")), "placed")
    work.drop("sized", "known")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    pieces = pieces.select("doc_id", "hash", "sid", "begin", "size", "block", F.greatest(F.lit(0), F.col("block") * block - F.col("begin")).alias("start"))
    pieces = pieces.withColumn("from", F.col("begin") + F.col("start") - F.col("block") * block)
    pieces = pieces.withColumn("length", F.least(F.col("size") - F.col("start"), block - F.col("from"))).drop("size")
    slots = slot_table(spark, rows["source_size"].to_numpy(np.int64), rows["target"].to_numpy(float), block, seed)
    met = slots.hint("shuffle_merge").join(pieces.hint("shuffle_merge"), ["sid", "block"])
    met = met.withColumn("words", F.least(F.col("length"), F.col("words") - F.col("from"))).filter("words > 0")
    return met.select("shard", "slot", "sid", "doc_id", "hash", "begin", "start", "words"), placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words the mix takes of each document."""
    mixed, sized = mix_sources(docs, **options)
    taken = mixed.groupBy("sid", "begin").agg(F.sum("words").alias("taken")).withColumn("some", F.lit(True))
    sized = sized.withColumn("some", F.col("size") > 0)
    out = sized.hint("shuffle_merge").join(taken.hint("shuffle_merge"), ["sid", "begin", "some"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = 2048, **options) -> DataFrame:
    """The mix as documents: a row per piece that a slot takes, with docs' columns, whatever their names.

    A piece that is a whole document keeps its text; others have their words and
    the white space after each. n_chars, if there, follows the text. Of rows that
    repeat doc_id and text one gives the other columns of all their pieces. A text
    is taken apart once, however many pieces it has.
    """
    mixed, _ = mix_sources(docs, block=block, **options)
    parts = mixed.groupBy(F.col("doc_id").alias("_mix_id"), F.col("hash").alias("_mix_hash"), "begin").agg(F.collect_list(F.struct("start", "words")).alias("_mix_pieces"))
    whole = docs.select(F.struct(*docs.columns).alias("_mix_doc"), F.col("doc_id").alias("_mix_of"), F.xxhash64("text").alias("_mix_own"))
    one = whole.dropDuplicates(["_mix_of", "_mix_own"])
    met = one.hint("shuffle_merge").join(parts.hint("shuffle_merge"), F.col("_mix_of").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_own") == F.col("_mix_hash")))
    text = F.col("_mix_doc.text")
    met = met.select("_mix_doc", "_mix_pieces", word_count(text.cast("string")).alias("_mix_size"))
    some = F.exists("_mix_pieces", lambda p: (p["start"] > 0) | (p["words"] < F.col("_mix_size")))
    met = met.withColumn("_mix_words", F.when(some, F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))))
    cut = lambda p: F.array_join(F.slice("_mix_words", (p["start"] + 1).cast("int"), p["words"].cast("int")), "")
    texts = F.transform("_mix_pieces", lambda p: F.when((p["start"] == 0) & (p["words"] == F.col("_mix_size")), text).otherwise(cut(p)))
    out = met.select("_mix_doc", F.explode(texts).alias("_mix_text"))
    own = {"text": F.col("_mix_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("_mix_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(own[c].alias(c) if c in own else F.col("_mix_doc").getField(c).alias(c) for c in docs.columns))
