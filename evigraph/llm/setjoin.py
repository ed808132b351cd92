"""Exact similarity join of many small sets, shared by the n-gram join and line dedup.

A set is a row ``(d long, l int, n int, sizes binary, prefix array<long>)``: its
key, its size, its sizes in blocks of columns and, in one global order, the
elements that a similar partner must share one of. ``prefix_length`` bounds that number from the size alone. Rows of
``prefix`` are the non-zero entries of a sparse incidence matrix; grouping them
by element is the blocked product whose non-zero cells are candidate pairs.

Work is linear in the entries first: every element links its sets to the least
of them (a star). Only what those verified stars leave apart meets in pairs, so
large groups of near copies never expand into all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace
from .textops import bound_of_blocks as _block_bound
from .textops import block_overlap, mix

#: Sets of one element that meet in one task; more are split into blocks.
BLOCK = 2_000
#: Second sets of one first set that meet it in one task; tokens that are multiplied at a time; blocks of columns of that product.
STAR, TOKENS, COLUMN_BLOCKS = 512, 500_000, 8
#: Bits of the bitmap that names sets to load for verification: fixed, 2 MB. A false hit only costs time.
SLOTS = 1 << 24
#: Rows of a list that meet in one task when each set takes its first candidate; longer lists are cut there, and their sets may go on.
LIST_ROWS = 10_000
#: Elements with more than LIST_ROWS sets that are told to every task, at most; more are joined by a shuffle.
LONG_LISTS = 20_000
#: Parts of the elements whose lists are made one after the other, so that only one part of them is on disk at a time.
PARTS = 2
#: Columns of a signature. In place of l1: a row that tells of a list, or of further candidates.
SIGNED, LIST, MORE = ("s0", "s1", "s2", "s3"), -2, -3
#: Columns of packed entries; bytes of a bucket that meet in memory; rows of short lists that are gone through together.
ENTRY = {"h": np.int64, "pos": np.int32, "d": np.int64, "l": np.int32, "n": np.int32, **dict.fromkeys(SIGNED, np.int64)}
BUCKET_BYTES, TOGETHER = 64 << 20, 50_000
#: Elements that a set may have to be told with 16 bits of each where lists are gone through again.
SHORT = 256
#: In place of l: the slot of any set of this d.
WHOLE = -1
_PAIR = pa.schema([("d1", pa.int64()), ("l1", pa.int32()), ("d2", pa.int64()), ("l2", pa.int32())])
_PAIR_DDL = "d1 long, l1 int, d2 long, l2 int"


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements of a set of n of which a partner of Jaccard >= num/den shares one: n - ceil(n num/den) + 1."""
    return n - -(-n * num // den) + 1


def least_overlap(n1: np.ndarray, n2: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least common elements of sets of n1 and n2 elements with Jaccard >= num/den."""
    return -(-(n1 + n2) * num // (num + den))


def common_elements(counts: DataFrame, keep: int, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements of (h, c), at most ``keep`` of them: values, sorted, and ranks.

    ``keep`` bounds what is broadcast. The choice only shapes the order of
    elements; results do not depend on it.
    """
    top = counts.groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    rows = top.orderBy(F.desc("c"), "h").limit(keep).toPandas()
    values = rows["h"].to_numpy(np.int64).view(np.uint64)
    ranks = np.minimum(4 * np.log2(rows["c"].to_numpy(float)), 127).astype(np.uint8)
    order = np.argsort(values)
    return values[order], ranks[order]


def repeats(values: np.ndarray, least: int = 2) -> pa.RecordBatch:
    """(h, c) of the values that at least ``least`` sets of a chunk have.

    An element of C sets over M chunks is seen once C*C/2M is a few, so longer
    unseen posting lists grow as the root of the number of chunks only.
    """
    found, count = np.unique(values, return_counts=True)
    keep = count >= least
    return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(count[keep])], ["h", "c"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Regroups sorted batches so that rows of equal keys are never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        cut = int(np.argmin(same[::-1])) if not same.all() else batch.num_rows
        cut = batch.num_rows - cut  # where the last run begins
        if cut == 0:
            if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                yield _table(held)
                held = []
            held.append(batch)
            continue
        yield _table([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield _table(held)


def _table(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return {c: _column(c, table.column(c)) for c in table.column_names}


def _column(name: str, column: pa.ChunkedArray) -> np.ndarray | pa.Array:
    if name == "short":
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _packed_rows(column) if pa.types.is_binary(column.type) else column.to_numpy()


def _packed_rows(column: pa.ChunkedArray) -> np.ndarray:
    """A binary column of equally long values as uint8 rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _run_bounds(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of ``size`` values from each ``start`` on, one row after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def packed(bucket: np.ndarray, lists: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows dealt into buckets: (bucket, one binary of each column), a row per bucket; Spark moves few large values in place of many rows.

    Columns of several values a row come as ``lists``: (values, start, size).
    """
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = _run_bounds(bucket) if len(bucket) else np.zeros(1, np.int64)
    out = [pa.array(bucket[cut[:-1]].astype(np.int64))]
    for x in columns.values():
        ends = pa.py_buffer((cut * x.itemsize).astype(np.int32))
        out.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(x[order]).tobytes())]))
    for values, start, size in (lists or {}).values():
        ends = pa.py_buffer((np.append(0, np.cumsum(size[order]))[cut] * values.itemsize).astype(np.int32))
        out.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, ends, pa.py_buffer(values[ragged(start[order], size[order])].tobytes())]))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns, *(lists or {})])


def unpacked(batches, most: int = 1 << 62, **kinds):
    """(bucket, {column: array}) of each bucket, from packed rows sorted by bucket; a bucket of more than ``most`` bytes comes in pieces, with bucket None."""
    held, now, held_bytes, cut = [], None, 0, False
    whole = lambda: {c: np.frombuffer(b"".join(x), kind) for (c, kind), x in zip(kinds.items(), zip(*held, strict=True), strict=True)}
    for batch in batches:
        for bucket, *values in zip(*(batch.column(c).to_pylist() for c in ("bucket", *kinds)), strict=True):
            if held and (bucket != now or held_bytes > most):
                cut = cut or bucket == now
                yield None if cut else now, whole()
                held, held_bytes = [], 0
            cut = cut and bucket == now
            now = bucket
            held.append(values)
            held_bytes += sum(map(len, values))
    if held:
        yield None if cut else now, whole()


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _may_match(t: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length and positional bounds: can sets i and j, that share this element, be similar?"""
    n1, n2 = t["n"][i].astype(np.int64), t["n"][j].astype(np.int64)
    rest = np.minimum(n1 - t["pos"][i], n2 - t["pos"][j])  # this element and those after it
    before = np.minimum(t["pos"][i], t["pos"][j])  # those before it, at most
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (rest + before >= least_overlap(n1, n2, num, den))


def _unique_pairs(t: dict, i: np.ndarray, j: np.ndarray, ok: np.ndarray | None = None) -> pa.RecordBatch | None:
    if ok is not None:
        i, j = i[ok], j[ok]
    if not len(i):
        return None
    d1, l1, d2, l2 = t["d"][i], t["l"][i], t["d"][j], t["l"][j]
    order = np.lexsort((l2, d2, l1, d1))
    d1, l1, d2, l2 = d1[order], l1[order], d2[order], l2[order]
    at = _run_bounds(d1, l1, d2, l2)[:-1]
    return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (d1, l1, d2, l2)], schema=_PAIR)


def shared_entries(sets: DataFrame) -> DataFrame:
    """(h, d, l, n, pos): entries of elements that several sets have, with the least such set's (d0, l0, n0, pos0).

    A list streams through its task: one row is remembered, however long it is.
    """
    columns = ["h", "d", "l", "n", "pos"]

    def keep(batches):
        seen = None  # the last row, and whether it opens a list and has not been told yet
        head = None  # the first row of the last list
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in columns]
            if seen:
                cols = [np.append(x, y).astype(y.dtype) for x, y in zip(seen[0], cols, strict=True)]
            h = cols[0]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            out = ~new
            out[:-1] |= ~new[1:]
            if seen:  # its first row goes on the list that went before, and is told now if it opened it
                out[0] = bool(out[0] and seen[1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            first = [x[at] for x in cols[1:]]
            if seen and head is not None:
                of_old = at == 0
                first = [np.where(of_old, o, x).astype(x.dtype) for o, x in zip(head, first, strict=True)]
            head = [x[-1] for x in first]
            seen = ([x[-1] for x in cols], bool(new[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (*cols, *first)], [*columns, "d0", "l0", "n0", "pos0"])

    entries = sets.select("d", "l", "n", F.posexplode("prefix").alias("pos", "h")).select(*columns)
    return entries.repartition("h").sortWithinPartitions("h", "d", "l").mapInArrow(
        keep, "h long, d long, l int, n int, pos int, d0 long, l0 int, n0 int, pos0 int"
    )


def star_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of each entry's set with the least set of the same element, that the size bounds allow."""
    n1, n2 = F.col("n0").cast("long"), F.col("n").cast("long")
    rest = F.least(n1 - F.col("pos0"), n2 - F.col("pos")) + F.least("pos0", "pos")
    return (
        entries.filter((F.col("d") != F.col("d0")) | (F.col("l") != F.col("l0")))
        .filter((F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (rest * (num + den) >= (n1 + n2) * num))
        .select(F.col("d0").alias("d1"), F.col("l0").alias("l1"), F.col("d").alias("d2"), F.col("l").alias("l2"))
        .distinct()
    )


def _near(t: dict, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of the rows after each one in its run (bounds), where sizes ascend, have a size near enough."""
    run, n = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), t["n"].astype(np.int64)
    wide = int(n.max()) * den // num + 1
    return np.searchsorted(run * wide + n, run * wide + np.minimum(n * den // num, wide - 1), "right") - np.arange(len(n)) - 1


def _by_place(t: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the set at the earlier place first."""
    turned = (t["d"][i] > t["d"][j]) | ((t["d"][i] == t["d"][j]) & (t["l"][i] > t["l"][j]))
    return np.where(turned, j, i), np.where(turned, i, j)


def _signed_candidates(t: dict, left: np.ndarray, wanted: np.ndarray, fits, skip: int, most: int, num: int, den: int):
    """(i, j, open): for each wanted row j its candidates at earlier places but for the first ``skip``, ``most`` of them; open rows have more.

    left tells how many rows after each one are near enough in size.
    """
    seen = np.zeros(len(left), np.int64)
    act, step, found = np.flatnonzero(left >= 1), 1, []
    while len(act):
        i, j = _by_place(t, act, act + step)
        ok = wanted[j] & (seen[j] <= skip + most)
        i, j = i[ok], j[ok]
        ok = _may_match(t, i, j, num, den) & fits(i, j)
        i, j = i[ok], j[ok]
        ok = _signatures_allow(t, i, j, num, den)
        i, j = i[ok], j[ok]
        ok = _shorts_allow(t, i, j, num, den)
        i, j = i[ok], j[ok]
        # a row is the later one of two pairs of a step at most
        for first in (True, False):
            _, at = np.unique(j, return_index=True)
            one = np.zeros(len(j), bool)
            one[at] = True
            sel = np.flatnonzero(one if first else ~one)
            if not len(sel):
                continue
            a, b = i[sel], j[sel]
            take = (seen[b] >= skip) & (seen[b] < skip + most)
            found.append((a[take], b[take]))
            seen[b] += 1
        step += 1
        act = act[left[act] >= step]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return i, j, np.flatnonzero(seen > skip + most)


def _told(t: dict, i: np.ndarray, j: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs, and rows with l1 = MORE that name sets with further candidates."""
    pair = _unique_pairs(t, i, j)
    if pair is not None:
        yield pair
    if len(more):
        none = np.zeros(len(more), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(none), pa.array(np.full(len(more), MORE, np.int32)), pa.array(t["d"][more]), pa.array(t["l"][more])], schema=_PAIR)


def packed_entries(sets: DataFrame, part: int, buckets: int) -> DataFrame:
    """The entries of one part of the elements, packed by bucket of the element (columns ENTRY)."""
    columns = ["d", "l", "n", *SIGNED]

    def entries(batches):
        for batch in batches:
            size = batch.column("prefix").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column("prefix").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            at = np.flatnonzero(h % PARTS == part)
            h, row = h[at], row[at]
            yield packed((mix(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), h=h, pos=pos[at], **{c: batch.column(c).to_numpy()[row] for c in columns})

    return sets.select(*columns, "prefix").mapInArrow(entries, "bucket long, " + ", ".join(f"{c} binary" for c in ENTRY))


def first_candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """For each entry's set one set at an earlier place with the same element that sizes, places in the order and signatures allow.

    entries are packed ones. Rows with l1 = MORE name, in d2 and l2, sets that
    have further candidates, or may have in lists of more than LIST_ROWS or in
    buckets that don't fit one task; rows with l1 = LIST tell of those lists: the
    element and its sets in this piece.
    """

    def candidates(batches):
        for bucket, t in unpacked(batches, BUCKET_BYTES, **ENTRY):
            order = np.lexsort((t["n"], t["h"]))
            t = {c: x[order] for c, x in t.items()}
            lists = _run_bounds(t["h"])
            size = np.repeat(np.diff(lists), np.diff(lists))
            cut = (size > LIST_ROWS) if bucket is not None else np.ones(len(size), bool)
            bounds = _run_bounds(t["h"], (np.arange(len(size)) - np.repeat(lists[:-1], np.diff(lists))) // LIST_ROWS)
            every = np.ones(len(t["h"]), bool)
            i, j, more = _signed_candidates(t, _near(t, bounds, num, den), every, lambda i, j: np.ones(len(i), bool), 0, 1, num, den)
            yield from _told(t, i, j, np.union1d(more, np.flatnonzero(cut)))
            pieces = bounds[:-1][cut[bounds[:-1]]]
            if len(pieces):
                none = pa.array(np.full(len(pieces), LIST, np.int32))
                sizes = np.diff(bounds)[np.searchsorted(bounds[:-1], pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(t["h"][pieces]), none, pa.array(sizes.astype(np.int64)), none], schema=_PAIR)

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(candidates, _PAIR_DDL)


def further_candidates(entries: DataFrame, num: int, den: int, skip: int, most: int) -> DataFrame:
    """Candidates of the sets with mark 0 but for the first ``skip`` in each list, ``most`` of them; rows with l1 = MORE as above.

    entries has nb besides, the blocks that the element's sets are dealt into;
    pairs of blocks meet in separate tasks.
    """

    def candidates(batches):
        for t in _runs(_together(batches, TOGETHER), ["h", "b1", "b2"]):
            left = _near(t, _run_bounds(t["h"], t["b1"], t["b2"]), num, den)
            fits = lambda i, j: (t["blk"][i] != t["blk"][j]) | (t["b1"][i] == t["b2"][i])  # noqa: B023, E731
            yield from _told(t, *_signed_candidates(t, left, t["mark"] == 0, fits, skip, most, num, den))

    return _dealt(entries, (*SIGNED, "short")).mapInArrow(candidates, _PAIR_DDL)


def _dealt(entries: DataFrame, bounds: tuple[str, ...]) -> DataFrame:
    """entries by pairs of blocks (b1, b2) of each element, sizes ascending."""
    dealt = entries.withColumn("blk", F.expr("cast(pmod(xxhash64(d, l), nb) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = dealt.withColumns({"b1": F.least("blk", "other"), "b2": F.greatest("blk", "other")})
    dealt = dealt.select("h", "b1", "b2", "d", "l", "n", "pos", "mark", "blk", *bounds)
    return dealt.repartition("h", "b1", "b2").sortWithinPartitions("h", "b1", "b2", "n", "d", "l")


def signatures(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """256 bits of each unit as four int64: which of 256 columns blocks it has elements in."""
    n, out = len(first) - 1, []
    bit = (values & np.uint64(255)).astype(np.int64)
    for a in range(0, n, 16_384):
        b = min(n, a + 16_384)
        cells = np.zeros((b - a, 256), bool)
        cells[np.repeat(np.arange(b - a), np.diff(first[a : b + 1])), bit[first[a] : first[b]]] = True
        out.append(np.packbits(cells, axis=1).view(np.int64))
    rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return [np.ascontiguousarray(rows[:, k]) for k in range(4)]


def _signatures_allow(t: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the elements in columns that the other set has none in leave either side enough to share."""
    n1, n2 = t["n"][i].astype(np.int64), t["n"][j].astype(np.int64)
    alone, other = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for c in SIGNED:
        x, y = t[c][i].view(np.uint64), t[c][j].view(np.uint64)
        alone += np.bitwise_count(x & ~y)
        other += np.bitwise_count(y & ~x)
    return np.minimum(n1 - alone, n2 - other) >= least_overlap(n1, n2, num, den)


def low_bits(values: np.ndarray) -> np.ndarray:
    """16 bits of each element, as sets of SHORT elements at most tell them."""
    return (values >> np.uint64(8)).astype(np.uint16)


def _shorts_allow(t: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether enough elements of either set have the 16 bits of one of the other's; true for pairs with a set that has none told."""
    if "short" not in t or not len(i):
        return np.ones(len(i), bool)
    used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    rows = t["short"].take(pa.array(used))
    size = np.diff(np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)) // 2
    flat = np.frombuffer(b"".join(rows.to_pylist()), np.uint16).astype(np.uint64)
    begin = np.cumsum(size) - size
    n1, n2 = t["n"][i].astype(np.int64), t["n"][j].astype(np.int64)
    out = np.ones(len(i), bool)
    for a in range(0, len(i), 100_000):
        x, y = at[: len(i)][a : a + 100_000], at[len(i) :][a : a + 100_000]
        told = (size[x] > 0) & (size[y] > 0)
        keys, of = [], []
        for side in (x, y):
            count = np.where(told, size[side], 0)
            row = np.repeat(np.arange(len(side)), count)
            place = np.repeat(begin[side] - (np.cumsum(count) - count), count) + np.arange(len(row))
            keys.append((row.astype(np.uint64) << np.uint64(16)) | flat[place])
            of.append(row)
        shared = [np.bincount(of[k][np.isin(keys[k], keys[1 - k])], minlength=len(x)) for k in (0, 1)]
        out[a : a + 100_000] = ~told | (np.minimum(*shared) >= least_overlap(n1[a : a + 100_000], n2[a : a + 100_000], num, den))
    return out


def open_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs within each element of different marks (components still apart).

    entries has ``nb``, the blocks that the element's sets are dealt into,
    ``mark`` and ``sizes`` besides; the sizes in column blocks bound the overlap
    here already. Pairs of blocks meet in separate tasks.
    """

    def pairs(batches):
        for t in _runs(batches, ["h", "b1", "b2"]):
            n = t["n"].astype(np.int64)
            left = _near(t, _run_bounds(t["h"], t["b1"], t["b2"]), num, den)
            act, step, found = np.flatnonzero(left >= 1), 1, []
            while len(act):
                other = act + step
                ok = _may_match(t, act, other, num, den) & (t["mark"][act] != t["mark"][other])
                ok &= (t["blk"][act] != t["blk"][other]) | (t["b1"][act] == t["b2"][act])
                i, j = _by_place(t, act[ok], other[ok])
                ok = _block_bound(t["sizes"][i], t["sizes"][j]) >= least_overlap(n[i], n[j], num, den)
                found.append((i[ok], j[ok]))
                step += 1
                act = act[left[act] >= step]
                if sum(len(a) for a, _ in found) > 2_000_000:
                    yield _unique_pairs(t, *map(np.concatenate, zip(*found, strict=True)))
                    found = []
            if found and (out := _unique_pairs(t, *map(np.concatenate, zip(*found, strict=True)))):
                yield out

    return _dealt(entries, ("sizes",)).mapInArrow(pairs, _PAIR_DDL).distinct()


def slot(d: np.ndarray, l: np.ndarray) -> np.ndarray:
    return (mix(d.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + l.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def wanted(pairs: DataFrame) -> np.ndarray:
    """A bitmap over the slots of all sets in pairs, of SLOTS bits whatever the input's size."""

    def slots(batches):
        for b in batches:
            sides = [(b.column(f"d{k}").to_numpy(), b.column(f"l{k}").to_numpy()) for k in (1, 2)]
            both = [slot(d, x) for d, l in sides for x in (l, np.full(len(l), WHOLE, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(both)))], ["s"])

    return bitmap_of(pairs.mapInArrow(slots, "s long"))


def bitmap_of(slots: DataFrame, size: int = SLOTS) -> np.ndarray:
    """The bitmap of slots (s), of ``size`` bits."""
    words = slots.groupBy(F.expr("shiftright(s, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("x"))
    out = np.zeros(size // 64, np.uint64)
    rows = words.toPandas()
    out[rows["w"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64).view(np.uint64)
    return out


def is_wanted(bitmap: np.ndarray, d: np.ndarray, l: np.ndarray) -> np.ndarray:
    s = slot(d, l)
    return (bitmap[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1


def bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes in each column block still allow Jaccard >= num/den.

    The overlap of two rows is at most the sum, over column blocks of the
    incidence matrix, of the smaller of their sizes there.
    """
    sizes = sets.select("d", "l", "n", "sizes")
    joined = pairs
    for k in (1, 2):
        side = sizes.select(F.col("d").alias(f"d{k}"), F.col("l").alias(f"l{k}"), F.col("n").alias(f"n{k}"), F.col("sizes").alias(f"s{k}"))
        joined = joined.hint("shuffle_merge").join(side.hint("shuffle_merge"), [f"d{k}", f"l{k}"])

    def keep(batches):
        for b in batches:
            if b.num_rows:
                n1, n2 = b.column("n1").to_numpy().astype(np.int64), b.column("n2").to_numpy().astype(np.int64)
                ok = block_overlap(b.column("s1"), b.column("s2")) >= least_overlap(n1, n2, num, den)
                yield b.select(["d1", "l1", "d2", "l2"]).filter(pa.array(ok))

    return joined.mapInArrow(keep, _PAIR_DDL)


def _overlaps(centre: tuple[np.ndarray, np.ndarray], row: np.ndarray, star: np.ndarray, token: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which rows share at least ``need`` elements with the centre of their star.

    centre is (star, element), as are the rows' (row, star of the row, element).
    Counts accumulate over blocks of columns; a row that can't reach its bound
    any more, with all that is left on the smaller side, is dropped on the way.
    """
    n = len(need)
    block, own_block = (x & np.uint64(COLUMN_BLOCKS - 1) for x in (token, centre[1]))
    cell, own = (mix(t + mix(k.astype(np.uint64) + np.uint64(1))) for t, k in ((token, star[row]), (centre[1], centre[0])))
    rest, stars = np.bincount(row, minlength=n), int(max(star.max(initial=0), centre[0].max(initial=0))) + 1
    own_rest = np.bincount(centre[0], minlength=stars)
    overlap, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for c in range(COLUMN_BLOCKS):
        here, there = block == c, own_block == c
        rest = rest - np.bincount(row[here], minlength=n)
        own_rest = own_rest - np.bincount(centre[0][there], minlength=stars)
        here &= alive[row]
        column = np.sort(own[there])
        if len(column):
            at = np.minimum(np.searchsorted(column, cell[here]), len(column) - 1)
            overlap += np.bincount(row[here][column[at] == cell[here]], minlength=n)
        alive &= overlap + np.minimum(rest, own_rest[star]) >= need
    return alive


def products(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of Jaccard >= num/den from rows sorted by star (d1, l1, blk), each star's centre (d2 null) before its members.

    Rows are read as a stream: of earlier batches only the last centre is kept.
    """
    keys, held = ["d1", "l1", "blk"], []
    for whole in batches:
        ends = np.append(0, np.cumsum(whole.column("tokens").value_lengths().to_numpy(zero_copy_only=False)))
        start = 0
        while start < whole.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOKENS, "right")) - 1)
            batch, start = whole.slice(start, stop - start), stop
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            member = batch.column("d2").is_valid().to_numpy(zero_copy_only=False)
            bounds = _run_bounds(*(batch.column(c).to_numpy() for c in keys))
            star = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            centres = np.flatnonzero(~member & (star == star[-1]))
            held = [batch.take(pa.array(centres))]
            size = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            turn = np.arange(len(size)) - bounds[star]  # more than one centre where keys repeat
            number, at = np.cumsum(member) - 1, member[row]
            ok = np.zeros(int(member.sum()), bool)
            for k in range(int(turn[~member].max(initial=-1)) + 1):
                one = ~member & (turn == k)
                own, centre_size = one[row], np.zeros(len(bounds) - 1, np.int64)
                centre_size[star[one]] = size[one]
                need = least_overlap(size[member], centre_size[star[member]], num, den)
                ok |= _overlaps((star[row[own]], token[own]), number[row[at]], star[member], token[at], need)
            found = np.flatnonzero(member)[ok]
            if len(found):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(found)) for c in _PAIR.names], schema=_PAIR)


def verified(pairs: DataFrame, sets: DataFrame | None, load: Callable[[np.ndarray], DataFrame], num: int, den: int, work: Workspace, name: str) -> DataFrame:
    """Pairs whose whole sets have Jaccard >= num/den; with ``sets`` they are bounded first.

    load(bitmap) gives (d, l, tokens array<long>), of distinct elements, for at
    least the sets in the bitmap. The pairs of one first set are a row block of
    the product: its tokens meet those of at most STAR second sets in one task.
    """
    if sets is not None:
        pairs = work.written(bounded(pairs, sets, num, den), f"{name}-bounded")
    whole = work.written(load(wanted(pairs)).select("d", "l", "tokens"), f"{name}-sets")
    many = pairs.groupBy("d1", "l1").agg(F.ceil(F.count("*") / STAR).cast("int").alias("nb")).filter("nb > 1")
    dealt = pairs.hint("shuffle_merge").join(many.hint("shuffle_merge"), ["d1", "l1"], "left").withColumn("blk", F.expr("cast(pmod(xxhash64(d2, l2), coalesce(nb, 1)) as int)")).drop("nb")
    centres = dealt.select("d1", "l1", "blk").distinct().hint("shuffle_merge").join(whole.select(F.col("d").alias("d1"), F.col("l").alias("l1"), "tokens").hint("shuffle_merge"), ["d1", "l1"])
    members = dealt.hint("shuffle_merge").join(whole.select(F.col("d").alias("d2"), F.col("l").alias("l2"), "tokens").hint("shuffle_merge"), ["d2", "l2"])
    none = {"d2": F.lit(None).cast("long"), "l2": F.lit(None).cast("int")}
    order = ["d1", "l1", "blk", "d2", "l2"]
    rows = centres.withColumns(none).select(*order, "tokens").union(members.select(*order, "tokens"))
    rows = rows.repartition("d1", "l1", "blk").sortWithinPartitions("d1", "l1", "blk", F.col("d2").asc_nulls_first())
    out = work.written(rows.mapInArrow(lambda batches: products(batches, num, den), _PAIR_DDL), name)
    work.drop(f"{name}-sets")
    return out


def component_links(sets: DataFrame, load, num: int, den: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Links enough to join every component of similar sets, and the components (id, component) of their d."""
    from .components import components

    entries = work.written(shared_entries(sets), "entries")
    links = verified(work.written(star_pairs(entries, num, den), "star"), sets, load, num, den, work, "links")
    parts = components(links.select(F.col("d1").alias("a"), F.col("d2").alias("b")), work, "parts")
    known = sets.select("d", "l").hint("shuffle_merge").join(parts.select(F.col("id").alias("d"), "component").hint("shuffle_merge"), "d", "left")
    more = verified(_left_open(entries, known.select("d", "l", F.coalesce("component", "d").alias("mark")), sets, num, den, work), None, load, num, den, work, "more")
    work.drop("entries", "star", "open", "links-bounded")
    links = links.union(more)
    return links, components(links.select(F.col("d1").alias("a"), F.col("d2").alias("b")), work, "whole")


def _left_open(entries: DataFrame, known: DataFrame, sets: DataFrame, num: int, den: int, work: Workspace) -> DataFrame:
    """Candidate pairs of different components, from the elements whose sets (d, l, mark) are still in several; sizes come in only there."""
    columns = ["h", "d", "l", "n", "pos"]
    marked = work.written(entries.select(*columns).hint("shuffle_merge").join(known.hint("shuffle_merge"), ["d", "l"]), "marked")
    lists = marked.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    lists = lists.filter("low <> high").select("h", "nb")
    some = marked.hint("shuffle_merge").join(lists.hint("shuffle_merge"), "h").hint("shuffle_merge").join(sets.select("d", "l", "sizes").hint("shuffle_merge"), ["d", "l"])
    star = work.read("star")
    left = open_pairs(some, num, den)
    out = work.written(left.hint("shuffle_merge").join(star.hint("shuffle_merge"), ["d1", "l1", "d2", "l2"], "left_anti"), "open")
    work.drop("marked")
    return out


def later_matches(sets: DataFrame, load, num: int, den: int, work: Workspace, buckets: int) -> DataFrame:
    """(d, l) of every set with a similar set before it in (d, l) order. Sets have SIGNED and short (see ``low_bits``) in place of sizes.

    First every set meets one candidate of each list; only the lists of sets that
    found no match so, and have further candidates, are gone through again, with
    16 bits of every element of small sets told besides the signatures, so that
    few candidates are none.
    """
    told = reduce(DataFrame.union, [work.written(first_candidates(packed_entries(sets, part, buckets), num, den), f"told-{part}") for part in range(PARTS)])
    tried = work.written(told.filter("l1 >= 0").distinct(), "tried-0")
    first = verified(tried, None, load, num, den, work, "first")
    found = work.written(first.select(F.col("d2").alias("d"), F.col("l2").alias("l")).distinct(), "found-0")
    long = work.written(told.filter(F.col("l1") == LIST).groupBy(F.col("d1").alias("h")).agg(F.ceil(F.sum("d2") / BLOCK).cast("int").alias("nb")), "long")
    n = long.count()
    for turn, (skip, most) in enumerate(((0, 3), (3, 1 << 40)), 1):  # few first, as most sets with candidates have a match among them
        named = told.filter(F.col("l1") == MORE).select(F.col("d2").alias("d"), F.col("l2").alias("l")).distinct()
        open_ = work.written(named.hint("shuffle_merge").join(found.hint("shuffle_merge"), ["d", "l"], "left_anti"), f"open-{turn}")
        if open_.isEmpty():
            break
        again = _entries_beside(sets, open_, num, den)
        if n:
            again = again.hint("shuffle_merge").join(long.hint("broadcast" if n <= LONG_LISTS else "shuffle_merge"), "h", "left")
        again = again.withColumn("nb", F.coalesce("nb", F.lit(1)) if n else F.lit(1))
        told = work.written(further_candidates(again, num, den, skip, most), f"further-{turn}")
        fresh = told.filter("l1 >= 0").distinct().hint("shuffle_merge").join(tried.hint("shuffle_merge"), ["d1", "l1", "d2", "l2"], "left_anti")
        fresh = work.written(fresh, f"tried-{turn}")
        more = verified(fresh, None, load, num, den, work, f"more-{turn}")
        tried = tried.union(fresh)
        found = found.union(work.written(more.select(F.col("d2").alias("d"), F.col("l2").alias("l")).distinct(), f"found-{turn}"))
    return found.distinct()


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Classes of sizes such that similar sets are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / (np.log(den / num) * (1 + 1e-9)) + 1e-9).astype(np.int32)


def _entries_beside(sets: DataFrame, open_: DataFrame, num: int, den: int) -> DataFrame:
    """Entries of the elements that the open sets (d, l) have, of sets that are near enough in size, with mark 0 for the open ones, else 1.

    By two bitmaps of fixed size, of the open sets and of their elements by size
    class; a false hit only costs time.
    """
    zero = [F.col("d").alias("d1"), F.col("l").alias("l1"), F.col("d").alias("d2"), F.col("l").alias("l2")]
    of_sets = wanted(open_.select(*zero))

    def elements(batches):
        for b in batches:
            hit = is_wanted(of_sets, b.column("d").to_numpy(), b.column("l").to_numpy())
            prefix = b.column("prefix").filter(pa.array(hit))
            h = prefix.flatten().to_numpy(zero_copy_only=False)
            kind = np.repeat(size_class(b.column("n").to_numpy()[hit], num, den), prefix.value_lengths().to_numpy(zero_copy_only=False))
            near = [slot(h, kind + np.int32(k)) for k in range(3)]  # the classes from the one below to the one above
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(near)))], ["s"])

    of_elements = bitmap_of(sets.select("d", "l", "n", "prefix").mapInArrow(elements, "s long"))
    columns = ["d", "l", "n", *SIGNED, "short"]

    def beside(batches):
        for b in batches:
            size = b.column("prefix").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = b.column("prefix").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            at = is_wanted(of_elements, h, size_class(b.column("n").to_numpy(), num, den)[row] + np.int32(1))
            mark = 1 - is_wanted(of_sets, b.column("d").to_numpy(), b.column("l").to_numpy()).astype(np.int64)
            row = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), *(b.column(c).take(pa.array(row)) for c in columns), pa.array(pos[at].astype(np.int32)), pa.array(mark[row])], ["h", *columns, "pos", "mark"])

    return sets.select(*columns, "prefix").mapInArrow(beside, "h long, d long, l int, n int, s0 long, s1 long, s2 long, s3 long, short binary, pos int, mark long")
