"""Operators 5 and 8: less moved, same results."""

import numpy as np
import pyarrow as pa

from evigraph.llm import chaining, setjoin
from evigraph.llm.textops import Words


def test_rare_words_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(1)
    level, size = rng.integers(0, 40, (60, 96)), rng.integers(0, 97, 60)
    found = chaining.rare_of_rows(level, size, 50, 11)
    for row, values, n in zip(found, level, size, strict=True):
        starts = np.arange(max(n - 49, 0))
        assert (row[:n] == chaining.rare(values[:n], starts, starts + 50, np.full(len(starts), 11))).all() and not row[n:].any()


def test_holders_of_frequent_seeds_go_out_once_unless_their_key_is_crowded():
    text = " ".join(f"w{k}" for k in range(60))
    seeds = chaining.seeds(Words(pa.array([text])))[0]
    asking = chaining._Asking(np.sort(seeds), np.full(len(seeds), 40), np.uint64(4), 50, 0.8)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
    every = np.full(setjoin.SLOTS // 64, ~np.uint64(0))
    keys = lambda crowded: np.concatenate([np.frombuffer(h, np.uint64) for out in asking.holders([batch], every, crowded) for h in out.column("h").to_pylist()])
    once = keys(np.zeros(0, np.uint64))
    assert len(np.unique(once)) == len(once)
    assert len(keys(once[:1])) == len(once) + chaining.SALTS - 1


def test_the_look_at_diagonals_says_what_alignment_does():
    rng = np.random.default_rng(2)
    rows, closed_found, closed_none = [], 0, 0
    for _ in range(400):
        n, same = int(rng.integers(30, 300)), rng.choice([0.2, 0.6, 0.85, 1.0])
        x = rng.integers(0, 1 << 30, n).astype(np.uint32)
        y = np.where(rng.random(n) < same, x, x + 1).astype(np.uint32)
        b0 = int(rng.integers(0, n - 20))
        length = int(rng.integers(8, min(n - b0, 200)))
        y[b0 : b0 + length] = x[b0 : b0 + length]
        shift = int(rng.integers(0, 60))
        y = np.concatenate((rng.integers(0, 1 << 30, shift).astype(np.uint32), y))
        rows.append((x, y, b0, b0 + shift, length))
    window = lambda w, at, length: w[max(at - chaining.MARGIN, 0) : at + length + chaining.MARGIN]
    cols = {"sb": [[b] for _, _, b, _, _ in rows], "b0": [r[2] for r in rows], "a0": [r[3] for r in rows], "b1": [r[2] + r[4] for r in rows]}
    cols |= {"wb": [window(x, b, n).tobytes() for x, _, b, _, n in rows], "wa": [window(y, a, n).tobytes() for _, y, _, a, n in rows]}
    one, before, after, passage = chaining.on_diagonal(pa.RecordBatch.from_pydict(cols), 50, 0.8)
    assert one.all()
    for k, (x, y, b0, a0, length) in enumerate(rows):
        s, t = min(b0, chaining.MARGIN), min(a0, chaining.MARGIN)
        b, a, back, on = chaining.align(window(x, b0, length), window(y, a0, length), [s], [t], [length])
        assert (bool(before[k]), bool(after[k])) == (back, on)
        found = bool(chaining.stretches(b, a, 50, 0.8))
        assert passage[k] or not found
        closed_found, closed_none = closed_found + found, closed_none + (not passage[k])
    assert closed_found and closed_none


def test_packed_rows_come_back_with_their_lists_and_in_pieces():
    bucket, x = np.array([1, 0, 1, 2]), np.array([10, 20, 30, 40])
    values, size = np.array([5, 6, 7, 8, 9]), np.array([2, 0, 1, 2])
    row = setjoin.packed(bucket, {"v": (values, np.cumsum(size) - size, size)}, x=x)
    found = {b: {c: v.tolist() for c, v in t.items()} for b, t in setjoin.unpacked([row], x=np.int64, v=np.int64)}
    assert found == {0: {"x": [20], "v": []}, 1: {"x": [10, 30], "v": [5, 6, 7]}, 2: {"x": [40], "v": [8, 9]}}
    one = [setjoin.packed(np.array([b]), x=np.array([k])) for k, b in enumerate((0, 1, 1, 1, 2))]
    assert [(b, t["x"].tolist()) for b, t in setjoin.unpacked(one, 8, x=np.int64)] == [(0, [0]), (None, [1, 2]), (None, [3]), (2, [4])]


def test_lines_are_the_same_where_lists_and_buckets_are_cut(spark, monkeypatch):
    from evigraph.llm import line_dedup

    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{k}" for k in rng.choice(40, 12, replace=False)) for _ in range(40)]
    near = [" ".join([*x.split()[:-1], f"n{k % 3}"]) for k, x in enumerate(lines)]
    picks = [[(lines + near + [""])[k] for k in rng.integers(0, 81, 6)] for _ in range(60)]
    docs = spark.createDataFrame([(k if k % 9 else None, "\n".join(x)) for k, x in enumerate(picks)], "doc_id long, text string").repartition(5)
    result = lambda: sorted((r.doc_id is None, r.doc_id, r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.similar_lines(docs, 1).collect())
    sets = sorted((d, l, frozenset(x.split())) for d, texts in enumerate(picks) if d % 9 for l, x in enumerate(texts))
    gone = {}
    for k, (d, l, x) in enumerate(sets):
        if x and any(y and 100 * len(x & y) >= 80 * len(x | y) for _, _, y in sets[:k]):
            gone.setdefault(d, []).append(l)
    whole = result()
    assert {d: r for none, d, _, _, r in whole if not none and r} == gone
    monkeypatch.setattr(setjoin, "LIST_ROWS", 7)
    monkeypatch.setattr(setjoin, "BUCKET_BYTES", 300)
    assert result() == whole
