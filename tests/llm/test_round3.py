"""Whitening, periodic runs and compression bands against brute force, and their handling of odd input."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from evigraph.llm import compression_bands, periodic_runs, queries, whitening
from evigraph.llm.shared import Workspace

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"


# Earlier operators


def brute_rules(rows, least_support, least_confidence):
    """Rules of single tokens and pairs, by counting: (tokens, verdict) -> (confidence, support), those no smaller one equals."""
    from itertools import combinations

    out, n = {}, len(rows)
    names = sorted({t for tokens, _ in rows for t in tokens})
    for size in (1, 2):
        for some in combinations(names, size):
            have = [v for tokens, v in rows if set(some) <= set(tokens)]
            for v in set(have):
                if have.count(v) >= least_support * n and have.count(v) >= least_confidence * len(have):
                    out[some, v] = (have.count(v) / len(have), have.count(v) / n)
    return {(some, v): x for (some, v), x in out.items() if not any((less, v) in out and out[less, v][0] >= x[0] for less in combinations(some, len(some) - 1) if less)}


def test_rules_over_items_equal_rules_over_tokens(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(200):
        tokens = {f"t{x}" for x in rng.choice(6, 2, replace=False)}
        tokens |= {"u1", "u2"} if k % 3 == 0 else set()  # always together
        rows.append((sorted(tokens), "block" if ("u1" in tokens) ^ (rng.random() < 0.2) else "allow"))
    labelled = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(rows)], "row long, tokens array<string>, verdict string")
    from evigraph.llm import url_rules

    classes = url_rules.together(labelled, 10)
    items = {r.token: r.item for r in classes.collect()}
    assert items["u1"] == items["u2"] == "u1"
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in url_rules.mine(labelled, 0.05, 0.6, classes).collect()}
    want = brute_rules(rows, 0.05, 0.6)
    single = {(tuple(sorted({items[t] for t in some})), v): x for (some, v), x in want.items()}
    assert {k: v for k, v in got.items() if len(k[0]) <= 2} == {k: pytest.approx(v) for k, v in single.items()}


def test_many_keys_that_go_together(spark):
    from evigraph.llm import url_rules

    keys = "&".join(f"key{chr(97 + k % 26)}{chr(97 + k // 26)}=1" for k in range(40))
    urls = [f"https://a.org/x?{keys}" for _ in range(30)] + [f"https://b.com/de/x?{keys}&bad=1" for _ in range(30)] + ["https://c.net/y?bad=2", "https://c.net/y?keyaa=2", "https://c.net/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages).collect()}
    assert got[0] == ("org/", "allow") and got[30] == ("com/de/", "block") and got[60] == (None, "block") and got[62] == (None, "allow")


def test_pieces_of_documents_whatever_the_columns(spark):
    from evigraph.llm import mixing

    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(words[k : k + 700 * k]) + "\n tail", "a" if k % 2 else "b", "s", 1, 2, 3, 4, 5) for k in range(1, 5)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, start string, words int, shard int, slot int, hash int, begin int")
    got = mixing.mixed_documents(docs, block=64)
    assert got.columns == docs.columns
    texts = {r[0]: r[1] for r in rows}
    out = got.collect()
    assert out and all(r.text in texts[r.doc_id] and r.start == "s" for r in out)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs, block=64).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    mine = {}
    for r in out:
        mine[r.doc_id] = mine.get(r.doc_id, 0) + len(r.text.split())
    assert mine == {k: v for k, v in taken.items() if v}


def test_remembered_ids_are_bounded_by_bytes():
    import pyarrow as pa
    import public_tokenizers

    from evigraph.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    before = packing.REMEMBERED
    packing.REMEMBERED = 100_000
    try:
        for k in range(20):
            texts = pa.array([" ".join(f"{'q' * 90}{k}x{j}" for j in range(50)), "z" * 200_000])
            ids, first = packing.token_ids(texts, path, 2)
            want = [packing._tokenizer(path).encode(t, add_special_tokens=False).ids + [2] for t in texts.to_pylist()]
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want
            held = sum(len(w) + len(v) for part in packing._known[path] for w, v in part.items())
            assert held < 4 * 100_000 and all(len(w) <= packing.LONG for part in packing._known[path] for w in part)
    finally:
        packing.REMEMBERED = before


def test_lines_with_many_candidates_that_are_none(spark):
    """Variants of one line that differ from one another in two words and more: hundreds of candidates a line, few of them similar."""
    from evigraph.llm import line_dedup

    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(12)]
    texts, long = [], [f"l{k}" for k in range(90)]
    for k in range(260):
        one = list(base)
        for at in rng.choice(12, 2, replace=False):
            one[at] = f"x{rng.integers(0, 90)}"
        two = list(long)
        for at in rng.choice(90, int(rng.integers(8, 14)), replace=False):
            two[at] = f"y{rng.integers(0, 5000)}"
        texts.append((k, " ".join(one) + "\n" + " ".join(two)))
    got = {r.doc_id: r.removed for r in line_dedup.similar_lines(spark.createDataFrame(texts, "doc_id long, text string"), k=1).collect()}
    seen, want = [], {}
    for k, text in texts:
        want[k] = []
        for n, line in enumerate(text.split("\n")):
            words = set(line.split())
            if any(100 * len(words & x) >= 80 * len(words | x) for x in seen):
                want[k].append(n)
            seen.append(words)
    assert got == want and 10 < sum(map(len, want.values())) < 500


def scattered_passages(pieces, every, size, stride, seed=3):
    """Documents with 60-word passages and altered copies of them, of which every phrase occurs in earlier documents of its own."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    base = [fresh(60) for _ in range(8)]
    docs = [(k, " ".join(fresh(20) + p + fresh(20))) for k, p in enumerate(p[a : a + size] for _ in range(pieces) for p in base for a in range(0, 55, stride))]
    want = set()
    for p in base:
        altered = [w if k % every != every - 1 else fresh(1)[0] for k, w in enumerate(p)]
        docs += [(len(docs), " ".join(fresh(80) + p + fresh(80))), (len(docs) + 1, " ".join(fresh(80) + altered + fresh(80)))]
        want.add((len(docs) - 1, len(docs) - 2))
    return docs, want


@pytest.mark.parametrize(("pieces", "every", "size"), [(5, 10, 6), (3, 5, 6), (5, 8, 8)])
def test_passages_whose_phrases_occur_elsewhere_before(spark, pieces, every, size):
    from evigraph.llm import chaining

    docs, want = scattered_passages(pieces, every, size, 3)
    got = chaining.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.of_doc_id) for r in got} == want
    assert all(r.end - r.start >= 50 and r.equal >= 0.8 * max(r.end - r.start, r.of_end - r.of_start) for r in got)


def test_stretches_without_known_passages():
    from evigraph.llm.chaining import without

    assert without([(0, 100), (200, 260)], [(10, 60), (90, 95), (300, 400)]) == [(0, 10), (60, 90), (95, 100), (200, 260)]
    assert without([(0, 30)], [(0, 30)]) == [] and without([(0, 24)], [(24, 30)]) == [(0, 24)]


def test_longest_stretches_of_long_texts():
    from evigraph.llm.chaining import stretches

    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 50))
        b, a = (np.cumsum(1 + (rng.random(n) < 0.3) * rng.integers(0, 5, n)) for _ in range(2))
        want, todo = [], [(0, n)]
        while todo:
            x, y = todo.pop()
            fits = [(b[j] - b[i] + 1, -i, j) for i in range(x, y) for j in range(i, y) if b[j] - b[i] + 1 >= 9 and j - i + 1 >= 0.8 * max(b[j] - b[i] + 1, a[j] - a[i] + 1) - 1e-9]
            if fits:
                _, i, j = max(fits)
                want.append((-i, j))
                todo += [(x, -i), (j + 1, y)]
        assert stretches(b, a, 9, 0.8) == sorted(want)
    equal = np.flatnonzero(rng.random(100_000) < 0.75)
    import time

    began = time.time()
    stretches(equal, equal, 50, 0.8)
    assert time.time() - began < 20


def test_the_tables_of_operators_go_when_their_results_are_written(spark, tmp_path):
    import os

    from evigraph.llm import norm_topk
    from evigraph.llm.shared import dropped_after, shared_dir

    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "vec_id long, embedding array<double>")
    before = set(os.listdir(shared_dir(spark)))
    with dropped_after():
        norm_topk.top_inner_products(rows, query_every=10, k=2).write.parquet(str(tmp_path / "found"))
        assert set(os.listdir(shared_dir(spark))) - before
    assert set(os.listdir(shared_dir(spark))) == before and spark.read.parquet(str(tmp_path / "found")).count() == 6


# Whitening


@pytest.mark.parametrize("kind", ["dense", "repeated", "one direction", "constant columns", "axes"])
def test_spectra_grow_and_combine(kind):
    rng = np.random.default_rng(3)
    for d, n in ((1, 5), (7, 3), (16, 40), (33, 90)):
        x = rng.integers(-30, 30, (n, d)).astype(float)
        if kind == "repeated":
            x = x[rng.integers(0, max(1, n // 4), n)]
        if kind == "one direction":
            x = np.outer(rng.integers(-3, 3, n), rng.integers(-3, 3, d)).astype(float)
        if kind == "constant columns":
            x[:, rng.random(d) < 0.5] = 7
        if kind == "axes":
            x = np.eye(d)[rng.integers(0, d, n)] * 1000
        grown = [whitening.empty(d) for _ in range(3)]
        for k, row in enumerate(x):
            for to in (0, 1 if k < n // 3 else 2):
                grown[to] = whitening.with_row(grown[to], row)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        for rows, _, lam, q in (grown[0], whitening.combined(grown[1], grown[2])):
            assert rows == n
            assert np.abs(q @ np.diag(lam) @ q.T - scatter).max() <= 1e-11 * max(1, np.abs(scatter).max())
            assert np.abs(q.T @ q - np.eye(d)).max() < 1e-11


def test_secular_roots():
    d, z = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([0.5, 1e-4, 0.3, 0.8])
    origin, mu = whitening.secular_roots(d, z, 2.0)
    want = np.linalg.eigvalsh(np.diag(d) + 2.0 * np.outer(z, z))
    assert np.allclose(d[origin] + mu, want, rtol=0, atol=1e-13)
    assert ((d[origin] + mu)[:-1] <= d[1:]).all()


def test_whitened_against_exact_covariance(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(20)
    got = whitening.whitened(rows, 32).toPandas()
    assert got.columns.tolist() == "vec_id component n deviation whitened explained identity_error".split()
    data = {r.vec_id: np.floor(64 * np.array(r.embedding, np.float64)).astype(np.int64) + 1_000_000 for r in rows.collect()}
    ids = sorted(data)
    x = np.array([data[k] for k in ids])
    n, s = len(x), x.sum(0)
    off = n * x - s
    v = (off.T @ off).astype(np.float64) / n**3
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == dict(zip(ids, (off * off).sum(1).tolist(), strict=True))
    y = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = off / n @ u[:, :32] / np.sqrt(e[:32])
    want *= np.sign((want * y).sum(0))
    assert np.abs(y - want).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), e[:32] / np.trace(v), rtol=1e-10)


ODD = [(1, [1.0, 2.0], 7), (2, None, 7), (3, [None, 1.0], 7), (4, [float("nan"), 1.0], 7), (5, [float("inf"), 1.0], 7), (6, [3.0], 7), (None, [0.5, 0.25], 7), (1, [1.0, 2.0], 7), (8, [1e300, 0.0], 7), (9, [], 7)]


def test_whitening_of_odd_rows(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, component int").withColumn("n", F.lit("x"))
    got = whitening.whitened(rows, 32).collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 0, 1, 1, 1, 1, 6, 6, 9, 9]  # two dimensions, so two components
    x = [[64, 128], [192, 0], [32, 16], [64, 128], [0, 0]]
    sums = np.sum(x, 0)
    assert {r.deviation for r in got if r.vec_id == 6} == {int(((5 * np.array(x[1]) - sums) ** 2).sum())}
    assert whitening.whitened(rows.limit(0)).count() == 0 and whitening.whitened(rows.filter("embedding is null")).count() == 0


def test_whitening_without_variance(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0 + k]) for k in range(6)], "vec_id long, embedding array<double>")
    got = whitening.whitened(rows).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9
    assert all(r.whitened is None and r.deviation == 0 for r in whitening.whitened(rows.filter("vec_id = 1")).collect())


def test_deviation_that_fits_no_long():
    big = 2**40
    assert whitening.deviations(np.array([[0], [big]]), 10**6, [big * 10**6 // 2]) == [None, None]
    assert whitening.deviations(np.array([[0], [4]]), 2, [4]) == [16, 16]


def test_spectra_of_many_partitions_are_combined_in_rounds(spark):
    rows = spark.range(400).selectExpr("id as vec_id", "array(cast(id % 7 as double), cast(id % 5 as double), cast(id as double)) as embedding")
    x = Workspace(spark).written(whitening.quantized(rows.repartition(40)), "x")
    n, sums = whitening.exact_sums(x)
    assert n == 400 and sums[2] == sum(64 * k + 1_000_000 for k in range(400))
    found = whitening.spectrum(x.repartition(40), Workspace(spark), 3, n)
    data = np.array([[64 * (k % 7), 64 * (k % 5), 64 * k] for k in range(400)], float)
    assert found[0] == n and np.allclose(found[3] @ np.diag(found[2]) @ found[3].T, 400 * np.cov(data.T, bias=True), rtol=1e-10, atol=1e-4)


# Periodic runs


def brute_runs(x):
    out = {}
    for q in range(1, len(x) // 3 + 1):
        same = np.diff(np.concatenate(([0], np.array(x[:-q] == x[q:], np.int8), [0])))
        for s, t in zip(np.flatnonzero(same == 1), np.flatnonzero(same == -1), strict=True):
            if t - s + q >= max(24, 3 * q):
                out.setdefault((int(s), int(t - s + q)), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for b, w in ((8, 32), (64, 128), (2048, 4096)):
        blocks, windows = rng.integers(0, periodic_runs.PRIME, (3, b)).astype(float), rng.integers(0, periodic_runs.PRIME, (3, w)).astype(float)
        windows[1, 5 : 5 + b] = blocks[1]
        got = periodic_runs.mismatches(blocks, windows)
        for k, s in ((0, 0), (1, 4), (1, 5), (2, w - b), (2, 3)):
            want = sum((int(p) - int(q)) ** 2 for p, q in zip(blocks[k], windows[k, s : s + b], strict=True)) % periodic_runs.PRIME
            assert int(got[k, s]) % periodic_runs.PRIME == want


def test_all_runs_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(0, 600))
            x = rng.integers(0, int(rng.choice([1, 2, 3, 50])), n)
            for _ in range(int(rng.integers(0, 4)) * (n > 30)):
                a, e = sorted(rng.integers(0, n, 2).tolist())
                p = int(rng.integers(1, max(2, (n - a) // 2)))
                x[a:e] = x[a + np.arange(e - a) % p]
            texts.append(x)
        first = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        words = np.concatenate(texts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert periodic_runs.all_runs(words, first) == sorted((int(f) + s, n, q) for f, x in zip(first, texts, strict=False) for s, n, q in brute_runs(x))


def test_long_periods_and_long_turns():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**60, 60_000).astype(np.uint64)
    x[7_000:52_001] = x[7_000 + np.arange(45_001) % 12_345]  # blocks longer than LONGEST
    x[55_000:59_000] = 9
    assert periodic_runs.all_runs(x, np.array([0, len(x)])) == [(7_000, 45_001, 12_345), (55_000, 4_000, 1)]


def expected(doc_id, text, plant):
    words = [w for w in (text or "").translate(str.maketrans(WHITE, " " * len(WHITE))).split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = brute_runs(np.array([code[w] for w in words]))
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def test_runs_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    want = {d.doc_id: expected(d.doc_id, d.text, True) for d in docs}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 10


def test_runs_of_odd_documents(spark):
    schema = "doc_id long, text string, runs string, n_runs int, start string"
    texts = [(1, "a b " * 30), (1, "a b " * 30), (2, None), (3, ""), (4, " \t\n\x0b "), (None, "x\x0b" * 24), (5, "x " * 23), (6, "é ü é  ü\n" * 9), (7, "Ab ab " * 20), (8, "w" * 5_000 + " ")]
    docs = spark.createDataFrame([(k, t, "r", 1, "s") for k, t in texts], schema)
    got = periodic_runs.periodic_runs(docs).collect()
    assert sorted(tuple(r)[:8] for r in got if r.doc_id is not None) == sorted(expected(k, t, False) for k, t in texts if k is not None)
    by = {r.doc_id: r for r in got}
    assert by[None].n_runs == 1 and by[None].collapsed == "x" and by[6].collapsed == "é ü" and by[7].period == 2 and by[1].runs[0].length == 60
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_runs_in_a_text_longer_than_a_chunk(spark):
    rng = np.random.default_rng(0)
    words = [f"word{k}" for k in rng.integers(0, 10**6, 250_000)]
    words[1000:181_000] = (words[1000:61_000]) * 3
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 1000, 180_000, 60_000) and len(got[1].collapsed.split()) == 130_000


# Compression bands


def expected_counts(text):
    text = text or ""
    split = lambda t: [w for w in t.translate(str.maketrans(WHITE, " " * len(WHITE))).split(" ") if w]
    words = split(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = len({i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)})
    lines = [x for x in text.split("\n") if split(x)]
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed


def expected_verdict(text, limits):
    raw, z = (text or "").encode(), zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    if not raw:
        return True

    def fits(part):
        band = int(2 * math.log2(len(part)))
        near = sorted(limits, key=lambda b: (abs(b - band), b))[0]
        wide = 1 + 0.12 * abs(near - band) / 2
        return limits[near][0] / wide <= len(part) / len(z.compress(part)) <= limits[near][1] * wide

    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if len(parts) > 1 and len(parts[-1]) < 2048:
        parts[-2:] = [parts[-2] + parts[-1]]
    bad = sum(len(p) for p in parts if not fits(p)) if len(parts) > 1 else 0
    return fits(raw) and bad / len(raw) < 0.25


def test_rules_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    limits = compression_bands.fit_limits(docs, labels)
    got = {r.doc_id: r for r in compression_bands.quality_rules(docs, limits).collect()}
    kept = {r.doc_id for r in compression_bands.keep_ruled(docs, limits).collect()}
    for d in docs.collect():
        r, want = got[d.doc_id], expected_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[5] and expected_verdict(d.text, limits)) == (d.doc_id in kept)


def test_bands_reject_what_repeats_or_is_random_and_keep_prose(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    limits = compression_bands.fit_limits(docs, labels)
    rng = np.random.default_rng(0)
    vocabulary = [f"v{k}" for k in rng.integers(0, 10**9, 30)]
    planted = [(1, " ".join(rng.choice(vocabulary) for _ in range(3000))), (2, "".join(chr(c) for c in rng.integers(33, 127, 9000))), (3, " ".join("".join(chr(c) for c in rng.integers(97, 123, 7)) for _ in range(400)))]
    planted = spark.createDataFrame([(k, t if " " in t else " ".join(t[i : i + 9] for i in range(0, len(t), 9))) for k, t in planted], "doc_id long, text string")
    assert not any(r.kept for r in compression_bands.quality_rules(planted, limits).collect())
    judged = compression_bands.quality_rules(docs, limits).join(labels.hint("broadcast"), "doc_id").filter("not base_failed")
    clean = judged.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = judged.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.97 and junk < 0.6


def test_rules_of_odd_documents(spark):
    schema = "doc_id long, text string, kept string, ratio string, _id long"
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c " * 50), (4, "# " * 19), (5, " ".join(map(str, range(20)))), (6, "é\x0bü\n\né\x0bü\n x\n"), (7, "q " * 1_500_000), (5, " ".join(map(str, range(20))))]
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in texts], schema)
    got = compression_bands.quality_rules(docs).collect()
    assert sorted([(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]) == sorted(expected_counts(t) for _, t in texts)
    assert all(r.kept is not None for r in got) and not any(r.kept for r in got if r.doc_id != 5)
    assert compression_bands.keep_ruled(docs).columns == docs.columns
    nothing = docs.limit(0)
    assert compression_bands.quality_rules(nothing).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (None, 1)], "doc_id long, quality int")
    assert compression_bands.fit_limits(docs, labels) == compression_bands.DEFAULT_LIMITS == compression_bands.fit_limits(nothing, labels.limit(0))
