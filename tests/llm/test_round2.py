"""Whole results against brute force, and odd input."""

import time

import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import kmeans_tree, mixing, norm_topk, packing, quality_net, queries, secrets, shared


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    found = db.execute(queries.ORACLE_SQL[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    got = queries.QUERIES[name](spark, at)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(want, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def test_repeated_and_shorter_vectors_take_part(spark):
    rows = [(0, [1.0, 0.0, 0.0], "x"), (0, [0.0, 1.0], "y"), (1, [2.0], "z"), (2, [0.0, 3.0, 0.0], None), (3, [], None), (4, None, None), (5, [1.0, None], None), (6, [float("nan")], None), (7, [float("inf")], None), (None, [1.0], None)]
    top = norm_topk.top_inner_products(vectors(spark, rows), query_every=50, k=5).toPandas()
    by = lambda t, x: sorted(map(tuple, t[t["rank"] == x][["vec_id", "score"]].to_numpy().tolist()))
    # the two rows of id 0 are queries of their own: their best are 2 * 1 and 3 * 1
    assert by(top, 1) == [(1, 2 * 65536), (2, 3 * 65536)] and len(top) == 8
    near = kmeans_tree.nearest_neighbours(vectors(spark, rows), query_every=50, k=5).toPandas()
    assert by(near, 1) == [(1, 1.0), (2, 1.0)] and len(near) == 6


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError):
        norm_topk.top_inner_products(vectors(spark, [(0, [1e30], None), (1, [1.0], None)]))


def test_recall_of_queries_outside_the_fitted_sample(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = kmeans_tree.nearest_neighbours(table, query_every=50, k=5, sample=1_500).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-s)[:5]))
    assert hits >= 0.9 * 5 * 120


def test_bounds_carry_from_block_to_block(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("QUERY_BLOCK", 8), ("HELD", 3), ("STEP", 8)):
        monkeypatch.setattr(norm_topk, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12)) * rng.exponential(size=(700, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = norm_topk.top_inner_products(table, query_every=7, k=4).toPandas()
    z = np.floor(256 * x).astype(np.int64)
    for q in range(0, 700, 7):
        s = z @ z[q]
        s[q] = -(10**15)
        best = np.lexsort((np.arange(700), -s))[:4]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == best.tolist() and mine.score.tolist() == s[best].tolist()


def test_draws_of_any_size_are_uniform_choices():
    rng = np.random.default_rng(1)
    huge = np.array([6 * 10**12, 3 * 10**12, 0, 10**12, 5])
    for n in (0, 1, 10**11, int(huge.sum()) - 1, int(huge.sum())):
        out = mixing.drawn(huge, n, rng)
        assert out.sum() == n and (out >= 0).all() and (out <= huge).all()
        assert np.abs(out - huge * (n / huge.sum())).max() < 8 * np.sqrt(n + 1) + 1
    # against the hypergeometric distribution: mean and variance
    counts = np.array([30, 50, 20])
    some = np.array([mixing.drawn(counts, 40, rng) for _ in range(4000)])
    share = counts / 100
    assert np.allclose(some.mean(0), 40 * share, atol=0.15)
    assert np.allclose(some.var(0), 40 * share * (1 - share) * 60 / 99, rtol=0.12)


def test_scores_depend_on_the_text_alone(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab c"), int(n))) for n in rng.integers(0, 1500, 60)] + ["", "x", "ababababababababababab"]
    net = quality_net.Net()
    together = net.scores(pa.array(texts, pa.large_string()))
    alone = np.concatenate([net.scores(pa.array([t], pa.large_string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    for t, n in ((texts[3], 3), (texts[7], 7)):
        _, same, text = quality_net.chunked(pa.array(texts, pa.large_string()))
        assert (same[text == n] == quality_net.chunked(pa.array([t], pa.large_string()))[1]).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    codes, same, of = quality_net.chunked(pa.array(["".join(rng.choice(list("abcde f"), 900)) for _ in range(3)], pa.large_string()))
    labels = np.array([1.0, 0.0, 1.0])
    net = quality_net.Net()
    for name in ("embed", "filters", "shift", "weight", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.shift += 0.3

    def loss():
        h, _, _ = net.pooled(codes, same)
        mean = np.stack([h[of == d].mean(0) for d in range(3)])
        p = 1 / (1 + np.exp(-(mean @ net.weight + net.bias[0])))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = net.gradients(codes, same, of, labels)
    for name in ("filters", "shift", "weight", "bias", "embed"):
        value, grad = getattr(net, name), grads[name]
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        before, step = value[at], 1e-3
        value[at] = before + step
        up = loss()
        value[at] = before - step
        down = loss()
        value[at] = before
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.05, abs=1e-5)


def test_training_takes_a_bounded_number_of_chunks(spark):
    docs = [(i, ("good words here " if i % 2 else "$$$ spam $$$ ") * (20_000 if i < 4 else 40)) for i in range(60)] + [(1, None), (None, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality_net.train(table, labels)
    got = quality_net.score_documents(table.filter("doc_id is not null and text is not null"), net).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)
    assert quality_net.score_documents(table, net).count() == 62


def test_secrets_in_long_runs_and_many_matches(spark):
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    token = lambda n: "".join(rng.choice(letters, n))
    parts, want, at = [], [], 0
    for k in range(700):  # more than two blocks of running sums
        value, other = token(12), token(24)
        parts.append(f"é password={value} {other} ")
        want.append(f"assign:{at + 2}:{at + 11 + 12}")
        want.append(f"markov:{at + 24}:{at + 48}")
        at += len(parts[-1])
    ratios = [1.0] * (128 * 128)
    text = "".join(parts)
    rows = spark.createDataFrame([(1, text), (2, token(1_000_000)), (3, None), (None, "token: 12345678"), (1, text)], "doc_id long, text string")
    began = time.time()
    got = secrets.find_secrets(rows, ratios).select("doc_id", secrets.span_text("spans").alias("s")).collect()
    assert time.time() - began < 120
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted([("1", ",".join(want)), ("2", "markov:0:1000000"), ("3", ""), ("None", "assign:0:15"), ("1", ",".join(want))])


def test_running_folds_by_blocks(spark):
    from pyspark.sql import functions as F

    rows = [[], [5], list(range(1, 256)), list(range(256)), list(range(257)), [3, -1] * 400]
    table = spark.createDataFrame([(r,) for r in rows], "x array<int>")
    got = table.select("x", secrets.running(F.col("x"), lambda a, b: a + b).alias("s"), secrets.running(F.col("x"), F.least).alias("m")).collect()
    for r in got:
        assert r.s == np.cumsum(r.x, dtype=int).tolist() and r.m == (np.minimum.accumulate(r.x).tolist() if r.x else [])


def test_buckets_are_written_by_length(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, ""), (3, None), (None, "x " * 5000)], "doc_id long, text string")
    packed = packing.pack_powers(docs, public_tokenizers.path("word_bpe_49k.json"))
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert (2 ** back["bucket"] == back["length"]).all() and (back["ids"].map(len) == 4 * back["length"]).all()
    assert back["length"].sum() == sum(packed.toPandas()["length"]) and back["sequence_id"].is_unique


def test_hashed_sample_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(5_000).withColumnRenamed("id", "a")
    one = {r.a for r in shared.hashed_sample(rows, ["a"], 500).collect()}
    other = {r.a for r in shared.hashed_sample(rows.repartition(7), ["a"], 500).collect()}
    assert one == other and 350 < len(one) <= 500


def test_components_alone(spark):
    from evigraph.llm.components import components

    pairs = [(k, k + 1) for k in range(10, 60)] + [(99, 5), (5, 99), (7, 7), (None, 3), (200, 100), (100, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), shared.Workspace(spark), "c").collect()}
    assert got == {k: 10 for k in range(10, 61)} | {99: 5, 5: 5, 200: 100, 100: 100, 300: 100}
