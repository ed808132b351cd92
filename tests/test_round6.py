"""Large tables: what is asked chunk by chunk, pairs on shared keys."""

import itertools

import pandas as pd
from pyspark.sql import functions as F

from evigraph.operators import asking, identity, stages


def test_chunks_of_a_batch_come_in_one_frame_and_none_is_cut():
    keys = [k for k in range(40) for _ in range(k % 5 + 1)]
    rows = pd.DataFrame({"c": keys, "i": range(len(keys))})
    for size in (1, 2, 7, 50, 500):
        frames = list(asking._whole_chunks((rows.iloc[k : k + size].reset_index(drop=True) for k in range(0, len(rows), size)), ["c"]))
        chunks = [frame.iloc[a:b] for frame, starts in frames for a, b in zip(starts, starts[1:], strict=False)]
        assert [chunk["c"].unique().tolist() for chunk in chunks] == [[k] for k in range(40)]
        assert pd.concat(chunks)["i"].tolist() == rows["i"].tolist()
        assert len(frames) <= 2 * -(-len(rows) // size) + 1


def test_a_chunk_whose_answers_are_out_of_order_or_repeat(spark):
    asks = spark.createDataFrame([(c, i) for c in range(6) for i in range(3)], "c long, i long").coalesce(1)

    def judge(frame):
        c = int(frame["c"].iloc[0])
        assert frame.index.tolist() == [0, 1, 2]
        if c == 1:
            raise ValueError("no")
        if c == 2:
            return pd.DataFrame({"i": [2, 0, 0], "noul": [0.2, 0.0, 0.5]})
        return pd.DataFrame({"i": frame["i"], "noul": frame["i"] / 10})

    got = sorted((r.c, r.i, r.noul if r.noul is not None else -1.0, r.error or "") for r in asking.judged_chunks(asks, judge, ["c"], ["i"], "noul double").collect())
    want = [(c, i, i / 10, "") for c in (0, 3, 4, 5) for i in range(3)] + [(1, i, -1.0, "ValueError: no") for i in range(3)]
    assert got == sorted([*want, (2, 0, 0.0, ""), (2, 0, 0.5, ""), (2, 1, -1.0, ""), (2, 2, 0.2, "")])


def test_rows_of_a_crowded_key_meet_in_chunks(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(900)], "key long, l long")
    right = spark.createDataFrame([(k % 2, k) for k in range(2000)] + [(2, 7)], "key long, r long")
    met = stages.spread_join(left, right, "key", 100)
    assert met.columns == ["key", "l", "r"] and met.count() == met.distinct().count() == 300 * 1000 + 300 * 1000 + 300
    runs = [[(r.key, r.l) for r in rows] for rows in met.rdd.glom().collect()]
    longest = max(sum(1 for _ in run) for rows in runs for _, run in itertools.groupby(rows))
    assert 50 < longest <= 150


def test_exact_matches_write_a_graph_in_runs_of_few_records(spark, tmp_path):
    queries = spark.range(64).selectExpr("id as graph_id", "'AA' as query")
    records = spark.range(3000).selectExpr("id as record_id", "array('aa') as ids")
    got = identity.exact_matches(queries, records)
    assert got.count() == got.distinct().count() == 64 * 3000
    runs = [[r.graph_id for r in rows] for rows in got.rdd.glom().collect()]
    assert max(sum(1 for _ in run) for rows in runs for _, run in itertools.groupby(rows)) < 2 * stages.TOGETHER


def test_bridges_write_a_row_in_runs_of_few_claims(spark):
    rows = spark.range(64).selectExpr("id as k", "1 as place")
    records = spark.range(1500).selectExpr("id as r", "1 as place", "array('a' || id) as aliases", "array('' || id) as pmids")
    got = stages.bridge(rows, records, "place", ["k", "r"], F.lit("x"), "pmids")
    assert got.count() == got.distinct().count() == 64 * 3000
    runs = [[r.k for r in part] for part in got.rdd.glom().collect()]
    assert max(sum(1 for _ in run) for part in runs for _, run in itertools.groupby(part)) < 2 * stages.TOGETHER
