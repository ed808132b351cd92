"""Nulls, repeated rows, empty and long texts, clashing column names, empty tables: every operator gives its stated result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import chaining, line_dedup, mixing, ngram_join, packing, quality_net, secrets, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, l int, h long, score string, bucket string"
WORDS = " ".join(f"w{k}" for k in range(70))
ROWS = [
    (1, WORDS, "en", "a", 1, 7, 7, 7, "s", "b"),
    (1, WORDS, "en", "a", 1, 7, 7, 7, "s", "b"),  # a repeated row
    (2, WORDS + " x", "en", "a", 1, 7, 7, 7, None, None),
    (3, "", "en", None, None, None, None, None, None, None),
    (4, None, None, None, None, None, None, None, None, None),
    (None, WORDS, "en", "b", 1, 1, 1, 1, "s", "b"),
    (None, None, None, None, None, None, None, None, None, None),
    (5, " \t\n ", "en", "b", 4, 1, 1, 1, "s", "b"),
    (6, "é " * 30_000, "en", "b", 60_000, 1, 1, 1, "s", "b"),
    (7, "password = abcdefgh1 AKIAABCDEFGHIJKL\nline two here", "en", "a", 1, 1, 1, 1, "s", "b"),
]
TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is not None, x) if not isinstance(x, list) else (True, tuple(x)) for x in r)


def test_ngram_join(docs, nothing):
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert len(got) == len(ROWS)
    by = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key)
    assert [x for x in by if x[0] in (1, 2)] == [(1, 66, 1), (1, 66, 1), (2, 67, 1)]
    assert sorted(x[2] is None for x in by if x[0] is None) == [True, True]
    assert ngram_join.ngram_jaccard_join(nothing).count() == 0
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7]


def test_line_dedup(docs, nothing):
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.similar_lines(docs, k=1).collect()}
    assert got[2] == (1, 1) and got[1] == (2, 0) and got[4] == (1, 0) and got[None] == (2, 0) and got[7] == (2, 0)
    kept = line_dedup.line_dedup(docs, k=1)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7]
    assert line_dedup.line_dedup(nothing, k=1).count() == 0


def test_mixing(docs, nothing):
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum({r.source_size: r.target for r in got}.values()), abs=3)
    again = mixing.taken_words(docs.repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.taken_words(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_packing(docs, nothing):
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    got = packing.digests(packing.pack_powers(docs, path)).collect()
    ends = [r for r in got if r.doc_tokens == 1]
    assert len(ends) == 4 and len({r.sequence_id for r in got}) == len(got)  # two null texts, an empty one, one of white space
    assert packing.pack_powers(nothing, path).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (1, None, "y"), (7, 0, "x"), (None, 1, "x"), (6, 0, "x")], "doc_id long, quality int, score string")
    net = quality_net.train(docs, labels)
    got = quality_net.score_documents(docs, net)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text == WORDS}) == 1 and len({r.score for r in rows if not r.text}) == 1
    assert quality_net.keep_good(docs, net).columns == docs.columns
    assert quality_net.score_documents(nothing, quality_net.train(nothing, labels.limit(0))).count() == 0


def test_passages(docs, nothing):
    got = chaining.repeated_passages(docs).collect()
    assert {(r.doc_id, r.of_doc_id, r.start, r.end) for r in got} == {(2, 1, 0, 70)}
    assert chaining.repeated_passages(nothing).count() == 0


def test_chains_of_equal_scores_use_each_part_once():
    chains = chaining.fenwick_chains(np.array([0, 0, 10, 10]), np.array([0, 10, 0, 10]), np.array([5, 5, 5, 5]))
    assert sorted(x for c in chains for x in c) == [0, 1, 2, 3] and len(chains[0]) == 2


def test_secrets(docs, nothing):
    got = secrets.find_secrets(docs).select("doc_id", secrets.span_text("base").alias("s")).collect()
    assert len(got) == len(ROWS) and {r.doc_id: r.s for r in got}[7] == "assign:0:20,access:21:37"
    assert secrets.find_secrets(nothing).count() == 0
    assert secrets.find_secrets(docs.withColumn("text", F.lit(None).cast("string"))).filter(F.size("spans") > 0).count() == 0


def test_urls(spark):
    schema = "page_id long, url string, host string, path string, tokens string, salt string"
    rows = [(k, f"https://a{k % 3}.org/x/{k}", "h", "p", "t", "s") for k in range(30)] + [(k, f"https://a.example.org/es/{k}", "h", "p", "t", "s") for k in range(30)]
    rows += [(1, None, None, None, None, None), (None, "no host", None, None, None, None), (2, "", None, None, None, None), (3, "ftp://A.NET/x/1?q=1#f", None, None, None, None), (3, "ftp://A.NET/x/1?q=1#f", None, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    assert [(r.host, r.path) for r in got if r.page_id == 3 and r.host == "a.net"] == [("a.net", "/x/1")] * 2
    assert sorted(map(key, got)) == sorted(map(key, url_rules.judge_urls(pages.repartition(5)).collect()))  # ties between rules too
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages.filter("host is null"), rules=()).collect()} == {"allow"}


@pytest.mark.parametrize("texts", [[], [None, None], ["", None]])
def test_pipeline_over_nothing(spark, tmp_path, texts):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], columns).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
