
import numpy as np

from evigraph.llm import chaining, ngram_join, url_rules


def texts(spark, docs, first=1):
    return spark.createDataFrame([(first + i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")


def fresh_words(seed):
    rng = np.random.default_rng(seed)
    return lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]


def covered(rows, doc):
    return {x for r in rows if r.doc_id == doc for x in range(r.start, r.end)}


def test_chains_are_cut_where_too_much_lies_between(spark):
    fresh = fresh_words(1)
    whole, one, two = fresh(120), fresh(55), fresh(55)
    inserted = whole[:60] + fresh(45) + whole[60:]
    forms = [fresh(55) for _ in range(4)]
    form = lambda: [w for part in forms for w in part + fresh(45)]
    docs = [fresh(20) + whole + fresh(20), fresh(30) + inserted + fresh(30), fresh(9) + one + fresh(45) + two + fresh(9), fresh(70) + one + fresh(45) + two + fresh(5), form(), form()]
    rows = chaining.repeated_passages(texts(spark, docs)).collect()
    assert all(r.end - r.start >= 50 and r.equal >= 0.8 * max(r.end - r.start, r.of_end - r.of_start) for r in rows)
    for doc, starts, n in ((2, (30, 135), 60), (4, (70, 170), 55), (6, (0, 100, 200, 300), 55)):
        for start in starts:
            assert set(range(start, start + n)) <= covered(rows, doc)


def test_stretches_are_the_longest_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        b, a = (np.cumsum(np.where(rng.random(n) < 0.7, 1, rng.integers(1, 6, n))) for _ in range(2))
        ok = [(b[j] - b[i] + 1, i, j) for i in range(n) for j in range(i, n) if b[j] - b[i] + 1 >= 8 and j - i + 1 >= 0.8 * max(b[j] - b[i] + 1, a[j] - a[i] + 1)]
        found = chaining.stretches(b, a, 8, 0.8)
        assert bool(found) == bool(ok)
        if ok:
            assert max(b[j] - b[i] + 1 for i, j in found) == max(ok)[0]


def changed(words, every):
    return [f"z{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


def test_passages_with_every_fifth_to_twentieth_word_changed_are_found(spark):
    fresh = fresh_words(3)
    docs, want = [], []
    for every in (5, 6, 8, 10, 20):
        for _ in range(20):
            passage = fresh(60)
            docs += [fresh(100) + passage + fresh(100), fresh(70) + changed(passage, every) + fresh(90)]
            want.append(len(docs))
    rows = chaining.repeated_passages(texts(spark, docs)).collect()
    assert {r.doc_id for r in rows} == set(want)
    assert all(len(covered(rows, d) & set(range(70, 130))) >= 50 for d in want)


def test_ends_go_on_until_the_score_drops(spark):
    fresh = fresh_words(4)
    long = fresh(600)
    # seeds in the middle only: elsewhere the words of each seed are first held by other documents
    others = [long[i : i + 4] + [f"y{i}"] for i in range(600) if not 290 <= i < 310]
    docs = [[w for o in others for w in o], fresh(50) + long + fresh(50), fresh(9) + long + fresh(9)]
    rows = chaining.repeated_passages(texts(spark, docs)).collect()
    assert set(range(9, 609)) <= {x for r in rows if r.doc_id == 3 and r.of_doc_id == 2 for x in range(r.start, r.end)}


def test_exact_repeats_are_found_though_first_holders_split_them(spark):
    fresh = fresh_words(5)
    passage, other = fresh(60), fresh(50)
    docs = [fresh(40) + passage[:30] + fresh(40), fresh(40) + passage[30:] + fresh(40)]
    docs += [fresh(5) + other[k : k + 8] + fresh(20) for k in range(0, 50, 5)]
    docs += [fresh(10) + passage + fresh(30), fresh(25) + other + fresh(25), fresh(33) + passage + fresh(10), fresh(8) + other + fresh(45)]
    rows = chaining.repeated_passages(texts(spark, docs)).collect()
    for doc, of, start, of_start, n in ((15, 13, 33, 10, 60), (16, 14, 8, 25, 50)):
        assert (start, start + n, of_start, of_start + n, n) in {(r.start, r.end, r.of_start, r.of_end, r.equal) for r in rows if r.doc_id == doc and r.of_doc_id == of}


def test_exact_repeats_by_brute_force_over_few_words(spark):
    rng = np.random.default_rng(6)
    phrases = [[f"p{x}" for x in rng.integers(0, 60, 9)] for _ in range(12)]
    docs = [[w for k in rng.integers(0, 12, 40) for w in phrases[k]] for _ in range(30)]
    for d in (11, 17, 23, 29):
        s, t = rng.integers(0, 250, 2)
        docs[d][s : s + 70] = docs[int(rng.integers(0, d))][t : t + 70]
    rows = chaining.repeated_passages(texts(spark, docs, 0)).collect()
    runs, want = {}, {}
    for d, ws in enumerate(docs):
        for i in range(len(ws) - 49):
            if runs.setdefault(tuple(ws[i : i + 50]), d) != d:
                want.setdefault(d, set()).update(range(i, i + 50))
    assert want and all(places <= covered(rows, d) for d, places in want.items())


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 5)
    fresh = fresh_words(7)
    base, chain = fresh(200), fresh(120)
    docs = [base[:k] + ["zz"] + base[k + 1 :] for k in range(0, 200, 9)]  # all similar to one another
    docs += docs[:3] + [chain[2 * k : 2 * k + 60] for k in range(14)]  # copies; neighbours are similar, ends are not
    docs += [fresh(50), fresh(2)]
    sets = [{tuple(d[i : i + 4]) for i in range(len(d) - 3)} or {tuple(d)} for d in docs]
    want = {i: sum(100 * len(s & x) >= 85 * len(s | x) for x in sets) - 1 for i, s in enumerate(sets)}
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_jaccard_join(texts(spark, docs, 0), 4, 85, 100).collect()}
    assert got == want and max(want.values()) == 25


def test_all_mined_rules_judge(spark, monkeypatch):
    named = ["x" + "".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(1_100)]
    labelled = [f"http://h.com/de/{x}/" for x in named for _ in range(2)]
    other = [f"http://k.net/{x}/" for x in named]
    plain = [f"http://{host}.com/fr/" for host in "mn" for _ in range(200)]
    urls = labelled + other + plain
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def judged():
        return {r.page_id: (r.rule, r.verdict, r.confidence) for r in url_rules.judge_urls(pages, min_support=0.0005).collect()}

    many = judged()  # over FEW_RULES
    assert {many[i][:2] for i in range(2_200, 3_300)} == {(None, "block")}
    monkeypatch.setattr(url_rules, "FEW_RULES", 10**6)
    assert judged() == many


def test_lines_with_one_inner_word_changed_go(spark, tmp_path):
    from evigraph.llm import queries

    fresh = fresh_words(8)
    lines = [fresh(20) for _ in range(5)]
    near = [[*w[:9], "zz", *w[10:]] for w in lines]
    rows = [(i, "\n".join(" ".join(w) for w in part)) for i, part in enumerate((lines, near, [fresh(20)]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "0,1,2,3,4", 2: ""}


def test_a_copy_put_together_from_two_sources_is_found_whole(spark):
    fresh = fresh_words(11)
    passage = fresh(80)
    docs = [fresh(30) + passage[:40] + fresh(20), fresh(20) + passage[40:] + fresh(30), fresh(12) + passage + fresh(12), fresh(40) + passage + fresh(5)]
    rows = chaining.repeated_passages(texts(spark, docs)).collect()
    assert covered(rows, 4) == set(range(40, 120))


def test_seeds_meet_however_batches_and_parts_cut_them(spark, monkeypatch):
    """Whole results by brute force: which words of later documents lie in an exact repeat of 50 words; frequent seeds told or not, gaps of more than BRIDGE words."""
    fresh = fresh_words(12)
    one, two = fresh(60), fresh(90)
    docs = [fresh(5) + one + fresh(75) + two for _ in range(9)] + [two + fresh(100) + one, one, fresh(200), two[:50], one + one]
    n = 50
    want = {}
    seen = set()
    for i, d in enumerate(docs, 1):
        runs = [tuple(d[j : j + n]) for j in range(len(d) - n + 1)]
        want[i] = {x for j, r in enumerate(runs) if r in seen for x in range(j, j + n)}
        seen |= set(runs)
    monkeypatch.setattr(chaining, "OFTEN", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = chaining.repeated_passages(texts(spark, docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in want:
        assert want[i] <= covered(rows, i)
        assert len(covered(rows, i) - want[i]) < 5


def test_a_nearer_part_is_taken_where_the_best_is_out_of_reach():
    at, length = np.array([0, 161, 185]), np.array([100, 20, 30])
    assert sorted(map(sorted, chaining.fenwick_chains(at, at, length))) == [[0], [1, 2]]


def test_chains_keep_their_bridge_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(2, 9))
        b0 = np.sort(rng.integers(0, 300, n))
        a0, length = rng.integers(0, 300, n), rng.integers(4, 60, n)
        best = np.zeros(n)
        for i in range(n):
            gaps = [(j, b0[i] - b0[j] - length[j], a0[i] - a0[j] - length[j]) for j in range(n) if j != i]
            ok = [best[j] - chaining.GAP_COST * (x + y) for j, x, y in gaps if 0 <= x <= chaining.BRIDGE and 0 <= y <= chaining.BRIDGE]
            best[i] = length[i] + max([0, *ok])
        chains = chaining.fenwick_chains(b0, a0, length)
        top = chains[0]
        score = sum(length[top]) - sum(chaining.GAP_COST * (b0[y] - b0[x] - length[x] + a0[y] - a0[x] - length[x]) for x, y in zip(top, top[1:], strict=False))
        assert abs(score - best.max()) < 1e-9
        assert sorted(x for c in chains for x in c) == list(range(n))


def test_similar_lines_by_brute_force_over_few_words(spark, monkeypatch):
    """Long posting lists in blocks, small batches, lists told as long by broadcast and by shuffle."""
    from evigraph.llm import line_dedup, setjoin

    rng = np.random.default_rng(9)
    words = np.array([f"w{k}" for k in range(40)])
    base = [rng.choice(words, 12, replace=False) for _ in range(12)]
    lines = []
    for _ in range(300):
        x = base[rng.integers(12)].copy()
        x[rng.integers(12)] = rng.choice(words)
        lines.append(" ".join(rng.permutation(x)))
    docs = ["\n".join(lines[a : a + 6]) for a in range(0, 300, 6)]
    sets = [(i // 6, i % 6, frozenset(x.split())) for i, x in enumerate(lines)]
    want = {}
    for k, (d, l, s) in enumerate(sets):
        if any(len(s & t) * 100 >= 80 * len(s | t) for _, _, t in sets[:k]):
            want.setdefault(d, []).append(l)
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    monkeypatch.setattr(setjoin, "LIST_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for told in (20_000, 0):
            monkeypatch.setattr(setjoin, "LONG_LISTS", told)
            rows = line_dedup.similar_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), k=1).collect()
            assert {r.doc_id: list(r.removed) for r in rows if r.removed} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
