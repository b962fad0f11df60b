from datetime import date

from pyspark.sql import functions as F

from presswork.operators import blocklist, dedupe, evaluation, overlap, state, windows


def test_greedy_fold_is_no_closure(spark):
    rows = [(1, "c1", "f1", "h1"), (2, "c1", "f2", "h2"), (3, "c2", "f2", "h3"), (4, "x", "y", "h1"), (5, None, "", None), (6, "f1", None, "h9")]
    df = spark.createDataFrame(rows, "id long, canonical_url string, final_url string, content_hash string")
    got = {r.id: r.kept for r in dedupe.greedy_fold(df, "id", ["canonical_url", "final_url", "content_hash"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert dedupe.greedy_fold(df.limit(0), "id", ["canonical_url"]).count() == 0


def test_fold_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(25)}", f"u{rng.randrange(25)}", f"h{rng.randrange(60)}") for i in range(60)]
    seen, want = set(), {}
    for i, a, b, h in rows:
        keys = {a, b, "#" + h}
        want[i] = not keys & seen
        seen |= keys if want[i] else set()
    df = spark.createDataFrame(rows, "id long, a string, b string, hash string")
    assert {r.id: r.kept for r in dedupe.greedy_fold(df, "id", ["a", "b", "hash"]).collect()} == want


def test_cascade_is_sequential(spark):
    rows = [(1, "u1", "g1"), (2, "u1", "g2"), (3, "u2", "g2"), (4, None, "g1"), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, u string, g string")
    passes = [("u", F.col("u")), ("g", F.col("g"))]
    assert sorted(r.id for r in dedupe.cascade(df, "id", passes, []).collect()) == [1, 3, 5]
    flags = dedupe.cascade_flags(df, "id", passes, [])
    assert {r.id: r.dropped_by for r in flags.collect()} == {1: None, 2: "u", 3: None, 4: "g", 5: None}
    assert {r.metric: r.value for r in dedupe.cascade_metrics(flags, ["u", "g"]).collect()} == {"before_u": 5, "before_g": 4, "kept_rows": 3}
    assert {r.value for r in dedupe.cascade_metrics(dedupe.cascade_flags(df.limit(0), "id", passes, []), ["u", "g"]).collect()} == {0}
    # missing order values come last, ties go to the least id
    late = spark.createDataFrame([(1, "k", None), (2, "k", "b"), (3, "k", "a"), (4, "k", "a")], "id long, u string, g string")
    assert [r.id for r in dedupe.cascade(late, "id", [("u", F.col("u"))], [F.col("g")]).collect()] == [3]


def test_cascade_reads_its_table_once(spark, sf):
    from presswork.plans import table_queries as tq

    for q in (tq.dedupe_cascade, tq.dedupe_metrics):
        assert "rss_items" not in q(spark, sf)._jdf.queryExecution().executedPlan().toString()  # only written rows are read after it


def test_ranks_with_payload_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(3_000_000).select((F.col("id") * 7919 % 3_000_000).alias("x"), F.md5(F.col("id").cast("string")).alias("payload"), (F.col("id") % 3 == 0).alias("hot"))
        ranked = state.global_rank(df, [F.col("x")])
        assert ranked.where("rn <> x + 1").count() == 0 and ranked.select("rn").distinct().count() == 3_000_000
        small = df.limit(20_000).select("x", F.when(F.col("hot"), F.lit(None)).otherwise(F.lit("g")).cast("string").alias("g"))
        sums = state.running_total(small, "g", [F.col("x")], F.col("x"), "s").collect()
        by, want = {}, {}
        for r in sorted(small.collect(), key=lambda r: r.x):
            by[r.g] = by.get(r.g, 0) + r.x
            want[r.g, r.x] = by[r.g]
        assert {(r.g, r.x): r.s for r in sums} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chunk_names(spark):
    got = spark.range(2).select(state.chunk_name(F.lit("human_en"), F.col("id") * 12345).alias("n")).collect()
    assert [r.n for r in got] == ["human_en_headline_batch_0001", "human_en_headline_batch_12346"]


def test_blocklist_suffixes(spark):
    listed = spark.createDataFrame([("https://www.bad.example/", " No "), ("ok.example", "yes"), (None, "no")], "domain string, is_news_outlet string")
    hosts = spark.createDataFrame([("bad.example", 1), ("a.bad.example", 2), ("notbad.example", 3), ("", 4), ("ok.example", 5)], "h string, i int")
    kept = blocklist.without_blocked(hosts, "h", blocklist.blocked_domains(listed))
    assert sorted(r.i for r in kept.collect()) == [3, 4, 5]


def test_ladder_tiles_and_splits(spark):
    facts = [("k", date(2020, 1, 1 + d)) for d in range(20) for _ in range(d)] + [("e", date(2019, 1, 1))]
    leaves = windows.split_ladder(spark.createDataFrame(facts, "k string, day date"), "k", "day", "2019-01-01", "2021-12-31", threshold=15).collect()
    for key in ("k", "e"):
        own = sorted((r.window_start, r.window_end, r.entries) for r in leaves if r.k == key)
        assert own[0][0] == date(2019, 1, 1) and own[-1][1] == date(2021, 12, 31)
        assert all((b[0] - a[1]).days == 1 for a, b in zip(own, own[1:]))
        assert sum(x[2] for x in own) == sum(f[0] == key for f in facts)
        assert all(x[2] < 15 or x[0] == x[1] for x in own)
    assert windows.ladder_levels("7,30") == [30, 7, 1]


def test_registry_and_ranks(spark):
    cols = "canonical_url string, first_seen int, last_seen int, original_url string, source string, content_hash string"
    old = spark.createDataFrame([("u", 1, 1, "o", "s", "h")], cols)
    new = spark.createDataFrame([("u", 2, 2, "n", "t", None), ("v", 2, 2, "n", "t", "k")], cols)
    got = {r.canonical_url: tuple(r)[1:] for r in state.upsert_registry(old, new).collect()}
    assert got == {"u": (1, 2, "o", "t", "h"), "v": (2, 2, "n", "t", "k")}
    ranked = state.global_rank(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), [F.col("x")])
    assert ranked.where("rn <> x + 1").count() == 0 and ranked.count() == 1000


def test_greedy_chunks(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 20, 1, 1, 1])], "g string, i long, size long")
    got = {r.i: r.chunk_no for r in state.chunk_greedy(df, "g", "i", [("size", 10)], 3).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 3]


def test_alpha_worked_example(spark):
    # the published example of four observers and twelve units, nominal alpha 0.743
    table = ["1 1 . 1", "2 2 3 2", "3 3 3 3", "3 3 3 3", "2 2 2 2", "1 2 3 4", "4 4 4 4", "1 1 2 1", "2 2 2 2", ". 5 5 5", ". . 1 1", ". . 3 ."]
    votes = [(i, None if v == "." else v) for i, row in enumerate(table) for v in row.split()]
    a = evaluation.krippendorff_alpha(spark.createDataFrame(votes, "item int, label string")).first().alpha
    assert abs(a - 0.743) < 0.001


def test_pooling_edges(spark):
    votes = [(1, "a", 0.0, 0.9, True), (1, "b", 0.0, 0.5, False), (2, "a", 1.0, 0.8, True), (2, "b", -1.0, 0.0, False)]
    got = {r.item: r for r in evaluation.pooled(spark.createDataFrame(votes, "item int, alias string, weight double, p double, vote boolean"), "item", 0.7, 0.5).collect()}
    assert (round(got[1].probability, 3), got[1].agreement, got[1].relevant) == (0.7, 0.5, True)
    assert (got[2].probability, got[2].agreement, got[2].supporters) == (0.8, 1.0, "a")


def test_overlap_of_empty_and_full(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "a", "y"), (1, "a", "y")], "g int, v string, k string")
    s = overlap.summary(df, ["g"], "v", "k").first()
    assert (s.sum_variant_articles, s.union_articles, s.best_single_variant, s.shared_all_articles, s.exclusive_articles) == (3, 2, "a", 1, 1)
    assert overlap.pairwise(df, ["g"], "v", "k").first().jaccard == 0.5
    assert overlap.summary(df.limit(0), ["g"], "v", "k").count() == 0


def test_full_tuning_grid_against_brute_force(spark, sf):
    from presswork.plans import analysis_queries as aq

    votes = {}
    for r in aq._votes(spark, sf).collect():
        votes.setdefault(r.item, {})[r.alias] = (r.p, r.vote)
    truth = {r.item: r.truth for r in aq._labels(spark, sf).collect()}
    cands = [(w, t, a) for w in evaluation.weight_grid(aq.MODELS, 0.25) for t in (0.65, 0.7, 0.75, 0.8, 0.85) for a in (0.34, 0.67, 1.0)]
    assert len(cands) == 225
    best = None
    for i, (w, t, a) in enumerate(cands):
        used = [m for m in aq.MODELS if w[m] > 0]
        hit = {k: round(sum(w[m] * v[m][0] for m in used), 9) >= t and round(sum(v[m][1] for m in used) / len(used), 9) >= a for k, v in votes.items()}
        tp, n, pos = sum(hit[k] and truth[k] for k in hit), sum(hit.values()), sum(truth.values())
        p, r = tp / n if n else 0.0, tp / pos
        f1 = round(2 * p * r / (p + r), 4) if p + r else 0.0
        key = (round(r, 4) >= 0.85, f1, round(r, 4), t, a, -i)
        best = max(best or key, key)
    got = aq.threshold_tuning_full(spark, sf).first()
    assert (got.candidate, got.threshold, got.agreement, got.f1) == (-best[5], best[3], best[4], best[1])


def test_summaries_and_ngrams_of_all_labels(spark, sf):
    from presswork.plans import analysis_queries, record_queries

    rows = [(1, None, "One is here. Two, two. Three it is. Four."), (2, "es", "Uno. Dos."), (3, "en", "x" * 50), (4, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r.summary for r in record_queries.summaries(df, 24).collect()}
    assert got == {1: "One is here. Two, two.", 2: "Uno. Dos.", 3: "x" * 24}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert record_queries.extractive_summary(spark, sf).count() == docs.where("trim(text) <> ''").count()
    labels = {r.lang for r in analysis_queries.ngram_counts_all(spark, sf.replace("sf0.001", "sf0.01")).select("lang").distinct().collect()}
    assert {"en", "fr", "es", "pt", "(missing)"} <= labels
