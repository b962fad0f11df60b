"""History, near-duplicates, look-alikes and the pivot tables below them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from presswork import session
from presswork.llm import history, lookalikes, near_duplicates, pivots

ITEM = "item_id long, google_news_redirect_url string, guid string, batch_no int, key string, n string"


def repeats(spark, batches):
    h = history.PivotHistory(spark, buckets=4)
    found = []
    for b in batches:
        df = spark.createDataFrame([(*x, 1, "clash", "n") for x in b], ITEM)
        found += [r.item_id for r in h.admit(history.identities(df)).collect()]
    h.drop()
    return sorted(found)


def test_links_and_guids_in_other_spellings(spark):
    first = [(1, "https://hub.example/rss/articles/NBaB?oc=5", "x"), (2, "http://www.p.example/a/b?p=1", None), (3, None, "{5D1F8FCC-FE7D-BCAC-36BA-F711A9F17CC0}"), (4, "", "N/A"), (5, None, None)]
    second = [
        (6, " HTTPS://HUB.example:443//rss//articles/NB%61B/?hl=en#top\n", None), (7, "https://hub.example/articles/NBab", None), (8, "https://p.example//a/b/?utm_x=1&p=1", "0"),
        (9, "https://p.example/a/b?p=2", None), (10, "bad", " urn:uuid:5d1f8fcc-fe7d-bcac-36ba-f711a9f17cc0 "), (11, " ", "n/a"), (12, "x" * 50000, "X"), (13, None, "x"),
    ]
    assert repeats(spark, [first, [], second]) == [6, 8, 10, 13]
    # the result does not depend on how arrivals are cut into batches
    assert repeats(spark, [first + second]) == [6, 8, 10, 13]


def test_different_identities_of_equal_fingerprint_are_not_repeats(spark):
    # two guids of which both 64-bit hashes agree
    a, b = "zzrFvHCUV=nQtoecHkmFeEfekFjfpdgupJIAcl0zPfew:GhnjGeaGavtrFjahA", "zzrFvHCUV=nA/DecHkmFeEfekFjfpdgupJIAcl02Vf.QyFhnjGeaGavtrFjahA"
    one = spark.createDataFrame([("g:" + a, "g:" + b)], "x string, y string").select(*pivots.fingerprint(F.col("x")), *pivots.fingerprint(F.col("y"))).first()
    assert one[:2] == one[2:]
    first, second = [(1, None, a)], [(2, None, b), (3, None, a), (4, None, b)]
    assert repeats(spark, [first, second]) == [3, 4]
    assert repeats(spark, [first + second]) == [3, 4]
    assert repeats(spark, [second, [(5, None, a), (6, None, b), (7, None, a + "x")]]) == [4, 5, 6]


def test_a_batch_does_not_shuffle_the_history(spark):
    h = history.PivotHistory(spark, buckets=4)
    guids = lambda n, m: history.identities(spark.range(n, m).selectExpr("id AS item_id", "cast(null AS string) AS google_news_redirect_url", "concat('g', id % 2000) AS guid"))
    h.admit(guids(0, 1000))
    with session.setting(spark, *history.BY_CELL):
        plan = h._fresh(guids(1000, 3000))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if h.name in x]
    assert scans and all("Bucketed: true" in x for x in scans)
    assert sorted(r.item_id for r in h.admit(guids(1000, 3000)).collect()) == list(range(2000, 3000))
    assert spark.conf.get(history.BY_CELL[0]) == "true"
    h.drop()


def test_third_of_rows_share_an_identity(spark):
    rows = [(i, None, "hot" if i % 3 == 0 else f"g{i}") for i in range(1, 91)]
    assert repeats(spark, [rows[:50], rows[50:]]) == [i for i in range(6, 91, 3)]


def test_new_batch_opens_only_its_ranges_of_a_long_history(spark):
    h = history.PivotHistory(spark, buckets=16)
    old = spark.range(20_000).selectExpr("id AS item_id", "cast(null AS string) AS google_news_redirect_url", "concat('g', id) AS guid")
    h.admit(history.identities(old))
    new = history.identities(spark.createDataFrame([(30_000 + i, None, g) for i, g in enumerate(["g7", "new", "g8", "G8"])], "item_id long, google_news_redirect_url string, guid string"))
    touched = h._touched(new)
    assert 1 <= len(touched) <= 4 and h.held(touched).count() < 20_000 * 0.05
    plan = h.held(touched)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan or "isin" in plan.lower() or " IN (" in plan
    assert sorted(r.item_id for r in h.admit(new).collect()) == [30_000, 30_002]
    assert h.held().count() == 20_002
    h.drop()


def test_pairs_within_radius_against_brute_force(spark):
    rng = random.Random(3)
    base = [(i, rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for i in range(60)]
    near = [(100 + i, h1 ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)), h2 ^ (1 << rng.randrange(60))) for i, h1, h2 in base[:30]]
    a = pivots.with_pivot_table(spark.createDataFrame(base, "id long, h1 long, h2 long"))
    b = pivots.with_pivot_table(spark.createDataFrame(near, "id long, h1 long, h2 long"))
    dist = lambda x, y: bin((x[1] ^ y[1]) % 2**64).count("1") + bin((x[2] ^ y[2]) % 2**64).count("1")
    want = {(x[0], y[0], dist(x, y)) for x in base for y in near if dist(x, y) <= 3}
    assert {tuple(r) for r in pivots.pairs_within(a, b, 3).collect()} == want and len(want) >= 30


def words(rng, n, vocab):
    return [f"w{int(rng.paretovariate(0.7)) % vocab}" for _ in range(n)]


def brute(rows, threshold, run, least):
    find = near_duplicates.Tokens(run, least)
    sets = {i: set(t.tolist()) for i, x in rows if (t := find(x)) is not None}
    return {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize("n_words", [4, 14, 70])
def test_short_sets_lose_no_pair(spark, n_words):
    rng = random.Random(n_words)
    rows = [(1, None), (2, ""), (3, " ?! "), (4, "A b"), (5, "b, a"), (6, "solo")]
    for i in range(10, 60):
        text = words(rng, n_words, 400)
        rows.append((i, " ".join(text)))
        for k in range(3):
            edited = list(text)
            for _ in range(rng.randrange(1, max(2, n_words // 5))):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(1000)}"
            rng.shuffle(edited)
            rows.append((i * 100 + k, " ".join(edited).upper()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, rss_title string, id string")
    nd = near_duplicates.NearDuplicates(df, "item_id", "rss_title", 0.75)
    got = [tuple(r) for r in nd.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.75, 1, 1)


def test_articles_by_runs_of_words(spark):
    rng = random.Random(9)
    rows = [(1, None), (2, "too short " * 10)]
    for i in range(10, 40):
        text = words(rng, 120, 3000)
        rows.append((i, " ".join(text)))
        cut = rng.randrange(100)
        rows.append((i + 1000, " ".join(text[:cut] + ["new"] * 3 + text[cut + 10 :])))
    rows += [(5000, "long " * 60000 + rows[3][1])]
    df = spark.createDataFrame(rows, "article_id long, full_text string")
    nd = near_duplicates.NearDuplicates(df, "article_id", "full_text", 0.5, 3, 60, True)
    got, want = {tuple(r) for r in nd.pairs().collect()}, brute(rows, 0.5, 3, 60)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) >= 25
    per = {r.id: r.links for r in nd.classes().collect()}
    assert per[10] >= 1 and 1 not in per and 2 not in per


def test_large_group_of_near_copies_loses_no_pair(spark):
    # the group's common runs of words are in every article, each article's own edits in one
    common = [f"c{k}" for k in range(100)]
    rows = [(i, " ".join(common + [f"own{i}x{k}" for k in range(40)])) for i in range(200)]
    df = spark.createDataFrame(rows, "article_id long, full_text string")
    got = {tuple(r) for r in near_duplicates.NearDuplicates(df, "article_id", "full_text", 0.5, 3, 60, True).pairs().collect()}
    assert got == set(itertools.combinations(range(200), 2)) == brute(rows, 0.5, 3, 60)


def test_groups_of_near_copies_are_compared_in_blocks(spark, monkeypatch):
    # groups below and above the least size, of several blocks, and articles that link two groups
    monkeypatch.setattr(near_duplicates, "GROUP_LEAST", 20)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "COLUMNS", 64)
    rng, rows = random.Random(8), []
    for g, (n, own) in enumerate([(60, 6), (45, 30), (8, 10)]):
        common = [f"g{g}c{k}" for k in range(100)]
        rows += [(g * 1000 + i, " ".join(common + [f"g{g}i{i}x{k}" for k in range(own + rng.randrange(3))])) for i in range(n)]
    rows += [(9000 + i, " ".join([f"g0c{k}" for k in range(75)] + [f"g1c{k}" for k in range(75 - i)])) for i in range(3)]
    df = spark.createDataFrame(rows, "article_id long, full_text string")
    nd = near_duplicates.NearDuplicates(df, "article_id", "full_text", 0.5, 3, 60, True)
    got = [tuple(r) for r in nd.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5, 3, 60) and len(got) > 60 * 59 // 2


@pytest.mark.parametrize("copies", [5, 200, 20_000])
def test_versions_of_an_often_copied_story_stay_linked(spark, copies):
    # similarity of the story and its versions, and of the versions, lies between 0.5 and 0.56
    story = [f"s{k}" for k in range(142)]
    versions = [story[:100] + [f"v{i}x{k}" for k in range(3)] + story[103:] if i == 0 else story[:102] + [f"v{i}x{k}" for k in range(40)] for i in range(21)]
    rows = [(i, " ".join(versions[i])) for i in range(21)]
    rows += [(1000 + i, " ".join(story)) for i in range(copies)]
    df = spark.createDataFrame(rows, "article_id long, full_text string")
    nd = near_duplicates.NearDuplicates(df, "article_id", "full_text", 0.5, 3, 60, True)
    want = brute(rows[:22], 0.5, 3, 60)
    assert {(r.a, r.b) for r in nd.links.collect()} == want and len(want) >= 210
    assert nd.classes().where(f"cls = 1000 AND copies = {copies}").count() == copies


def test_copies_are_one_class_and_empty_table(spark):
    df = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(99, "others")], "item_id long, rss_title string")
    nd = near_duplicates.NearDuplicates(df, "item_id", "rss_title", 0.75)
    assert nd.pairs().count() == 40 * 39 // 2 and nd.links.count() == 0
    assert near_duplicates.NearDuplicates(df.limit(0), "item_id", "rss_title", 0.75).pairs().count() == 0


DOCS = [
    (1, "Rozu influenza in Pebu"), (2, "Rоzu influenzа in Pebu"), (3, "Ｒｏｚｕ influenza in Pebu"), (4, "Rozu inﬂuenza in​ Pebu"), (5, "rozu influenza in Pebu"),
    (6, "café 12"), (7, "café 12"), (8, "cafe 12"), (9, "café 1２"), (10, "Министерство"), (11, None), (12, ""), (13, "..."), (14, ".​.."), (15, "a\nb"), (16, "a\r\nb"), (17, "R₀ ½"), (18, "R0 1/2"),
    (19, "Τise x"), (20, "Тise x"), (21, "Rozu influenza in Pebu"), (22, "y" * 40000), (23, "y" * 39999 + "у"),
]


def test_same_looking_pairs(spark):
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in DOCS], "doc_id long, text string, form string, token string")
    got = {tuple(r) for r in lookalikes.same_looking(df).collect()}
    group = [1, 2, 3, 4, 21]
    want = {p for p in itertools.combinations(group, 2) if p != (1, 21)} | {(6, 7), (6, 9), (7, 9), (19, 20), (22, 23)}
    assert got == want
    forms = {r.doc_id: r.form for r in lookalikes.canonical_forms(df).collect()}
    assert forms[2] == DOCS[0][1] and forms[10] == "Министерство" and forms[11] is None and forms[12] == "" and forms[17] == "R₀ ½"
    assert lookalikes.same_looking(df.limit(0)).count() == 0


def test_foreign_words_stay_unless_the_corpus_has_the_repair(spark):
    df = spark.createDataFrame([(1, "сор"), (2, "xаy unseen")], "doc_id long, text string")
    forms = {r.doc_id: r.form for r in lookalikes.canonical_forms(df).collect()}
    assert forms == {1: "сор", 2: "xаy unseen"}
