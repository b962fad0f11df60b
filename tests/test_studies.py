import random

import pytest
from pyspark.sql import functions as F

from presswork import config
from presswork.functions import html, model_output
from presswork.operators import evaluation, groups, overlap, topics
from presswork.sources import readers, writers


def test_alpha_bounds_hold_the_bounds_of_a_plain_bootstrap(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b"]) if rng.random() < 0.3 else "ab"[i % 2]) for i in range(150) for _ in range(3)] + [(999, None)]
    df = spark.createDataFrame(rows, "item int, label string")
    got = evaluation.alpha_interval(df, resamples=2000).first()
    by = {}
    for i, x in rows:
        if x:
            by.setdefault(i, []).append(x)

    def alpha(items):
        n, c, same = {"a": 0, "b": 0}, 0, 0.0
        for i in items:
            for x in by.get(i, []):
                n[x] += 1
        off = sum(2 * by[i].count("a") * by[i].count("b") / (len(by[i]) - 1) for i in items if i in by)
        t = n["a"] + n["b"]
        return 1 - (t - 1) * off / (2 * n["a"] * n["b"])

    ids = sorted({i for i, _ in rows})
    draws = sorted(alpha([rng.choice(ids) for _ in ids]) for _ in range(2000))
    assert abs(got.alpha - alpha(ids)) < 1e-6 and abs(got.low - draws[50]) < 0.03 and abs(got.high - draws[1949]) < 0.03
    assert evaluation.alpha_interval(df.limit(0)).first().alpha is None


def test_ordinal_alpha_worked_example(spark):
    # the published example of four observers and twelve units, ordinal alpha 0.815
    table = ["1 1 . 1", "2 2 3 2", "3 3 3 3", "3 3 3 3", "2 2 2 2", "1 2 3 4", "4 4 4 4", "1 1 2 1", "2 2 2 2", ". 5 5 5", ". . 1 1", ". . 3 ."]
    votes = [(i, None if v == "." else v) for i, row in enumerate(table) for v in row.split()]
    a = evaluation.ordinal_alpha(spark.createDataFrame(votes, "item int, label string"), list("12345")).first().alpha
    assert abs(a - 0.815) < 0.001


def test_precision_steps(spark):
    rows = [("m", 0.9, True), ("m", 0.8, False), ("m", 0.8, True), ("m", 0.1, False), ("n", 0.5, False)]
    got = {r.k: r.auprc for r in evaluation.average_precision(spark.createDataFrame(rows, "k string, p double, y boolean"), "p", F.col("y"), ["k"]).collect()}
    assert got == {"m": round(0.5 * 1 + 0.5 * 0.6667, 4), "n": None}


def test_groups_merge_by_the_best_likeness(spark):
    rows = [("b", 1, 1, "market closure", "x y"), ("b", 1, 2, "school closure", "z"), ("b", 2, 1, "school closures", "z z"), ("b", 2, 2, "drought", None)]
    df = spark.createDataFrame(rows, "batch string, run int, rank int, label string, definition string")
    c = groups.leader_clusters(df, "batch", "label", "definition", ["run", "rank"])
    ids = {(r.run, r.rank): r.cluster_id for r in c.collect()}
    assert ids[2, 1] == ids[1, 2] and len(set(ids.values())) == 3
    s = {r.cluster_id: (r.name, r.definition, r.members) for r in groups.cluster_summary(c, "batch", "label", "definition", ["run", "rank"]).collect()}
    assert s[ids[1, 2]] == ("school closure", "z z", 2)


def test_hot_label_keeps_its_first_examples(spark):
    rows = [(i, "g", "hot", f"t{i:05d}", "c" if i % 2 else None) for i in range(5000)] + [(9000, "g", "cold", "", None), (9001, "g", " ", "x", "y")]
    df = spark.createDataFrame(rows, "id long, g string, label string, example string, cause string")
    got = {r.label: (r.articles, r.definition, r.evidence) for r in groups.build_groups(df, ["g"], "label", "id", "example", "cause").collect()}
    assert got == {"hot": (5000, "t00000 | t00001 | c", ["t00000", "t00001", "t00002"]), "cold": (1, "", [])}


def test_names_are_absorbed_and_twins_merged(spark):
    rows = [("Virus A", "s1", "a1", ""), ("virus a", "s2", "", "Fever"), ("Virus A", "s3", "a2", "Fever (old)"), ("Virus B", "s4", "b", ""), ("Virus B", "S4; s5", "", ""), ("Virus C", "", "c", "Pox")]
    df = spark.createDataFrame(rows, "name string, sub string, aka string, disease string")
    got = {(r.name, r.disease): (r.sub, r.aka) for r in groups.merged_names(df, "name", ["sub", "aka"], "disease").collect()}
    assert got == {("Virus A", "Fever (old)"): ("s3, s1, s2", "a2, a1"), ("Virus B", ""): ("S4, s5", "b"), ("Virus C", "Pox"): ("", "c")}


def test_jaccard_of_one_variant(spark):
    df = spark.createDataFrame([(1, "a", "x")], "g int, v string, k string")
    r = overlap.jaccard_summary(df, ["g"], "v", "k").first()
    assert (r.variants, r.mean_jaccard) == (1, None)


def test_clusterings(spark):
    rows = [(i, [float(i % 2) * 10 + random.Random(i).random(), 1.0]) for i in range(40)] + [(99, [500.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, e array<double>")
    for method in ("kmeans", "bisecting"):
        out = topics.clustered(df, "e", 41, method, 3, 2)
        got = {r.id: r.topic for r in out.collect()}
        assert got[99] == -1 and got[0] != got[1] and len({got[i] for i in range(0, 40, 2)}) == 1
        assert topics.silhouette(out, "e") > 0.9
    with pytest.raises(ValueError, match="hdbscan"):
        topics.clustered(df, "e", 41, "hdbscan")
    assert topics.silhouette(df.withColumn("topic", F.lit(0)), "e") is None
    assert topics.enough_documents(3) == "too_few_documents:3<20" and topics.enough_documents(20) == ""


PAGE = """<html><head><meta name="pubdate" content="2020-02-02"><script type="application/ld+json">{"@type": "Article", "datePublished": "2021-01-01"}</script></head><body>
<div class="site-header"><p>Menu of the site that is longer than forty characters in all</p></div><article><p>%s</p><p>Short one.</p><a href="/">link</a></article><p>Outside.</p></body></html>"""


def test_pages():
    long = "A sentence, with marks; and more of them. " * 8
    title, text, method = html.extracted(PAGE % long)
    assert method == "density" and text == " ".join(long.split())
    assert html.extracted(PAGE % "Few words.")[1:] == ("Few words. Short one.", "article_paragraphs")
    assert html.extracted("<p>Before you continue to Google</p>")[2] == "interstitial_blocked" and html.extracted(None) == ("", "", "density")
    assert html.article_paragraphs(PAGE % "x") == "x\n\nShort one." and html.article_paragraphs("<p>a<p>b") == "a\n\nb"
    assert html.published_date(PAGE % "x") == "2020-02-02" and html.published_date("<time datetime='2019'>") == "2019" and html.published_date("") == ""


def test_cards():
    page = """<ul><li class="card"><h3 class="t"><a href="/a"> Sheep <b>pox</b></a></h3><p class="k">Viral</p><div class="i"><span class="l">Other</span><span class="v">no</span></div>
    <div class="i"><span class="l">Type of animals</span><span class="v">Terrestrials, sheep</span></div></li><li class="card"><h3 class="t">No address</h3></li></ul>"""
    got = html.cards(page, "card", "t", "k", "i", "l", "v", "type of animals")
    assert got == [{"title": "Sheep pox", "url": "/a", "kind": "Viral", "value": "Terrestrials, sheep"}]
    assert html.top_group(["Terrestrials", "sheep"]) == "terrestrial" and html.top_group([]) == "unknown" and html.cards(None, *"abcdefg") == []


def test_stated_answers():
    raw = 'Relevant: yes, confidence = 0.8, rationale: "it is so", evidence_spans: ["a b", \'c\'] and more'
    assert model_output.stated_answer(raw) == {"relevant": True, "confidence": 0.8, "rationale": "it is so", "evidence_spans": ["a b", "c"]}
    assert model_output.stated_answer("irrelevant: true") is None and model_output.stated_answer(None) is None


def test_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text('{"feeds": {"api_key_env": "MY_KEY", "n": 3}, "own": {"a": 1}}')
    s = config.load_settings(str(tmp_path / "s.json"))
    assert s.get("feeds", "n") == 3 and s.get("paths", "x", 7) == 7 and s.get("own", "a") == 1
    with pytest.raises(ValueError, match="MY_KEY"):
        s.secret("feeds", "OTHER")
    monkeypatch.setenv("MY_KEY", " k ")
    assert s.secret("feeds", "OTHER") == "k"
    one = {"id": "en_us", "lang": "en", "country": "US", "accept_language": "en"}
    assert config.locale_table(spark, [one]).count() == 1
    with pytest.raises(ValueError):
        config.locale_table(spark, [one, one])
    assert config.proxies("") == {} and config.proxies("h:1", "u", "p")["https"] == "http://u:p@h:1"


def test_sinks_of_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "batch_id int, v string")
    writers.write_batches(df, str(tmp_path / "b"))
    writers.write_batches(df.where("batch_id = 2").withColumn("v", F.lit("c")), str(tmp_path / "b"))
    assert {(r.batch_id, r.v) for r in spark.read.json(str(tmp_path / "b")).collect()} == {(1, "a"), (2, "c")}
    writers.write_topics(str(tmp_path / "t"), {"n": 2}, info=df, keywords=df)
    assert spark.read.csv(str(tmp_path / "t/info"), header=True).count() == 2 and (tmp_path / "t/summary.json").exists()
    assert (tmp_path / writers.write_workbook(df, str(tmp_path / "w.xlsx")).rsplit("/", 1)[-1]).exists()
    # a replacement that broke off between its renames is put back
    path = str(tmp_path / "r")
    writers.replace_table(df, path)
    (tmp_path / "r").rename(tmp_path / "r.replaced")
    assert writers.recover_table(spark, path) and spark.read.parquet(path).count() == 2
    for n in (0, 0, 1):
        writers.write_batch(df, n, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_text_sources(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text(f"head,x\n{n}1,2\n\n{n}2\n")
    assert sorted(r.value for r in readers.read_first_column(spark, f"{tmp_path}/*.csv").collect()) == ["a1", "a2", "b1", "b2"]
    assert readers.read_first_column(spark, f"{tmp_path}/*.csv", False).count() == 6
    (tmp_path / "n.csv").write_text("p,q\n,1\n")
    assert readers.read_csv(spark, str(tmp_path / "n.csv"), fill="").first().p == ""
    assert readers.worksheet_column([["h"], ["x", "A  b"], ["x", None], ["x", "A b"], ["x", 3], []], 1, 1) == ["A b", "3"]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("z", T.StringType())])
    assert tuple(readers.conform(spark.createDataFrame([("1",)], "a string"), schema, default="N/A").first()) == ("1", "N/A")


def test_release_removes_written_tables(spark):
    import os

    from presswork.session import new_path, release, written

    path = new_path(spark, "test")
    written(spark.range(3), "test")
    spark.range(3).write.parquet(path)
    before = len(spark.sparkContext._presswork_paths)
    kept, spark.sparkContext._presswork_paths = spark.sparkContext._presswork_paths[: before - 2], spark.sparkContext._presswork_paths[before - 2 :]
    assert release(spark) == 2 and not os.path.exists(path)
    spark.sparkContext._presswork_paths = kept


def test_charts():
    from xml.etree import ElementTree

    from presswork.functions.charts import facet_bars

    svg = facet_bars([("a & b", "x<", 2), ("a & b", "y", 4), ("c", "z", -1)], "t")
    rects = [float(r.get("width")) for r in ElementTree.fromstring(svg).iter("{http://www.w3.org/2000/svg}rect")]
    assert rects[1] == 2 * rects[0] and rects[2] == 0 and "a &amp; b" in svg and ElementTree.fromstring(facet_bars([])) is not None


def test_masks_rules_and_inputs(spark):
    from presswork.functions import text

    label = spark.createDataFrame([(" relevant ",), ("x",), (None,)], "final_label string")
    assert label.where(readers.relevance_mask(label)).count() == 1
    flag = spark.createDataFrame([("Yes",), ("0",), (None,)], "relevant string")
    assert flag.where(readers.relevance_mask(flag)).count() == 1 and flag.drop("relevant").where(readers.relevance_mask(flag.drop("relevant"))).count() == 3
    assert spark.range(1).select(readers.feed_item_count(F.lit("<item><b/></item><item a='1'/><items>")).alias("n")).first().n == 2
    df = spark.createDataFrame([("T", "long  body", "sum"), (None, "", "sum"), ("T", "body", None)], "t string, b string, s string")
    got = [tuple(r.i) for r in df.select(text.model_input(F.col("t"), F.col("b"), 6, F.col("s")).alias("i")).collect()]
    assert got == [("T", "sum"), ("", ""), ("T", "body")]
    rows = spark.createDataFrame([(1, "Old barn"), (2, "barn"), (3, None)], "id int, x string")
    rules = spark.createDataFrame([(2, "barn", "b"), (1, "OLD", "a")], "rule_order int, word string, outcome string")
    assert {r.id: r.outcome for r in groups.by_rule_table(rows, "id", "x", rules, "none").collect()} == {1: "a", 2: "b", 3: "none"}
    assert [r.x for r in groups.assigned(rows, "x", spark.createDataFrame([("BARN",)], "n string"), "n").orderBy("id").collect()] == ["N/A", "BARN", "N/A"]
