import json

from pyspark.sql import functions as F

from presswork.schemas import RSS_ITEMS
from presswork.sources import readers, writers
from presswork.streaming import ingest

FEED = """<rss><channel><item><title>A &amp; B</title><link>https://x.example/1</link><guid>g1</guid><pubDate>Sun, 03 Jan 2021 09:32:06 GMT</pubDate>
<source url="https://x.example">X</source></item><item><title>C</title></item></channel></rss>"""


def payload(n, at="2021-01-04T00:00:00Z"):
    e = {"title": f"t{n}", "published": "Sun, 03 Jan 2021 09:32:06 +0200", "summary": "", "summary_detail": {"value": "<b>s</b> x"}, "link": f"l{n}", "id": f"g{n}"}
    return {"dataset_key": "human_en", "window_start": "2021-01-01", "window_end": "2021-01-30", "search_string": "q", "retrieved_at": at, "feed": {"language": "en", "title": "f"}, "entries": [e] if n else []}


def test_csv_encodings_and_missing_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,x\n\"a\"\"b\",1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,x\ncaf\xe9,1\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [('a"b', "1")]
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).first().name == "café"
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), RSS_ITEMS).count() == 0


def test_payloads_and_stream(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.json").write_text(json.dumps(payload(n)))
    items = readers.payload_items(readers.read_payloads(spark, str(tmp_path)))
    assert items.columns == RSS_ITEMS.fieldNames()
    rows = sorted((r.rss_title, r.rss_description_text, str(r.rss_pubdate_utc)) for r in items.collect())
    assert rows == [("t1", "s x", "2021-01-03 07:32:06"), ("t2", "s x", "2021-01-03 07:32:06")]
    (tmp_path / "again.json").write_text(json.dumps(payload(1)))
    out = str(tmp_path / "out")
    stream = ingest.stream_items(ingest.stream_payloads(spark, str(tmp_path) + "/*.json"))
    ingest.start(stream, lambda df, n: writers.append_table(df, out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.rss_title for r in spark.read.parquet(out).collect()) == ["t1", "t2"]


def test_feed_source(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    spark.dataSource.register(readers.feed_source(name="feedtest"))
    got = spark.read.format("feedtest").option("urls", f"{tmp_path}/f.xml {tmp_path}/gone.xml").load().collect()
    assert [(r.title, r.source_url) for r in got if r.error is None] == [("A & B", "https://x.example"), ("C", "")]
    assert sum(r.error is not None for r in got) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>")
    path = str(tmp_path / "t")
    writers.replace_table(df, path)
    writers.replace_table(df.withColumn("k", F.lit("b")), path)
    assert [r.k for r in spark.read.parquet(path).collect()] == ["b"]
    assert writers.text_columns(df).first().v == "x | y"
    writers.write_summary(spark, str(tmp_path / "s.json"), {"n": 1})
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 1}


def test_batch_results_and_inference(spark):
    lines = [json.dumps(x) for x in (
        {"custom_id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "ok"}}]}}},
        {"custom_id": "2", "response": {"status_code": 500, "body": {}}},
        {"custom_id": "3", "result": {"type": "succeeded", "message": {"content": [{"text": "fine"}]}}},
        {"custom_id": "4", "result": {"type": "expired"}},
    )]
    got = {r.custom_id: (r.success, r.raw_text, r.error) for r in readers.batch_results(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"1": (True, "ok", ""), "2": (False, "", "http_500"), "3": (True, "fine", ""), "4": (False, "", "expired")}
    t = spark.createDataFrame([("https://a.example", "x", "2021-01-01")], "q string, headline string, w string")
    assert readers.infer_columns(t) == {"url": "q", "title": "headline", "description": None, "date": "w"}
