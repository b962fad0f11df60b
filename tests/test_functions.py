import hashlib
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from presswork.functions import html, links, model_output, text, urls


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("x")).first().x


def test_white_space_as_in_python(spark):
    for s in [None, "", " a  b\x1c c\n", "x　y", "\x85z"]:
        want = " ".join((s or "").split())
        assert one(spark, s, text.normalize_ws) == want
        assert one(spark, want, text.normalize_ws) == want


def test_hash_and_slug(spark):
    assert one(spark, "été", text.content_hash) == hashlib.sha256("été".encode()).hexdigest()
    long = "Ä" + "b" * 100
    assert one(spark, long, text.slugify) == "b" * 61 + "_" + hashlib.sha256(long.encode()).hexdigest()[:10]
    assert one(spark, "!!", text.slugify) == "item" and one(spark, " A-b ", text.slugify) == "a_b"


def test_mail_dates_as_in_python(spark):
    for s in ["Sun, 03 Jan 2021 09:32:06 +0200", "03 Jan 2021 09:32:06 GMT", "Fri, 1 Jan 2021 05:16:45 -0330"]:
        assert one(spark, s, lambda c: F.unix_seconds(text.rfc822_utc(c))) == int(parsedate_to_datetime(s).timestamp())
    for s in ["yesterday", "", None]:
        assert one(spark, s, text.rfc822_utc) is None


def test_domains(spark):
    cases = {"https://www.A.example:443/x": "a.example", "a.example": "a.example", "//b.example/": "b.example", "no url": "", "http://u:p@c_d.example/q?x y": "c_d.example", None: "", ".www.x.example.": "x.example"}
    for s, want in cases.items():
        assert one(spark, s, urls.extract_domain) == want, s


def test_canonical_urls(spark):
    cases = {
        "//x.example//a//b/": "https://x.example/a/b", "www.x.example": "https://www.x.example/", "ftp://x.example": None, "HTTP://X.example:80/?b=2&a=1&utm_x=3#f": "http://x.example/?a=1&b=2",
        "https://x.example:8080/p/?fbclid=1": "https://x.example:8080/p", "https://u:p@x.example/?q=a%20b": "https://x.example/?q=a+b", "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.c for r in urls.with_canonical_url(df, "u", "c").collect()}
    assert got == cases
    again = urls.with_canonical_url(spark.createDataFrame([(v,) for v in cases.values() if v], "u string"), "u", "c").collect()
    assert all(r.u == r.c for r in again)


def test_strict_answers(spark):
    cases = [('x {"label": "Relevant", "confidence": "0.9", "rationale": "r"} y', "relevant", 0.9, None), ("", None, None, "empty_response"), ("{bad", None, None, "invalid_json"),
             ('{"label": "maybe"}', None, None, "invalid_label"), ('{"label": "unsure", "confidence": "x"}', None, None, "invalid_confidence"), ('{"label": "unsure", "confidence": 1.7}', "unsure", 1.0, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "c string").select(model_output.strict_answer(F.col("c")).alias("a"))
    assert [(r.a.label, r.a.confidence, r.a.error) for r in df.collect()] == [c[1:] for c in cases]


def test_repaired_answers():
    for raw in ['```json\n{"a": 1,}\n```', "{'a': 1}", 'so: {"a": 1', '{"a": 1} ok']:
        assert model_output.repair_json(raw) == {"a": 1}
    assert model_output.repair_json("none") is None and model_output.repair_json(None) is None


def test_page_fields():
    page = """<html lang="fr"><head><title>T</title><meta property="og:title" content="O"><link rel="canonical" href="https://c.example/">
    <script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle"], "headline": "H", "datePublished": "2021-01-01", "author": [{"name": "A B"}, "a b"]}]}</script></head>
    <body><nav><p>menu menu menu</p></nav><article><p>%s</p><p>%s</p></article><div class="related"><p>more, more</p></div></body></html>""" % ("One, two. " * 20, "Three. " * 20)
    got = html.read_page(page, "f")
    assert (got["canonical_url"], got["page_title"], got["published_at"], got["language"], got["authors"]) == ("https://c.example/", "O", "2021-01-01", "fr", "A B")
    assert got["text"].startswith("One, two.") and "menu" not in got["text"] and "more" not in got["text"]
    assert html.read_page(None)["text"] == "" and html.strip_tags("a<b>b</b><script>x</script>") == "a b"


def test_term_lists(spark):
    assert one(spark, "b; B ,, a|b", text.split_terms) == ["b", "a"]
    assert one(spark, "x", lambda c: text.search_string(F.array(c, F.lit('q"r')))) == '"x" OR "qr"'


def article_id(url, marks=b"\x08\x13\x22"):
    import base64

    raw, n = url.encode(), len(url.encode())
    size = bytes([n]) if n < 128 else bytes([n % 128 + 128, n // 128])
    return base64.urlsafe_b64encode(marks + size + raw + b"\xd2\x01\x00").decode().rstrip("=")


def test_decoded_article_ids():
    long = "https://p.example/" + "a" * 300
    for url in ("https://p.example/a?b=1", "HTTP://p.example/", long):
        assert links.decode_article_id(article_id(url)) == url and links.decode_article_id(article_id(url, b"\x08\x13")) == url
    # a wrong length, or none that fits: the address among the bytes
    import base64

    odd = base64.urlsafe_b64encode(b"\x05zz https://q.example/x\" y").decode()
    assert links.decode_article_id(odd) == "https://q.example/x"
    for bad in (None, "", "a", "AAAA", "?!", base64.urlsafe_b64encode(b"\xff" * 20).decode()):
        assert links.decode_article_id(bad) is None


def test_link_decisions(spark):
    hub = "https://news.google.com/rss/articles/"
    rows = [("https://p.example/a", None, None), (hub + article_id("https://p.example/b") + "?oc=5", None, None), (hub + "AAAA", "https://p.example/c", None), (hub + "AAAA", None, "missing_sig_ts"), (None, None, None)]
    df = spark.createDataFrame(rows, "u string, online string, err string").select(links.resolved_link(F.coalesce("u", F.lit("")), F.col("online"), F.col("err")).alias("r"))
    assert [tuple(r.r) for r in df.collect()] == [
        ("https://p.example/a", "not_wrapper", ""), ("https://p.example/b", "decoded_offline", ""), ("https://p.example/c", "decoded_online", ""), (hub + "AAAA", "decode_failed", "missing_sig_ts"), ("", "not_wrapper", ""),
    ]


def test_locales_and_instants(spark):
    for v, want in {"es-419": "MX", "pt-PT": "PT", "fr": "FR", "en-gb": "GB", "pt": "BR", "xx": None}.items():
        assert one(spark, v, links.variant_country) == want
    got = spark.range(1).select(links.accept_language(F.lit("fr"), F.lit("fr-CA"), F.array(*map(F.lit, ["fr", "fr-CA", " ", "fr-FR"]))).alias("a")).first().a
    assert got == "fr-CA,fr;q=0.9,fr-FR;q=0.8,en;q=0.3"
    for s, want in {"2021-01-03T09:32:06Z": 1609666326, "2021-01-03 09:32:06+02:00": 1609659126, "2021-01-03": 1609632000, "03 Jan 2021": None, "": None, "2021-13-40": None}.items():
        assert one(spark, s, lambda c: F.unix_seconds(links.lenient_instant(c))) == want
    assert one(spark, "Sorry: Before you continue to Google", lambda c: links.consent_page(F.lit(None).cast("string"), c)) is True
    assert one(spark, "cookies and data", lambda c: links.consent_page(F.lit("https://x.example"), c)) is False


def test_small_text_rules(spark):
    assert one(spark, " 1e2 ", text.to_float) == 100.0 and one(spark, "x", text.to_float) is None
    assert one(spark, "a  virus", lambda c: text.with_subtype(c, F.lit("H5 Virus"))) == "a virus H5 Virus"
    assert one(spark, "H5 virus b", lambda c: text.with_subtype(c, F.lit("h5 Virus"))) == "H5 virus b"
    assert spark.range(1).select(text.elapsed(F.lit(3725.9)).alias("e")).first().e == "01:02:05"
