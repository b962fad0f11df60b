"""Site lines, residue, languages, page bodies, tokens and packing."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.llm import languages, main_content, packing, render, residue, site_lines, tokens

ART = "article_id long, domain string, full_text string, h string, line_no string"


def articles(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ART)


def test_site_lines_threshold_and_spelling(spark):
    rows = [(i, "s.example", f"own text {chr(97 + i)}\n\n{['Share  THIS 12!', 'share this …', 'Share this 7'][i % 3]}") for i in range(6)]
    rows += [(10 + i, "s.example", f"body {chr(97 + i)}") for i in range(24)]
    rows += [(50, None, "Share this"), (51, " ", "Share this"), (52, "s2.example", "Share this"), (53, "s.example", None), (54, "t.example", "")]
    df = articles(spark, rows)
    counts = site_lines.LineCounts(spark)
    hashed = site_lines.hashed(df)
    counts.add(hashed)
    # 31 articles of the site: 6 are below a fifth of them
    assert counts.occurrences(hashed).count() == 0
    fewer = articles(spark, rows[:28])
    counts = site_lines.LineCounts(spark)
    newly = counts.add(site_lines.hashed(fewer))
    assert {tuple(r) for r in counts.occurrences(site_lines.hashed(fewer)).collect()} == {(i, 3) for i in range(6)}
    touched = counts.touched(site_lines.hashed(fewer), newly)
    rebuilt = {r.article_id: r.full_text for r in counts.rebuild(fewer.join(touched, "article_id", "left_semi"), site_lines.hashed(fewer)).collect()}
    assert rebuilt == {i: f"own text {chr(97 + i)}\n" for i in range(6)}


def test_site_lines_merge_equals_one_pass(spark):
    rng = random.Random(1)
    rows = [(i, f"d{i % 2}", "\n".join(rng.choice(["alpha", "beta!", "gamma 3", "delta", "eps"]) for _ in range(3))) for i in range(40)]
    whole, parts = site_lines.LineCounts(spark), site_lines.LineCounts(spark)
    whole.add(site_lines.hashed(articles(spark, rows)))
    crossed = [parts.add(site_lines.hashed(articles(spark, rows[a : a + 10]))).count() for a in range(0, 40, 10)]
    key = lambda c: {tuple(r) for r in c.lines().select("domain", "h", "articles").collect()}
    assert key(whole) == key(parts) and crossed[-1] <= whole.crossed.count()
    assert {tuple(r) for r in whole.crossed.collect()} == {tuple(r) for r in parts.crossed.collect()}


def test_site_lines_partitions_equal_one_run(spark, monkeypatch):
    # a line of 6 of 20 articles falls to 6 of 100 by the next partition; another crosses only then
    first = [(i, "s.example", f"own {chr(97 + i)}\nShare this" if i < 6 else f"own {chr(97 + i)}\nLate line" if i < 9 else "Late line" if i < 11 else "body") for i in range(20)]
    second = [(100 + i, "s.example", f"text {chr(97 + i % 26)}{chr(97 + i // 26)}" + ("\nLate line" if i < 40 else "")) for i in range(80)]
    # and one of a site that the second partition does not touch
    first += [(50 + i, "t.example", f"t {chr(97 + i)}\nFollow us") for i in range(7)]
    whole = articles(spark, first + second)
    part = F.when(F.col("article_id") < 100, 0).otherwise(1)
    hashes = site_lines.hashed(whole).withColumn("part", part)
    counts = site_lines.LineCounts(spark)
    for k in (0, 1):
        counts.add(hashes.where(F.col("part") == k))
    assert {tuple(r) for r in counts.occurrences(hashes).collect()} >= {(50, 2), (56, 2)}
    assert {r[0] for r in counts.touched(hashes.where("part = 0"), counts.crossed.where("domain = 's.example'")).collect()} == {*range(20)}
    monkeypatch.setattr(site_lines, "_part", lambda n: part if n == 2 else F.lit(0))
    got, want = ({r.article_id: r.full_text for r in site_lines.cleaned(spark, whole, hashes if n == 2 else hashes.withColumn("part", F.lit(0)), n).collect()} for n in (2, 1))
    assert got == want and got[0] == "own a\nShare this" and got[6] == "own g" and got[9] == "" and got[100] == "text aa"


RESIDUE = ["{{ article.title }}", "Hi {name}, {{{x}}}", "by %AUTHOR_NAME% today", "in #{region_name} now", "[object Object]", "Lorem ipsum dolor eget gravida nullam sit amet.", "Error 404 - Page gone", "503 Service Temporarily Unavailable",
           "Please enable JavaScript and reload the page", "Votre navigateur doit autoriser les scripts", "Access denied. Reference 9af3", "Loading...", "[INSERT PLACE NAME]", "TK TK figures TK", "Your headline goes here", "@@SUMMARY@@"]
PROSE = ["The portal showed an error 404 page, officials said.", '"The strain {clade 2.5} is new [sic] to us," they wrote.', "Aid of $14 million, about 12% of it.", "The registry asks farmers to enable scripts and cookies in the browser.", "404 herds were visited.",
         "Loading of ships has resumed.", "a < b and c > d", "El servicio de salud visitó 12 granjas.", "", None, "word " * 20000]


def test_residue(spark):
    rows = [(i, "s", f"Good line.\n{x}\nMore.") for i, x in enumerate(RESIDUE)] + [(100 + i, None, x) for i, x in enumerate(PROSE)]
    df = articles(spark, rows)
    assert sorted(r.article_id for r in residue.residue_articles(df).collect()) == list(range(len(RESIDUE)))
    assert all(r.line_no == 2 for r in residue.residue_lines(df).collect())
    assert residue.residue_articles(df.limit(0)).count() == 0


def test_wide_messages_and_retold_ones(spark):
    # another wording than any rule's first words: residue where it stands between different lines on several sources
    notice = "For this part of the site JavaScript has to be on."
    rows = [(i, f"s{i}.example", f"Line {chr(97 + i)} of ours.\n{notice}\nEnd {chr(97 + i)}.") for i in range(4)]
    # the same sentence in copies of one article, a message that names somebody, one site's own habit
    rows += [(10 + i, f"s{i}.example", "Story.\nThe clinic needs JavaScript on its page.\nEnd.") for i in range(5)]
    rows += [(20 + i, f"s{i}.example", f"Day {chr(97 + i)}.\nTo enable scripts is wrong, said Kivask.\nEnd {chr(97 + i)}.") for i in range(5)]
    rows += [(30 + i, "one.example", f"Day {chr(97 + i)}.\nOur readers asked why JavaScript is slow.\nEnd.") for i in range(5)]
    # upper-case copies, filler with one word of the public text and no word of a language, Spanish pain
    rows += [(40, "a", "x\n[object Object]"), (41, "b", "x\n[OBJECT OBJECT]"), (42, "c", "Gravida saltor mivex tadem fusca cursat orati posta."), (43, "c", "El dolor de la gente en los pueblos del norte no cesa.")]
    df = spark.createDataFrame(rows, "article_id long, domain string, full_text string")
    assert sorted(r.article_id for r in residue.residue_articles(df).collect()) == [0, 1, 2, 3, 40, 41, 42]


SAMPLES = "/root/testdata/sf0.001/language_samples.parquet"


def test_languages_held_out(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(SAMPLES).orderBy("sample_id").collect()]
    model = languages.WordFirst([x for i, x in enumerate(rows) if i % 3])
    test = [x for i, x in enumerate(rows) if i % 3 == 0]
    got = languages._names(model.batch([x[0] for x in test])[0])
    assert sum(a == b[1] for a, b in zip(got, test)) >= 0.95 * len(test)


def test_language_edges(spark):
    model = languages.WordFirst([(r.text, r.lang) for r in spark.read.parquet(SAMPLES).collect()])
    langs, sure, _, _ = model.batch([None, "", "123 !", "Jepopofam", "the market inspectors closed two markets"])
    assert languages._names(langs)[:3] == [None, None, None] and sure[0] == 0 and languages._names(langs)[4] == "en" and languages._names(langs)[3] is not None
    en = "The inspectors of the market closed two markets and asked for more vaccine in the town."
    fr = "Les inspecteurs du marché ont fermé deux marchés et ont réclamé davantage de vaccins dans la ville."
    df = spark.createDataFrame([(1, f"{en}\n{en}\n{fr}\nLes marchés"), (2, None), (3, fr)], "article_id long, full_text string")
    got = {(r.article_id, r.line_no): r.lang for r in languages.article_segments(df, model, "article_id", "full_text").collect()}
    assert got == {(1, 0): "en", (1, 3): "fr", (3, 0): "fr"}
    lab = spark.createDataFrame([("FR-ca",), ("und",), (" ",), (None,), ("en_GB",)], "l string").select(languages.label_language(F.col("l")).alias("x"))
    assert [r.x for r in lab.collect()] == ["fr", None, None, None, "en"]


def test_language_labels_teach_words_the_samples_lack(spark):
    # the sentences alone take these Portuguese titles for Spanish; a tenth of their labels is wrong, as in any feed
    base = [(r.text, r.lang) for r in spark.read.parquet(SAMPLES).orderBy("sample_id").collect()]
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("bdfgkl") + rng.choice("aeiou") for _ in range(3)).capitalize()
    made = {
        "pt": lambda: f"Por que {name()} teme que a gripe de {name()} chegue de {name()} até {name()}",
        "es": lambda: f"Por qué {name()} teme que la gripe de {name()} llegue de {name()} hasta {name()}",
        "en": lambda: f"Why {name()} fears that {name()} flu may reach {name()} from {name()}",
    }
    titles = [(make(), lang if rng.random() < 0.9 else rng.choice(languages.LANGUAGES)) for lang, make in made.items() for _ in range(300)]
    df = spark.createDataFrame(titles, "text string, label string")
    model = languages.fit(spark.read.parquet(SAMPLES), df)
    for lang, make in made.items():
        langs, sure, _, _ = model.batch([make() for _ in range(50)])
        assert set(languages._names(langs)) == {lang} and sure.min() > 0.8
    assert languages.fit(spark.read.parquet(SAMPLES), df.limit(0)).batch(["the town"])[0][0] == 0
    # the temperature keeps short pieces from being taken for certain
    assert 1 <= languages.calibrated(base) <= 12 and model.batch(["no"])[1][0] < 0.99


PAGE = """Home / News / Sport
Home > Health > Pebu
Ladoro-Mezi residents told to avoid pigs: Kivask reports 4 alerts

Officials in Ladoro-Mezi said on Tuesday that pigs were ill. They closed two markets.
Read also: Zuri-Bero residents told to avoid goats: Mevusk reports 9 alerts
What is known so far
- Pebu: 7 pigs
- Zori: 9 pigs
Advertisement
The ministry put the damage at 9 thousand crowns.
Most read
Zuri-Bero market closed after virus hits 9 goats, says Mevusk
© Herald 2022, all rights reserved
Contact"""


def test_main_content(spark):
    names = ["Ladoro-Mezi", "Bano-Ruvi", "Cedi-Towe", "Dulo-Kami", "Esu-Pate", "Firo-Naze"]
    rows = [(i, f"https://h{i}.example/news/{n.lower()}-{i}", PAGE.replace("Ladoro-Mezi", n).replace("damage", f"damage in {n}")) for i, n in enumerate(names)]
    # copies of one article do not make its sentences furniture
    rows += [(60 + i, f"https://c{i}.example/x/ladoro-mezi-9", rows[0][2]) for i in range(8)]
    rows += [(50, None, None), (51, "x", ""), (52, "https://h.example/a/no-such-7", "Home\nContact\nMost read"), (53, None, PAGE)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, final_url string, full_text string, key string")
    got = {}
    for r in main_content.furniture_lines(df).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert got[0] == {1, 2, 6, 12, 13, 14, 15} | {10} & got[0] and got[60] == got[53] == got[0] and got[52] == {1, 2, 3} and 50 not in got and 51 not in got
    body = {r.page_id: r.main_text for r in main_content.main_text(df).collect()}
    assert body[0].startswith("Ladoro-Mezi residents") and body[50] == "" and body[52] == ""


def test_main_text_of_markup(spark):
    head, foot = "<html><body>\n<nav><a href='/'>Home</a></nav>\n", "<footer>Contact</footer>\n</body></html>"
    article = "<h1>Mezi residents told to avoid pigs</h1>\n<p>Officials in Mezi said <b>on\nTuesday</b> that pigs were ill.</p>\n"
    notice = "<div>We use cookies, see our cookie policy to agree.</div>\n"
    html = head + article + notice + foot
    plain = "Mezi residents told to avoid pigs\nThe tag <p> begins a block.\nOfficials closed two markets.\nContact"
    url = "https://h.example/mezi-residents-told-to-avoid-pigs"
    df = spark.createDataFrame([(1, url, html), (2, url, html.replace("\n", " ")), (3, url, plain)], "page_id long, final_url string, full_text string")
    body = {r.page_id: r.main_text for r in main_content.main_text(df).collect()}
    want = "Mezi residents told to avoid pigs\n\nOfficials in Mezi said on Tuesday that pigs were ill."
    assert body == {1: want, 2: want, 3: plain.removesuffix("\nContact")}
    got = sorted((r.page_id, r.line_no) for r in main_content.furniture_lines(df).collect())
    assert got == [(1, 1), (1, 2), (1, 6), (1, 7), (1, 8), (3, 4)]


def test_notice_of_a_small_site_in_a_large_corpus(spark):
    notice = "Subscribers of the Pebu Herald read more every single day."
    rows = []
    for i in range(30_000):
        word = "".join(chr(97 + int(d)) for d in f"{i:05d}")
        host = "www.pebu.example" if i < 25 else f"h{i % 900}.example"
        lines = [f"Story of {word} ends", "", f"The {word} was seen in town today.", *([notice] if i < 25 else []), f"Last word on {word} came from the mayor."]
        rows.append((i, f"https://{host}/a/story-of-{word}-ends", "\n".join(lines)))
    df = spark.createDataFrame(rows, "page_id long, final_url string, full_text string").repartition(4)
    assert {(r.page_id, r.line_no) for r in main_content.furniture_lines(df).collect()} == {(i, 4) for i in range(25)}


def test_other_sites_change_no_page_of_a_site(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgkl") + rng.choice("aeiou") for _ in range(3))

    def page(i, site):
        head = f"{word()} {word()} {word()} {word()} {word()}"
        body = [f"The {word()} of {word()} said that {word()} was {word()}." for _ in range(4)]
        lines = ["Home", head.capitalize(), body[0], "What is known", body[1], "Read on", f"{word()} {word()} more", "We value our readers on every day.", body[2], body[3], "About us"]
        return (i, f"https://{site}.example/news/{head.replace(' ', '-')}", "\n".join(lines))

    one = [page(i, "one") for i in range(30)]
    schema = "page_id long, final_url string, full_text string"
    few = {tuple(r) for r in main_content.furniture_lines(spark.createDataFrame(one, schema)).collect()}
    many = one + [page(1000 + i, f"s{i % 40}") for i in range(400)]
    more = {tuple(r) for r in main_content.furniture_lines(spark.createDataFrame(many, schema)).collect()}
    assert {x for x in more if x[0] < 30} == few and {n for _, n in few} >= {1, 6, 8, 11} and not {n for _, n in few} & {2, 3, 4, 5, 9, 10}


def test_rendering():
    html = "<html><head><title>t</title></head><body><nav hidden>n</nav><h1>Head<p>One <b>two</b><p>Three<script>x</script><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>k<td>1<tr><td>long key<td>22</table><div style='display: none'>no</div>end</body>"
    assert render.render(html) == "Head\n\nOne two\n\nThree\n\n- a\n- b\n  - c\n\nk         1\nlong key  22\n\nend"
    assert render.render("") == "" and render.render("a &amp; b<br>c") == "a & b\nc"


HAVE = os.path.exists(tokens.tokenizer_file("byte_bpe_50k"))


@pytest.mark.skipif(not HAVE, reason="public vocabulary files are not here")
class TestTokens:
    @pytest.fixture(scope="session")
    def coder(self):
        return tokens.CorpusEncoder(tokens.tokenizer_file("byte_bpe_50k"), keep=300)

    @pytest.fixture(scope="session")
    def public(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k"))
        t.encode_special_tokens = True
        return t

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(max_size=60), max_size=6))
    def test_equals_the_public_library(self, coder, public, texts):
        offsets, ids = coder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]

    def test_repeats_and_specials(self, coder, public):
        texts = ["aaaa aaaaaaa " * 50, "<|endoftext|> x", None, "", "don't  stop\r\n\n ", "é" * 3000]
        offsets, ids = coder.encode(texts)
        want = [[] if not t else public.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want

    def test_table(self, spark):
        df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "Hello world", "c"), (3, "Hello world", "c")], "doc_id long, text string, ids string")
        assert sorted((r.doc_id, r.ids) for r in tokens.encoded(df).collect()) == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
        assert tokens.encoded(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(40, 60))
def test_plan_fills_containers(counts, capacity):
    slots, used = packing.best_fit_plan(counts, capacity)
    load = [0] * used
    ranks = {k: 0 for k in counts}
    for length, lo, hi, first, per in slots:
        assert lo == ranks[length]
        ranks[length] = hi
        for r in range(lo, hi):
            load[first + (r - lo) // per] += length
    # item by item: the fullest container that still holds it, else a new one
    rooms = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= length]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    assert ranks == counts and all(0 < x <= capacity for x in load) and used == len(rooms)


def test_packing_table(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 7, 7, 7, 31, 64, 65, 200])) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame([(*x, "c") for x in sizes], "doc_id long, tokens int, rank string")
    got = packing.pack(df, 64).collect()
    load, own = {}, {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.length
        own.setdefault(r.doc_id, []).append((r.start, r.length))
    assert max(load.values()) <= 64 and sorted(load) == list(range(len(load)))
    for i, n in sizes:
        parts = sorted(own[i])
        assert sum(p[1] for p in parts) == (n or 0) and ((n or 0) > 64 or len(parts) == 1)
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert sum(load.values()) / (64 * len(load)) > 0.93
    assert packing.pack(df.limit(0), 64).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    art = articles(spark, [(1, "s", "The town is quiet today, said the mayor of the town.")])
    empty = art.limit(0)
    counts = site_lines.LineCounts(spark)
    assert counts.add(site_lines.hashed(empty)).count() == 0 and counts.occurrences(site_lines.hashed(empty)).count() == 0
    assert counts.add(site_lines.hashed(art)).count() == 0 and counts.lines().count() == 1
    assert site_lines.cleaned(spark, empty, site_lines.hashed(empty).withColumn("part", F.lit(0)), 1).count() == 0
    pages = spark.createDataFrame([(1, None, None, "x", "y", "z")], "page_id long, final_url string, full_text string, site string, page string, h string")
    assert main_content.furniture_lines(pages).count() == 0 and main_content.main_text(pages).first().main_text == ""
    assert main_content.furniture_lines(pages.limit(0)).count() == 0 and main_content.main_text(pages.limit(0)).count() == 0
    model = languages.fitted([("the town is quiet", "en"), ("la ville est calme", "fr")], [])
    titles = spark.createDataFrame([(1, None, "fr"), (2, "the town", "FR"), (3, "the town", None), (4, "the town", "en-GB"), (5, "the town", "en-GB")], "item_id long, t string, lang string")
    assert sorted(r.item_id for r in languages.labelled(titles, model, "item_id", "t", "lang").collect()) == [2, 3]
    assert languages.labelled(titles.limit(0), model, "item_id", "t", "lang").count() == 0
    assert languages.article_segments(empty, model, "article_id", "full_text").count() == 0
    assert residue.message_groups(residue.suspicious_lines(empty, "article_id", "domain", "full_text")).count() == 0
