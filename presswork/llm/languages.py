"""Problem 6: language and confidence of texts and of the foreign lines inside them, word first with n-gram backoff.

A word known from the labelled samples is scored by its log frequency per language. An unknown word falls back to its
character n-grams, the longest known ones first; an unknown capitalised word is most likely a name and counts
only where nothing else is known.
The model is fitted on a bounded table of labelled sentences (language_samples, a fixed table) and is broadcast; all
texts are scored whole, each task keeping the scores of words it has met.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.residue import residue_articles
from presswork.session import read_table

LANGUAGES = ["en", "fr", "es", "pt", "de"]
#: The most rows the model is fitted on: labelled sentences (language_samples has 150), then titles and articles of the
#: corpus with their own labels.
FIT_ROWS, FIT_TITLES, FIT_ARTICLES = 100_000, 20_000, 1_000
#: Characters of the longest text that is drawn for the fit, so that the drawn rows are bounded in size too.
FIT_CHARS = 100_000
#: Least confidence of the first model in a label for its text to be in the second.
AGREED = 0.9
#: Temperatures tried for the confidence, and the words of the pieces of sentences it is judged on.
TEMPERATURES, PIECE_WORDS, FOLDS = (1, 1.5, 2, 3, 4, 6, 8, 12), 6, 5
#: Share given to a word in languages that do not have it.
UNSEEN = 1e-4
MIN_FOREIGN_WORDS = 12
NGRAMS = (5, 4, 3, 2, 1)
#: Weight of unknown words against known ones.
UNKNOWN_WEIGHT = 0.5
WORDS_KEPT = 500_000
_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"


class WordFirst:
    """Scores of words per language from labelled sentences.

    Frequencies are shares of each language's own words, or with `joint` of all words: then a language of few texts, many
    of which have its label by mistake, does not get the words of the others.
    """

    def __init__(self, samples: list[tuple[str, str]], joint: bool = False):
        import regex

        self.find = regex.compile(_WORD).findall  # a bound method of a pattern, which is pickled as its text
        words: dict[str, Counter] = defaultdict(Counter)
        # capitalised words that are no sentence starts are names, unless a language writes its nouns so
        for text, lang in samples:
            if lang not in LANGUAGES or not text:
                continue
            for i, w in enumerate(self.find(text)):
                if w[0].isupper() and i and lang != "de":
                    continue
                for part in self._parts(w.lower()):
                    words[part][lang] += 1
        total = Counter()
        for counts in words.values():
            total.update(counts)
        n = {lang: max(1, sum(total.values()) if joint else total[lang]) for lang in LANGUAGES}
        self.words = {w: np.array([math.log(c[lang] / n[lang] + UNSEEN) for lang in LANGUAGES]) for w, c in words.items()}
        grams: dict[str, np.ndarray] = {}
        for w, c in words.items():
            weight = np.array([c[lang] / n[lang] for lang in LANGUAGES])
            for k in NGRAMS:
                for g in self._grams(w, k):
                    grams[g] = grams.get(g, 0) + weight
        self.grams = {g: np.log((v + 1e-5) / (v.sum() + 5e-5)) for g, v in grams.items()}
        # row 0 scores nothing: names, and words of which not even a letter is known
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)))
        self.used = 1
        #: divides the scores where they become a confidence; see calibrated()
        self.temperature = 1.0

    @staticmethod
    def _parts(word: str) -> list[str]:
        # an elided article (l', d', qu') is a word of its own
        for quote in "'’":
            if quote in word:
                head, tail = word.split(quote, 1)
                return [x for x in (head + "'", tail) if x]
        return [word]

    @staticmethod
    def _grams(word: str, k: int) -> list[str]:
        padded = f"^{word}$" if k > 1 else word
        return [f"{k}{padded[i:i + k]}" for i in range(len(padded) - k + 1)]

    def backoff(self, part: str) -> np.ndarray | None:
        """Mean score of the longest known n-grams of an unknown word."""
        for k in NGRAMS:
            hits = [self.grams[g] for g in self._grams(part, k) if g in self.grams]
            if hits:
                s = np.mean(hits, axis=0)
                return UNKNOWN_WEIGHT * (s - s.max())
        return None

    def _row(self, word: str) -> int:
        """Row of the score table for a word as it is written; only differences between languages are kept."""
        out = np.zeros(len(LANGUAGES))
        hit = False
        for part in self._parts(word.lower()):
            s = self.words.get(part)
            if s is not None:
                s = s - s.max()
            elif word[0].isupper() and not (len(word) > 1 and word.isupper()):
                continue  # a name
            else:
                s = self.backoff(part)
            if s is not None:
                out += s
                hit = True
        if not hit:
            self.rows[word] = 0
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row = self.used
        self.used += 1
        self.table[row] = out
        self.rows[word] = row
        return row

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language numbers, confidences, summed scores, words with letters) of a list of texts.

        Without letters a text has language -1 and confidence 0; ties go to the first of LANGUAGES. The confidence is a
        softmax of the summed scores over the temperature. Texts of names only are scored by the n-grams of those names.
        """
        n = len(texts)
        scores = np.zeros((n, len(LANGUAGES)))
        counts = np.zeros(n, dtype=np.int64)
        get, find = self.rows.get, self.find
        for lo in range(0, n, 2000):
            flat: list[int] = []
            ends = []
            if len(self.rows) > WORDS_KEPT:
                self.rows.clear()
                self.used = 1
            for i in range(lo, min(lo + 2000, n)):
                words = find(texts[i]) if texts[i] else []
                counts[i] = len(words)
                known = 0
                start = len(flat)
                for w in words:
                    r = get(w)
                    if r is None:
                        r = self._row(w)
                    known |= r
                    flat.append(r)
                if words and not known:
                    del flat[start:]
                    for w in words:
                        s = self.backoff(w.lower())
                        if s is not None:
                            scores[i] += s
                ends.append(len(flat))
            rows = self.table[np.array(flat, dtype=np.int64)]
            sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(rows, axis=0)])
            marks = np.array([0, *ends])
            scores[lo:lo + len(ends)] += sums[marks[1:]] - sums[marks[:-1]]
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0), scores, counts
        scores = np.round(scores, 9)
        langs = np.where(counts > 0, scores.argmax(axis=1), -1)
        e = np.exp((scores - scores.max(axis=1, keepdims=True)) / self.temperature)
        sure = np.where(counts > 0, np.round(e.max(axis=1) / e.sum(axis=1), 6), 0.0)
        return langs, sure, scores, counts


def _names(langs: np.ndarray) -> list[str | None]:
    return [LANGUAGES[i] if i >= 0 else None for i in langs]


def fit(samples: DataFrame, titles: DataFrame | None = None, articles: DataFrame | None = None) -> WordFirst:
    """A model of at most FIT_ROWS labelled sentences (text, lang), FIT_TITLES titles and FIT_ARTICLES articles (text, label).

    Labels of titles and articles are wrong at times, and the sentences alone know too few words to tell which. So a first
    model takes every label as it is, with joint frequencies, where the wrong ones are outnumbered word by word, and the
    second keeps the lines whose label the first one confirms. The order is fixed, so the model is the same on every run.
    """
    rows = samples.select("text", "lang").where(F.col("lang").isin(LANGUAGES)).orderBy(F.xxhash64("text", "lang"), "text").limit(FIT_ROWS)
    base = [(r[0], r[1]) for r in rows.collect()]
    lines = []
    for frame, bound in ((titles, FIT_TITLES), (articles, FIT_ARTICLES)):
        if frame is not None:
            short = frame.where(F.length("text") <= FIT_CHARS)
            labelled_rows = short.select("text", label_language(F.col("label")).alias("label")).where(F.col("label").isin(LANGUAGES))
            lines += [(line, r[1]) for r in _bounded_sample(labelled_rows, bound).collect() for line in (r[0] or "").split("\n")]
    return fitted(base, lines)


def fitted(base: list[tuple[str, str]], lines: list[tuple[str, str]]) -> WordFirst:
    """The model of correctly labelled sentences and of lines with labels of which some are wrong."""
    model = WordFirst(base)
    if lines:
        langs, sure, _, _ = WordFirst(base + lines, joint=True).batch([x[0] for x in lines])
        model = WordFirst(base + [x for x, lang, p in zip(lines, _names(langs), sure) if lang == x[1] and p >= AGREED])
    model.temperature = calibrated(base)
    return model


def calibrated(samples: list[tuple[str, str]]) -> float:
    """The temperature whose confidences fit best how often models are right about pieces of sentences they have not seen."""
    scores, truth = [], []
    for fold in range(FOLDS):
        model = WordFirst([x for i, x in enumerate(samples) if i % FOLDS != fold])
        pieces = []
        for text, lang in samples[fold::FOLDS]:
            words = text.split()
            pieces += [(" ".join(words[i : i + PIECE_WORDS]), lang) for i in range(0, len(words), PIECE_WORDS)]
        _, _, s, counts = model.batch([x[0] for x in pieces])
        scores += [row for row, n in zip(s, counts) if n]
        truth += [LANGUAGES.index(lang) for (_, lang), n in zip(pieces, counts) if n]
    if not scores:
        return 1.0
    z, at = np.array(scores), np.arange(len(truth))

    def loss(t: float) -> float:
        x = z / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[at, truth]))

    return float(min(TEMPERATURES, key=loss))


def _bounded_sample(rows: DataFrame, bound: int) -> DataFrame:
    """At most `bound` distinct rows of a whole table, the same on every run: of each of `bound` hash buckets the row with
    the least hash. Tasks fold their rows to one number per bucket; no task sends the driver anything by itself."""
    hashed = rows.withColumn("__h", F.xxhash64(*rows.columns))
    least = hashed.groupBy(F.pmod("__h", F.lit(bound)).alias("__b")).agg(F.min("__h").alias("__h")).select("__h")
    return hashed.join(F.broadcast(least), "__h", "left_semi").distinct().orderBy("__h").drop("__h")


def corpus_model(spark: SparkSession, sf_dir: str) -> WordFirst:
    titles = read_table(spark, sf_dir, "rss_items").selectExpr("rss_title AS text", "rss_language AS label")
    articles = read_table(spark, sf_dir, "fulltext").selectExpr("full_text AS text", "article_language AS label")
    return fit(read_table(spark, sf_dir, "language_samples"), titles, articles)


def label_language(label: Column) -> Column:
    """The language part of a label in lower case; NULL for missing ones and und."""
    part = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    return F.when(part.isin("", "und"), F.lit(None)).otherwise(part)


def title_languages(titles: DataFrame, model: WordFirst, id_col: str, text: str) -> DataFrame:
    """(id, lang, confidence) of short texts; texts without letters (NULL, empty) have no language and confidence 0."""
    kind = dict(titles.dtypes)[id_col]
    shared = titles.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            langs, sure, _, _ = model.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_names(langs), pa.string()), pa.array(sure)], names=[id_col, "lang", "confidence"])

    return titles.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang string, confidence double")


def article_segments(articles: DataFrame, model: WordFirst, id_col: str, text: str) -> DataFrame:
    """(id, line_no, words, lang, confidence): line 0 is the article's main language, further rows are its foreign lines.

    The main language is the one with most words, counted line by line (ties: the better total score). A line is foreign
    if it has MIN_FOREIGN_WORDS white-space-separated words or more and another language than the article. Articles
    without letters have no row.
    """
    kind = dict(articles.dtypes)[id_col]
    shared = articles.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out: list[tuple] = []
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lines = [(i, no, line) for i, t in enumerate(texts) for no, line in enumerate((t or "").split("\n"), 1)]
            langs, sure, scores, counts = model.batch([x[2] for x in lines])
            at = 0
            for i, key in enumerate(keys):
                weight, sums, own = [0] * len(LANGUAGES), np.zeros(len(LANGUAGES)), []
                while at < len(lines) and lines[at][0] == i:
                    if counts[at]:
                        size = len(lines[at][2].split())
                        weight[langs[at]] += size
                        sums += scores[at]
                        own.append((lines[at][1], size, int(langs[at]), float(sure[at])))
                    at += 1
                if not own:
                    continue
                main = max(range(len(LANGUAGES)), key=lambda x: (weight[x], sums[x]))
                total = sum(weight)
                out.append((key, 0, total, LANGUAGES[main], round(weight[main] / total, 6)))
                out += [(key, no, size, LANGUAGES[x], p) for no, size, x, p in own if x != main and size >= MIN_FOREIGN_WORDS]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[id_col, "line_no", "words", "lang", "confidence"])

    return articles.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, line_no int, words int, lang string, confidence double")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    model = corpus_model(spark, sf_dir)
    titles = title_languages(read_table(spark, sf_dir, "rss_items").select("item_id", "rss_title"), model, "item_id", "rss_title")
    articles = read_table(spark, sf_dir, "fulltext").select("article_id", "domain", "full_text")
    clean = articles.join(residue_articles(articles), "article_id", "left_anti")
    return titles, article_segments(clean, model, "article_id", "full_text")


def labelled(df: DataFrame, model: WordFirst, id_col: str, text: str, label: str) -> DataFrame:
    """(id, lang, confidence) of texts whose label is missing or names another language."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(model)
    slim = df.select(id_col, text, label_language(F.col(label)).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            langs, sure, _, _ = model.batch(b.column(1).to_pylist())
            rows = [(k, x, float(p)) for k, label, x, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _names(langs), sure) if x is not None and x != label]
            cols = list(zip(*rows)) if rows else [[]] * 3
            types = [b.schema.field(0).type, pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[id_col, "lang", "confidence"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, lang string, confidence double")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = corpus_model(spark, sf_dir)
    titles = labelled(read_table(spark, sf_dir, "rss_items"), model, "item_id", "rss_title", "rss_language")
    rss = titles.select(F.lit("rss_language").alias("field_name"), F.col("item_id").alias("record_no"), F.lit(0).alias("line_no"), "lang")
    articles = read_table(spark, sf_dir, "fulltext").select("article_id", "domain", "article_language", "full_text")
    segments = article_segments(articles, model, "article_id", "full_text")
    labels = articles.select("article_id", label_language(F.col("article_language")).alias("label"))
    cases = segments.join(labels, "article_id").where("line_no > 0 OR label IS NULL OR label <> lang")
    cases = cases.join(residue_articles(articles), "article_id", "left_anti")
    art = cases.select(F.lit("article_language").alias("field_name"), F.col("article_id").alias("record_no"), "line_no", "lang")
    return rss.unionByName(art)


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every title, every article (line 0) and every foreign line."""
    titles, segments = _parts(spark, sf_dir)
    rss = titles.selectExpr("'rss_title' AS field_name", "item_id AS record_no", "0 AS line_no", "lang", "confidence")
    return rss.unionByName(segments.selectExpr("'full_text' AS field_name", "article_id AS record_no", "line_no", "lang", "confidence"))


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages}
ORACLE: dict[str, str] = {}
