"""Topics: n-gram tables, class-based term weights, keywords, clustering and projection of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.text import text_or_empty

# fixed values: one short stop list for every engine
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "is", "was", "were", "are", "be", "that", "this", "it", "had", "has", "have"]


def content_words(c: Column) -> Column:
    """ASCII words without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z]{2,})")), lambda x: ~x.isin(STOP_WORDS))


def ngrams(w: Column, longest: int = 2) -> Column:
    """Entries of an array column and runs of up to `longest` of them. The array should be a column of its own, since an
    expression would be evaluated again for each run."""
    return F.concat(w, *[_runs(w, n) for n in range(2, longest + 1)]) if longest > 1 else w


def _runs(words: Column, n: int) -> Column:
    """All runs of n consecutive entries, joined by blanks."""
    last = F.size(words) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def term_counts(docs: DataFrame, topic: str, doc: str, text: str, longest: int = 1, least_docs: int = 2) -> DataFrame:
    """(topic, term, tf) of terms in at least `least_docs` documents."""
    words = docs.select(topic, F.col(doc).alias("__d"), content_words(F.col(text)).alias("__w"))
    terms = words.select(topic, "__d", F.explode(ngrams(F.col("__w"), longest)).alias("term"))
    per_doc = terms.groupBy(topic, "__d", "term").agg(F.count(F.lit(1)).alias("n"))
    df = per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_docs)
    return per_doc.groupBy(topic, "term").agg(F.sum("n").alias("tf")).join(df.select("term"), "term").select(topic, "term", "tf")


def class_tf_idf(counts: DataFrame, topic: str) -> DataFrame:
    """(topic, term, tf, weight): square-root term share times log(1 + (A - f + 0.5) / (f + 0.5)), A the mean number of
    terms per topic and f the term's count over all topics."""
    per_topic = counts.groupBy(topic).agg(F.sum("tf").alias("n"))
    mean = per_topic.agg((F.sum("n") / F.count(F.lit(1))).alias("a"))
    f = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    j = counts.join(f, "term").join(F.broadcast(per_topic), topic).crossJoin(F.broadcast(mean))
    idf = F.log(1 + F.greatest(F.col("a") - F.col("f") + 0.5, F.lit(0.0)) / (F.col("f") + 0.5))
    return j.select(topic, "term", "tf", (F.sqrt(F.col("tf") / F.col("n")) * idf).alias("weight"))


def topic_keywords(weights: DataFrame, topic: str, top: int = 6) -> DataFrame:
    w = Window.partitionBy(topic).orderBy(F.round("weight", 9).desc(), F.col("term"))
    best = weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))


def topic_summary(assigned: DataFrame, topic: str, outlier: int = -1) -> DataFrame:
    """Documents, topics, outliers and the share of the largest topic among the other documents."""
    per = assigned.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(topic) != outlier
    return per.agg(
        F.sum("n").alias("documents"), F.sum(F.when(real, 1).otherwise(0)).cast("bigint").alias("topics"), F.sum(F.when(~real, F.col("n")).otherwise(0)).alias("outliers"),
        F.round(F.max(F.when(real, F.col("n"))) / F.sum(F.when(real, F.col("n"))), 6).alias("largest_share"),
    )


def kmeans_topics(vectors: DataFrame, embedding: str, documents: int, clusters: int = 10, seed: int = 42) -> DataFrame:
    """Adds topic by k-means with k = max(2, min(clusters, max(2, documents // 3)))."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = max(2, min(clusters, max(2, documents // 3)))
    v = vectors.withColumn("__v", array_to_vector(F.col(embedding).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="topic").fit(v).transform(v).drop("__v")


def reduced(vectors: DataFrame, embedding: str, components: int, to: str) -> DataFrame:
    """Adds an array of the first principal components, in place of a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("__v", array_to_vector(F.col(embedding).cast("array<double>")))
    return PCA(k=components, inputCol="__v", outputCol="__p").fit(v).transform(v).withColumn(to, vector_to_array("__p")).drop("__v", "__p")


def projection_2d(vectors: DataFrame, embedding: str) -> DataFrame:
    """Adds x, y: the first two principal components."""
    return reduced(vectors, embedding, 2, "__a").withColumn("x", F.col("__a")[0]).withColumn("y", F.col("__a")[1]).drop("__a")


def clustered(vectors: DataFrame, embedding: str, documents: int, method: str = "kmeans", clusters: int = 10, least_size: int = 0, seed: int = 42) -> DataFrame:
    """Adds topic (-1 for outliers) by one of the methods that scale out: "kmeans" or "bisecting". Topics with fewer than
    `least_size` documents are outliers. Density clustering needs all pairs of distances and is refused by name."""
    if method == "kmeans":
        out = kmeans_topics(vectors, embedding, documents, clusters, seed)
    elif method == "bisecting":
        from pyspark.ml.clustering import BisectingKMeans
        from pyspark.ml.functions import array_to_vector

        v = vectors.withColumn("__v", array_to_vector(F.col(embedding).cast("array<double>")))
        k = max(2, min(clusters, max(2, documents // 3)))
        out = BisectingKMeans(k=k, seed=seed, minDivisibleClusterSize=float(max(1, least_size)), featuresCol="__v", predictionCol="topic").fit(v).transform(v).drop("__v")
    else:
        raise ValueError(f"unknown method {method!r}: kmeans and bisecting are there; hdbscan has no distributed form, use bisecting with a least size")
    if least_size <= 0:
        return out
    # a row per topic
    small = out.groupBy("topic").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < least_size).select("topic", F.lit(True).alias("__small"))
    return out.join(F.broadcast(small), "topic", "left").withColumn("topic", F.when(F.col("__small"), -1).otherwise(F.col("topic"))).drop("__small")


def silhouette(assigned: DataFrame, embedding: str, topic: str = "topic") -> float | None:
    """Mean silhouette by squared distances of the documents that are no outliers; None with fewer than two topics."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = assigned.where(F.col(topic) >= 0).select(F.col(topic).cast("double").alias("prediction"), array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    if v.select("prediction").distinct().limit(2).count() < 2:
        return None
    return float(ClusteringEvaluator().evaluate(v))


def document_topics(docs: DataFrame, topic: str, keywords: DataFrame, outlier: int = -1) -> DataFrame:
    """Documents with topic_name, topic_keywords and is_outlier; keywords: (topic, keywords), a row per topic."""
    j = docs.join(F.broadcast(keywords), topic, "left")
    out = F.col(topic) == outlier
    words = F.when(out, "outlier").otherwise(F.coalesce("keywords", F.lit("")))
    name = F.concat_ws("_", F.col(topic).cast("string"), F.array_join(F.slice(F.split(words, ", "), 1, 4), "_"))
    return j.withColumn("is_outlier", out).withColumn("topic_name", name).withColumn("topic_keywords", words).drop("keywords")


def enough_documents(documents: int, least: int = 20) -> str:
    """Why a topic model is not made, empty if it is."""
    return "" if documents >= least else f"too_few_documents:{documents}<{least}"


def mmr_keywords(weights: DataFrame, topic: str, pool: int = 30, top: int = 6, diversity: float = 0.5) -> DataFrame:
    """Keywords picked for weight and against likeness (shared letter trigrams) to those picked before. The pool of each
    topic is its `pool` best terms, so a group is small."""
    w = Window.partitionBy(topic).orderBy(F.round("weight", 9).desc(), F.col("term"))
    best = weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool).select(topic, "term", "weight")
    kind = dict(weights.dtypes)[topic]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "term"], ascending=[False, True])
        grams = [{f" {t} "[i : i + 3] for i in range(len(t))} for t in pdf["term"]]
        like = np.array([[len(a & b) / len(a | b) for b in grams] for a in grams])
        scale = pdf["weight"].to_numpy() / max(pdf["weight"].max(), 1e-12)
        chosen: list[int] = []
        while len(chosen) < min(top, len(pdf)):
            gain = (1 - diversity) * scale - diversity * (like[:, chosen].max(axis=1) if chosen else 0)
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
        return pd.DataFrame({topic: [pdf[topic].iloc[0]], "keywords": [", ".join(pdf["term"].iloc[i] for i in chosen)]})

    return best.groupBy(topic).applyInPandas(pick, f"`{topic}` {kind}, keywords string")
