"""Questions to a word clustering: top words, a word's cluster, the topics of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.text import STOP_WORDS


def top_words(clusters: DataFrame, t: int = 10, cluster: int | None = None) -> DataFrame:
    """The ``t`` most important words of each cluster, or of one; equal importance goes by word."""
    rows = clusters if cluster is None else clusters.where(F.col("cluster") == cluster)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("importance"), "word"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= t)


def word_cluster(clusters: DataFrame, word: str) -> DataFrame:
    """(cluster) of a word, given in any case and with blanks around; no row if it has none."""
    return clusters.where(F.col("word") == word.strip().lower()).select("cluster")


def describe_cluster(clusters: DataFrame, labels: DataFrame, cluster: int = 1, t: int = 10) -> DataFrame:
    """Top words of a cluster with its label and coherence."""
    return top_words(clusters, t, cluster).join(labels, "cluster", "left")


def topic_scores(df: DataFrame, tokens: Column, clusters: DataFrame, labels: DataFrame, t: int = 10, coherence: int = 3, apply_stopwords: bool = False, stop_words: list[str] | None = None) -> DataFrame:
    """(cluster, score): summed importance of all messages' tokens in clusters of enough coherence, as a share of all
    clusters from 1 on. Tokens are matched as written and count as often as they occur; cluster 0 has no label and
    takes no part. ``apply_stopwords`` leaves out the service's own ``stop_words``, by default those of the news. At most ``t`` rows; ties go to the smaller cluster. Without any match there is no row.
    """
    words = df.select(F.explode(tokens).alias("word"))
    if apply_stopwords:
        words = words.where(~F.lower("word").isin(list(STOP_WORDS) if stop_words is None else stop_words))
    able = clusters.join(labels.where(F.col("coherence") >= coherence).select("cluster"), "cluster", "left_semi").where("cluster >= 1")
    # Counting words first leaves one row a word for the join.
    counted = words.groupBy("word").count().join(able, "word")
    scores = counted.groupBy("cluster").agg(F.sum(F.col("count") * F.col("importance")).alias("s"))
    total = F.sum("s").over(Window.partitionBy())
    return scores.where("s > 0").select("cluster", (F.col("s") / total).alias("score")).orderBy(F.desc("score"), "cluster").limit(t)
