"""Counts, word graph, clusters and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import counts, graph, topics
from loomline.plans.lineage import cut
from loomline.queries.common import NEIGHBOURS, NPMI_MIN, ONCE, VOCABULARY_MIN, WORDS, messages


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """(ord, posted_at, words) with the distinct words of each message once."""
    rows = messages(spark, d, "analysis", "posted_at").where("analysis.tokens.all is not null")
    return rows.select("ord", "posted_at", counts.distinct_words(F.col("analysis.tokens.all")).alias("words"))


def _frequencies(lists: DataFrame) -> DataFrame:
    return counts.document_frequency(lists, F.col("words"))


def _vocabulary(lists: DataFrame) -> DataFrame:
    return counts.vocabulary(_frequencies(lists), VOCABULARY_MIN)


def _records(lists: DataFrame, vocab: DataFrame) -> DataFrame:
    return counts.to_ids(lists, "ord", F.col("words"), vocab)


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges with NPMI, vocabulary). The messages are made distinct once for both."""
    lists = cut(_lists(spark, d).select("ord", "words"))
    vocab = cut(_vocabulary(lists))
    pairs = cut(counts.pair_counts(_records(lists, vocab)))
    return counts.npmi(pairs, vocab).withColumn("npmi", F.round("npmi", 6)), vocab


def _symmetric(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges, vocab = _edges(spark, d)
    return counts.symmetrise(counts.truncate(edges, NPMI_MIN)), vocab


def _mutual(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(mutual edges, vocabulary), the edges cut."""
    edges, vocab = _symmetric(spark, d)
    return cut(graph.mutual(graph.nearest(edges, NEIGHBOURS))), vocab


def word_df(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(_lists(spark, d))


def vocab_index(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(_lists(spark, d))


def dict_df(spark: SparkSession, d: str) -> DataFrame:
    lists = cut(_lists(spark, d).select("ord", "words"))
    records = _records(lists, _vocabulary(lists))
    return records.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("cnt"))


def cooc_counts(spark: SparkSession, d: str) -> DataFrame:
    lists = cut(_lists(spark, d).select("ord", "words"))
    return counts.pair_counts(_records(lists, cut(_vocabulary(lists))))


def npmi_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)[0]


def npmi_truncated_sym(spark: SparkSession, d: str) -> DataFrame:
    return _symmetric(spark, d)[0]


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest(_symmetric(spark, d)[0], NEIGHBOURS)


def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    return graph.mutual(graph.nearest(_symmetric(spark, d)[0], NEIGHBOURS))


def _roots(edges: DataFrame) -> DataFrame:
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)


def word_components(spark: SparkSession, d: str) -> DataFrame:
    return _roots(_mutual(spark, d)[0])


def giant_component(spark: SparkSession, d: str) -> DataFrame:
    return graph.giant_component(_mutual(spark, d)[0])


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mutual edges, components as clusters, vocabulary)."""
    edges, vocab = _mutual(spark, d)
    return edges, cut(_roots(edges).select("node", F.col("root").alias("cluster"))), vocab


def _words(spark: SparkSession, d: str) -> DataFrame:
    """(word, cluster, importance) with components as clusters."""
    edges, clusters, vocab = _clusters(spark, d)
    words = graph.centrality(edges, clusters).join(vocab.select(F.col("id").alias("node"), "word"), "node")
    return words.select("word", "cluster", F.round("importance", 8).alias("importance"))


def cluster_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.centrality(*_clusters(spark, d)[:2]).withColumn("importance", F.round("importance", 6))


def cluster_top_words(spark: SparkSession, d: str) -> DataFrame:
    return topics.top_words(_words(spark, d), 5).withColumn("importance", F.round("importance", 6))


def word_cluster_lookup(spark: SparkSession, d: str) -> DataFrame:
    return topics.word_cluster(_words(spark, d), "  Weekend ")


def topic_scores(spark: SparkSession, d: str) -> DataFrame:
    words = cut(_words(spark, d))
    labels = words.select("cluster").distinct().withColumn("coherence", F.when(F.col("cluster") % 4 == 0, 2).otherwise(3))
    rows = messages(spark, d, "analysis").where("analysis.tokens.all is not null")
    return topics.topic_scores(rows, F.col("analysis.tokens.all"), words, labels, 10).withColumn("score", F.round("score", 6))


def spectral_clusters(spark: SparkSession, d: str) -> DataFrame:
    edges, vocab = _mutual(spark, d)
    inside = graph.centrality(edges, cut(graph.spectral_clusters(edges, 30)))
    return inside.join(vocab.select(F.col("id").alias("node"), "word"), "node").select("word", "cluster", F.round("importance", 5).alias("importance"))


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    """Word pair counts of two halves of the time span as (t, src, dst, weight), every pair."""
    lists = cut(_lists(spark, d))
    vocab = cut(_vocabulary(lists))
    out = None
    for t, part in enumerate((lists.where("posted_at < timestamp'2013-01-19'"), lists.where("posted_at >= timestamp'2013-01-19'"))):
        pairs = counts.pair_counts(_records(part, vocab))
        one = pairs.select(F.lit(t).alias("t"), F.col("i").alias("src"), F.col("j").alias("dst"), F.col("cnt").cast("double").alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


def affect_smooth(spark: SparkSession, d: str) -> DataFrame:
    weekly = cut(_weekly(spark, d))
    now, before = (weekly.where(F.col("t") == t).select("src", "dst", "weight") for t in (1, 0))
    return graph.smooth_over_time(now, before, 0.3).withColumn("weight", F.round("weight", 6))


def affect_mean_similarity(spark: SparkSession, d: str) -> DataFrame:
    return graph.mean_similarity(_weekly(spark, d)).withColumn("weight", F.round("weight", 6))


def affect_evolve(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the later half, smoothed by the earlier one with an estimated share, under the earlier one's numbers."""
    weekly = cut(_weekly(spark, d))
    now, before = (weekly.where(F.col("t") == t).select("src", "dst", "weight") for t in (1, 0))
    _, first, _ = graph.evolve_clusters(before, None, None, 10)
    return graph.evolve_clusters(now, before, first, 10)[1]


def queries() -> dict:
    return {f.__name__: f for f in (word_df, vocab_index, dict_df, cooc_counts, npmi_edges, npmi_truncated_sym, knn_topk, mutual_knn, word_components, giant_component, cluster_centrality, cluster_top_words, word_cluster_lookup, topic_scores, spectral_clusters, affect_smooth, affect_mean_similarity, affect_evolve)}


_WORD = f"""with recursive {ONCE}, e as (select ord, unnest({WORDS.format("all_tokens")}) as word from t where all_tokens is not null),
f as (select word, count(*) as cnt from e group by word),
v as (select cast(row_number() over (order by word) as integer) as id, word, cnt from f where (word like '#%' or regexp_matches(word, '^\\p{{L}}')) and cnt > {VOCABULARY_MIN}),
r as (select ord, id from e join v using (word))"""
_PAIRS = _WORD + """, p as (select a.id as i, b.id as j, count(*) as cnt from r a join r b on a.ord = b.ord and a.id < b.id group by a.id, b.id)"""
_NPMI = _PAIRS + """, m as (select (select sum(cnt) from v)::double as w, (select sum(cnt) from p)::double as pp),
g as (select i, j, round(ln(p.cnt::double * w * w / (a.cnt::double * b.cnt::double * pp)) / -ln(p.cnt::double / pp), 6) as npmi from p join v a on a.id = i join v b on b.id = j, m
  where p.cnt <> a.cnt and p.cnt <> b.cnt and a.cnt > 10 and b.cnt > 10)"""
_SYM = _NPMI + f""", h as (select i, j, npmi from g where npmi > {NPMI_MIN}), s as (select i as src, j as dst, npmi as weight from h union all select j, i, npmi from h)"""
_KNN = _SYM + f""", k as (select * from (select src, dst, weight, cast(row_number() over (partition by src order by weight desc, dst) as integer) as rank from s) where rank <= {NEIGHBOURS})"""
_MUTUAL = _KNN + """, u as (select least(src, dst) as src, greatest(src, dst) as dst, min(weight) as weight from k group by 1, 2 having count(*) >= 2)"""
_ROOTS = _MUTUAL + """, b as (select src as x, dst as y from u union select dst, src from u),
reach(node, root) as (select distinct x, x from b union select b.y, reach.root from reach join b on b.x = reach.node),
c as (select node, min(root) as root from reach group by node)"""
_CENTRAL = _ROOTS + """, w as (select u.src, u.dst, u.weight, cs.root as cluster from u join c cs on cs.node = u.src join c cd on cd.node = u.dst where cs.root = cd.root),
n as (select node, sum(weight) as w from (select src as node, weight from w union all select dst, weight from w) group by node),
z as (select c.node, c.root as cluster, coalesce(n.w, 0) as w from c left join n using (node)),
i as (select node, cluster, w / nullif(sum(w) over (partition by cluster), 0) as importance from z),
y as (select v.word, i.cluster, round(coalesce(i.importance, 0), 8) as importance from i join v on v.id = i.node)"""
_HALVES = _WORD + """, q as (select r.ord, r.id, case when posted_at < timestamp '2013-01-19' then 0 else 1 end as t from r join t using (ord) where posted_at is not null),
p as (select a.t, a.id as src, b.id as dst, count(*)::double as weight from q a join q b on a.ord = b.ord and a.id < b.id group by a.t, a.id, b.id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "word_df": _WORD + " select word, cnt from f",
        "vocab_index": _WORD + " select id, word, cnt from v",
        "dict_df": _WORD + " select id, count(*) as cnt from r group by id",
        "cooc_counts": _PAIRS + " select i, j, cnt from p",
        "npmi_edges": _NPMI + " select i, j, npmi from g",
        "npmi_truncated_sym": _SYM + " select src, dst, weight from s",
        "knn_topk": _KNN + " select src, dst, weight, rank from k",
        "mutual_knn": _MUTUAL + " select src, dst, weight from u",
        "word_components": _ROOTS + " select node, root from c",
        "giant_component": _ROOTS + ", l as (select root, count(*) as n from c group by root order by n desc, root limit 1) select node from c join l using (root)",
        "cluster_centrality": _CENTRAL + " select node, cluster, round(coalesce(importance, 0), 6) as importance from i",
        "cluster_top_words": _CENTRAL + " select word, cluster, round(importance, 6) as importance, rank from (select *, cast(row_number() over (partition by cluster order by importance desc, word) as integer) as rank from y) where rank <= 5",
        "word_cluster_lookup": _CENTRAL + " select cluster from y where word = 'weekend'",
        "topic_scores": _CENTRAL + """, a as (select unnest(all_tokens) as word from t where all_tokens is not null),
            o as (select y.cluster, sum(y.importance) as s from a join y using (word) where y.cluster >= 1 and y.cluster % 4 <> 0 group by y.cluster)
            select cluster, round(s / (select sum(s) from o), 6) as score from o where s > 0 order by s desc, cluster limit 10""",
        "affect_smooth": _HALVES + """, now as (select * from p where t = 1), bef as (select * from p where t = 0),
            nn as (select src as n from now union select dst from now), bn as (select src as n from bef union select dst from bef),
            kept as (select * from bef where src in (select n from nn) and dst in (select n from nn))
            select coalesce(now.src, kept.src) as src, coalesce(now.dst, kept.dst) as dst,
              round(case when coalesce(now.src, kept.src) in (select n from bn) and coalesce(now.dst, kept.dst) in (select n from bn) then coalesce(kept.weight, 0) * 0.3 + coalesce(now.weight, 0) * 0.7 else coalesce(now.weight, 0) end, 6) as weight
            from now full outer join kept on now.src = kept.src and now.dst = kept.dst""",
        "affect_mean_similarity": _HALVES + " select src, dst, round(sum(weight) / (select count(distinct t) from p), 6) as weight from p group by src, dst",
    }
