import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from loomline.operators import counts, graph, polls, topics
from loomline.plans import lineage


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_vocabulary_threshold_is_strict(spark):
    c = spark.createDataFrame([("#tag", 5), ("1word", 9), ("é", 3), ("b", 2), ("a", 3), ("!x", 7)], "word string, cnt long")
    assert rows(counts.vocabulary(c, 2).select("id", "word")) == [(1, "#tag"), (2, "a"), (3, "é")]


def test_dense_ids_over_many_partitions(spark):
    got = lineage.dense_ids(spark.range(1000).repartition(7).withColumn("k", F.col("id") * 3).drop("id"), "k").collect()
    assert sorted((r.id, r.k) for r in got) == [(i + 1, 3 * i) for i in range(1000)]
    assert lineage.dense_ids(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


def test_once_per_key(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert sorted(r.k for r in lineage.once_per_key(frame, "k").collect()) == [1, 2]


def test_bounded_sample_is_fixed(spark):
    frame = spark.range(5000).withColumnRenamed("id", "k")
    a, b = ({r.k for r in lineage.bounded_sample(frame.repartition(n), "k", 100).collect()} for n in (3, 9))
    assert a == b and len(a) == 100


def test_pairs_and_npmi(spark):
    docs = [["a", "b"]] * 11 + [["a"]] * 3 + [["b"]] * 2 + [["c", "a"]] * 1
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "ord long, t array<string>")
    vocab = counts.vocabulary(counts.document_frequency(frame, counts.distinct_words(F.col("t"))), 0)
    records = counts.to_ids(frame, "ord", counts.distinct_words(F.col("t")), vocab)
    pairs = counts.pair_counts(records)
    assert rows(pairs) == [(1, 2, 11), (1, 3, 1)]
    (i, j, value), = rows(counts.npmi(pairs, vocab))
    w, p = 15 + 13 + 1, 12
    assert (i, j) == (1, 2) and math.isclose(value, math.log(11 * w * w / (15 * 13 * p)) / -math.log(11 / p))


def test_pairs_only_together_drop(spark):
    pairs = spark.createDataFrame([(1, 2, 11), (1, 3, 11)], "i int, j int, cnt long")
    vocab = spark.createDataFrame([(1, "a", 30), (2, "b", 11), (3, "c", 12)], "id int, word string, cnt long")
    assert [(i, j) for i, j, _ in rows(counts.npmi(pairs, vocab))] == [(1, 3)]


def test_nearest_ties_and_mutual(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (1, 4, 2.0), (2, 1, 1.0), (4, 1, 0.5)], "src int, dst int, weight double")
    near = graph.nearest(e, 2)
    assert [(r.src, r.dst) for r in near.orderBy("src", "rank").collect()] == [(1, 4), (1, 2), (2, 1), (4, 1)]
    assert rows(graph.mutual(near)) == [(1, 2, 1.0), (1, 4, 0.5)]


def test_components_against_search(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    links = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in {*(a for a, _ in edges), *(b for _, b in edges), 999}], "node long")
    assert dict(rows(graph.components(nodes, links))) == {n: find(n) if n in parent else n for n, in nodes.collect()}


def test_giant_component_tie(spark):
    e = spark.createDataFrame([(5, 6, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    assert rows(graph.giant_component(e)) == [(1,), (2,)]


def test_spectral_finds_two_blocks(spark):
    edges = [(a, b, 1.0) for block in (range(0, 8), range(8, 18)) for a in block for b in block if a < b] + [(7, 8, 0.01)]
    got = dict(rows(graph.spectral_clusters(spark.createDataFrame(edges, "src long, dst long, weight double"), 2)))
    assert len({got[i] for i in range(8)}) == 1 and len({got[i] for i in range(8, 18)}) == 1 and got[0] != got[17]


def test_centrality_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 3, 1.0), (3, 4, 5.0)], "src long, dst long, weight double")
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "node long, cluster int")
    got = {n: i for n, _, i in rows(graph.centrality(e, c))}
    assert got == {1: 2 / 6, 2: 3 / 6, 3: 1 / 6, 4: 0.0}


def test_smoothing(spark):
    s = "src long, dst long, weight double"
    now, before = spark.createDataFrame([(1, 2, 1.0), (1, 9, 4.0)], s), spark.createDataFrame([(1, 2, 3.0), (2, 7, 1.0)], s)
    assert rows(graph.smooth_over_time(now, before, 0.5)) == [(1, 2, 2.0), (1, 9, 4.0)]


def test_match_clusters(spark):
    s = "node long, cluster int"
    now = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], s)
    before = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (9, 6)], s)
    assert sorted(graph.match_clusters(now, before).collect()) == [(0, 5), (1, None), (2, None)]


def test_estimated_alpha(spark):
    rng = np.random.default_rng(0)
    s = "src long, dst long, weight double"
    clusters = spark.createDataFrame([(i, i // 6) for i in range(12)], "node long, cluster int")
    draw = lambda: [(i, j, float(np.clip(rng.normal(1.0 if i // 6 == j // 6 else 0.2, 0.1), 0, None))) for i in range(12) for j in range(i + 1, 12)]
    now = spark.createDataFrame(draw(), s)
    same, other = spark.createDataFrame(draw(), s), spark.createDataFrame([(i, j, 1.2 - w) for i, j, w in draw()], s)
    near, far = (graph.estimate_alpha(now, x, clusters) for x in (same, other))
    assert 0 <= far < 0.2 < near <= 1
    assert graph.estimate_alpha(now, same.where("false"), clusters) == 0.0


def test_evolving_clusters_keep_their_names(spark):
    s = "src long, dst long, weight double"
    block = lambda a, b: [(i, j, 1.0) for i in range(a, b) for j in range(i + 1, b)]
    edges = spark.createDataFrame(block(0, 6) + block(6, 14) + [(5, 6, 0.05)], s)
    before = spark.createDataFrame([(i, 7 if i < 6 else 3) for i in range(14)], "node long, cluster int")
    smoothed, clusters, alpha = graph.evolve_clusters(edges, edges, before, 2)
    assert dict(rows(clusters)) == dict(rows(before)) and 0 <= alpha <= 1 and smoothed.count() == edges.count()


def test_leading_vectors_against_dense():
    rng = np.random.default_rng(2)
    for n, k in ((40, 5), (300, 12), (3, 3)):
        m = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.1 if n > 3 else 1), 1)
        a, b = np.nonzero(m)
        values, vectors = graph.leading_vectors(a, b, m[a, b], n, k)
        assert np.allclose(values, np.linalg.eigvalsh(m + m.T)[-k:], atol=1e-6)
        assert np.allclose((m + m.T) @ vectors, vectors * values, atol=1e-5)


def test_eigengap(spark):
    edges = [(i, j, 1.0) for block in (range(0, 6), range(6, 12), range(12, 18)) for i in block for j in block if i < j] + [(5, 6, 0.01), (11, 12, 0.01)]
    values = graph.leading_eigenvalues(spark.createDataFrame(edges, "src long, dst long, weight double"), 6)
    assert graph.eigengap(values) == 3


def test_topics(spark):
    clusters = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25), ("z", 0, 1.0), ("low", 3, 1.0)], "word string, cluster int, importance double")
    labels = spark.createDataFrame([(1, 3, "x"), (2, 3, "y z"), (3, 1, "w")], "cluster int, coherence int, label string")
    msgs = spark.createDataFrame([(["a", "a", "A"],), (["b", "z", "low"],), (None,)], "t array<string>")
    assert rows(topics.topic_scores(msgs, F.col("t"), clusters, labels)) == [(1, 0.8), (2, 0.2)]
    assert topics.topic_scores(msgs.where("false"), F.col("t"), clusters, labels).count() == 0
    assert topics.word_cluster(clusters, " B ").first()[0] == 2 and topics.word_cluster(clusters, "nope").count() == 0
    assert topics.describe_cluster(clusters, labels, 1).first().label == "x"


def test_polls(spark):
    kw = spark.createDataFrame([("p", None, "tax"), ("q", None, " tax"), ("p", None, "tax"), (None, "positive", "good"), (None, "negative", "bad"), (None, "positive", "tax")], "party string, polarity string, keyword string")
    msgs = spark.createDataFrame([("d1", ["Tax", "tax", "good", "bad"]), ("d1", None), ("d2", ["bad"])], "day string, t array<string>")
    got = {(r.day, r.party): (r.pos, r.neg, r.ratio) for r in polls.poll_sentiment(msgs, kw, "day", "t").collect()}
    assert got == {("d1", "p"): (6, 2, 7 / 3), ("d1", "q"): (6, 2, 7 / 3), ("d2", "p"): (0, 0, 1.0), ("d2", "q"): (0, 0, 1.0)}


def test_affect_takes_rare_pairs(spark, monkeypatch):
    from loomline.queries import words as queries

    s = "ord long, posted_at timestamp_ntz, analysis struct<tokens: struct<all: array<string>>>"
    days = [dt.datetime(2013, 1, 8)] * 4 + [dt.datetime(2013, 1, 22)] * 20
    rows_ = [(i, t, ((["a", "b"],),)) for i, t in enumerate(days)] + [(24, days[-1], ((["a", "c"],),))]
    frame = spark.createDataFrame(rows_, s).withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    monkeypatch.setattr(queries, "messages", lambda spark, d, *columns: frame)
    monkeypatch.setattr(queries, "_vocabulary", lambda lists: spark.createDataFrame([(1, "a", 25), (2, "b", 24), (3, "c", 1)], "id int, word string, cnt long"))
    registered = queries.queries()
    assert rows(registered["affect_mean_similarity"](spark, "")) == [(1, 2, 12.0), (1, 3, 0.5)]
    assert rows(registered["affect_smooth"](spark, "")) == [(1, 2, 15.2), (1, 3, 1.0)]
    seen = []
    monkeypatch.setattr(queries.graph, "evolve_clusters", lambda edges, *rest: seen.append(edges) or (edges, edges, 0.0))
    registered["affect_evolve"](spark, "")
    assert [rows(e) for e in seen] == [[(1, 2, 4.0)], [(1, 2, 20.0), (1, 3, 1.0)]]


def test_spectral_is_the_same_method_at_any_size(spark):
    """Two stars, together larger than the former switch to power iteration, with one weak edge between their hubs."""
    n = 25_100
    leaves = spark.range(2, 2 + 2 * n).select((F.col("id") % 2).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    edges = leaves.unionByName(spark.createDataFrame([(0, 1, 0.01)], leaves.schema))
    got = graph.spectral_clusters(edges, 2).withColumn("star", F.col("node") % 2).groupBy("star", "cluster").count().collect()
    assert sorted(r["count"] for r in got) == [n + 1, n + 1]


def test_spectral_of_spread_edges(spark):
    edges = [(a, b, 1.0 + (a * b) % 3) for block in (range(0, 8), range(20, 30), range(40, 46)) for a in block for b in block if a < b] + [(7, 20, 0.01), (29, 40, 0.01)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(2)
    parts = [{frozenset(n for n, c in got if c == k) for k in range(3)} for got in (rows(graph.spectral_clusters(frame, 3, local_edges=m)) for m in (0, 1000))]
    assert parts[0] == parts[1] == {frozenset(range(0, 8)), frozenset(range(20, 30)), frozenset(range(40, 46))}


def test_evolving_joins_the_times_and_finds_the_component_once(spark, monkeypatch):
    blocks = (range(0, 6), range(10, 17), range(20, 25))
    edges = [(a, b, 2.0) for block in blocks for a in block for b in block if a < b] + [(5, 10, 0.01), (16, 20, 0.01)]
    now = spark.createDataFrame(edges + [(30, 31, 9.0)], "src int, dst int, weight double")
    before = spark.createDataFrame(edges[:-3] + [(16, 20, 0.5)], "src int, dst int, weight double")
    calls, found = [], graph.giant_component
    monkeypatch.setattr(graph, "giant_component", lambda e: calls.append(1) or found(e))
    first = graph.evolve_clusters(before, None, None, 3)[1]
    smoothed, clusters, alpha = graph.evolve_clusters(now, before, first, 3)
    assert len(calls) == 2
    assert rows(smoothed) == rows(graph.smooth_over_time(now, before, alpha))
    got = rows(clusters)
    assert {frozenset(n for n, c in got if c == k) for k in range(3)} == {frozenset(b) for b in blocks}


def test_forest_keeps_components_with_fewer_links(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for base in (0, 100, 200) for a, b in draw.integers(base, base + 40, (600, 2))] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(pairs, "a int, b int").repartition(3)
    less = graph.forest(links).select(F.col("u").alias("a"), F.col("v").alias("b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    assert less.count() <= 3 * nodes.count() < links.count()
    assert rows(graph.components(nodes, less)) == rows(graph.components(nodes, links))
