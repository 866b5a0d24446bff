import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomline.operators import news, panel

PAGE = """<html><div class="newsbody">
<p>First <Person>Ann<b>Lee</b></Person> words<script>var x</script></p>
<p></p>
<p>Linked to nothing <a href="http://10.0.0.1/x">a</a> <Location>Nowhere</Location></p>
<p>End <a href="http://www.paper.example/1">x</a> <a href="http://r.example/redir.asp?URL=http://daily.co.uk/2">y</a></p>
<p>Second <Mention inst="http://dbpedia.org/resource/Oslo" class="c:City" countryowl="Norway, New Land"/></p>
<p>No<b>link</b></p>
<p>never ended</p></div></html>"""


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pages_to_stories(spark):
    pages = spark.createDataFrame([("/x/news_2013-02-03.html", PAGE), ("/x/news_2013-02-04.html", "<broken"), ("/x/news_2013-02-05.html", None), ("/x/n_2013-02-06.html", "<html/>")], "file string, content string")
    paragraphs = news.read_paragraphs(pages)
    assert paragraphs.count() == 7 and paragraphs.first().day == dt.date(2013, 2, 3)
    got = [(r.story, [t.term for t in r.terms], sorted(r.sources)) for r in news.segment_stories(paragraphs).orderBy("story").collect()]
    assert got == [(1, ["annotated:Ann_Lee"], ["daily.co.uk", "paper.example"]), (2, ["annotated:Oslo", "annotated:Norway", "annotated:New_Land"], ["No Source"])]


STORIES = "day date, story int, terms array<string>, sources array<string>"
D1, D2 = dt.date(2013, 1, 1), dt.date(2013, 1, 2)


@pytest.fixture
def stories(spark):
    return spark.createDataFrame([(D1, 1, ["a", "b", None], ["S", "T"]), (D1, 2, ["a"], ["S", "S"]), (D2, 1, None, ["No Source"]), (D2, 2, ["a", "a"], ["No Source", "T"]), (D2, 3, ["c"], [None])], STORIES)


def test_source_frequency(stories):
    assert rows(news.source_frequency(stories)) == [("No Source", 1), ("S", 2), ("T", 2)]
    assert rows(news.source_frequency(stories, "day")) == [("No Source", 1), ("S", 1), ("T", 2)]


def test_facts(stories):
    kept = news.keep_sources(stories, 2)
    freq = news.term_frequency(kept)
    assert rows(freq) == [("a", 4), ("b", 1)]
    assert rows(news.term_counts(kept, freq, 1)) == [(D1, "S", "a", 2), (D1, "T", "a", 1), (D2, "T", "a", 2)]
    assert rows(news.article_counts(kept)) == [(D1, "S", 2), (D1, "T", 1), (D2, "T", 1)]
    assert rows(news.source_index(news.keep_sources(stories, None))) == [(0, "No Source"), (1, "S"), (2, "T")]
    encoded = news.index_encode(news.term_counts(kept, freq, 1), news.term_index(freq, 1), news.source_index(kept))
    assert rows(encoded) == [(0, 1, 0, 2), (0, 2, 0, 1), (1, 2, 0, 2)]


def test_missing_id_is_an_error(spark, stories):
    kept = news.keep_sources(stories, 2)
    counts = news.term_counts(kept, news.term_frequency(kept), 0)
    with pytest.raises(Exception, match="no idx"):
        news.index_encode(counts, news.term_index(news.term_frequency(kept), 1), news.source_index(kept)).collect()


def test_closure_of_chain_diamond_and_cycle(spark):
    words = spark.createDataFrame([("w", "a")], "word string, class string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "child string, parent string")
    assert rows(news.class_closure(words, edges)) == [("w", x) for x in "abcd"]


def test_metadata_first_wins(spark):
    t = spark.createDataFrame([(2, "t", "u2", None), (1, "t", "u1", "k")], "ordinal int, term string, uri string, type string")
    assert rows(news.term_metadata(t)) == [("t", "u1", "k")]


def test_triples(spark):
    lines = spark.createDataFrame([('<a> <b> "x \\" y"^^<t:int> .',), ("_:n <b> <c> .",), ("rubbish",), (None,)], "value string")
    assert rows(news.parse_triples(lines)) == [("_:n", "b", "c", None), ("a", "b", 'x \\" y', "t:int")]


def test_pos_terms(spark):
    frame = spark.createDataFrame([([("Cat", "NN"), (".", ".")], ["cat", None])], "t array<struct<string:string,category:string>>, n array<string>")
    assert frame.select(news.pos_terms(F.col("t"), F.col("n"))).first()[0] == ["cat/NN"]


def days(folds, fold, part):
    return sorted(r.day for r in folds.where((F.col("fold") == fold) & (F.col("part") == part)).collect())


def test_folds(spark):
    g = panel.growing_folds(spark, 3)
    assert days(g, 0, "validation") == list(range(19, 27)) and days(g, 0, "train") == [*range(19), *range(27, 48)] and days(g, 0, "test") == list(range(48, 53))
    i = panel.iterator_folds(spark, 20, 0, 10, 2, 2)
    assert i.select("fold").distinct().count() == 5 and days(i, 0, "validation") == [4, 5] and days(i, 0, "train") == [0, 1, 2, 3, 6, 7, 8, 9] and days(i, 0, "test") == [10, 11]
    w = panel.windowed_folds(spark, 2)
    assert days(w, 1, "train") == list(range(5, 53)) and days(w, 1, "test") == list(range(53, 58))
    s = panel.split_validation(g)
    assert days(s, 0, "val_it") == [22, 23] and days(s, 0, "val_param") == [19, 20, 21, 24, 25, 26]
    for f in range(3):
        parts = [set(days(g, f, p)) for p in ("train", "validation", "test")]
        assert not (parts[0] & parts[1] or parts[0] & parts[2] or parts[1] & parts[2])


@pytest.fixture
def x(spark):
    return spark.createDataFrame([(0, 1, 10, "a", 2.0), (0, 1, 11, "b", 1.0), (1, 1, 10, "b", 3.0), (1, 2, 12, "a", 1.0)], "day int, region int, user long, word string, x double")


def test_contractions_agree(spark, x):
    w = spark.createDataFrame([(r, "t", k, v) for r in (1, 2) for k, v in (("a", 0.5), ("b", -1.0))], "region int, task string, word string, w double")
    u = spark.createDataFrame([(1, "t", 10, 2.0), (1, "t", 11, 3.0), (2, "t", 12, 1.0)], "region int, task string, user long, u double")
    key = ["region", "task", "day"]
    left = panel.contract_words(x, w).join(u, ["region", "task", "user"]).groupBy(key).agg(F.sum(F.col("v") * F.col("u")).alias("s"))
    right = panel.contract_users(x, u).join(w, ["region", "task", "word"]).groupBy(key).agg(F.sum(F.col("d") * F.col("w")).alias("s"))
    assert rows(left) == rows(right) == [(1, "t", 0, -1.0), (1, "t", 1, -6.0), (2, "t", 1, 0.5)]
    bias = spark.createDataFrame([(1, "t", 10.0), (2, "t", 20.0)], "region int, task string, b double")
    assert rows(panel.predict(x, w, u, bias, x.select("day"))) == [(1, "t", 0, 9.0), (1, "t", 1, 4.0), (2, "t", 0, 20.0), (2, "t", 1, 20.5)]


def test_expansion_and_split(spark, x):
    flat = x.drop("region")
    regions = spark.createDataFrame([(10, 1), (10, 1), (10, 2), (11, None), (None, 3)], "user long, region int")
    assert sorted(r.region for r in panel.region_expand(flat, regions).collect()) == [1, 1, 2, 2]
    genders = spark.createDataFrame([(10, " F"), (11, "male"), (11, None), (12, "??")], "user long, gender string")
    assert {(r.user, r.gender) for r in panel.gender_split(flat, genders).collect()} == {(10, "female"), (11, "male"), (12, "none")}


def test_baselines_and_errors(spark):
    y = spark.createDataFrame([(d, "t", 1, float(v)) for d, v in enumerate((1, 2, 6))], "day int, task string, region int, y double")
    last = panel.last_value(panel.mean_center(y)).withColumn("y_hat", F.col("y"))
    assert [r.y_last for r in last.orderBy("day").collect()] == [6.0, 1.0, 2.0]
    r = panel.errors(last, "task", estimate="y_last").first()
    assert (r.sse, r.n) == (42.0, 3) and r.rmse == pytest.approx(14**0.5) and r.sqrt_sse == pytest.approx(42**0.5)
    assert panel.rmse_table(last).count() == 3


def test_top_weights_all_negative(spark):
    w = spark.createDataFrame([(1, "t", c, v) for c, v in (("a", -1.0), ("b", -2.0), ("c", 0.0))], "region int, task string, word string, w double")
    got = [(r.sign, r.rank, r.word) for r in panel.top_weights(w, 1).orderBy("sign").collect()]
    assert got == [("negative", 1, "b"), ("positive", 1, "a")]
    assert rows(panel.selected_counts(w).where("region is not null")) == [(1, 2)]


def test_polls_long_drops_missing(spark):
    wide = spark.createDataFrame([(1, 0.5, None)], "day int, a double, b double")
    assert rows(panel.polls_long(wide, ["a", "b"], ["day"])) == [(1, "a", 0.5)]
