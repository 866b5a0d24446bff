import pandas as pd
from pyspark.sql import functions as F

from loomline.sources import sinks, tables, text
from loomline.streaming import flows


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "a_2013-01-02.json").write_text('{"id": 1}\n')
    (tmp_path / "list").write_text("a_2013-01-02.json\n\n")
    got = text.read_listed(spark, str(tmp_path / "list"), str(tmp_path)).first()
    assert str(got.day) == "2013-01-02" and got.raw == '{"id": 1}'
    (tmp_path / "d").write_text("1 Alpha\n2 beta gamma\nx\n")
    assert rows(text.read_dictionary(spark, str(tmp_path / "d"), lower=True)) == [(1, "alpha"), (2, "beta gamma")]
    (tmp_path / "t").write_text(" a \n\nb\na\n")
    assert rows(text.read_terms(spark, str(tmp_path / "t"))) == [("a",), ("b",)]
    (tmp_path / "l").write_text("3 big  topic\n1 other\n")
    assert rows(text.read_labels(spark, str(tmp_path / "l"))) == [(1, 3, "big topic"), (2, 1, "other")]
    (tmp_path / "g").write_text("7 0\n8 1\n9 5\n")
    assert rows(text.read_user_genders(spark, str(tmp_path / "g"))) == [(7, "female"), (8, "male")]
    (tmp_path / "p_2013-02-03.html").write_text("<html><div class='newsbody'><p>x</p></div></html>")
    assert text.read_pages(spark, str(tmp_path / "p_2013-02-03.html")).count() == 1
    (tmp_path / "r").write_text("5 1\nbad\n")
    assert rows(text.read_user_regions(spark, str(tmp_path / "r"))) == [(5, 1)]
    (tmp_path / "n.nt").write_text("<a> <b> <c> .\n")
    assert rows(text.read_triples(spark, str(tmp_path / "n.nt"))) == [("a", "b", "c", None)]


def test_writers(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5)], "i int, j int, npmi double")
    sinks.write_edges(edges, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()[0] == "1 2 0.5000000000"
    clusters = spark.createDataFrame([("w", 3, 0.123456)], "word string, cluster int, importance double")
    sinks.write_clusters(clusters, str(tmp_path / "c"))
    assert rows(text.read_clusters(spark, str(tmp_path / "c"))) == [("w", 3, 0.12346)]
    sinks.write_counts(spark.createDataFrame([("a", 2)], "k string, n long"), str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).first()[0] == "a\t2"
    sinks.write_json_lines(edges, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().npmi == 0.5
    daily = spark.createDataFrame([("2013-01-02", "p", 1), ("2013-01-01", "p", 2)], "day string, party string, pos int")
    sinks.write_by_party(daily, str(tmp_path / "party"))
    assert (tmp_path / "party" / "party=p").exists()
    x = spark.createDataFrame([(1, 0, 5, "w", 1.0), (2, 1, 5, "w", 2.0)], "region int, day int, user long, word string, x double")
    sinks.write_panel(x, str(tmp_path / "x"))
    back = tables.read_panel(spark, str(tmp_path / "x"), (1, 2), [1, 2])
    assert back.first().x == 2.0 and "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().toString()
    assert tables.read_panel(spark, str(tmp_path / "x"), words=spark.createDataFrame([("v",)], "word string")).count() == 0
    assert tables.next_index(spark.createDataFrame([(4,)], "idx int")) == 5
    for _ in range(2):
        sinks.append_metrics(spark.createDataFrame([("r", 1, 0.5)], "run string, fold int, value double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    table = spark.createDataFrame([("t", 1, 0.5), ("t", 2, 0.7)], "task string, region int, model double")
    assert sinks.wide_errors(table).columns == ["task", "1", "2"]


def test_incremental_learner_refits_and_survives_replay(spark, tmp_path):
    learner = flows.IncrementalLearner(spark, lambda df: df.agg(F.sum("v")).first()[0], str(tmp_path / "inc"))
    one, two = (spark.createDataFrame([(v,)], "v long") for v in (1, 10))
    learner(one, 0)
    learner(two, 1)
    learner(two, 1)
    assert learner.model == 11


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    for i in range(3):
        pd.DataFrame({"ts": pd.to_datetime(["2024-01-01", "2024-01-02"]).as_unit("us"), "k": ["a", "b"]}).to_parquet(tmp_path / f"{i}.parquet")
    stream = flows.table_stream(spark, str(tmp_path), files_per_trigger=1)
    out = flows.run_available(flows.windowed_counts(stream, "ts", "k", delay="30 days"), "update")
    assert rows(out.groupBy("k").agg(F.max_by("n", "_batch"))) == [("a", 3), ("b", 3)]
