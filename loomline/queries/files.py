"""Round trips through the readers and writers, news pages, and fixtures with known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import stemmers, tokeniser
from loomline.functions import text as X
from loomline.operators import graph, learning, news, panel, topics
from loomline.plans.lineage import cut
from loomline.queries import news as news_queries
from loomline.queries import panel as panel_queries
from loomline.queries import text as text_queries
from loomline.queries import words as word_queries
from loomline.queries.common import ONCE
from loomline.sources import sinks, tables, text
from loomline.sources.tables import read_table
from loomline.streaming.flows import work_folder

NS = "http://example.org/facts#"


# ------------------------------------------------------------------ lines, lists, dictionaries
def json_lines_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    sinks.write_json_lines(read_table(spark, d, "tweets").where("text is not null").select("ord", "text").distinct(), folder)
    return spark.read.schema("ord long, text string").json(folder)


def listed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written by day and read back through a list of the days' folders: (day, lines)."""
    base = work_folder(spark)
    rows = read_table(spark, d, "tweets").where("raw is not null and seen_at is not null").select(F.to_date("seen_at").alias("day"), F.col("raw").alias("value"))
    rows.write.partitionBy("day").text(f"{base}/lines")
    rows.select(F.concat(F.lit("day="), F.col("day").cast("string")).alias("value")).distinct().write.text(f"{base}/list")
    got = text.read_listed(spark, f"{base}/list", f"{base}/lines")
    return got.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("lines"))


def terms_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    read_table(spark, d, "keywords").select(F.concat(F.lit(" "), F.coalesce("keyword", F.lit(""))).alias("value")).write.text(folder)
    return text.read_terms(spark, folder)


def dictionary_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    word_queries.vocab_index(spark, d).select(F.format_string("%d %s", "id", F.translate("word", "abc", "ABC")).alias("value")).write.text(folder)
    return text.read_dictionary(spark, folder, lower=True)


def counts_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    sinks.write_counts(word_queries.vocab_index(spark, d).select("word", "cnt"), folder)
    return text.scan_pattern(spark.read.text(folder), r"^(.*)\t(\d+)$", ["string", "long"]).toDF("word", "cnt")


def edges_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    sinks.write_edges(word_queries.npmi_edges(spark, d), folder)
    return text.scan_pattern(spark.read.text(folder), r"^(\d+) (\d+) (\S+)$", ["int", "int", "double"]).toDF("i", "j", "npmi")


def clusters_file(spark: SparkSession, d: str) -> DataFrame:
    """Clusters written and read, with labels read from lines, described: the five most important words of cluster 1."""
    folder = work_folder(spark)
    rows = spark.createDataFrame([("alpha", 1, 0.5), ("beta", 1, 0.3), ("gamma", 1, 0.2), ("delta", 2, 1.0)], "word string, cluster int, importance double")
    sinks.write_clusters(rows, f"{folder}/clusters")
    spark.createDataFrame([("3 first  topic\n2 other",)], "value string").coalesce(1).write.text(f"{folder}/labels")
    return topics.describe_cluster(text.read_clusters(spark, f"{folder}/clusters"), text.read_labels(spark, f"{folder}/labels"), 1, 2).select("word", "cluster", "importance", "rank", "coherence", "label")


def user_region_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    read_table(spark, d, "user_region").where("user_id is not null").select(F.concat_ws(" ", "user_id", F.coalesce(F.col("region").cast("string"), F.lit("-"))).alias("value")).write.text(folder)
    return text.read_user_regions(spark, folder)


def user_gender_file(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    clean = panel.clean_gender(F.col("gender"))
    rows = read_table(spark, d, "user_gender").where("user_id is not null").select(F.concat_ws(" ", "user_id", F.when(clean == "female", "0").when(clean == "male", "1").otherwise("none")).alias("value"))
    rows.write.text(folder)
    return text.read_user_genders(spark, folder)


# ------------------------------------------------------------------ tables
def by_party_files(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    sinks.write_by_party(text_queries.poll_sentiment_daily(spark, d).select("day", "party", "pos", "neg"), folder)
    return spark.read.schema("day string, pos long, neg long, party string").csv(folder, header=True).select("day", "party", "pos", "neg")


def news_files(spark: SparkSession, d: str) -> DataFrame:
    """The facts of the five news tables, put together again from ids and dictionaries."""
    folder = work_folder(spark)
    kept, frequencies, counts = news_queries._counts(spark, d)
    counts = cut(counts)
    terms, sources = cut(news.term_index(frequencies, news_queries.MIN_TERM)), cut(news.source_index(kept))
    days = counts.select(news.day_index(counts).alias("day_id"), F.col("day").cast("string").alias("day")).distinct()
    sinks.write_news(folder, news.index_encode(counts, terms, sources), news.article_counts(kept), terms.select("idx", "term"), sources, days)
    read = lambda name, schema: spark.read.schema(schema).csv(f"{folder}/{name}", sep="\t")
    facts = read("facts", "day_id int, uid int, idx int, cnt long").join(read("dates", "day_id int, day string"), "day_id")
    return facts.join(read("dictionary", "idx int, term string"), "idx").join(read("sources", "uid int, source string"), "uid").select("day", "source", "term", "cnt")


def triples_files(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as N-Triples by day, copied to another folder, read and pivoted back."""
    folder = work_folder(spark)
    sinks.write_triples(news.to_triples(news_queries._counts(spark, d)[2], NS), f"{folder}/triples")
    sinks.copy_through(spark, f"{folder}/triples", f"{folder}/copy")
    return news.facts_from_triples(text.read_triples(spark, f"{folder}/copy"), NS)[1].withColumn("day", F.col("day").cast("string"))


def panel_files(spark: SparkSession, d: str) -> DataFrame:
    """Days 3 to 9 of regions 1 and 2, with the keywords only, out of a panel written by region and day."""
    folder = work_folder(spark)
    sinks.write_panel(panel_queries.region_expand(spark, d), folder)
    words = read_table(spark, d, "keywords").select(F.trim("keyword").alias("word"))
    return tables.read_panel(spark, folder, (3, 10), [1, 2], words).select("region", "day", "user", "word", "x")


def gender_panel_files(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    sinks.write_panel(panel_queries.gender_split(spark, d), folder, "gender", "day")
    return tables.read_panel(spark, folder, (0, 12), genders=["female", "none"]).select("gender", "day", "word", "x")


def day_lists(spark: SparkSession, d: str) -> DataFrame:
    """(day, users, words): one row a day with its number of cells and words, days before the twelfth."""
    x = panel_queries.panel_x(spark, d).where("day < 12")
    return x.groupBy("day").agg(F.count_distinct("user").alias("users"), F.count_distinct("word").alias("words"))


def sparse_file(spark: SparkSession, d: str) -> DataFrame:
    """The panel through its flat form and back."""
    folder = work_folder(spark)
    sinks.write_sparse(panel_queries.panel_x(spark, d), folder, 1_000_003)
    day, user = sinks.unflat_row(F.col("row"), 1_000_003)
    return spark.read.parquet(folder).select(day.alias("day"), user.cast("int").alias("user"), F.col("col").alias("word"), "x")


def metrics_state(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of poll errors appended to one state, of which the second is read."""
    folder = work_folder(spark)
    errors = cut(panel_queries.eval_linear(spark, d).select("task", "n"))
    for run in ("one", "two"):
        sinks.append_metrics(errors.withColumn("run", F.lit(run)), folder)
    return tables.load_metrics(spark, folder, "two").select("run", "task", "n")


def report_table(spark: SparkSession, d: str) -> DataFrame:
    """Errors with one column a region."""
    return sinks.wide_errors(panel_queries.rmse_table(spark, d).where("task <> 'all' and region in ('1', '2')")).select("task", F.col("1").alias("r1"), F.col("2").alias("r2"))


def wordle_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.wordle(panel_queries.normalised_weights(spark, d))


# ------------------------------------------------------------------ polls and index lists
def _wide(spark: SparkSession, d: str) -> DataFrame:
    """day, and a column '<task>_region_<r>' for the first three regions."""
    y = panel_queries.poll_panel(spark, d).where("region <= 3").withColumn("name", F.concat_ws("_region_", "task", "region"))
    names = [f"{t}_region_{r}" for t in panel_queries.TASKS for r in (1, 2, 3)]
    return y.groupBy("day").pivot("name", names).agg(F.first("y"))


def polls_by_key(spark: SparkSession, d: str) -> DataFrame:
    return panel.polls_by_key(_wide(spark, d), "harbour", ["day"])


def task_values(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment of region 1 gathered by a list of positions that runs backwards, for days 2 to 7 and two tasks."""
    y = cut(panel_queries.poll_panel(spark, d).where("region = 1"))
    last = y.agg(F.max("day")).first()[0] or 0
    values = y.select((F.col("day") + 1).alias("pos"), "task", "y")
    index = y.select("day").distinct().withColumn("pos", F.lit(last + 1) - F.col("day"))
    return panel.task_values(values, index, (2, 8), ["civic", "meadow"])


def vocab_indirect(spark: SparkSession, d: str) -> DataFrame:
    """Every third word of the vocabulary through two lists of positions."""
    words = cut(word_queries.vocab_index(spark, d).select(F.col("id").alias("pos"), "word"))
    index = words.where("pos % 3 = 0").select((F.col("pos") / 3).cast("int").alias("pos"), F.col("pos").alias("ref"))
    return text.vocabulary_of(words, index, index.select("pos", F.col("pos").alias("ref")))


def panel_splits(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the panel with keywords only, by fold and part."""
    words = read_table(spark, d, "keywords").select(F.trim("keyword").alias("word"))
    return panel.splits(panel_queries.panel_x(spark, d), words, panel.iterator_folds(spark, 20, 0, 10, 2, 2)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


def last_of_cell(spark: SparkSession, d: str) -> DataFrame:
    """Facts written twice, the second time raised by one: what stays is the second."""
    facts = news_queries._counts(spark, d)[2]
    twice = facts.withColumn("ordinal", F.lit(0)).unionByName(facts.withColumn("cnt", F.col("cnt") + 1).withColumn("ordinal", F.lit(1)))
    return news.last_of_cell(twice).withColumn("day", F.col("day").cast("string"))


def series_by_region(spark: SparkSession, d: str) -> DataFrame:
    """The line of each region and task that a plot would draw: its values in the order of days."""
    y = panel_queries.poll_panel(spark, d)
    return y.groupBy("region", "task").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "y"))), lambda v: v["y"]).alias("line"))


def records_united(spark: SparkSession, d: str) -> DataFrame:
    """Messages of two halves put one below the other, by language label."""
    t = read_table(spark, d, "tweets").select("ord", "lang_det", "posted_at")
    both = t.where("posted_at < timestamp'2013-01-19'").unionByName(t.where("posted_at >= timestamp'2013-01-19'"))
    return both.groupBy("lang_det").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ news pages
def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(file, content): a page for each story, its terms as persons, mentions and tokens, its sources as links."""
    s = news.unique_stories(read_table(spark, d, "stories")).where("terms is not null and size(sources) > 0")
    clean = F.filter("terms", lambda t: t.isNotNull() & t.rlike("^[A-Za-z]+$"))
    element = lambda pattern: F.array_join(F.transform(clean, lambda t: F.format_string(pattern, t)), "")
    body = F.concat(
        F.lit("<html><script>var x = 1;</script><div class='newsbody'><p>text <script>hidden</script>"),
        element("<Person>Jo <script>no</script>%s</Person>"), element("<Mention inst='http://dbpedia.org/resource/%s' class='c' partyowl='Left, Right b'/>"),
        element("<Token string='%s' category='NN'/>"), F.lit("</p><p/><p>"),
        F.when(F.array_contains("sources", news.NO_SOURCE), "No<b>link</b>").otherwise(F.array_join(F.transform("sources", lambda x: F.concat(F.lit("<a href='http://www.s"), F.hex(F.abs(F.crc32(x))), F.lit(".example/x'>l</a>"))), "")),
        F.lit("</p></div></html>"),
    )
    return s.select(F.format_string("page%d_%s.html", "story", F.col("day").cast("string")).alias("file"), body.alias("content"))


def page_stories(spark: SparkSession, d: str) -> DataFrame:
    out = news.segment_stories(news.read_paragraphs(_pages(spark, d)))
    return out.select("file", F.col("day").cast("string").alias("day"), F.size("terms").alias("n_terms"), F.size("sources").alias("n_sources"))


def page_annotations(spark: SparkSession, d: str) -> DataFrame:
    """(term, uri, type, n) of the entities and mentions of all pages."""
    terms = news.read_paragraphs(_pages(spark, d)).select(F.explode("terms").alias("t")).select("t.term", "t.uri", "t.type")
    return terms.groupBy("term", "uri", "type").agg(F.count(F.lit(1)).alias("n"))


def page_pos_terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, n): the pages' tokens, lower-cased, with their category; those of three letters or less aren't kept."""
    kept = F.transform("tokens", lambda t: F.when(F.length(t["string"]) > 3, F.lower(t["string"])))
    terms = news.read_paragraphs(_pages(spark, d)).select(F.explode(news.pos_terms(F.col("tokens"), kept)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ fixtures
MESSAGES = {
    "see http://bla.com/x. ok": "see|http://bla.com/x|.|ok", "at 18:00h": "at|18:00h", "1,234 and 3.5": "1,234|and|3.5", "John's dog": "John|'s|dog", "hi :-)": "hi|:-)", "expense": "e|xp|ense",
    "#tag @user": "#tag|@user", "“quoted”": "“|quoted|”", "don’t stop": "don’t|stop", "it’s ‘here’": "it’s|‘|here|’", "U.S. today": "U.S.|today", "a -- b": "a|--|b", "wait... what?!": "wait|...|what|?!", "(yes)": "(|yes|)", "A &amp; B": "A|&amp;|B", "go to bla.com.": "go|to|bla.com|.",
}
STEMS = (
    "en generously generous|en running run|en flies fli|en relational relat|de aufeinanderfolgenden aufeinanderfolg|de häuser haus|sv jaktkarlarne jaktkarl|nl lichamelijkheden licham|no havnedistriktene havnedistrikt|da undersøgelser undersøg|"
    "fr majestueusement majestu|fr chevaux cheval|es rápidamente rapid|pt quilométricas quilométr|it pronunciamento pronunc|ru падение паден|fi edeltäneeseen edeltän|hu babakocsijáért babakocs|ro acceptabile accept"
)
LINKS = {"http://www.news.example/x": "news.example", "https://a.bbc.co.uk/a?b": "bbc.co.uk", "http://r.example/redir.asp?URL=http://www.paper.example/1": "paper.example", "http://192.168.0.1/x": None, "ftp://a.example": None, "http://x.y.com.br": "y.com.br", "http://co.uk/": "co.uk", "http://deep.a.b.example:80/": "b.example", "http://user@host.example/": "host.example"}


def tokenise_golden(spark: SparkSession, d: str) -> DataFrame:
    """(text, tokens, aligned): known token lists, and whether every token stands at its offset."""
    rows = spark.createDataFrame([(t,) for t in MESSAGES], "text string").select("text", tokeniser.analyse("text").alias("a"))
    aligned = F.forall("a.tokens", lambda t: F.substring(F.col("text"), t["pos"] + 1, F.length(t["token"])) == t["token"])
    return rows.select("text", F.array_join(F.transform("a.tokens", lambda t: t["token"]), "|").alias("tokens"), aligned.alias("aligned"))


def tokenise_aligned(spark: SparkSession, d: str) -> DataFrame:
    """(ord, aligned) of every message: whether its tokens stand at their offsets, in order, and nothing but blanks between."""
    from loomline.queries.common import messages

    rows = messages(spark, d, "text").where("text is not null").select("ord", "text", tokeniser.analyse("text").alias("a"))
    plain = F.trim(F.regexp_replace("text", tokeniser.BLANKS, " "))
    known = F.filter("a.tokens", lambda t: t["pos"].isNotNull())
    stands = F.forall(known, lambda t: F.substring(plain, t["pos"] + 1, F.length(t["token"])) == t["token"])
    letters = lambda c: F.regexp_replace(c, tokeniser.BLANKS, "")
    whole = letters(F.array_join(F.transform("a.tokens", lambda t: t["token"]), "")) == letters(F.col("text"))
    return rows.select("ord", (stands & whole).alias("aligned"))


def stem_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x.split()[0], [x.split()[1]]) for x in STEMS.split("|")], "language string, words array<string>")
    return rows.select("language", F.element_at("words", 1).alias("word"), F.element_at(stemmers.stem_tokens(F.col("words"), F.col("language")), 1).alias("stem"))


def domain_golden(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in LINKS], "link string").select("link", X.source_domain(F.col("link")).alias("domain"))


def _blocks(spark: SparkSession) -> DataFrame:
    edges = [(a, b, 1.0 + (a * b) % 3) for block in (range(0, 8), range(20, 30), range(40, 46)) for a in block for b in block if a < b] + [(7, 20, 0.01), (29, 40, 0.01)]
    return spark.createDataFrame(edges, "src long, dst long, weight double")


def spectral_planted(spark: SparkSession, d: str) -> DataFrame:
    """(least, nodes): the blocks found in a graph of three planted ones, each named by its least node."""
    return graph.spectral_clusters(_blocks(spark), 3).groupBy("cluster").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("nodes")).select("least", "nodes")


def eigengap(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(graph.eigengap(graph.leading_eigenvalues(_blocks(spark), 8)),)], "clusters int")


def tree_prox(spark: SparkSession, d: str) -> DataFrame:
    """(item, w): the tree regulariser's operator on three variables, {0} and {1, 2} below all of them, worked out by hand."""
    import numpy as np

    tree = learning.tree_from_table([(0, None, 0.8, []), (1, 0, 1.0, [0]), (2, 0, 0.5, [1, 2])])
    got = learning.prox_tree(tree)(np.array([3.0, 2.0, 1.0]), 1.0)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(got)], "item int, w double")


def spectral_cover(spark: SparkSession, d: str) -> DataFrame:
    """(node): what the spectral clusters of the word graph hold; every node of the largest component, once."""
    return graph.spectral_clusters(word_queries._mutual(spark, d)[0], 30).select("node")


def queries() -> dict:
    return {f.__name__: f for f in (json_lines_file, listed_lines, terms_file, dictionary_file, counts_file, edges_file, clusters_file, user_region_file, user_gender_file, by_party_files, news_files, triples_files, panel_files, gender_panel_files, day_lists, sparse_file, metrics_state, report_table, wordle_lines, polls_by_key, task_values, vocab_indirect, panel_splits, last_of_cell, series_by_region, records_united, page_stories, page_annotations, page_pos_terms, tokenise_golden, tokenise_aligned, stem_golden, domain_golden, spectral_planted, eigengap, tree_prox, spectral_cover)}


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    words, facts = word_queries.oracle_sql(), news_queries.oracle_sql()["day_source_facts"]
    panels = panel_queries.oracle_sql()
    x, xr, y = panels["panel_x"], panels["region_expand"], panels["poll_panel"]
    of = lambda sql, rest: f"select * from (with q as ({sql}) {rest})"
    pages = """with s as (select day, story, any_value(terms) as terms, any_value(sources) as sources from stories where day is not null and story is not null group by day, story),
        p as (select day, story, list_filter(terms, lambda t: regexp_matches(t, '^[A-Za-z]+$')) as terms, sources from s where terms is not null and len(sources) > 0)"""
    golden = [(t, v, True) for t, v in MESSAGES.items()]
    return {
        "json_lines_file": "select distinct ord, text from tweets where text is not null",
        "listed_lines": "select cast(cast(seen_at as date) as varchar) as day, count(*) as lines from tweets where raw is not null and seen_at is not null group by 1",
        "terms_file": "select distinct trim(keyword) as term from keywords where trim(keyword) <> ''",
        "dictionary_file": of(words["vocab_index"], "select id, word from q"),
        "counts_file": of(words["vocab_index"], "select word, cnt from q"),
        "edges_file": words["npmi_edges"],
        "clusters_file": "select * from (values ('alpha', 1, 0.5::double, 1, 3, 'first topic'), ('beta', 1, 0.3::double, 2, 3, 'first topic')) v(word, cluster, importance, rank, coherence, label)",
        "user_region_file": 'select cast(user_id as bigint) as "user", region from user_region where user_id is not null and region is not null',
        "user_gender_file": """select cast(user_id as bigint) as "user", case when lower(trim(gender)) in ('f', 'female', '0') then 'female' else 'male' end as gender from user_gender
            where user_id is not null and lower(trim(gender)) in ('f', 'female', '0', 'm', 'male', '1')""",
        "by_party_files": of(text_queries.oracle_sql()["poll_sentiment_daily"], "select day, party, pos, neg from q"),
        "news_files": facts,
        "triples_files": facts,
        "panel_files": of(xr, 'select region, day, "user", word, x from q where day >= 3 and day < 10 and region in (1, 2) and word in (select trim(keyword) from keywords)'),
        "gender_panel_files": of(panels["gender_split"], "select gender, day, word, x from q where day >= 0 and day < 12 and gender in ('female', 'none')"),
        "day_lists": of(x, 'select day, count(distinct "user") as users, count(distinct word) as words from q where day < 12 group by day'),
        "sparse_file": x,
        "metrics_state": of(panels["eval_linear"], "select 'two' as run, task, n from q"),
        "report_table": of(panels["rmse_table"], "select task, max(model) filter (where region = '1') as r1, max(model) filter (where region = '2') as r2 from q where task <> 'all' and region in ('1', '2') group by task"),
        "wordle_lines": of(panels["normalised_weights"], "select region, task, printf('%s: %.4f', word, score) as value from q where score > 0"),
        "polls_by_key": of(y, "select day, cast(region - 1 as integer) as group_id, 'harbour_region_' || region as name, y from q where region <= 3 and task = 'harbour'"),
        "task_values": of(y, "select cast((select max(day) from q where region = 1) - day as integer) as day, task, y from q where region = 1 and task in ('civic', 'meadow') and (select max(day) from q where region = 1) - day in (select day from q where region = 1) and (select max(day) from q where region = 1) - day between 2 and 7"),
        "vocab_indirect": of(words["vocab_index"], "select cast(id / 3 - 1 as integer) as id, word from q where id % 3 = 0"),
        "panel_splits": of(x, "select * from (with " + panel_queries._ITER.format(n=5, h=1, v=2) + " select fold, part, count(*) as n from q join fo using (day) where word in (select trim(keyword) from keywords) group by 1, 2)"),
        "last_of_cell": of(facts, "select day, source, term, cnt + 1 as cnt from q"),
        "series_by_region": of(y, "select region, task, list(y order by day) as line from q group by 1, 2"),
        "records_united": "select lang_det, count(*) as n from tweets where posted_at is not null group by 1",
        "page_stories": pages + " select 'page' || story || '_' || cast(day as varchar) || '.html' as file, cast(day as varchar) as day, cast(4 * len(terms) as integer) as n_terms, cast(case when list_contains(sources, 'No Source') then 1 else len(list_distinct(sources)) end as integer) as n_sources from p",
        "page_annotations": pages + """, e as (select unnest(terms) as t from p), a as (select 'annotated:Jo_' || t as term, 'http://dbpedia.org/resource/Jo_' || t as uri, 'http://dbpedia.org/ontology/Person' as type from e
            union all select 'annotated:' || t, 'http://dbpedia.org/resource/' || t, 'c' from e union all select 'annotated:Left', 'http://dbpedia.org/resource/Left', 'http://dbpedia.org/ontology/PoliticalParty' from e
            union all select 'annotated:Right_b', 'http://dbpedia.org/resource/Right_b', 'http://dbpedia.org/ontology/PoliticalParty' from e) select term, uri, type, count(*) as n from a group by 1, 2, 3""",
        "page_pos_terms": pages + ", e as (select unnest(terms) as t from p) select lower(t) || '/NN' as term, count(*) as n from e where length(t) > 3 group by 1",
        "tokenise_golden": f"select * from (values {_values(golden)}) v(text, tokens, aligned)",
        "tokenise_aligned": f"with {ONCE} select ord, true as aligned from t where text is not null",
        "stem_golden": f"select * from (values {_values([tuple(s.split()) for s in STEMS.split('|')])}) v(language, word, stem)",
        "domain_golden": f"select * from (values {_values(list(LINKS.items()))}) v(link, domain)",
        "spectral_planted": "select * from (values (0::bigint, 8::bigint), (20, 10), (40, 6)) v(least, nodes)",
        "eigengap": "select 3 as clusters",
        "tree_prox": "select * from (values (0, 1.35::double), (1, 1.35), (2, 1.0)) v(item, w)",
        "spectral_cover": words["giant_component"],
    }
