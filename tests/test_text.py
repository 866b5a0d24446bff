import pytest
from pyspark.sql import functions as F

from loomline.functions import stemmers, tokeniser
from loomline.functions import text as X
from loomline.operators import records


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("RT @u: hello there", "hello there"),
        ("so true RT @u: hello", "hello"),
        ("what he said RT @u", "what he said"),
        ("RT hm @u look", " look"),
        ("good read (via @u)", "good read"),
        ("good read, via @u now", "good read"),
        (" via @u: text [mine]", "text"),
        ("no quote at all", ""),
        ("ART @u", "A"),
        ("", ""),
    ],
)
def test_quoted(spark, text, quoted):
    assert one(spark, X.quoted(F.col("t")), t=text) == quoted


def test_quoted_null(spark):
    assert spark.sql("select cast(null as string) t").select(X.quoted(F.col("t"))).first()[0] is None


@pytest.mark.parametrize(
    ("tokens", "key"),
    [
        (["A", "b"], "a b"),
        (["A", "b", "c", "d", "e", "F", "g"], "A b c d e F"),
        (["A", "b", "c", "YouTube", "e", "F", "g"], "A b c YouTube e"),
        ([], ""),
    ],
)
def test_dedup_key(spark, tokens, key):
    assert one(spark, X.dedup_key(F.col("t")), t=tokens) == key


def test_normalise_and_terms(spark):
    tokens = ["The", "``", "Budget", "2013", "don’t", "…", "x", "rose"]
    assert one(spark, X.unigrams(F.col("t")), t=tokens) == ["budget", "<num>", "rose"]
    assert one(spark, X.bigrams(F.col("t")), t=tokens)[:3] == ['the__"', '"__budget', "budget__<num>"]
    assert one(spark, X.bigrams(F.col("t")), t=["a"]) == []
    assert one(spark, X.simple_tokens(F.col("t")), t="  A  b\t C ") == ["a", "b", "c"]
    assert one(spark, X.simple_tokens(F.col("t")), t="   ") == []


@pytest.mark.parametrize(
    ("link", "domain"),
    [
        ("http://www.news.example/x", "news.example"),
        ("https://bbc.co.uk/a?b", "bbc.co.uk"),
        ("http://r.example/redir.asp?URL=http://www.paper.example/1", "paper.example"),
        ("http://192.168.0.1/x", None),
        ("ftp://a.example", None),
        ("", None),
    ],
)
def test_source_domain(spark, link, domain):
    assert one(spark, X.source_domain(F.col("t")), t=link) == domain


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("see http://bla.com/x. ok", ["see", "http://bla.com/x", ".", "ok"]),
        ("at 18:00h", ["at", "18:00h"]),
        ("1,234 and 3.5", ["1,234", "and", "3.5"]),
        ("John's dog", ["John", "'s", "dog"]),
        ("hi :-)", ["hi", ":-)"]),
        ("expense", ["e", "xp", "ense"]),
        ("#tag @user", ["#tag", "@user"]),
        ("“quoted”", ["“", "quoted", "”"]),
        ("", []),
        ("   ", []),
    ],
)
def test_tokenise(text, tokens):
    assert [t for t, _ in tokeniser.tokenise(text)] == tokens


def test_offsets_point_at_tokens():
    text = 'He said "it\'s  John\'s" at 18:00, see www.x.com/a... :-) U.S. 1,234'
    plain = tokeniser.squeeze(text)
    for token, at in tokeniser.tokenise(text):
        assert plain[at : at + len(token)] == token


def test_tokens_of_nulls_and_long_texts(spark):
    frame = spark.createDataFrame([(None,), ("",), ("word " * 20000,)], "text string").select(tokeniser.analyse("text").alias("a"))
    a = [r.a for r in frame.collect()]
    assert a[0]["tokens"] is None and a[1]["tokens"] == [] and len(a[2]["tokens"]) == 20000


@pytest.mark.parametrize(
    ("language", "word", "stem"),
    [x.split() for x in (
        "en generously generous|en running run|en flies fli|en relational relat|de aufeinanderfolgenden aufeinanderfolg|de häuser haus|sv jaktkarlarne jaktkarl|nl lichamelijkheden licham|no havnedistriktene havnedistrikt|da undersøgelser undersøg|"
        "fr majestueusement majestu|fr chevaux cheval|es rápidamente rapid|pt quilométricas quilométr|it pronunciamento pronunc|ru падение паден|fi edeltäneeseen edeltän|hu babakocsijáért babakocs|ro acceptabile accept|xx Words Words"
    ).split("|")],
)
def test_stem(language, word, stem):
    assert stemmers.stem(word, language) == stem


@pytest.mark.parametrize("language", sorted(stemmers.STEMMERS))
def test_stem_odd_words(language):
    for word in ("", "a", "'", "y", "ß", "123", "é", "qu", "aa", "s", "ия", "x" * 5000):
        assert isinstance(stemmers.stem(word, language), str)


def test_stem_tokens(spark):
    frame = spark.createDataFrame([(["cats", None, "dogs"], "en"), (["cats"], "xx"), (["cats"], None), (None, "en")], "t array<string>, l string")
    assert [r[0] for r in frame.select(stemmers.stem_tokens(F.col("t"), F.col("l"))).collect()] == [["cat", "dog"], [], [], []]


def test_parse_lines(spark):
    lines = spark.createDataFrame([('{"id": 1, "text": "a\tb", "extra": 5}',), ('{"id": 2, "te',), (None,), ("",), ('{"id": 3, "analysis": {"tokens": {"all": ["x"]}}}',)], "raw string")
    got = {r.id: r for r in records.parse_lines(lines).collect()}
    assert set(got) == {1, 3} and got[1].text == "a\tb" and got[3].analysis.tokens.all == ["x"]


def test_dedup_keeps_first(spark):
    rows = [(3, "x", None, (["A", "b"],)), (1, "y", None, (["a", "B"],)), (2, "RT @u: z", None, (["q"],)), (4, None, None, (["q"],)), (5, "w", ("old",), (["q"],))]
    frame = spark.createDataFrame([(o, t, q, (a,)) for o, t, q, a in rows], "ord long, text string, retweeted_status struct<text:string>, analysis struct<tokens:struct<unprotected:array<string>>>")
    assert [tuple(r) for r in records.dedup_messages(frame).collect()] == [("a b", 1)]
