"""What the registered queries share: each message once, and the SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.plans.lineage import once_per_key
from loomline.sources.tables import read_table

#: Words have to occur in more than so many messages to enter the vocabulary of the word graph.
VOCABULARY_MIN = 20
NPMI_MIN = 0.1
NEIGHBOURS = 10

ONCE = (
    "t as (select ord, any_value(text) as text, any_value(retweeted_status.text) as rt_text, any_value(tokens) as tokens, any_value(tok_lang) as tok_lang, "
    "any_value(lang_det) as lang_det, any_value(analysis.tokens.unprotected) as unprotected, any_value(analysis.tokens.\"all\") as all_tokens, any_value(user_id) as user_id, "
    "any_value(posted_at) as posted_at from tweets where ord is not null group by ord)"
)
#: Distinct lower-cased words without enclosing quotes, like operators.counts.distinct_words.
WORDS = "list_filter(list_distinct(list_transform({0}, lambda w: regexp_replace(lower(w), '^\"+|\"+$', '', 'g'))), lambda w: w <> '')"


def messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given columns of each message once; ``ord`` always comes along."""
    return once_per_key(read_table(spark, sf_dir, "tweets").select("ord", *[c for c in columns if c != "ord"]), "ord")
