"""Registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm import cooccurrence, frequency, langcrf, lookalike, mixing, neardup, packing, subjects, tokens
from loomline.plans.lineage import cut
from loomline.sources.tables import read_table


def _tweets(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, "tweets"))


def _with(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(read_table(spark, sf_dir, t) for t in tables))


def _pairs(tweets: DataFrame) -> DataFrame:
    return cooccurrence.pairs(tweets).withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 2))


def _stable(tweets: DataFrame) -> DataFrame:
    """(ord, n, again): the number of tokens of each tweet after normalising, and how many of them a second run would change."""
    once = cut(lookalike.normalise_tokens(tweets.select("ord", "tokens")))
    again = lookalike.found(once).groupBy("ord").count()
    return once.join(again, "ord", "left").select("ord", F.size("tokens").alias("n"), F.coalesce("count", F.lit(0)).cast("int").alias("again"))


def _sound_passages(tweets: DataFrame) -> DataFrame:
    """(ord, sound): whether a tweet's passages follow one another within its words, neighbours of different languages,
    confidences are shares, and there is a language exactly where there is a passage."""
    ps = F.col("passages")
    inside = F.forall(ps, lambda p: (p["first"] < p["past"]) & (p["past"] <= F.col("n_words")) & p["confidence"].between(0, 1.000001) & (p["words"] <= p["past"] - p["first"]))
    apart = F.forall(F.zip_with(F.slice(ps, F.lit(1), F.greatest(F.size(ps) - 1, F.lit(0))), F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), lambda a, b: (a["past"] <= b["first"]) & (a["lang"] != b["lang"])), lambda x: x)
    return langcrf.languages(tweets).select("ord", (inside & apart & (F.col("lang").isNotNull() == (F.size(ps) > 0)) & F.coalesce("confidence", F.lit(1.0)).between(0, 1.000001)).alias("sound"))


def _sound_packing(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(kind, capacity, documents, overfull, lost, cut): texts with an id that were assigned, containers above their
    capacity, texts whose pieces don't add up to their tokens, texts cut although they would fit."""
    packed = cut(packing.pack(documents, containers))
    sized = tokens.with_token_counts(documents.where("doc_id is not null").select("doc_id", "text"), "text").select("doc_id", F.col("tokens").alias("all"))
    over = packed.where("container is not null").groupBy("kind", "capacity", "container").agg(F.sum("tokens").alias("load")).groupBy("kind", "capacity").agg(F.sum((F.col("load") > F.col("capacity")).cast("long")).alias("overfull"))
    by = packed.where("doc_id is not null").groupBy("kind", "capacity", "doc_id").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("pieces")).join(sized, "doc_id")
    texts = by.groupBy("kind", "capacity").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("held") != F.col("all")).cast("long")).alias("lost"), F.sum(((F.col("pieces") > 1) & (F.col("all") <= F.col("capacity"))).cast("long")).alias("cut"))
    return texts.join(over, ["kind", "capacity"]).select("kind", "capacity", "documents", "overfull", "lost", "cut")


def _met_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, met): for each source with a share and records, whether its part of what such sources have came within a
    twentieth of the wanted part, a hundredth of the whole, or one record of the source's mean size: records are used whole."""
    got = mixing.shares(documents, targets).where("target_share > 0 and labelled_tokens > 0")
    whole = Window.partitionBy()  # one row a source
    part = lambda c: F.col(c) / F.sum(c).over(whole)
    return got.select("source", (F.abs(part("reached_share") - part("target_share")) <= F.greatest(F.lit(0.01), part("target_share") / 20, F.col("tokens") / F.col("records") / F.sum("tokens").over(whole))).alias("met"))


def _sound_subjects(documents: DataFrame, labels: DataFrame, subjects_: DataFrame) -> DataFrame:
    """(check, bad): rows of the subjects' table that can't be: more sentences about subjects than a text has, shares and
    confidences that are none, subjects that aren't given."""
    found = cut(subjects.subject_shares(documents, subjects.fit(documents, labels, subjects_)))
    names = subjects_.select(F.lower(F.trim("subject")).alias("subject"))
    checks = {
        "more than all": found.groupBy("doc_id").agg(F.sum("about").alias("a"), F.max("sentences").alias("n")).where("a > n"),
        "no share": found.where("not (share > 0 and share <= 1 and confidence > 0 and confidence <= 1.000001)"),
        "not given": found.join(names, "subject", "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _tweets(lookalike.found),
        "p1_tokens": _tweets(lookalike.normalise_tokens),
        "p1_stable": _tweets(_stable),
        "p2_found": _tweets(frequency.found),
        "p2_terms": _tweets(lambda t: frequency.marked_terms(t, ["tokens", "stemming"])),
        "p3_found": _tweets(neardup.found),
        "p3_groups": _tweets(neardup.groups),
        "p4_found": _tweets(cooccurrence.found),
        "p4_pairs": _tweets(_pairs),
        "p5_found": _tweets(langcrf.found),
        "p5_languages": _tweets(langcrf.languages),
        "p5_sound": _tweets(_sound_passages),
        "p6_pack": _with(packing.pack, "documents", "containers"),
        "p6_filling": _with(lambda d, c: packing.filling(packing.pack(d, c)), "documents", "containers"),
        "p6_sound": _with(_sound_packing, "documents", "containers"),
        "p7_selection": _with(mixing.selection, "documents", "mix_targets"),
        "p7_shares": _with(mixing.shares, "documents", "mix_targets"),
        "p7_met": _with(_met_shares, "documents", "mix_targets"),
        "p8_found": _with(subjects.found, "documents", "doc_labels", "subjects"),
        "p8_composition": _with(subjects.composition, "documents", "doc_labels", "subjects"),
        "p8_sound": _with(_sound_subjects, "documents", "doc_labels", "subjects"),
    }


_ONCE = "t as (select ord, any_value(tokens) as tokens, any_value(stemming) as stemming, any_value(tok_lang) as tok_lang, any_value(posted_at) as posted_at, any_value(lang_det) as lang_det from tweets where ord is not null group by ord)"
_TERMS = f"""with {_ONCE},
e as (select 'tokens' as field, ord, unnest(list_transform(tokens, lambda x: lower(x))) as term from t
      union all select 'stemming', ord, unnest(list_transform(stemming, lambda x: lower(x))) from t),
n as (select count(*) as n from t where tokens is not null),
c as (select field, term, count(*) as occurrences, count(distinct ord) as records from e where term is not null group by field, term),
m as (select field, term, occurrences, records, case when records < 3 then 'rare' when records * 20 > n then 'common' end as mark from c, n)
"""
_PAIRS = """,
n as (select count(*) as n from w), e as (select ord, unnest(items) as term from w),
f as (select term, count(*) as c from e group by term having count(*) >= 6), g as (select ord, term, c from e join f using (term) where c * 25 <= (select n from n)),
p as (select a.term as term_a, b.term as term_b, any_value(a.c) as n_a, any_value(b.c) as n_b, count(*) as n_ab from g a join g b on a.ord = b.ord and a.term < b.term group by a.term, b.term having count(*) >= 6)
"""


def oracle_sql() -> dict[str, str]:
    words = "list_distinct(list_filter(string_split(tok_lang, ' '), lambda x: x <> ''))"
    return {
        "p2_found": _TERMS + "select field, term, mark from m where mark is not null",
        "p2_terms": _TERMS + "select field, term, occurrences, records, mark from m",
        "p3_found": f"""with {_ONCE}, d as (select ord, posted_at, {words} as w from t where posted_at is not null and len({words}) >= 8),
            e as (select ord, posted_at, unnest(w) as word, len(w) as n from d),
            p as (select a.ord as ord_a, b.ord as ord_b, count(*) as k, any_value(a.n) + any_value(b.n) as sizes from e a join e b on a.word = b.word and a.ord < b.ord
                  and b.posted_at - a.posted_at between interval (-72) hour and interval 72 hour and 10 * a.n >= 7 * b.n and 10 * b.n >= 7 * a.n group by a.ord, b.ord)
            select ord_a, ord_b from p where 10 * k >= 7 * (sizes - k)""",
        "p4_found": f"""with {_ONCE}, w as (select ord, list_distinct(list_transform(tokens, lambda x: lower(x))) as items from t where lang_det = 'en' and tokens is not null)
            {_PAIRS} select term_a, term_b from p, n where n_ab * n >= 25 * n_a * n_b""",
        "p1_stable": f"with {_ONCE} select ord, len(tokens) as n, cast(0 as integer) as again from t",
        "p3_groups": f"""with recursive {_ONCE}, d as (select ord, list_sort({words}) as w, epoch_us(posted_at) as u, epoch_us(posted_at) // 259200000000 as slot from t where posted_at is not null and len({words}) >= 8),
            c as (select w, slot, min(ord) as cell, min(u) as lo, max(u) as hi, len(w) as n from d group by w, slot), e as (select cell, slot, lo, hi, n, unnest(w) as word from c),
            p as (select a.cell as x, b.cell as y, count(*) as k, any_value(a.n) + any_value(b.n) as sizes from e a join e b on a.word = b.word and a.cell < b.cell
                  and a.lo - b.hi <= 259200000000 and b.lo - a.hi <= 259200000000 and 10 * a.n >= 7 * b.n and 10 * b.n >= 7 * a.n group by a.cell, b.cell),
            l as (select x, y from p where 10 * k >= 7 * (sizes - k)), s as (select x, y from l union all select y, x from l),
            r(node, root) as (select distinct x, x from s union select s.y, r.root from r join s on s.x = r.node), g as (select node, min(root) as root from r group by node), m as (select x, count(*) as links from s group by x)
            select d.ord, c.cell, coalesce(g.root, c.cell) as "group", coalesce(m.links, 0) as links from d join c on c.w = d.w and c.slot = d.slot left join g on g.node = c.cell left join m on m.x = c.cell""",
        "p4_pairs": f"""with {_ONCE}, w as (select ord, list_distinct(list_filter(list_transform(tokens, lambda x: lower(x)), lambda x: x is not null)) as items from t where tokens is not null), n as (select count(*)::double as n from w),
            e as (select ord, unnest(items) as term from w), f as (select term, count(*) as c from e group by term), g as (select ord, term, c from e join f using (term)),
            p as (select a.term as term_a, b.term as term_b, any_value(a.c) as n_a, any_value(b.c) as n_b, count(*) as n_ab from g a join g b on a.ord = b.ord and a.term < b.term group by a.term, b.term),
            q as (select *, n_a - n_ab as k2, n_b - n_ab as k3, n - n_a - n_b + n_ab as k4 from p, n)
            select term_a, term_b, n_a, n_b, n_ab, round(n_ab * n / (n_a * n_b::double), 6) as lift, round(greatest(2 * (n_ab * ln(n_ab * n / (n_a::double * n_b)) + case when k2 > 0 then k2 * ln(k2 * n / (n_a * (n - n_b))) else 0 end
              + case when k3 > 0 then k3 * ln(k3 * n / ((n - n_a) * n_b)) else 0 end + case when k4 > 0 then k4 * ln(k4 * n / ((n - n_a) * (n - n_b))) else 0 end), 0), 2) as llr from q""",
        "p5_sound": f"with {_ONCE} select ord, true as sound from t",
        "p6_sound": "select kind, capacity, (select count(distinct doc_id) from documents) as documents, 0::bigint as overfull, 0::bigint as lost, 0::bigint as cut from (select distinct kind, capacity from containers where kind is not null and capacity > 0)",
        "p7_met": """with k as (select distinct lower(trim(regexp_replace(source, '[\\s_ ]+', ' ', 'g'))) as key from documents where doc_id is not null and trim(text) <> '')
            select trim(source) as source, true as met from mix_targets where target_share > 0 and max_repeats > 0 and lower(trim(regexp_replace(source, '[\\s_ ]+', ' ', 'g'))) in (select key from k)""",
        "p8_sound": "select \"check\", 0::bigint as bad from (values ('more than all'), ('no share'), ('not given')) v(\"check\")",
    }
