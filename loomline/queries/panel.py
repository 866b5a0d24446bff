"""Panels of days, regions, users and words, folds, predictions and their errors."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import bilinear, counts, learning, panel, polls
from loomline.plans.lineage import cut
from loomline.queries.common import ONCE, VOCABULARY_MIN, WORDS, messages
from loomline.sources.tables import read_table
from loomline.streaming import flows

START = "2013-01-07"
#: Folds that are fitted beside each other.
FOLDS_AT_ONCE = 3
TASKS = ("civic", "harbour", "meadow")


def _user_region(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "user_region").select(F.col("user_id").alias("user"), "region")


def _x(spark: SparkSession, d: str) -> DataFrame:
    """(day, user, word, x): how many of a user's messages of a day hold a word of the vocabulary."""
    rows = messages(spark, d, "user_id", "posted_at", "analysis").where("analysis.tokens.all is not null")
    words = counts.distinct_words(F.col("analysis.tokens.all"))
    vocab = counts.vocabulary_filter(counts.document_frequency(rows, words), VOCABULARY_MIN)
    day = F.datediff(F.to_date("posted_at"), F.lit(START).cast("date"))
    flat = rows.where("user_id is not null and posted_at is not null").select(day.alias("day"), F.col("user_id").alias("user"), F.explode(words).alias("word"))
    # Adding up before the vocabulary join leaves fewer rows for it.
    return panel.keep_words(flat.groupBy("day", "user", "word").agg(F.count(F.lit(1)).cast("double").alias("x")), vocab)


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    return panel.region_expand(_x(spark, d), _user_region(spark, d))


def _weights(spark: SparkSession, rows: DataFrame, item: str, name: str) -> DataFrame:
    """Weights by a rule: whole numbers, so that sums are exact."""
    pairs = rows.select("region", item).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(TASKS) - 1))))
    number = F.length(item) if item == "word" else F.col(item)
    return pairs.select("region", F.element_at(F.array(*map(F.lit, TASKS)), F.col("k") + 1).alias("task"), item, ((number + F.col("region") + F.col("k")) % 5 - 2).cast("double").alias(name))


def _y(spark: SparkSession, d: str) -> DataFrame:
    """(day, task, region, y): smoothed sentiment ratio of each party among the users of a region."""
    rows = messages(spark, d, "user_id", "posted_at", "analysis").select(F.col("user_id").alias("user"), F.datediff(F.to_date("posted_at"), F.lit(START).cast("date")).alias("day"), F.col("analysis.tokens.unprotected").alias("t"))
    located = rows.join(_user_region(spark, d).where("user is not null and region is not null").distinct(), "user")
    sets = polls.keyword_sets(read_table(spark, d, "keywords"))
    c = polls.party_counts(located, "day", "t", *sets, "region")
    return c.select("day", F.col("party").alias("task"), "region", ((F.col("pos") + 1) / (F.col("neg") + 1)).alias("y"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    y = panel.last_value(panel.mean_center(_y(spark, d)))
    return y.withColumn("y_hat", (F.col("y_mean") + F.col("y_last")) / 2)


def panel_x(spark: SparkSession, d: str) -> DataFrame:
    return _x(spark, d)


def region_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d)


def region_flat_sum(spark: SparkSession, d: str) -> DataFrame:
    return panel.region_flat_sum(_expanded(spark, d))


def gender_split(spark: SparkSession, d: str) -> DataFrame:
    genders = read_table(spark, d, "user_gender").select(F.col("user_id").alias("user"), "gender")
    return panel.gender_split(_x(spark, d), genders).groupBy("gender", "day", "word").agg(F.sum("x").alias("x"))


def voc_keep(spark: SparkSession, d: str) -> DataFrame:
    return panel.keep_words(_x(spark, d), read_table(spark, d, "keywords").select(F.trim("keyword").alias("word")))


def contract_v(spark: SparkSession, d: str) -> DataFrame:
    x = cut(_expanded(spark, d))
    return panel.contract_words(x, _weights(spark, x, "word", "w"))


def contract_d(spark: SparkSession, d: str) -> DataFrame:
    x = cut(_expanded(spark, d))
    return panel.contract_users(x, _weights(spark, x, "user", "u"))


def bilinear_predict(spark: SparkSession, d: str) -> DataFrame:
    x = cut(_expanded(spark, d))
    bias = x.select("region").distinct().withColumn("task", F.explode(F.array(*map(F.lit, TASKS)))).withColumn("b", F.col("region").cast("double") / 4)
    return panel.predict(x, _weights(spark, x, "word", "w"), _weights(spark, x, "user", "u"), bias, x.select("day"))


def poll_panel(spark: SparkSession, d: str) -> DataFrame:
    return _y(spark, d).withColumn("y", F.round("y", 6))


def polls_long(spark: SparkSession, d: str) -> DataFrame:
    wide = _y(spark, d).groupBy("day", "region").pivot("task", list(TASKS)).agg(F.first("y"))
    return panel.polls_long(wide, list(TASKS), ["day", "region"]).withColumn("y", F.round("y", 6))


def baseline_mean(spark: SparkSession, d: str) -> DataFrame:
    return panel.mean_center(_y(spark, d)).select("day", "task", "region", F.round("y_mean", 6).alias("y_mean"), F.round("y_centred", 6).alias("y_centred"))


def baseline_last(spark: SparkSession, d: str) -> DataFrame:
    return panel.last_value(_y(spark, d)).select("day", "task", "region", F.round("y_last", 6).alias("y_last"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def eval_linear(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.errors(_predictions(spark, d), "task"), 4)  # a sum of these data lies midway between two values of six digits


def eval_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Total errors of the rule-weighted bilinear prediction."""
    joined = bilinear_predict(spark, d).join(_y(spark, d), ["day", "task", "region"])
    return _rounded(panel.errors(joined), 4)


def rmse_table(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return _rounded(panel.rmse_table(_predictions(spark, d))).select(named("task"), named("region"), "model", "mean", "last")


def top_pos_neg_words(spark: SparkSession, d: str) -> DataFrame:
    x = _expanded(spark, d)
    return panel.top_weights(_weights(spark, x, "word", "w"), 20)


def normalised_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.normalised_weights(_weights(spark, _expanded(spark, d), "word", "w")))


def selected_counts(spark: SparkSession, d: str) -> DataFrame:
    return panel.selected_counts(_weights(spark, _expanded(spark, d), "word", "w")).withColumn("region", F.coalesce(F.col("region").cast("string"), F.lit("all")))


def sparsity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.sparsity(_weights(spark, _expanded(spark, d), "word", "w"), "task"))


def subsample(spark: SparkSession, d: str) -> DataFrame:
    return panel.subsample(_x(spark, d), 0.5, 0.5)


def folds_growing(spark: SparkSession, d: str) -> DataFrame:
    return panel.growing_folds(spark, 6)


def folds_windowed(spark: SparkSession, d: str) -> DataFrame:
    return panel.windowed_folds(spark, 6)


def folds_iterator(spark: SparkSession, d: str) -> DataFrame:
    return panel.iterator_folds(spark, 20, 0, 10, 2, 2)


def fold_val_split(spark: SparkSession, d: str) -> DataFrame:
    return panel.split_validation(panel.growing_folds(spark, 6))


def fold_apply(spark: SparkSession, d: str) -> DataFrame:
    """Means of the poll panel by fold and part."""
    data = panel.apply_folds(_y(spark, d), panel.iterator_folds(spark, 24, 0, 10, 4, 2))
    return _rounded(data.groupBy("fold", "part", "task").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")))


def _design(spark: SparkSession, d: str) -> DataFrame:
    """(part, day, item, x, y): per day the messages with each word of the vocabulary, against the mean sentiment."""
    x = _x(spark, d).groupBy("day", F.col("word").alias("item")).agg(F.sum("x").alias("x"))
    y = _y(spark, d).groupBy("day").agg(F.avg("y").alias("y"))
    return x.join(y, "day").withColumn("part", F.when(F.col("day") < 16, "train").otherwise("val_param"))


def lambda_search(spark: SparkSession, d: str) -> DataFrame:
    return bilinear.lambda_search(cut(_design(spark, d)), [x / 10 for x in range(1, 10)])


def lambda_best(spark: SparkSession, d: str) -> DataFrame:
    return bilinear.best_lambda(lambda_search(spark, d))


def prequential(spark: SparkSession, d: str) -> DataFrame:
    return bilinear.prequential(cut(_design(spark, d)), 0.5)


def _fit(spark: SparkSession, d: str, **options) -> bilinear.Bilinear:
    """Of every user with a region, the whole vocabulary and all days, for the default 10 epochs."""
    return bilinear.fit_regions(_expanded(spark, d), _y(spark, d), lam_w=0.5, lam_u=0.5, **options)


def bilinear_region_fit(spark: SparkSession, d: str) -> DataFrame:
    """The words' weights that aren't zero."""
    return _fit(spark, d).w


def bilinear_ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, ridge=0.1).w


def bilinear_multitask_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, multitask=True).w


def bilinear_users_first_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, users_first=True, center=False).u


def bilinear_flat_fit(spark: SparkSession, d: str) -> DataFrame:
    y = _y(spark, d).groupBy("day", "task").agg(F.avg("y").alias("y"))
    return bilinear.fit_flat(region_flat_sum(spark, d), y).w.select("task", "word", "w")


def bilinear_incremental_fit(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of days, learnt from one after the other: (task, b) of the model after the second."""
    y = cut(_y(spark, d).groupBy("day", "task").agg(F.avg("y").alias("y")))
    x = cut(region_flat_sum(spark, d))
    learner = flows.IncrementalLearner(spark, lambda rows: bilinear.fit_incremental(rows.where("word is not null").select("day", "user", "word", "x"), rows.where("task is not null").select("day", "task", "y")))
    both = x.unionByName(y, allowMissingColumns=True)
    for number, part in enumerate((both.where("day < 12"), both.where("day >= 12"))):
        learner(part, number)
    return learner.model.bias.select("task", F.round("b", 3).alias("b"))


def bilinear_open_users(spark: SparkSession, d: str) -> DataFrame:
    """(region, task, open): users whose weight isn't optimal given the words' weights after two epochs, judged over all
    users from the data: no user's sum against the residuals may be above the penalty, and where the weight isn't zero
    it has to be equal to it in size, to a hundredth."""
    x, y = cut(_expanded(spark, d)), cut(_y(spark, d))
    m = bilinear.fit_regions(x, y, lam_w=0.5, lam_u=0.5, epochs=2)
    estimate = panel.predict(x, m.w, m.u, m.bias, y.select("day"))
    residual = y.join(estimate, ["region", "task", "day"]).select("region", "task", "day", (F.col("y_hat") - F.col("y")).alias("r"))
    sums = panel.contract_words(x, m.w).join(residual, ["region", "task", "day"]).groupBy("region", "task", "user").agg(F.sum(F.col("v") * F.col("r")).alias("g"))
    judged = sums.join(m.u, ["region", "task", "user"], "full_outer").select("region", "task", F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("u", F.lit(0.0)).alias("u"))
    off = (F.abs("g") > 0.505) | ((F.col("u") != 0) & (F.abs(F.col("g") + F.signum("u") * 0.5) > 0.005))
    cells = y.select("region", "task").distinct()
    return cells.join(judged.where(off).groupBy("region", "task").count(), ["region", "task"], "left").select("region", "task", F.coalesce("count", F.lit(0)).cast("int").alias("open"))


def bilinear_dense_same(spark: SparkSession, d: str) -> DataFrame:
    """(kind, epochs, same) on a planted panel: whether the working sets reach the objective of the dense solver, within a
    ten-thousandth, on the words' problem of the first epoch."""
    import numpy as np

    x, y = learning.random_panel(regions=2, tasks=3, users=9, words=25, days=15, zeros=0.6)
    cells = [(r, f"t{t}") for r in range(2) for t in range(3)]
    days, words = range(15), range(25)
    d_ = x.groupby(["region", "day", "word"])["x"].sum()
    columns = np.array([[[d_.get((r, n, w), 0.0) for n in days] for r, _ in cells] for w in words])
    goal = np.array([y[(y.region == r) & (y.task == t)].sort_values("day")["y"] for r, t in cells])
    goal -= goal.mean(axis=1, keepdims=True)
    design = np.zeros((len(cells) * 15, 25 * len(cells)))
    for w in words:
        for c in range(len(cells)):
            design[c * 15 : c * 15 + 15, w * len(cells) + c] = columns[w, c]
    out = []
    for kind, prox in (("graph", learning.prox_graph((25, 2, 3))), ("multitask", learning.prox_multitask((25, 2, 3))), ("l1", learning.prox_l1)):
        flat = lambda w, t: prox(w.reshape(-1, 3), t).reshape(-1, 1)  # noqa: B023, E731
        dense, _ = learning.fista(design, goal.ravel(), flat, 0.5, rounds=20000, tolerance=1e-12)
        penalty = bilinear.Penalty(kind, (2, 3))
        value = lambda w: 0.5 * ((np.einsum("wc,wcd->cd", w, columns) - goal) ** 2).sum() + 0.5 * penalty.value(w)  # noqa: B023, E731
        fit = bilinear.fit_regions(spark.createDataFrame(x), spark.createDataFrame(y), lam_w=0.5, lam_u=0.5, epochs=1, multitask=kind == "multitask", simple=kind == "l1")
        got = np.zeros((25, len(cells)))
        for r in fit.w.collect():
            got[r.word, cells.index((r.region, r.task))] = r.w
        best = value(dense.reshape(25, -1))
        out.append((kind, bool(value(got) <= best * 1.0001 and fit.settled)))
    return spark.createDataFrame(out, "kind string, same boolean")


def bilinear_objective(spark: SparkSession, d: str) -> DataFrame:
    """(epoch, falls): whether the objective of the fit falls from epoch to epoch."""
    values = bilinear.fit_regions(_expanded(spark, d), _y(spark, d), lam_w=0.5, lam_u=0.5, epochs=4, tolerance=0.0).objective
    return spark.createDataFrame([(i, bool(i == 0 or v <= values[i - 1] * 1.001)) for i, v in enumerate(values)], "epoch int, falls boolean")


def panel_experiment(spark: SparkSession, d: str) -> DataFrame:
    """(fold, task, region, sse, ...): the region model fitted on each fold's training days, scored on its test days.
    Folds grow over all days of the panel."""
    x, y = cut(_expanded(spark, d)), cut(_y(spark, d))
    n_days = (y.agg(F.max("day")).first()[0] or 0) + 1
    folds = panel.iterator_folds(spark, n_days, 0, 14, 2, 5)
    packed = bilinear.pack_panel(x)  # once for all folds, whose training days are those of y
    days = lambda fold, part: folds.where((F.col("fold") == fold) & (F.col("part") == part)).select("day")

    def score(fold: int) -> DataFrame:
        model = bilinear.fit_regions(packed, y.join(days(fold, "train"), "day"), lam_w=0.5, lam_u=0.5)
        test = y.join(days(fold, "test"), "day")
        estimate = panel.predict(x.join(days(fold, "test"), "day"), model.w, model.u, model.bias, days(fold, "test"))
        return panel.errors(test.join(estimate, ["day", "task", "region"]), "task", "region").withColumn("fold", F.lit(fold))

    numbers = sorted(r.fold for r in folds.select("fold").distinct().collect())
    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:  # one fold's solver works while another's tasks run
        scored = list(pool.map(score, numbers))
    packed.release()
    return reduce(DataFrame.unionByName, scored) if scored else None


def queries() -> dict:
    return {f.__name__: f for f in (panel_x, region_expand, region_flat_sum, gender_split, voc_keep, contract_v, contract_d, bilinear_predict, poll_panel, polls_long, baseline_mean, baseline_last, eval_linear, eval_bilinear, rmse_table, top_pos_neg_words, normalised_weights, selected_counts, sparsity, subsample, folds_growing, folds_windowed, folds_iterator, fold_val_split, fold_apply, lambda_search, lambda_best, prequential, bilinear_region_fit, bilinear_ridge_fit, bilinear_multitask_fit, bilinear_users_first_fit, bilinear_flat_fit, bilinear_incremental_fit, bilinear_open_users, bilinear_dense_same, bilinear_objective, panel_experiment)}


_X = f"""with {ONCE}, e as (select ord, unnest({WORDS.format("all_tokens")}) as word from t where all_tokens is not null),
v as (select word from e group by word having count(*) > {VOCABULARY_MIN} and (word like '#%' or regexp_matches(word, '^\\p{{L}}'))),
x as (select cast(cast(posted_at as date) - date '{START}' as integer) as day, user_id as "user", word, count(*)::double as x from e join t using (ord)
  where user_id is not null and posted_at is not null and word in (select word from v) group by 1, 2, 3),
ur as (select distinct user_id as "user", region from user_region where user_id is not null and region is not null),
xr as (select day, "user", word, x, region from x join ur using ("user")),
tk(k, task) as (values (0, 'civic'), (1, 'harbour'), (2, 'meadow')),
w as (select region, task, word, ((length(word) + region + k) % 5 - 2)::double as w from (select distinct region, word from xr), tk),
u as (select region, task, "user", (("user" + region + k) % 5 - 2)::double as u from (select distinct region, "user" from xr), tk)"""
_Y = """, kw as (select distinct trim(party) as party, lower(trim(polarity)) as polarity, trim(keyword) as word from keywords where trim(keyword) <> ''),
me as (select ord, region, cast(cast(posted_at as date) - date '2013-01-07' as integer) as day, list_transform(unprotected, lambda w: lower(w)) as ws from t join ur on ur."user" = t.user_id where unprotected is not null and posted_at is not null),
ew as (select distinct ord, ws from me), ee as (select ord, unnest(ws) as word from ew),
sp as (select ord, count(*) filter (where polarity = 'positive') as p, count(*) filter (where polarity = 'negative') as n from ee join kw using (word) where polarity is not null group by ord),
hp as (select ord, party, count(*) as c from ee join kw using (word) where party is not null group by ord, party),
gy as (select distinct day, region, task from me, tk),
ny as (select day, region, party as task, sum(c * coalesce(p, 0)) as pos, sum(c * coalesce(n, 0)) as neg from me join hp using (ord) left join sp using (ord) group by 1, 2, 3),
y as (select day, task, region, (coalesce(pos, 0) + 1)::double / (coalesce(neg, 0) + 1)::double as y from gy left join ny using (day, region, task)),
ym as (select *, avg(y) over (partition by task, region) as y_mean, coalesce(lag(y) over (partition by task, region order by day), last_value(y) over (partition by task, region order by day rows between unbounded preceding and unbounded following)) as y_last from y),
yh as (select *, (y_mean + y_last) / 2 as y_hat from ym)"""
_PRED = """, dd as (select distinct day from xr), bb as (select region, task, region::double / 4 as b from (select distinct region from xr), tk),
sc as (select region, task, day, sum(x * w * u) as s from xr join w using (region, word) join u using (region, task, "user") group by 1, 2, 3),
pr as (select bb.region, bb.task, dd.day, coalesce(s, 0) + b as y_hat from bb, dd left join sc on sc.region = bb.region and sc.task = bb.task and sc.day = dd.day)"""
_ERR = "round(sum((y - y_hat) ** 2), 4) as sse, round(avg((y - y_hat) ** 2), 4) as mse, round(sqrt(avg((y - y_hat) ** 2)), 4) as rmse, round(sqrt(sum((y - y_hat) ** 2)), 4) as sqrt_sse, count(*) as n"
_GROW = """with f as (select cast(fold as integer) as fold, fold * 5 + 48 as total from range(6) r(fold)), g as (select fold, total, (total + 1) // 2 - 1 - 4 as s from f),
z as (select fold, total, s, unnest(range(0, total + 5)) as day from g),
fo as (select fold, case when day >= total then 'test' when day >= s and day < s + 8 then 'validation' else 'train' end as part, cast(day as integer) as day from z)"""
_ITER = """f as (select cast(fold as integer) as fold, fold * 2 + 10 as total from range({n}) r(fold)), z as (select fold, total, total // 2 - {h} as s, unnest(range(0, total + 2)) as day from f),
fo as (select fold, case when day >= total then 'test' when day >= s and day < s + {v} then 'validation' else 'train' end as part, cast(day as integer) as day from z)"""


def oracle_sql() -> dict[str, str]:
    ranked = lambda way: f"cast(row_number() over (partition by region, task order by w {way}, word) as integer) as rank"
    return {
        "panel_x": _X + ' select day, "user", word, x from x',
        "region_expand": _X + ' select day, "user", word, x, region from xr',
        "region_flat_sum": _X + ' select day, "user", word, sum(x) as x from xr group by 1, 2, 3',
        "gender_split": _X + """, ug as (select user_id as "user", min(case when lower(trim(gender)) in ('f', 'female', '0') then 'female' when lower(trim(gender)) in ('m', 'male', '1') then 'male' else 'none' end) as gender from user_gender where user_id is not null group by 1)
            select coalesce(gender, 'none') as gender, day, word, sum(x) as x from x left join ug using ("user") group by 1, 2, 3""",
        "voc_keep": _X + ' select day, "user", word, x from x where word in (select trim(keyword) from keywords)',
        "contract_v": _X + ' select region, task, day, "user", sum(x * w) as v from xr join w using (region, word) group by 1, 2, 3, 4',
        "contract_d": _X + ' select region, task, day, word, sum(x * u) as d from xr join u using (region, "user") group by 1, 2, 3, 4',
        "bilinear_predict": _X + _PRED + " select region, task, day, y_hat from pr",
        "poll_panel": _X + _Y + " select day, task, region, round(y, 6) as y from y",
        "polls_long": _X + _Y + " select day, region, task, round(y, 6) as y from y",
        "baseline_mean": _X + _Y + " select day, task, region, round(y_mean, 6) as y_mean, round(y - y_mean, 6) as y_centred from ym",
        "baseline_last": _X + _Y + " select day, task, region, round(y_last, 6) as y_last from ym",
        "eval_linear": _X + _Y + f" select task, {_ERR} from yh group by task",
        "eval_bilinear": _X + _Y + _PRED + f" select {_ERR} from pr join y using (day, task, region)",
        "rmse_table": _X + _Y + """, ce as (select task, region, sqrt(avg((y - y_hat) ** 2)) as model, sqrt(avg((y - y_mean) ** 2)) as mean, sqrt(avg((y - y_last) ** 2)) as last from yh group by task, region)
            select coalesce(task, 'all') as task, coalesce(cast(region as varchar), 'all') as region, round(avg(model), 6) as model, round(avg(mean), 6) as mean, round(avg(last), 6) as last from ce group by rollup(task, region)""",
        "top_pos_neg_words": _X + f", nz as (select * from w where w <> 0), rk as (select region, task, 'positive' as sign, {ranked('desc')}, word, w from nz union all select region, task, 'negative', {ranked('asc')}, word, w from nz) select * from rk where rank <= 20",
        "normalised_weights": _X + " select region, task, word, w, round(w / nullif(max(w) over (partition by region, task), 0), 6) as score from w",
        "selected_counts": _X + ", s as (select distinct region, word from w where w <> 0) select cast(region as varchar) as region, count(*) as selected from s group by region union all select 'all', count(distinct word) from s",
        "sparsity": _X + " select task, round(avg(case when w <= 0 then 1.0 else 0.0 end), 6) as not_positive, round(avg(case when w = 0 then 1.0 else 0.0 end), 6) as zero, round(avg(case when abs(w) < 1e-5 then 1.0 else 0.0 end), 6) as tiny, count(*) filter (where w > 0) as positive from w group by task",
        "folds_growing": _GROW + " select fold, part, day from fo",
        "folds_windowed": "select cast(fold as integer) as fold, case when day < fold * 5 + 48 then 'train' else 'test' end as part, cast(day as integer) as day from (select fold, unnest(range(fold * 5, fold * 5 + 53)) as day from range(6) r(fold))",
        "folds_iterator": "with " + _ITER.format(n=5, h=1, v=2) + " select fold, part, day from fo",
        "fold_val_split": _GROW + """, va as (select fold, day, row_number() over (partition by fold order by day) - 1 as r from fo where part = 'validation'),
            sp as (select fold, case when r >= 3 and r < 5 then 'val_it' else 'val_param' end as part, day from va)
            select * from fo where part in ('train', 'test') union all select * from sp union all select fold, 'train_all', day from fo where part = 'train' union all select fold, 'train_all', day from sp where part = 'val_param'""",
        "bilinear_open_users": _X + _Y + ' select distinct region, task, 0 as open from y',
        "bilinear_objective": "select cast(range as integer) as epoch, true as falls from range(4)",
        "bilinear_dense_same": "select kind, true as same from (values ('graph'), ('multitask'), ('l1')) v(kind)",
        "fold_apply": _X + _Y + ", " + _ITER.format(n=7, h=2, v=4) + " select fold, part, task, round(avg(y), 6) as y, count(*) as n from y join fo using (day) group by 1, 2, 3",
    }
