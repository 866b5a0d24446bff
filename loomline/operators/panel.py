"""Day x region x user x word panels: folds, expansion by region and gender, contractions, predictions, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLDS = "fold int, part string, day int"


def _fold_frame(spark: SparkSession, n: int, parts: list[tuple[str, Column]]) -> DataFrame:
    """(fold, part, day) for folds 0..n-1 from array columns over ``fold``."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("fold"))
    every = F.array(*[F.struct(F.lit(name).alias("part"), days.alias("days")) for name, days in parts])
    return rows.select("fold", F.explode(every).alias("x")).select("fold", "x.part", F.explode("x.days").alias("day")).select("fold", "part", F.col("day").cast("int").alias("day"))


def _days(first: Column, past: Column) -> Column:
    return F.when(past > first, F.sequence(first.cast("int"), (past - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def growing_folds(spark: SparkSession, n_folds: int, n_train: int = 48, n_val: int = 8, n_test: int = 5) -> DataFrame:
    """Training grows by a test step from fold to fold; the validation days lie in its middle, the test follows it."""
    fold = F.col("fold")
    total = fold * n_test + n_train
    # The middle is rounded half up, and the validation begins half its length (rounded down) before it, less one.
    start = F.greatest(F.floor((total + 1) / F.lit(2)) - 1 - n_val // 2, F.lit(0))
    train = F.concat(_days(F.lit(0), start), _days(start + n_val, total))
    return _fold_frame(spark, n_folds, [("train", train), ("validation", _days(start, start + n_val)), ("test", _days(total, total + n_test))])


def windowed_folds(spark: SparkSession, n_folds: int, train: int = 48, test: int = 5) -> DataFrame:
    """A training window that moves on by the test window."""
    first = F.col("fold") * test
    return _fold_frame(spark, n_folds, [("train", _days(first, first + train)), ("test", _days(first + train, first + train + test))])


def iterator_folds(spark: SparkSession, n_days: int, start: int = 0, n_train: int = 7, n_val: int = 3, n_test: int = 1) -> DataFrame:
    """Training from ``start`` on growing by ``n_test`` days, with the validation days in its middle."""
    n = max(0, ((n_days - start) - n_train) // n_test)
    length = F.col("fold") * n_test + n_train
    first = F.floor(length / F.lit(2)) - n_val // 2 + start
    end = length + start
    train = F.concat(_days(F.lit(start), first), _days(first + n_val, end))
    return _fold_frame(spark, n, [("train", train), ("validation", _days(first, first + n_val)), ("test", _days(end, end + n_test))])


def split_validation(folds: DataFrame, share: float = 2 / 3) -> DataFrame:
    """The validation days of each fold parted: the middle 1 - share to 'val_it', the others to 'val_param'; with
    'train_all' for the training days and those of 'val_param'."""
    v = folds.where("part = 'validation'")
    w = Window.partitionBy("fold")
    v = v.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("day")) - 1)
    k = F.floor(F.col("n") * F.lit(1.0 - share) + F.lit(1e-9)).cast("int")
    first = F.floor(F.col("n") / F.lit(2)).cast("int") - F.floor(k / F.lit(2)).cast("int")
    parted = v.select("fold", F.when((F.col("r") >= first) & (F.col("r") < first + k), "val_it").otherwise("val_param").alias("part"), "day")
    everything = folds.where("part = 'train'").unionByName(parted.where("part = 'val_param'")).select("fold", F.lit("train_all").alias("part"), "day")
    return folds.where("part in ('train', 'test')").unionByName(parted).unionByName(everything)


def apply_folds(data: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of ``data`` once per fold and part their day is in. Folds are few rows; the planner broadcasts them if so."""
    return data.join(folds, "day")


def region_expand(x: DataFrame, user_region: DataFrame) -> DataFrame:
    """(region, *x): each row once per region of its user; users without a region drop out. Repeated and null
    assignments fold away."""
    return x.join(user_region.select("user", "region").where("user is not null and region is not null").distinct(), "user")


def clean_gender(gender: Column) -> Column:
    """female, male or none, however it is written."""
    g = F.lower(F.trim(gender))
    return F.when(g.isin("f", "female", "0"), "female").when(g.isin("m", "male", "1"), "male").otherwise("none")


def gender_split(x: DataFrame, user_gender: DataFrame) -> DataFrame:
    """(*x, gender): unknown users count as none; of several entries of a user the first in the order female, male, none."""
    one = user_gender.where("user is not null").groupBy("user").agg(F.min(clean_gender(F.col("gender"))).alias("gender"))
    return x.join(one, "user", "left").withColumn("gender", F.coalesce("gender", F.lit("none")))


def keep_words(x: DataFrame, words: DataFrame) -> DataFrame:
    return x.join(words.select("word").distinct(), "word", "left_semi")


def region_flat_sum(x: DataFrame) -> DataFrame:
    return x.groupBy("day", "user", "word").agg(F.sum("x").alias("x"))


def polls_long(wide: DataFrame, task_columns: list[str], keys: list[str]) -> DataFrame:
    """(*keys, task, y) from one column per task; missing values give no row."""
    return wide.unpivot(keys, task_columns, "task", "y").where("y is not null")


def polls_by_key(wide: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """(*keys, group_id, name, y) of the columns whose name holds ``part``; groups are numbered from 0 in the order of
    their names, missing values give no row."""
    names = sorted(c for c in wide.columns if part in c and c not in keys)
    if not names:
        return wide.select(*keys, F.lit(0).alias("group_id"), F.lit("").alias("name"), F.lit(0.0).alias("y")).where("false")
    long = wide.unpivot(keys, names, "name", "y").where("y is not null")
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("name"))
    return long.select(*keys, number.alias("group_id"), "name", "y")


def task_values(values: DataFrame, index: DataFrame, days: tuple[int, int] | None = None, tasks: list[str] | None = None) -> DataFrame:
    """(day, task, y): values (pos, task, y) gathered by an index (day, pos), positions from 1; of the days from the first up
    to but without the second, and of the given tasks. Positions without values drop out."""
    if days is not None:
        index = index.where((F.col("day") >= days[0]) & (F.col("day") < days[1]))
    if tasks is not None:
        values = values.where(F.col("task").isin(tasks))
    return index.join(values, "pos").select("day", "task", "y")


def splits(x: DataFrame, words: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, part, *x): the panel with only the given words, once for each fold and part its day is in."""
    return apply_folds(keep_words(x, words), folds)


def subsample(x: DataFrame, fraction_words: float, fraction_users: float, seed: int = 0) -> DataFrame:
    """Rows of the words and users that a hash draws: the same on every run."""
    share = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    return x.where((share("word") < fraction_words) & (share("user") < fraction_users))


def contract_words(x: DataFrame, w: DataFrame) -> DataFrame:
    """V (region, task, day, user, v): sum over words of x times the word's weight."""
    return x.join(w, ["region", "word"]).groupBy("region", "task", "day", "user").agg(F.sum(F.col("x") * F.col("w")).alias("v"))


def contract_users(x: DataFrame, u: DataFrame) -> DataFrame:
    """D (region, task, day, word, d): sum over users of x times the user's weight."""
    return x.join(u, ["region", "user"]).groupBy("region", "task", "day", "word").agg(F.sum(F.col("x") * F.col("u")).alias("d"))


def predict(x: DataFrame, w: DataFrame, u: DataFrame, bias: DataFrame, days: DataFrame) -> DataFrame:
    """(region, task, day, y_hat): sum over users and words of x u w, plus the bias, for every given day."""
    v = contract_words(x, w).join(u, ["region", "task", "user"])
    score = v.groupBy("region", "task", "day").agg(F.sum(F.col("v") * F.col("u")).alias("s"))
    dates = sorted(r.day for r in days.select("day").distinct().collect())  # a panel's days are few by nature
    grid = bias.select("*", F.explode(F.array(*map(F.lit, dates)).cast("array<int>")).alias("day"))
    return grid.join(score, ["region", "task", "day"], "left").select("region", "task", "day", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("y_hat"))


def mean_center(y: DataFrame) -> DataFrame:
    """(*y, y_mean, y_centred): means over the days of each (task, region)."""
    mean = F.avg("y").over(Window.partitionBy("task", "region"))
    return y.withColumn("y_mean", mean).withColumn("y_centred", F.col("y") - mean)


def last_value(y: DataFrame) -> DataFrame:
    """(*y, y_last): the value of the day before; the first day gets the last day's."""
    w = Window.partitionBy("task", "region").orderBy("day")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return y.withColumn("y_last", F.coalesce(F.lag("y").over(w), F.last("y").over(full)))


def errors(predictions: DataFrame, *by: str, estimate: str = "y_hat") -> DataFrame:
    """(*by, sse, mse, rmse, sqrt_sse, n) over the rows with both values."""
    d = F.col("y") - F.col(estimate)
    rows = predictions.where(F.col("y").isNotNull() & F.col(estimate).isNotNull())
    agg = rows.groupBy(*by).agg(F.sum(d * d).alias("sse"), F.count(F.lit(1)).alias("n"))
    return agg.select(*by, "sse", (F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), F.sqrt("sse").alias("sqrt_sse"), "n")


def rmse_table(predictions: DataFrame) -> DataFrame:
    """(task, region, model, mean, last): root mean squared errors of the model, the fold's mean and the last value;
    null region: mean over regions; null task too: mean of all cells."""
    sq = lambda c: F.sqrt(F.avg(F.pow(F.col("y") - F.col(c), F.lit(2.0))))
    cells = predictions.where("y is not null").groupBy("task", "region").agg(sq("y_hat").alias("model"), sq("y_mean").alias("mean"), sq("y_last").alias("last"))
    return cells.rollup("task", "region").agg(*[F.avg(c).alias(c) for c in ("model", "mean", "last")])


def top_weights(w: DataFrame, n: int = 20, item: str = "word") -> DataFrame:
    """(region, task, sign, rank, item, w): the n largest and the n smallest non-zero weights; ties by item."""
    rows = w.where(F.col("w") != 0)
    key = Window.partitionBy("region", "task")
    up = rows.withColumn("rank", F.row_number().over(key.orderBy(F.desc("w"), item))).withColumn("sign", F.lit("positive"))
    down = rows.withColumn("rank", F.row_number().over(key.orderBy(F.asc("w"), item))).withColumn("sign", F.lit("negative"))
    return up.unionByName(down).where(F.col("rank") <= n).select("region", "task", "sign", "rank", item, "w")


def normalised_weights(w: DataFrame) -> DataFrame:
    top = F.max("w").over(Window.partitionBy("region", "task"))
    return w.withColumn("score", F.when(top != 0, F.col("w") / F.nullif(top, F.lit(0.0))))


def selected_counts(w: DataFrame, item: str = "word") -> DataFrame:
    """(region, selected): items with a non-zero weight; null region: over all regions."""
    rows = w.where(F.col("w") != 0).select("region", item).distinct()
    every = rows.agg(F.count_distinct(item).alias("selected")).select(F.lit(None).cast("int").alias("region"), "selected")
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("selected")).unionByName(every)


def sparsity(w: DataFrame, *by: str, column: str = "w") -> DataFrame:
    """(*by, not_positive, zero, tiny, positive): shares of weights <= 0, = 0, < 1e-5 in size, and their number > 0."""
    c = F.col(column)
    share = lambda cond, name: F.avg(F.when(cond, 1.0).otherwise(0.0)).alias(name)
    return w.groupBy(*by).agg(share(c <= 0, "not_positive"), share(c == 0, "zero"), share(F.abs(c) < 1e-5, "tiny"), F.sum((c > 0).cast("long")).alias("positive"))
