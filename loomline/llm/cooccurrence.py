"""Problem 4: how often two items occur in the same record and how far that is above chance.

Method: stripes. Every record adds, for each of its items, its more frequent items to that item's associative array of
neighbours; a task adds arrays up locally, arrays are merged by item, and the merged counts get a log-likelihood
ratio. Items are numbered from rare to frequent and the rarer of a pair owns it, so no array is long: an item that
occurs n times meets at most n x (record length) neighbours, and no more than (all occurrences) / n items are as
frequent. Items that can't be part of a wanted pair are left out first by bounds that are exact: a pair occurs at most
as often as its rarer item, so n_ab >= m needs n_a, n_b >= m, and lift >= l needs n_a, n_b <= N/l.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task writes its stripes out when it has gathered this many pairs.
FLUSH_PAIRS = 4_000_000
#: Stripes and pairs that go to the JVM at once.
BATCH_STRIPES, BATCH_PAIRS = 20_000, 200_000
STRIPES = "item int, neighbours array<int>, counts array<long>"
PAIRS = "a int, b int, n_ab long"
#: The list of items is broadcast while its terms have no more than so many bytes; else only the items that more than
#: one in so many records hold, of which there are at most that number times the mean size of a record.
BROADCAST_BYTES = 32 << 20
HEAVY_SHARE = 1000


def _keys(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """All (smaller, larger) item pairs of records lying one after the other, as smaller << 32 | larger, in blocks of
    bounded size; a very long record comes in several."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    for n in np.unique(sizes[sizes > 1]):
        rows, pairs = starts[sizes == n], int(n) * (int(n) - 1) // 2
        if pairs > FLUSH_PAIRS:
            for s in rows:
                items, at = np.sort(values[s : s + n].astype(np.int64)), 0
                while at < n - 1:
                    end = min(n - 1, at + max(1, FLUSH_PAIRS // (n - at)))
                    yield np.repeat(items[at:end] << 32, n - 1 - np.arange(at, end)) | np.concatenate([items[i + 1 :] for i in range(at, end)])
                    at = end
            continue
        i, j = np.triu_indices(n, 1)
        for at in range(0, len(rows), max(1, FLUSH_PAIRS // pairs)):
            block = np.sort(values[rows[at : at + max(1, FLUSH_PAIRS // pairs)][:, None] + np.arange(n)].astype(np.int64), axis=1)
            yield ((block[:, i] << 32) | block[:, j]).ravel()


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _stripes(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct ordered keys and their counts as one array of neighbours an item."""
    item = key >> 32
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    ends = np.r_[starts[1:], len(key)]
    neighbour = (key & 0xFFFFFFFF).astype(np.int32)
    for at in range(0, len(starts), BATCH_STRIPES):
        s, e = starts[at : at + BATCH_STRIPES], ends[at : at + BATCH_STRIPES]
        offsets = pa.array(np.r_[s, e[-1]] - s[0], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[s[0] : e[-1]])) for x in (neighbour, n)]
        yield pa.RecordBatch.from_arrays([pa.array(item[s].astype(np.int32)), *lists], names=["item", "neighbours", "counts"])


def _local_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the records of a task: one column of lists of item numbers."""
    keys, counts, size = [], [], 0
    for batch in batches:
        column = batch.column(0)
        for block in _keys(np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))):
            key, n = np.unique(block, return_counts=True)
            keys.append(key)
            counts.append(n.astype(np.int64))
            size += len(key)
            if size >= FLUSH_PAIRS:
                yield from _stripes(*_add_up(keys, counts))
                keys, counts, size = [], [], 0
    if size:
        yield from _stripes(*_add_up(keys, counts))


def _merge(min_count: int):
    """Merges the stripes of a partition sorted by item into pairs, holding one item's array beyond a batch."""

    def pairs(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = _add_up(keys, counts)
        key, n = key[n >= min_count], n[n >= min_count]
        for at in range(0, len(key), BATCH_PAIRS):
            k = key[at : at + BATCH_PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n[at : at + BATCH_PAIRS])], names=["a", "b", "n_ab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(1)
            item = np.repeat(np.asarray(batch.column(0)).astype(np.int64), np.diff(np.asarray(lists.offsets)))
            key, n = (item << 32) | np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column(2).flatten())
            last = item == item[-1] if len(item) else np.zeros(0, bool)
            if not len(item):
                continue
            if last.all() and (not keys or keys[0][0] >> 32 == item[-1]):  # still the same item: added up as it grows
                key, n = _add_up([*keys, key], [*counts, n])
                keys, counts = [key], [n]
                continue
            yield from pairs([*keys, key[~last]], [*counts, n[~last]])
            keys, counts = [key[last]], [n[last]]
        if keys:
            yield from pairs(keys, counts)

    return run


def log_likelihood(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio (G squared) of the two-by-two table."""
    term = lambda k, row, col: F.when(k > 0, k * F.ln(k * n / (row * col))).otherwise(F.lit(0.0))
    cells = ((n_ab, n_a, n_b), (n_a - n_ab, n_a, n - n_b), (n_b - n_ab, n - n_a, n_b), (n - n_a - n_b + n_ab, n - n_a, n - n_b))
    return F.lit(2.0) * sum((term(k.cast("double"), r.cast("double"), c.cast("double")) for k, r, c in cells[1:]), term(*(x.cast("double") for x in cells[0])))


def _attach(rows: DataFrame, names: DataFrame, key: str, small: bool, heavy: Column) -> DataFrame:
    """``rows`` joined with ``names`` by ``key``: names are broadcast if they are few (``small``), else only the heavy
    ones, so that no key that many rows hold is shuffled."""
    if small:
        return rows.join(F.broadcast(names), key)
    often = names.where(heavy)
    return rows.join(F.broadcast(often), key).unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(names.where(~heavy), key))


def associated_pairs(df: DataFrame, id_col: str, items_col: str, min_count: int = 6, min_lift: float = 25.0, min_llr: float = 10.83, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(term_a, term_b, n_a, n_b, n_ab, lift, llr) for every pair of distinct items, term_a < term_b by bytes, that
    shares ``min_count`` records or more, ``min_lift`` times chance or more, at the given significance.

    Each id counts once, items within a record once. Null lists count no record, null items no item; an empty
    table gives no rows. Only the two named columns are read.
    """
    from loomline.plans.lineage import cut, dense_ids, once_per_key

    rows = once_per_key(df.select(F.col(id_col).alias("id"), F.col(items_col).alias("items")).where(F.col(items_col).isNotNull()), "id")
    records = cut(rows.select("id", F.array_distinct(F.filter(F.transform("items", F.lower), lambda x: x.isNotNull())).alias("items")))
    exploded = records.select("id", F.explode("items").alias("term"))
    total = records.count()
    counts = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    most = total / min_lift if min_lift > 0 else float("inf")
    wanted = counts.where((F.col("n") >= min_count) & (F.col("n") <= F.lit(most)))
    kept = cut(dense_ids(wanted, "n", "term", name="item").select("term", "n", "item"))
    small = (kept.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0) <= broadcast_bytes
    heavy = F.col("n") > total / HEAVY_SHARE
    if not small and min_lift >= 1:  # terms too common for any pair go before they are shuffled: at most min_lift x (mean size) of them
        exploded = exploded.join(F.broadcast(counts.where(F.col("n") > F.lit(most)).select("term")), "term", "left_anti")
    keyed = _attach(exploded, kept, "term", small, heavy).groupBy("id").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1).select("items")
    partial = keyed.mapInArrow(_local_stripes, STRIPES)
    merged = partial.repartition("item").sortWithinPartitions("item").mapInArrow(_merge(min_count), PAIRS)
    name = lambda side: kept.select(F.col("item").alias(side), F.col("term").alias(f"t_{side}"), F.col("n").alias(f"c_{side}"))
    named = _attach(_attach(merged, name("a"), "a", small, F.col("c_a") > total / HEAVY_SHARE), name("b"), "b", small, F.col("c_b") > total / HEAVY_SHARE)
    first = F.col("t_a") < F.col("t_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    n = F.lit(total)
    out = named.select(pick("t_a", "t_b").alias("term_a"), pick("t_b", "t_a").alias("term_b"), pick("c_a", "c_b").alias("n_a"), pick("c_b", "c_a").alias("n_b"), "n_ab")
    exact = F.col("n_ab").cast("double") * n >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")
    out = out.where(exact).withColumn("lift", F.col("n_ab") * n.cast("double") / (F.col("n_a") * F.col("n_b").cast("double")))
    # Exactly at chance the ratio is 0, and rounding may leave it just below.
    return out.withColumn("llr", F.greatest(log_likelihood(F.col("n_ab"), F.col("n_a"), F.col("n_b"), n), F.lit(0.0))).where(F.col("llr") >= min_llr)


def pairs(df: DataFrame) -> DataFrame:
    """Every pair of terms that share a tweet, whatever its count or lift, with both and the ratio."""
    return associated_pairs(df, "ord", "tokens", min_count=1, min_lift=0.0, min_llr=0.0)


def english(df: DataFrame) -> DataFrame:
    return df.where("lang_det = 'en' and tokens is not null")


def found(df: DataFrame) -> DataFrame:
    """(term_a, term_b) over the tweets labelled exactly 'en': six common tweets or more, 25 times chance or more.

    The significance bound of ``associated_pairs`` can't drop such a pair: its ratio is above 27.
    """
    return associated_pairs(english(df), "ord", "tokens").select("term_a", "term_b")
