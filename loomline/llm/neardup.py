"""Problem 3: records that share most of their words, and the groups they form.

Method: Bayesian candidate pruning. Equal word sets of one time cell are one class. Classes that share a word of
their prefixes (the rarest words, as many as the threshold leaves no way around) are candidates, so no pair above the
threshold is missed. Inside that join one-bit MinHash values are compared 64 at a time; a pair is dropped as soon
as the posterior probability that its similarity reaches the threshold falls below the tolerance. The rest is
verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph import components

#: Bits of a sketch; compared in chunks of 64.
BITS = 256
CHUNK = 64
#: Buckets of the word-count sketch that orders words from rare to frequent: at most 1 MB whatever the input.
ORDER_BUCKETS = 1 << 18
SEED = 20130107
BLOCK_WORDS = 400_000
KEYS = "key long, cell long, slot long, at int, n int, lo long, hi long, h0 long, h1 long, h2 long, h3 long"


def word_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string."""
    return pd.util.hash_array(words.astype(object), categorize=False)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def sketches(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One-bit MinHash sketches, (records, 4) of 64 bits: bit i is the lowest bit of the i-th minimum of the set.
    codes: each set's words as indices into hashes, sets one after the other from starts."""
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (hashes >> np.uint64(32)).astype(np.uint32)
    seeds = np.random.default_rng(SEED).integers(0, 1 << 32, BITS, dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(starts), BITS // 64), np.uint64)
    for i in range(BITS):
        least = np.minimum.reduceat(_mix(low ^ seeds[i])[codes], starts)
        out[:, i // 64] |= (least & np.uint32(1)).astype(np.uint64) << np.uint64(i % 64)
    return out


def pruning_bounds(threshold: float, tolerance: float, chunk: int = CHUNK, bits: int = BITS) -> list[int]:
    """For 64, 128, ... compared bits, the most differing bits with which a pair is kept.

    Bits agree with probability (1 + s) / 2 at similarity s. With s uniform beforehand, the posterior of the
    agreement rate is a Beta distribution cut to [1/2, 1]; a pair is kept while P(s >= threshold) >= tolerance.
    """
    grid = np.linspace(0.5, 1.0, 4001)[1:-1]
    bounds = []
    for n in range(chunk, bits + 1, chunk):
        worst = -1
        for differ in range(n + 1):
            log = (n - differ) * np.log(grid) + differ * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= (1 + threshold) / 2].sum() / weight.sum() < tolerance:
                break
            worst = differ
        bounds.append(worst)
    return bounds


def _prefix_rows(ranks: bytes, threshold: Fraction):
    """The function that gives a cell's key rows: one for each word of its prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank_of = np.frombuffer(ranks, np.int32)
        for whole in frames:
            # Blocks of about so many words bound the memory, however long the records are.
            block = (whole["n"].to_numpy(np.int64).cumsum() - 1) // BLOCK_WORDS
            for _, frame in whole.groupby(block):
                sizes = frame["n"].to_numpy(np.int64)
                flat = np.concatenate([np.asarray(w, dtype=object) for w in frame["words"]])
                codes, names = pd.factorize(flat)
                hashes = word_hashes(np.asarray(names, dtype=object))
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                bits = sketches(codes, starts, hashes).view(np.int64)
                row = np.repeat(np.arange(len(frame)), sizes)
                h = hashes[codes]
                # Any order of all words gives the same pairs; rare words first gives the fewest candidates.
                order = np.lexsort((h, rank_of[h % np.uint64(len(rank_of))], row))
                at_pos = np.arange(len(order)) - np.repeat(starts, sizes)
                need = -((-sizes * threshold.numerator) // threshold.denominator)  # ceil of threshold x size
                keep = at_pos < np.repeat(sizes - need + 1, sizes)
                r = row[order][keep]
                yield pd.DataFrame({
                    "key": h[order][keep].view(np.int64), "cell": frame["cell"].to_numpy(np.int64)[r], "slot": frame["slot"].to_numpy(np.int64)[r], "at": at_pos[keep].astype(np.int32), "n": sizes[r].astype(np.int32),
                    "lo": frame["lo"].to_numpy(np.int64)[r], "hi": frame["hi"].to_numpy(np.int64)[r], **{f"h{k}": bits[r, k] for k in range(4)},
                })

    return run


def _word_order(cells: DataFrame) -> bytes:
    """Approximate record counts by hash bucket; bounded, gathered as at most ORDER_BUCKETS small rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(ORDER_BUCKETS, np.int64)
        for frame in frames:
            codes, names = pd.factorize(np.concatenate([np.asarray(w, dtype=object) for w in frame["words"]]))
            np.add.at(held, (word_hashes(np.asarray(names, dtype=object)) % np.uint64(ORDER_BUCKETS)).astype(np.int64), np.bincount(codes, minlength=len(names)))
        seen = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": seen.astype(np.int32), "c": held[seen]})

    got = cells.select("words").mapInPandas(count, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(ORDER_BUCKETS, np.int64)
    counts[got["bucket"].to_numpy()] = got["c"].to_numpy()
    ranks = np.zeros(ORDER_BUCKETS, np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(ORDER_BUCKETS)
    return ranks.tobytes()


def word_cells(df: DataFrame, id_col: str, words: Column, time_col: str, hours: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, cells): members (id, t, cell) once per id; cells (cell, slot, n, lo, hi, words) one per distinct
    word set and time slot of ``hours``; ``cell`` is the least id in it."""
    from loomline.plans.lineage import cut, spread_small

    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    df = spread_small(df.select(id_col, time_col, words.alias("_words")))
    rows = df.select(F.col(id_col).alias("id"), t.alias("t"), F.array_sort(F.array_distinct(F.filter("_words", lambda w: w.isNotNull() & (w != "")))).alias("words"))
    rows = rows.where(F.col("id").isNotNull() & F.col("t").isNotNull() & (F.size("words") >= min_words))
    rows = rows.select("id", "t", F.floor(F.col("t") / F.lit(hours * 3_600_000_000)).cast("long").alias("slot"), "words", F.unhex(F.md5(F.array_join("words", " "))).alias("sig"))
    cells = rows.groupBy("sig", "slot").agg(F.min("id").alias("cell"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.first("words").alias("words"))
    cells = cut(cells.select("sig", "slot", "cell", F.size("words").alias("n"), "lo", "hi", "words"))
    members = rows.select("id", "t", "sig", "slot").join(cells.select("sig", "slot", "cell"), ["sig", "slot"]).select("id", "t", "cell").distinct()
    return members, cells


def similar_cells(cells: DataFrame, hours: int, threshold: Fraction, tolerance: float = 1e-6) -> DataFrame:
    """(a, b): pairs of different cells, a < b, alike enough and possibly near enough in time."""
    from loomline.plans.lineage import cut

    # Four sides of the joins below read the sketches, which are costly: they are made once.
    keys = cut(cells.select("cell", "slot", "n", "lo", "hi", "words").mapInPandas(_prefix_rows(_word_order(cells), threshold), KEYS))
    span = hours * 3_600_000_000
    num, den = threshold.numerator, threshold.denominator
    side = lambda s: keys.select(*[F.col(c).alias(f"{s}_{c}") for c in keys.columns])
    a, b = side("a"), side("b")
    least = F.ceil(F.lit(num) * (F.col("a_n") + F.col("b_n")) / F.lit(num + den))  # words that have to be shared
    fits = (F.col("a_n") * den >= F.col("b_n") * num) & (F.col("b_n") * den >= F.col("a_n") * num) & (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= least)
    near = (F.col("a_lo") - F.col("b_hi") <= span) & (F.col("b_lo") - F.col("a_hi") <= span)
    alive, differ = F.lit(True), F.lit(0)
    for k, most in enumerate(pruning_bounds(float(threshold), tolerance)):
        differ = differ + F.bit_count(F.col(f"a_h{k}").bitwiseXOR(F.col(f"b_h{k}")))
        alive = alive & (differ <= most)
    same = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_slot") == F.col("b_slot")) & (F.col("a_cell") < F.col("b_cell")) & fits & near & alive)
    next_ = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_slot") + 1 == F.col("b_slot")) & fits & near & alive)
    ordered = lambda x: x.select(F.least("a_cell", "b_cell").alias("a"), F.greatest("a_cell", "b_cell").alias("b"))
    pairs = ordered(same).unionByName(ordered(next_)).distinct()
    words = lambda s: cells.select(F.col("cell").alias(s), F.col("words").alias(f"w{s}"))
    both = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - both
    return pairs.join(words("a"), "a").join(words("b"), "b").where(both * den >= either * num).select("a", "b")


def near_pairs(df: DataFrame, id_col: str, words: Column, time_col: str, hours: int = 72, min_words: int = 8, threshold: Fraction = Fraction(7, 10)) -> DataFrame:
    """(a, b), a < b: every pair of ids at most ``hours`` apart, each with at least ``min_words`` distinct words,
    whose word sets have a Jaccard similarity of ``threshold`` or more.

    Each id counts once. Rows with a null id, time or words take part in no pair; blanks other than U+0020 belong
    to words. Ties can't arise: the comparison is exact, in whole numbers. An empty table gives no rows.
    """
    members, cells = word_cells(df, id_col, words, time_col, hours, min_words)
    return _expand(members, similar_cells(cells, hours, threshold), hours)


def _expand(members: DataFrame, links: DataFrame, hours: int) -> DataFrame:
    span = hours * 3_600_000_000
    m = lambda s: members.select(F.col("id").alias(f"id_{s}"), F.col("t").alias(f"t_{s}"), F.col("cell").alias(s))
    near = F.abs(F.col("t_a") - F.col("t_b")) <= span
    across = links.join(m("a"), "a").join(m("b"), "b").where(near)
    within = m("a").join(m("b"), (F.col("a") == F.col("b")) & (F.col("id_a") < F.col("id_b"))).where(near)
    pick = lambda x: x.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return pick(across).unionByName(pick(within))


def near_groups(df: DataFrame, id_col: str, words: Column, time_col: str, hours: int = 72, min_words: int = 8, threshold: Fraction = Fraction(7, 10)) -> DataFrame:
    """(id, cell, group, links): for each id with enough words its class of equal texts, the group of classes it is
    linked to over any chain of similar pairs (named by its least id), and the number of classes its class is similar to.

    The form to use where texts have many copies: ``near_pairs`` gives every pair of ids, and so the square of the number
    of copies. Here copies aren't expanded; classes of one word set in neighbouring time slots are linked like others.
    A class joins a group by its first and last time, so two classes are linked if any of their members can be near.
    """
    from loomline.plans.lineage import cut

    members, cells = word_cells(df, id_col, words, time_col, hours, min_words)
    links = cut(similar_cells(cells, hours, threshold))
    degree = links.select(F.col("a").alias("cell")).unionByName(links.select(F.col("b").alias("cell"))).groupBy("cell").agg(F.count(F.lit(1)).alias("links"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    roots = components(nodes, links).select(F.col("node").alias("cell"), F.col("root").alias("group"))
    joined = members.join(roots, "cell", "left").join(degree, "cell", "left")
    return joined.select(F.col("id").alias(id_col), "cell", F.coalesce("group", "cell").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def tweet_words() -> Column:
    return F.split("tok_lang", " ")


def found(df: DataFrame) -> DataFrame:
    """(ord_a, ord_b) of the near-duplicate tweets."""
    return near_pairs(df, "ord", tweet_words(), "posted_at").select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def groups(df: DataFrame) -> DataFrame:
    return near_groups(df, "ord", tweet_words(), "posted_at")
