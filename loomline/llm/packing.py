"""Problem 6: texts of varying length put into containers of fixed capacity with little space unused.

Method: a grouping genetic algorithm on islands. Texts are spread by hash over blocks of bounded size; each block is
bred on several islands, each with a population of its own. A crossover injects whole well-filled containers of one
parent into another, removes the containers that hold the same texts and fills new ones with the displaced texts, each
as nearly as sums of their sizes allow. An island breeds until no packing can be better or many generations bring none.
Between rounds each island's elite migrates to the next island. Containers that a block can't fill are dissolved and
their texts packed again together with those of other blocks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import chain, compress, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.tokens import VOCABULARY, with_token_counts

#: Items of a block (on average), islands of a block, rounds between migrations, each island's population, and the
#: generations in a row without a fitter packing after which it counts as bred out.
BLOCK_ITEMS = 1500
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
PATIENCE = 40
ELITE = 2
#: Containers filled less than this are dissolved and their texts packed again in pools as large as blocks.
WELL_FILLED = 0.985


class Packing:
    """Bins (tuples of item numbers), their loads, and the bin of each item."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[tuple[int, ...]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> float:
        """Mean squared filling: prefers full bins, and with equal numbers of bins uneven ones."""
        fill = np.array(self.loads, float) / capacity
        return float((fill * fill).mean()) if len(fill) else 1.0

    def labels(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        out[[*chain.from_iterable(self.bins)]] = np.repeat(np.arange(len(self.bins)), [len(b) for b in self.bins])
        return out


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Each item, in the given order, into the fullest bin that still takes it."""
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in items:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            loads[b] += size
            if left > size:
                insort(room, (left - size, b))
        else:
            bins.append([i])
            loads.append(size)
            if size < capacity:
                insort(room, (capacity - size, len(bins) - 1))
    return Packing([tuple(b) for b in bins], loads)


def closest(items: list[int], sizes: list[int], gap: int) -> list[int]:
    """Items whose sizes add up to the most that fits into ``gap``; the earlier ones where several choices do."""
    sums, steps, most = 1, [], (1 << gap + 1) - 1  # bit k of sums: some of the items so far add up to k
    for i in items:
        if sizes[i] <= gap:
            steps.append((i, sums))
            sums |= sums << sizes[i] & most
            if sums >> gap:
                break
    left, out = sums.bit_length() - 1, []
    for i, before in reversed(steps):
        if not before >> left & 1:
            out.append(i)
            left -= sizes[i]
    return out


def fill(bins: list[tuple[int, ...]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """New bins for the items: each takes the first ones while its gap is wide, then those that fill the rest best."""
    total = sum([sizes[i] for i in items])
    while items:
        wide = 3 * total // len(items)
        n, gap = 1, capacity - sizes[items[0]]
        while n < len(items) and gap - sizes[items[n]] >= wide:
            gap -= sizes[items[n]]
            n += 1
        last = closest(items[n:], sizes, gap)
        load = capacity - gap + sum([sizes[i] for i in last])
        bins.append((*items[:n], *last))
        loads.append(load)
        total -= load
        items = items[n:]
        for i in last:
            items.remove(i)
    return Packing(bins, loads)


def crossover(taker: Packing, giver: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of the giver are injected into the taker; displaced items fill new bins, largest first."""
    loads = np.array(giver.loads)
    good = np.argsort(-loads, kind="stable")[: max(1, len(loads) // 2)]
    chosen = rng.choice(good, size=max(1, len(good) // 2), replace=False).tolist()
    bins, kept_loads = [giver.bins[b] for b in chosen], [giver.loads[b] for b in chosen]
    taken = {i for b in bins for i in b}
    whole = [taken.isdisjoint(b) for b in taker.bins]
    displaced = [i for b, kept in zip(taker.bins, whole, strict=True) if not kept for i in b if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    bins += compress(taker.bins, whole)
    kept_loads += compress(taker.loads, whole)
    return fill(bins, kept_loads, displaced, sizes, capacity)


def mutate(one: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest bins, some others that aren't full and a few of all are dissolved; their items fill new bins in a
    shaken order."""
    n, loads = len(one.bins), np.array(one.loads)
    ajar = np.flatnonzero(loads < capacity)
    some = rng.choice(ajar, min(len(ajar), 8), replace=False)
    gone = {*np.argsort(loads, kind="stable")[:2].tolist(), *some.tolist(), *rng.integers(0, n, max(2, n // 25)).tolist()}
    displaced = [i for b in sorted(gone) for i in one.bins[b]]
    shaken = rng.uniform(0.8, 1.0, len(displaced)) * [sizes[i] for i in displaced]
    displaced = [displaced[k] for k in np.argsort(-shaken, kind="stable").tolist()]
    kept = [b not in gone for b in range(n)]
    return fill([*compress(one.bins, kept)], [*compress(one.loads, kept)], displaced, sizes, capacity)


def fullest(sizes: list[int], capacity: int) -> int:
    """The most that any of the sizes add up to within the capacity."""
    sums, most = 1, (1 << capacity + 1) - 1
    for size in sizes:
        sums |= sums << size & most
        if sums >> capacity:
            break
    return sums.bit_length() - 1


def fewest(sizes: list[int], full: int) -> int:
    """A number of bins that no packing can undercut: items beside which not even the smallest fits have a bin each, the
    others fill theirs at best."""
    smallest = min(sizes)
    shared = [s for s in sizes if s + smallest <= full]
    return len(sizes) - len(shared) - (-sum(shared) // full)


def limits(sizes: list[int], capacity: int) -> tuple[int, int, int]:
    """(fullest, fewest, smallest size) of the items."""
    full = fullest(sizes, capacity)
    return full, fewest(sizes, full), min(sizes)


def unbeatable(one: Packing, full: int, least: int, smallest: int) -> bool:
    """Whether no packing has fewer bins or more of the unused room in a single one, whose items go to the pool."""
    if len(one.bins) > least:
        return False
    return sum(load < full and (len(b) > 1 or load + smallest <= full) for b, load in zip(one.bins, one.loads, strict=True)) <= 1


def first_generation(sizes: list[int], capacity: int, rng: np.random.Generator, n: int = POPULATION) -> list[Packing]:
    plain = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out = [best_fit([], [], plain, sizes, capacity)]
    for _ in range(n - 1):
        shaken = np.array(sizes) * rng.uniform(0.85, 1.0, len(sizes))
        out.append(best_fit([], [], np.argsort(-shaken, kind="stable").tolist(), sizes, capacity))
    return out


def evolve(population: list[Packing], sizes: list[int], capacity: int, rng: np.random.Generator, patience: int = PATIENCE) -> list[Packing]:
    """The fittest packings first, those of equal fitness once. Breeds until no packing can be fitter or ``patience``
    generations in a row brought none that is."""
    full, least, smallest = limits(sizes, capacity)
    worth = lambda p: (len(p.bins), -p.fitness(full))
    ranked = sorted({worth(p): p for p in population}.items())
    idle = 0
    while idle < patience and (idle or not unbeatable(ranked[0][1], full, least, smallest)):
        a = ranked[0][1]
        children = [mutate(a, sizes, full, rng)]
        if len(ranked) > 1:
            children.append(crossover(a, ranked[int(rng.integers(1, len(ranked)))][1], sizes, full, rng))
        bred = sorted({**dict(ranked), **{worth(p): p for p in children}}.items())[:POPULATION]
        idle = 0 if bred[0][0] < ranked[0][0] else idle + 1
        ranked = bred
    return [p for _, p in ranked]


def _restore(labels: np.ndarray, sizes: list[int]) -> Packing:
    order = np.argsort(labels, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(labels[order])) + 1).tolist()]
    items = order.tolist()
    bins = [tuple(items[a:b]) for a, b in pairwise([*cuts, len(items)])]
    return Packing(bins, np.add.reduceat(np.array(sizes)[order], cuts).tolist())


#: Columns that travel between rounds; e0 and e1 are an item's bins in the island's two fittest packings, -1 for none.
ITEMS = "kind int, capacity int, block long, island int, doc_id long, piece int, nr long, size int, e0 int, e1 int"


def _island(frame: pd.DataFrame) -> pd.DataFrame:
    """One round of one island. Each item comes once, or twice with a migrant elite. What can't be bettered stays as it is."""
    kept = frame[frame["own"]]
    if kept["e0"].iloc[0] >= 0:
        sizes = kept["size"].tolist()
        if unbeatable(_restore(kept["e0"].to_numpy(), sizes), *limits(sizes, int(kept["capacity"].iloc[0]))):
            return kept[["kind", "capacity", "block", "island", "doc_id", "piece", "nr", "size", "e0", "e1"]]
    frame = frame.sort_values(["own", "nr", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
    n = int(frame["own"].sum())
    own, guests = frame.iloc[:n], frame.iloc[n:]
    sizes, capacity = own["size"].tolist(), int(own["capacity"].iloc[0])
    rng = np.random.default_rng([int(own["block"].iloc[0]) & 0x7FFFFFFF, int(own["island"].iloc[0]), int(frame["round"].iloc[0]), capacity])
    population = [_restore(part[e].to_numpy(), sizes) for part in (own, guests) for e in ("e0", "e1") if len(part) and part[e].iloc[0] >= 0]
    best = evolve(population or first_generation(sizes, capacity, rng), sizes, capacity, rng)[:ELITE]
    out = own[["kind", "capacity", "block", "island", "doc_id", "piece", "nr", "size"]].copy()
    out["e0"] = best[0].labels(n)
    out["e1"] = best[1].labels(n) if len(best) > 1 else np.full(n, -1, np.int32)
    return out


PACKED = "kind int, capacity int, block long, doc_id long, piece int, size int, bin int, load int"


def _loaded(frame: pd.DataFrame, bins: np.ndarray) -> pd.DataFrame:
    out = frame[["kind", "capacity", "block", "doc_id", "piece", "size"]].copy()
    out["bin"] = bins.astype(np.int32)
    out["load"] = np.bincount(bins, weights=out["size"])[bins].astype(np.int32)
    return out


def _best_of_block(frame: pd.DataFrame) -> pd.DataFrame:
    best = None
    for _, island in frame.groupby("island"):
        loads = np.bincount(island["e0"], weights=island["size"]) / int(island["capacity"].iloc[0])
        key = (len(loads), -float((loads * loads).mean()))
        if best is None or key < best[0]:
            best = (key, island)
    return _loaded(best[1], best[1]["e0"].to_numpy())


def _repack(frame: pd.DataFrame) -> pd.DataFrame:
    """The pooled leftovers of several blocks, packed afresh."""
    frame = frame.sort_values(["doc_id", "piece"], kind="stable")
    sizes, capacity = frame["size"].tolist(), int(frame["capacity"].iloc[0])
    rng = np.random.default_rng([int(frame["block"].iloc[0]) & 0x7FFFFFFF, capacity])
    return _loaded(frame, evolve(first_generation(sizes, capacity, rng), sizes, capacity, rng)[0].labels(len(sizes)))


def pieces(sized: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(kind, capacity, doc_id, piece, size): each text once per kind of container (its number in ``kinds``), cut only
    where it is larger than the container: into full pieces and a rest. Texts without tokens have one piece of size 0."""
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).cast("int").alias("capacity")) for i, (_, c) in enumerate(kinds)]))
    cut = sized.select("doc_id", "tokens", every.alias("k")).select("k.kind", "k.capacity", "doc_id", "tokens")
    number = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    cut = cut.select("kind", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    return cut.select("kind", "capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))


def pack(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, capacity, container, doc_id, piece, tokens): every text (or piece of one larger than the container)
    assigned to a container of each kind.

    Null, empty and tokenless texts come out with a null container and 0 tokens, rows without an id with a null
    container; rows with the same id are packed as separate texts. A container's loads add up to its capacity or less. Empty tables give no rows.
    """
    from loomline.plans.lineage import cut, spread_small

    kinds = sorted((r.kind, r.capacity) for r in containers.where("kind is not null and capacity > 0").select("kind", "capacity").distinct().collect())  # a handful by nature
    if not kinds:
        return documents.sparkSession.createDataFrame([], "kind string, capacity int, container string, doc_id long, piece int, tokens int")
    texts = spread_small(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    sized = with_token_counts(texts, "text", path=path).select("doc_id", "tokens")
    items = cut(pieces(sized, kinds).withColumn("nr", F.monotonically_increasing_id()))
    loose = items.where("doc_id is not null and size > 0 and size < capacity")

    def by_items(df: DataFrame) -> Column:
        """How many blocks the items of a row's kind make."""
        blocks = F.lit(1)
        for r in df.groupBy("kind").count().collect():
            blocks = F.when(F.col("kind") == r.kind, F.lit(-(-r["count"] // BLOCK_ITEMS))).otherwise(blocks)
        return blocks.cast("long")

    spread = loose.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "nr"), by_items(loose)))
    state = spread.select("*", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.lit(-1).alias("e0"), F.lit(-1).alias("e1"))
    for round_ in range(ROUNDS):
        own = state.withColumn("own", F.lit(True))
        if round_:  # the elite moves on to the next island of the ring
            own = own.unionByName(state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("own", F.lit(False)))
        state = own.withColumn("round", F.lit(round_)).groupBy("kind", "block", "island").applyInPandas(_island, ITEMS)
    packed = cut(state.groupBy("kind", "block").applyInPandas(_best_of_block, PACKED))
    filled = F.col("load") >= F.col("capacity") * WELL_FILLED
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), F.col("kind") + 1)

    def assigned(df: DataFrame, container: Column, size: str = "size") -> DataFrame:
        return df.select(kind.alias("kind"), "capacity", container.alias("container"), "doc_id", "piece", F.col(size).alias("tokens"))

    name = lambda level: F.concat_ws("-", kind, F.lit(level), "block", "bin")
    left = packed.where(~filled)
    pools = by_items(left)
    pooled = left.withColumn("block", F.pmod("block", pools)).groupBy("kind", "block").applyInPandas(_repack, PACKED)
    whole = items.where("doc_id is not null and size = capacity")
    empty = items.where("doc_id is null or size <= 0")
    parts = [assigned(packed.where(filled), name("a")), assigned(pooled, name("b")), assigned(whole, F.concat_ws("-", kind, F.lit("w"), "nr")), assigned(empty, F.lit(None).cast("string"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def filling(packed: DataFrame) -> DataFrame:
    """(kind, capacity, containers, tokens, filled, fewest): how well each kind of container is filled; fewest is the
    number that no packing can undercut."""
    loads = packed.where("container is not null").groupBy("kind", "capacity", "container").agg(F.sum("tokens").alias("load"))
    by = loads.groupBy("kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"))
    return by.select("*", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"))
