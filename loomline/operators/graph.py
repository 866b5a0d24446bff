"""Word graphs: nearest neighbours, mutual edges, components, spectral clusters, centrality, smoothing over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.plans.lineage import cut, release

#: Edges that stay together as bytes where they are spread, and nodes up to which clusters are joined as a broadcast list.
PIECE, FEW_NODES = 1 << 20, 1 << 18


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges of each src; equal weights go to the smaller dst."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that exist in both directions, with the smaller of the two weights; each undirected edge once, src < dst."""
    low = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst")
    return low.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("weight")).where("n >= 2").select("src", "dst", "weight")


def forest(links: DataFrame) -> DataFrame:
    """(u, v), u > v: links that join what the links (a, b) join, fewer than each task has nodes: (node, least node of
    its component among the task's links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = (np.asarray(c) for c in batch.columns)
            ends, code = np.unique(np.r_[names, root, a, b], return_inverse=True)  # what is known counts as links
            x, y = np.r_[code[: len(names)], code[2 * len(names) : 2 * len(names) + len(a)]], np.r_[code[len(names) : 2 * len(names)], code[2 * len(names) + len(a) :]]
            label = np.arange(len(ends))
            while (label[x] != label[y]).any():
                low = np.minimum(label[x], label[y])
                np.minimum.at(label, label[x], low)
                np.minimum.at(label, label[y], low)
                while (label[label] != label).any():
                    label = label[label]
            names, root = ends, ends[label]
        apart = names != root
        for i in range(0, int(apart.sum()), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[apart][i : i + (1 << 16)]), pa.array(root[apart][i : i + (1 << 16)])], ["u", "v"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").mapInArrow(run, "u long, v long")


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable over the undirected links (a, b), for each node.

    Rounds of alternating large-star and small-star steps, so that rounds grow with the logarithm of a component's
    size. Only minima are taken by key, so hubs don't gather their neighbours; each round is cut from the last by a
    checkpoint.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        done, edges, last = edges, cut(small), state
        release(done)
        state = mark(edges)
        if state == last:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))


def giant_component(edges: DataFrame) -> DataFrame:
    """(node) of the largest component of the undirected edges (src, dst); of equally large ones, that of the least node."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = all(t in ("int", "bigint", "smallint", "tinyint") for _, t in links.dtypes)
    # Each task's links are first folded to at most as many as it has nodes.
    roots = cut(components(nodes, forest(links).select(F.col("u").alias("a"), F.col("v").alias("b")) if whole else links))
    best = roots.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1)
    return roots.join(F.broadcast(best.select("root")), "root", "left_semi").select("node")


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 10, rounds: int = 100) -> np.ndarray:
    best, least = np.zeros(len(x), int), np.inf
    for _ in range(tries):
        centres = x[[int(rng.integers(len(x)))]]
        near = _squares(x, centres)[:, 0]
        while len(centres) < k:
            pick = rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else int(rng.integers(len(x)))
            centres = np.vstack([centres, x[pick]])
            near = np.minimum(near, _squares(x, centres[-1:])[:, 0])
        for _ in range(rounds):
            dist = _squares(x, centres)
            label = dist.argmin(axis=1)
            moved = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = dist.min(axis=1).sum()
        if cost < least:
            best, least = label, cost
    return best


def leading_vectors(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, k: int, seed: int = 0, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenvalues, rising, of the sparse symmetric matrix with entries w at (a, b)
    and (b, a): Lanczos steps with full reorthogonalisation, more of them until the residuals are small."""
    order = np.argsort(np.r_[a, b], kind="stable")
    col, val = np.r_[b, a][order], np.r_[w, w][order]
    degree = np.bincount(np.r_[a, b], minlength=n)
    held = np.flatnonzero(degree)
    starts = np.r_[0, np.cumsum(degree[held])[:-1]]

    def times(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(held):
            out[held] = np.add.reduceat(val * v[col], starts)
        return out

    return lanczos(times, n, k, seed, tolerance)


def lanczos(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int = 0, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """``leading_vectors`` of the symmetric matrix that ``times`` multiplies a vector by."""
    q = np.random.default_rng(seed).normal(size=n)
    goal = min(n, max(4 * k, 120))
    space, alpha, beta = np.zeros((goal + 1, n)), [], []  # rows are the basis
    space[0], filled = q / np.linalg.norm(q), 1
    while True:
        while len(alpha) < goal:
            block = space[:filled]
            v = times(block[-1])
            alpha.append(float(v @ block[-1]))
            for _ in range(2):
                v -= block.T @ (block @ v)
            size = float(np.linalg.norm(v))
            beta.append(size)
            if size < 1e-12 or len(alpha) == n:  # an invariant subspace: what is left is reached from a new direction
                if len(alpha) >= goal or filled >= n:
                    break
                v = np.random.default_rng(seed + len(alpha)).normal(size=n)
                for _ in range(2):
                    v -= block.T @ (block @ v)
                beta[-1], size = 0.0, float(np.linalg.norm(v))
            space[filled], filled = v / size, filled + 1
        m = len(alpha)
        t = np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1)
        values, inner = np.linalg.eigh(t)
        keep = slice(max(0, m - k), m)
        if m >= n or np.abs(beta[m - 1] * inner[-1, keep]).max() < tolerance:
            return values[keep], space[:m].T @ inner[:, keep]
        goal = min(n, goal + max(40, goal // 4))
        space = np.concatenate([space, np.zeros((goal + 1 - len(space), n))])


def spectral_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    """Labels of the n nodes of an undirected graph: k-means on the rows of the leading eigenvectors of the normalised
    weights, each divided by the root of its degree."""
    if n <= k:
        return np.arange(n)
    root = 1 / np.sqrt(np.maximum(np.bincount(a, w, n) + np.bincount(b, w, n), 1e-12))
    _, vectors = leading_vectors(a, b, w * root[a] * root[b], n, k, seed)
    return _kmeans(vectors * root[:, None], k, np.random.default_rng(seed))


def _spread_labels(edges: DataFrame, nodes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``spectral_labels`` with the edges left where they are: a product is one pass over them, and only vectors of the
    nodes go to the tasks and come back."""
    n, context = len(nodes), edges.sparkSession.sparkContext
    if n <= k:
        return np.arange(n)
    names = context.broadcast(nodes)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in chain(frames, (None,)):
            if f is not None:
                held.append((np.searchsorted(names.value, f["src"]).astype(np.int32), np.searchsorted(names.value, f["dst"]).astype(np.int32), f["weight"].to_numpy(float)))
                size += len(f)
            if size >= PIECE or f is None and held:
                yield pd.DataFrame({c: [np.concatenate(x).tobytes()] for c, x in zip("abw", zip(*held, strict=True), strict=True)})
                held, size = [], 0

    # As many pieces as cores: each hands back one vector a product. Their edges lie in bytes, which no pass takes apart.
    coded = cut(edges.select("src", "dst", "weight").coalesce(context.defaultParallelism).mapInPandas(code, "a binary, b binary, w binary"))

    def product(v: np.ndarray) -> np.ndarray:
        sent = context.broadcast(v)

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, total = sent.value, np.zeros(n)
            for f in frames:
                for r in f.itertuples():
                    a, b, w = np.frombuffer(r.a, np.int32), np.frombuffer(r.b, np.int32), np.frombuffer(r.w)
                    total += np.bincount(a, w * x[b], n) + np.bincount(b, w * x[a], n)
            yield pd.DataFrame({"total": [total.tobytes()]})

        total = np.zeros(n)
        for r in coded.mapInPandas(part, "total binary").collect():
            total += np.frombuffer(bytes(r.total))
        sent.destroy()
        return total

    root = 1 / np.sqrt(np.maximum(product(np.ones(n)), 1e-12))
    _, vectors = lanczos(lambda v: root * product(root * v), n, k, seed)
    release(coded)
    return _kmeans(vectors * root[:, None], k, np.random.default_rng(seed))


def spectral_clusters(edges: DataFrame, n_clusters: int, seed: int = 0, local_edges: int = 4_000_000, giant: DataFrame | None = None) -> DataFrame:
    """(node, cluster): spectral clustering of the largest component of the undirected edges (src, dst, weight), each
    listed once.

    The method is the same at every size. Up to ``local_edges`` edges one task holds them; more stay spread, and each
    product of the eigenproblem is a pass over them. Some hundred vectors of the nodes are held in one place, which
    the vocabulary bounds. ``giant``: the nodes of the largest component where they are known.
    """
    giant = cut(giant_component(edges)) if giant is None else giant
    inside = edges.join(giant.select(F.col("node").alias("src")), "src", "left_semi")
    if (inside := cut(inside)).count() > local_edges:
        nodes = np.sort(giant.toArrow()["node"].to_numpy())
        labels = _spread_labels(inside, nodes, n_clusters, seed)
        table = pa.table({"node": nodes.astype(np.int64), "cluster": labels.astype(np.int32)})
        return edges.sparkSession.createDataFrame(table, "node long, cluster int")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["src", "dst"], kind="stable")
        names, code = np.unique(np.r_[frame["src"], frame["dst"]], return_inverse=True)
        labels = spectral_labels(code[: len(frame)], code[len(frame) :], frame["weight"].to_numpy(float), len(names), n_clusters, seed)
        return pd.DataFrame({"node": names, "cluster": labels.astype(np.int32)})

    return inside.groupBy(F.lit(0).alias("g")).applyInPandas(lambda f: cluster(f), "node long, cluster int")


def centrality(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, cluster, importance): a node's share of the weight between members of its cluster. ``edges`` are
    undirected and listed once; nodes without such an edge have importance 0."""
    c = lambda s: clusters.select(F.col("node").alias(s), F.col("cluster").alias(f"c_{s}"))
    inner = edges.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst")
    each = inner.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("w"))
    joined = clusters.join(each, "node", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    totals = joined.groupBy("cluster").agg(F.sum("w").alias("total"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("w") / F.nullif(F.col("total"), F.lit(0.0)))
    return joined.join(totals, "cluster").select("node", "cluster", share.alias("importance"))


def smooth_over_time(edges: DataFrame, previous: DataFrame, alpha: float) -> DataFrame:
    """(src, dst, weight): alpha x previous + (1 - alpha) x present between nodes known before; others as they are.

    Nodes that are no longer there lose their edges.
    """
    return _mixed(_aligned(edges, previous), alpha)


def _aligned(edges: DataFrame, previous: DataFrame) -> DataFrame:
    """(src, dst, weight, was, old_src, old_dst): the edges of both times side by side, the same for any share."""
    now = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    before = previous.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    p = previous.select("src", "dst", F.col("weight").alias("was"))
    for s in ("src", "dst"):
        p = p.join(now.withColumnRenamed("node", s), s, "left_semi")
    old = lambda s: before.select(F.col("node").alias(s), F.lit(True).alias(f"old_{s}"))
    return edges.join(p, ["src", "dst"], "full_outer").join(old("src"), "src", "left").join(old("dst"), "dst", "left")


def _mixed(joined: DataFrame, alpha: float) -> DataFrame:
    known = F.col("old_src").isNotNull() & F.col("old_dst").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mixed = F.when(known, zero("was") * alpha + zero("weight") * (1 - alpha)).otherwise(zero("weight"))
    return joined.select("src", "dst", mixed.alias("weight"))


def estimate_alpha(edges: DataFrame, previous: DataFrame, clusters: DataFrame) -> float:
    """The share of the past that minimises the expected error of the smoothed weights, by the shrinkage formula of
    adaptive evolutionary clustering: weights of one block (pair of clusters) are taken as draws of one distribution.

    ``edges`` and ``previous`` are undirected and listed once (src, dst, weight); absent edges weigh 0. Nodes outside
    ``clusters`` (node, cluster) don't count. 0 where nothing is known of the past.
    """
    sizes = {r.cluster: r["count"] for r in clusters.groupBy("cluster").count().collect()}  # as many as clusters were asked for
    few = F.broadcast if sum(sizes.values()) <= FEW_NODES else lambda df: df

    def blocks(df: DataFrame) -> dict[tuple[int, int], tuple[float, float]]:
        side = lambda x: clusters.select(F.col("node").alias(x), F.col("cluster").alias(f"c_{x}"))
        joined = df.join(few(side("src")), "src").join(few(side("dst")), "dst")
        key = [F.least("c_src", "c_dst").alias("a"), F.greatest("c_src", "c_dst").alias("b")]
        rows = joined.groupBy(*key).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")).collect()
        return {(r.a, r.b): (r.s, r.q) for r in rows}

    now, before = blocks(edges), blocks(previous)
    if not before:
        return 0.0
    variance = distance = 0.0
    for a in sizes:
        for b in sizes:
            n = sizes[a] * (sizes[a] - 1) / 2 if a == b else sizes[a] * sizes[b]
            if a > b or n < 1:
                continue
            (s, q), (ps, pq) = now.get((a, b), (0.0, 0.0)), before.get((a, b), (0.0, 0.0))
            mean = s / n
            variance += max(q - n * mean * mean, 0.0) / max(n - 1, 1) * n
            distance += pq - 2 * mean * ps + n * mean * mean
    return float(variance / (distance + variance)) if distance + variance > 0 else 0.0


def eigengap(values: list[float], most: int | None = None) -> int:
    """The number of clusters after which the falling eigenvalues drop the most."""
    values = values[: (most or len(values) - 1) + 1]
    return int(np.argmax(-np.diff(values))) + 1 if len(values) > 1 else 1


def evolve_clusters(edges: DataFrame, previous: DataFrame | None, before: DataFrame | None, k: int, alpha: float | None = None, rounds: int = 3) -> tuple[DataFrame, DataFrame, float]:
    """(smoothed edges, clusters, alpha) of one time step: smoothing and clustering in turn, ``rounds`` times where alpha
    is estimated; clusters take the numbers of the previous ones that they share most nodes with."""
    clusters, smoothed, used = before, edges, 0.0
    # The rounds differ in weights only: edges of both times are joined once, and hold the same largest component.
    joined = cut(_aligned(edges, previous)) if previous is not None else None
    giant = cut(giant_component(edges if joined is None else joined))
    for n in range(rounds if alpha is None and previous is not None else 1):
        if joined is not None:
            if n:
                release(smoothed)
            used = estimate_alpha(edges, previous, clusters) if alpha is None else alpha
            smoothed = cut(_mixed(joined, used))
        clusters = cut(spectral_clusters(smoothed, k, giant=giant))
    if before is not None:
        pairs = match_clusters(clusters, before).collect()
        taken = {r.previous for r in pairs if r.previous is not None}
        free = iter(n for n in range(len(pairs) + len(taken) + 1) if n not in taken)
        names = {r.cluster: r.previous if r.previous is not None else next(free) for r in pairs}
        table = edges.sparkSession.createDataFrame(list(names.items()), "cluster int, named int")
        clusters = clusters.join(F.broadcast(table), "cluster").select("node", F.col("named").alias("cluster"))
    return smoothed, clusters, used


def mean_similarity(slices: DataFrame, time_col: str = "t") -> DataFrame:
    """(src, dst, weight): mean weight over all time slices, absent edges counting 0."""
    n = slices.agg(F.count_distinct(time_col)).first()[0] or 1
    return slices.groupBy("src", "dst").agg((F.sum("weight") / F.lit(float(n))).alias("weight"))


def leading_eigenvalues(edges: DataFrame, k: int, max_edges: int = 5_000_000) -> list[float]:
    """The largest eigenvalues, falling, of the normalised weights of an undirected graph of bounded size."""
    frame = edges.select("src", "dst", "weight").limit(max_edges + 1).toPandas()
    if len(frame) > max_edges:
        raise ValueError(f"more than {max_edges} edges")
    names, code = np.unique(np.r_[frame["src"], frame["dst"]], return_inverse=True)
    a, b, w, n = code[: len(frame)], code[len(frame) :], frame["weight"].to_numpy(float), len(names)
    root = 1 / np.sqrt(np.maximum(np.bincount(a, w, n) + np.bincount(b, w, n), 1e-12))
    return leading_vectors(a, b, w * root[a] * root[b], n, min(k, n))[0][::-1].tolist()


def match_clusters(now: DataFrame, before: DataFrame) -> DataFrame:
    """(cluster, previous): greedy matching of clusters to previous ones by shared nodes, most first; the number of
    clusters is a parameter of the clustering, so the overlap table is small. Unmatched clusters have null."""
    overlap = now.join(before.select("node", F.col("cluster").alias("previous")), "node").groupBy("cluster", "previous").count()
    rows = overlap.orderBy(F.desc("count"), "cluster", "previous").collect()
    used_a, used_b, out = set(), set(), []
    for r in rows:
        if r.cluster not in used_a and r.previous not in used_b:
            used_a.add(r.cluster), used_b.add(r.previous), out.append((r.cluster, r.previous))
    out += [(r.cluster, None) for r in now.select("cluster").distinct().collect() if r.cluster not in used_a]
    return now.sparkSession.createDataFrame(out, "cluster int, previous int")
