"""Proximal operators, an accelerated solver for designs that one place can hold, and generators of panels.

Objective 1/2 ||Y - X W||^2 + lambda psi(W), missing entries of Y left out. Fits of any size are in ``bilinear``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

Prox = Callable[[np.ndarray, float], np.ndarray]


def prox_l1(w: np.ndarray, t: float) -> np.ndarray:
    return np.sign(w) * np.maximum(np.abs(w) - t, 0)


def prox_l2(w: np.ndarray, t: float) -> np.ndarray:
    """Of the squared norm 1/2 ||w||^2."""
    return w / (1 + t)


def prox_l1l2(w: np.ndarray, t: float) -> np.ndarray:
    """Of the sum of the rows' norms: whole rows go to zero."""
    norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
    return w * np.maximum(1 - t / np.maximum(norm, 1e-300), 0)


def prox_elastic(ridge: float) -> Prox:
    """Of ||w||_1 + ridge/2 ||w||^2."""
    return lambda w, t: prox_l1(w, t) / (1 + t * ridge)


def project_l1(v: np.ndarray, radius: float) -> np.ndarray:
    """The nearest point with an l1 norm of at most ``radius``."""
    a = np.abs(v)
    if a.sum() <= radius:
        return v
    s = np.sort(a)[::-1]
    c = np.cumsum(s) - radius
    k = np.nonzero(s > c / np.arange(1, len(s) + 1))[0][-1]
    return np.sign(v) * np.maximum(a - c[k] / (k + 1), 0)


def prox_linf(v: np.ndarray, t: float) -> np.ndarray:
    """Of the largest absolute value, by projection onto the dual ball."""
    return v - project_l1(v, t) if t > 0 else v


def prox_grid(m: np.ndarray, t_rows: float, t_columns: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Of t_rows sum over rows of max|.| + t_columns sum over columns of max|.|, for the region x task matrix of one word.

    Every cell is in one group of each family; Dykstra's splitting alternates the two separable operators.
    """
    x, p, q = m.copy(), np.zeros_like(m), np.zeros_like(m)
    for _ in range(rounds):
        y = np.apply_along_axis(prox_linf, 1, x + p, t_rows) if t_rows > 0 else x + p
        p = x + p - y
        new = np.apply_along_axis(prox_linf, 0, y + q, t_columns) if t_columns > 0 else y + q
        q = y + q - new
        if np.abs(new - x).max(initial=0) < tolerance:
            return new
        x = new
    return x


def _linf_rows(v: np.ndarray, t: float) -> np.ndarray:
    """``prox_linf`` along the last axis: values are capped at the level above which they add up to ``t``."""
    if t <= 0:
        return v
    a = np.abs(v)
    level = (np.cumsum(-np.sort(-a, axis=-1), axis=-1) - t) / np.arange(1, v.shape[-1] + 1)
    return np.sign(v) * np.minimum(a, np.maximum(level.max(axis=-1, keepdims=True), 0))


def prox_grids(cube: np.ndarray, t_rows: float, t_columns: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """``prox_grid`` of every word of a words x regions x tasks array at once; a word stops when it has settled."""
    out, at = cube.copy(), np.arange(len(cube))
    x, p, q = cube.copy(), np.zeros_like(cube), np.zeros_like(cube)
    for _ in range(rounds):
        y = _linf_rows(x + p, t_rows)
        p = x + p - y
        new = _linf_rows((y + q).swapaxes(1, 2), t_columns).swapaxes(1, 2)
        q = y + q - new
        open_ = np.abs(new - x).reshape(len(x), -1).max(axis=1, initial=0) >= tolerance
        out[at] = new
        at, x, p, q = at[open_], new[open_], p[open_], q[open_]
        if not len(at):
            break
    return out


def prox_graph(shape: tuple[int, int, int], t_tasks: float = 1.0, t_regions: float = 1.0, ridge: float = 0.0) -> Prox:
    """Weights (words x regions, tasks): groups are all tasks of a (word, region) and all regions of a (word, task);
    ``ridge`` adds half the squares times it. No group has cells of two words, so the operator splits by word."""
    words, regions, tasks = shape

    def prox(w: np.ndarray, t: float) -> np.ndarray:
        return prox_grids(w.reshape(words, regions, tasks), t * t_tasks, t * t_regions).reshape(w.shape) / (1 + t * ridge) if words else w

    return prox


@dataclass(frozen=True)
class Tree:
    """Groups of variables as a tree, children before parents: (variables, weight) of each."""

    groups: tuple[tuple[tuple[int, ...], float], ...]


def prox_tree(tree: Tree) -> Prox:
    """Of the weighted sum of groups' largest absolute values: with nested groups one pass from the leaves up is exact."""

    def prox(w: np.ndarray, t: float) -> np.ndarray:
        w = w.copy()
        for variables, weight in tree.groups:
            index = list(variables)
            flat = prox_linf(w[index].ravel(), t * weight)
            w[index] = flat.reshape(w[index].shape)
        return w

    return prox


def tree_from_table(rows: list[tuple[int, int | None, float, list[int]]]) -> Tree:
    """A tree from (node, parent, weight, own variables): a node's group holds its own and its descendants' variables."""
    children: dict[int | None, list[int]] = {}
    node = {n: (weight, own) for n, _, weight, own in rows}
    for n, parent, _, _ in rows:
        children.setdefault(parent, []).append(n)
    groups: list[tuple[tuple[int, ...], float]] = []

    def gather(n: int) -> list[int]:
        weight, own = node[n]
        variables = [*own, *(v for c in children.get(n, []) for v in gather(c))]
        if variables:
            groups.append((tuple(sorted(variables)), weight))
        return variables

    for root in children.get(None, []):
        gather(root)
    return Tree(tuple(groups))


def penalty_l1(w: np.ndarray) -> float:
    return float(np.abs(w).sum())


def penalty_l1l2(w: np.ndarray) -> float:
    return float(np.sqrt((w * w).sum(axis=1)).sum())


def prox_multitask(shape: tuple[int, int, int], ridge: float = 0.0) -> Prox:
    """Weights (words x regions, tasks): absolute values, and maxima over the tasks of a (word, region)."""
    return lambda w, t: _linf_rows(prox_l1(w, t), t) / (1 + t * ridge)


def penalty_graph(w: np.ndarray, shape: tuple[int, int, int]) -> float:
    cube = np.abs(w.reshape(shape))
    return float(cube.max(axis=2).sum() + cube.max(axis=1).sum())


def fista(x: np.ndarray, y: np.ndarray, prox: Prox, lam: float, intercept: bool = False, rounds: int = 500, tolerance: float = 1e-8, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the least squares problem with a regulariser; the bias isn't regularised.

    y: (n,) or (n, tasks), NaN where missing. Accelerated proximal gradient steps that restart when they overshoot.
    """
    y = y.reshape(len(y), -1)
    seen = ~np.isnan(y)
    target = np.where(seen, y, 0.0)
    design = np.hstack([x, np.ones((len(x), 1))]) if intercept else x
    w = np.zeros((design.shape[1], y.shape[1])) if start is None else start.copy()
    size = float(np.linalg.norm(design, 2) ** 2) if design.size else 1.0
    step = 1 / max(size, 1e-12)

    def shrink(v: np.ndarray) -> np.ndarray:
        if not intercept:
            return prox(v, step * lam)
        return np.vstack([prox(v[:-1], step * lam), v[-1:]])

    z, momentum = w.copy(), 1.0
    for _ in range(rounds):
        residual = np.where(seen, design @ z - target, 0.0)
        new = shrink(z - step * (design.T @ residual))
        if ((z - new) * (new - w)).sum() > 0:
            momentum = 1.0
        ahead = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        z = new + (momentum - 1) / ahead * (new - w)
        change = np.abs(new - w).max(initial=0)
        w, momentum = new, ahead
        if change < tolerance:
            break
    return (w[:-1], w[-1]) if intercept else (w, np.zeros(y.shape[1]))


def random_bilinear(tasks: int = 3, users: int = 5, words: int = 10, noise: float = 0.01, bias: tuple[float, float] | None = None, seed: int = 0):
    """(u, w, bias, draw): planted weights and a function that draws (X, y) with y = diag(u'Xw) + bias + noise."""
    rng = np.random.default_rng(seed)
    u, w = rng.random((users, tasks)), rng.random((words, tasks))
    b = rng.uniform(*bias, tasks) if bias else np.zeros(tasks)

    def draw() -> tuple[np.ndarray, np.ndarray]:
        x = rng.random((users, words))
        return x, np.einsum("ut,uw,wt->t", u, x, w) + b + rng.normal(0, noise, tasks)

    return u, w, b, draw


def random_panel(regions: int = 3, tasks: int = 5, users: int = 7, words: int = 11, days: int = 13, zeros: float = 0.9, seed: int = 1) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(x, y) in long form: a sparse tensor of which half the users and words matter."""
    rng = np.random.default_rng(seed)
    x = rng.random((days, regions, users, words)) * (rng.random((days, regions, users, words)) >= zeros)
    u = rng.random((regions, tasks, users)) * (np.arange(users) < users / 2)
    w = rng.random((regions, tasks, words)) * (np.arange(words) < words / 2)
    y = np.einsum("nruw,rtu,rtw->ntr", x, u, w)
    n, r, a, b = np.nonzero(x)
    long = pd.DataFrame({"day": n, "region": r, "user": a, "word": b, "x": x[n, r, a, b]}).astype({"day": "int32", "region": "int32", "user": "int64", "word": "int32"})
    d, t, g = np.indices(y.shape).reshape(3, -1)
    return long, pd.DataFrame({"day": d.astype("int32"), "task": [f"t{i}" for i in t], "region": g.astype("int32"), "y": y.ravel()})
