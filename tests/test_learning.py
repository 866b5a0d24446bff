import itertools

import numpy as np
import pytest

from loomline.operators import bilinear as B
from loomline.operators import learning as L
from loomline.plans.lineage import cut

rng = np.random.default_rng(5)


def brute(prox, penalty, shape, t=0.7, tries=3000):
    """No point near the result of a proximal operator may have a lower objective."""
    v = rng.normal(size=shape)
    p = prox(v, t)
    value = lambda z: 0.5 * ((z - v) ** 2).sum() + t * penalty(z)
    best = value(p)
    for k in range(tries):
        z = p + rng.normal(size=shape) * 10.0 ** -(k % 5)
        assert value(z) >= best - 1e-8
    assert value(np.zeros(shape)) >= best - 1e-8


def test_simple_prox():
    brute(L.prox_l1, L.penalty_l1, (4, 2))
    brute(L.prox_l2, lambda z: 0.5 * (z * z).sum(), (4, 2))
    brute(L.prox_l1l2, L.penalty_l1l2, (4, 2))
    brute(L.prox_elastic(0.3), lambda z: L.penalty_l1(z) + 0.15 * (z * z).sum(), (4, 2))
    brute(L.prox_linf, lambda z: np.abs(z).max(), (5,))


def test_graph_prox():
    brute(L.prox_graph((2, 2, 3)), lambda z: L.penalty_graph(z, (2, 2, 3)), (4, 3))


def test_tree_prox():
    tree = L.Tree((((0,), 1.0), ((1, 2), 0.5), ((0, 1, 2), 0.8)))
    brute(L.prox_tree(tree), lambda z: sum(w * np.abs(z[list(g)]).max() for g, w in tree.groups), (3,))


def test_tree_from_table():
    tree = L.tree_from_table([(0, None, 0.5, []), (1, 0, 1.0, [0]), (2, 0, 2.0, [1, 2])])
    assert tree.groups == (((0,), 1.0), ((1, 2), 2.0), ((0, 1, 2), 0.5))


def test_fista_with_missing_and_intercept():
    x = rng.normal(size=(120, 6))
    w = np.array([1.0, 0, -2, 0, 0, 0.5])
    y = x @ w + 4
    y[::7] = np.nan
    got, b = L.fista(x, y, L.prox_l1, 1e-3, intercept=True)
    assert np.allclose(got[:, 0], w, atol=1e-2) and b[0] == pytest.approx(4, abs=1e-2)


def test_fista_objective_falls():
    x, y = rng.normal(size=(50, 8)), rng.normal(size=50)
    value = lambda w: 0.5 * ((x @ w[:, 0] - y) ** 2).sum() + 0.5 * np.abs(w).sum()
    steps = [value(L.fista(x, y, L.prox_l1, 0.5, rounds=n, tolerance=0)[0]) for n in (1, 5, 20, 100, 400)]
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(steps))


@pytest.mark.parametrize("bias", [None, (100, 1000)])
def test_planted_generator(bias):
    u, w, b, draw = L.random_bilinear(bias=bias)
    total = 0.0
    for _ in range(10):
        x, y = draw()
        total += np.abs(np.einsum("ut,uw,wt->t", u, x, w) + b - y).sum() / 10
    assert total < 0.1


def dense(columns, y, seen, lam, prox, intercept):
    """The same problem by the dense solver: cells stacked one below the other."""
    n, cells, days = columns.shape
    design = np.zeros((cells * days, n * cells + (cells if intercept else 0)))
    for c in range(cells):
        for i in range(n):
            design[c * days : (c + 1) * days, i * cells + c] = columns[i, c]
        if intercept:
            design[c * days : (c + 1) * days, n * cells + c] = 1
    keep = lambda w, t: np.vstack([prox(w[: n * cells], t), w[n * cells :]])
    goal = np.where(seen, y, np.nan).ravel()
    w, _ = L.fista(design, goal, keep, lam, rounds=30000, tolerance=1e-13)
    return w[: n * cells].reshape(n, cells), w[n * cells :, 0] if intercept else np.zeros(cells)


@pytest.mark.parametrize(("kind", "ridge", "intercept"), [("l1", 0.0, True), ("l1", 0.3, False), ("graph", 0.0, False), ("graph", 0.2, True), ("multitask", 0.0, True)])
def test_working_sets_reach_the_dense_solution(spark, kind, ridge, intercept):
    n, regions, tasks, days = 30, 2, 3, 12
    cells = regions * tasks
    columns = rng.random((n, cells, days)) * (rng.random((n, cells, days)) < 0.5) * rng.integers(1, 20, n)[:, None, None]
    y, seen = rng.normal(size=(cells, days)) * 3 + 1, rng.random((cells, days)) < 0.9
    rows = [(int(i), int(c), int(d), float(columns[i, c, d])) for i, c, d in zip(*np.nonzero(columns))]
    items = cut(B.pack(spark.createDataFrame(rows, "item int, cell int, day int, v double"), "item"))
    shape = (n, regions, tasks)
    prox = {"l1": L.prox_elastic(ridge) if ridge else L.prox_l1, "graph": L.prox_graph(shape, ridge=ridge), "multitask": L.prox_multitask(shape, ridge)}[kind]
    penalty, lam = B.Penalty(kind, (regions, tasks), ridge), 2.0
    want, bias = dense(columns, y, seen, lam, lambda w, t: prox(w.reshape(-1, tasks), t).reshape(-1, 1), intercept)
    value = lambda w, b: 0.5 * (np.where(seen, np.einsum("ic,icd->cd", w, columns) + b[:, None] - y, 0) ** 2).sum() + lam * penalty.value(w)
    for working in (16, 1000):
        got = B.working_set(items, ["item"], y, seen, np.full(cells, lam), penalty, intercept, working=working)
        w = np.zeros((n, cells))
        for (i,), row in zip(got.keys, got.weights, strict=True):
            w[i] = row
        assert got.settled and value(w, got.bias) <= value(want, bias) * 1.0001


def test_region_fit_explains_panel(spark):
    from loomline.operators import panel

    x, y = L.random_panel(days=40, zeros=0.5)
    sx, sy = spark.createDataFrame(x), spark.createDataFrame(y)
    seen = []
    m = B.fit_regions(sx, sy, lam_w=1e-3, lam_u=1e-3, epochs=2, callback=lambda e, _: seen.append(e))
    assert seen == [0, 1] and len(m.history) == 2
    scored = sy.join(panel.predict(sx, m.w, m.u, m.bias, sy.select("day")), ["day", "task", "region"])
    mean = panel.mean_center(sy)
    fitted, base = panel.errors(scored).first().sse, panel.errors(mean, estimate="y_mean").first().sse
    assert fitted < 0.3 * base


def test_objective_falls_and_fit_stops_early(spark):
    x, y = L.random_panel(days=20, zeros=0.5)
    seen = []
    m = B.fit_regions(spark.createDataFrame(x), spark.createDataFrame(y), lam_w=0.5, lam_u=0.5, epochs=6, tolerance=1e9, callback=lambda e, _: seen.append(e))
    assert m.epochs == 1 and seen == []  # stops before the callback
    m = B.fit_regions(spark.createDataFrame(x), spark.createDataFrame(y), lam_w=0.5, lam_u=0.5, epochs=4, tolerance=0)
    assert all(b <= a * 1.001 for a, b in itertools.pairwise(m.objective))


def test_fits_of_odd_panels(spark):
    """Nulls, missing targets, repeated rows, no rows, users and words as text, clashing columns."""
    x = spark.createDataFrame([(d, 1, f"u{u}", f"w{w}", float((d * 7 + u * 3 + w) % 5), "z") for d in range(8) for u in range(3) for w in range(4)] + [(None, 1, "u0", "w0", 1.0, "z"), (0, None, "u0", "w0", 1.0, "z"), (0, 1, None, "w0", 1.0, "z"), (0, 1, "u0", "w0", None, "z"), (0, 1, "u0", "w0", 1.0, "z")], "day int, region int, user string, word string, x double, cell string")
    y = spark.createDataFrame([(d, t, 1, float(d % 3)) for d in range(8) for t in ("a", "b") if (d, t) != (3, "b")] + [(0, "a", None, 1.0), (4, "b", 1, None)], "day int, task string, region int, y double")
    m = B.fit_regions(x, y, lam_w=0.1, lam_u=0.1, epochs=2)
    assert m.bias.count() == 2 and m.settled
    for empty_x, empty_y in ((x.where("false"), y), (x, y.where("false"))):
        m = B.fit_regions(empty_x, empty_y, epochs=2)
        assert m.w.count() == 0 and m.u.count() == 0


def test_lambda_and_prequential(spark):
    rows = []
    for day in range(20):
        a, b = rng.normal(), rng.normal()
        rows += [("train" if day < 14 else "val_param", day, i, float(v), float(2 * a)) for i, v in (("a", a), ("b", b))]
    design = spark.createDataFrame(rows, "part string, day int, item string, x double, y double")
    grid = B.lambda_search(design, [0.1, 5.0, 0.1])
    assert grid.count() == 3 and B.best_lambda(grid).first().lam == 0.1
    table = design.toPandas().pivot(index="day", columns="item", values="x")
    y = design.toPandas().groupby("day")["y"].first()
    w, b = L.fista(table[:14].to_numpy(), y[:14].to_numpy(), L.prox_l1, 5.0, intercept=True)
    assert grid.where("idx = 1").first().err == pytest.approx(((table[14:].to_numpy() @ w[:, 0] + b - y[14:]) ** 2).sum(), rel=1e-2)
    out = B.prequential(design, 0.01).collect()
    assert len(out) == 15 and all(abs(r.y - r.y_hat) < 0.5 for r in out)
    assert B.prequential(design.where("false"), 0.1).count() == 0 and B.lambda_search(design.where("false"), [0.1]).count() == 1


def test_flat_and_incremental_fit(spark):
    x, y = L.random_panel(regions=1, days=30, zeros=0.3)
    sx, sy = spark.createDataFrame(x.drop(columns="region")), spark.createDataFrame(y.drop(columns="region"))
    m = B.fit_flat(sx, sy, epochs=2)
    assert {r.task for r in m.w.collect()} == set(y.task) and m.bias.count() == 5
    m = B.fit_incremental(sx, sy, most=9)
    assert m.epochs <= 9


def test_graph_prox_of_many_words():
    cube = rng.normal(size=(40, 4, 3))
    want = np.stack([L.prox_grid(m, 0.4, 0.7) for m in cube])
    assert np.allclose(L.prox_graph(cube.shape, 0.4, 0.7)(cube.reshape(-1, 3), 1.0).reshape(cube.shape), want, atol=1e-8)


def test_registered_fits_take_all_users_words_and_epochs(spark, data, monkeypatch):
    from loomline.queries import panel as queries

    class Seen(Exception):
        pass

    def spy(x, y, **options):
        raise Seen(x, options)

    monkeypatch.setattr(queries.bilinear, "fit_regions", spy)
    monkeypatch.setattr(queries.bilinear, "fit_flat", spy)
    whole = queries.region_expand(spark, data)
    flat = whole.groupBy("day", "user", "word").count().count()
    for name, n in (("bilinear_region_fit", whole.count()), ("bilinear_multitask_fit", whole.count()), ("bilinear_flat_fit", flat), ("panel_experiment", None)):
        with pytest.raises(Seen) as seen:
            queries.queries()[name](spark, data)
        x, options = seen.value.args
        assert "epochs" not in options
        assert n is None or x.count() == n


def test_fits_scan_the_panel_once_and_shuffle_no_entry_again(spark, monkeypatch):
    """A panel is packed by users; the steps of several fits take weights in without shuffling users or joining words."""
    x, y = L.random_panel(days=20, zeros=0.5)
    sx, sy = spark.createDataFrame(x), spark.createDataFrame(y)
    packed = B.pack_panel(sx)
    assert packed.users.count() == len(x[["region", "user"]].drop_duplicates()) and packed.n_words == x["word"].nunique()
    plans, cut_ = [], B.cut
    monkeypatch.setattr(B, "cut", lambda df: (plans.append((df.columns[0], df._jdf.queryExecution().executedPlan().toString())), cut_(df))[1])
    fits = [B.fit_regions(p, sy, lam_w=0.5, lam_u=0.5, epochs=2) for p in (packed, packed, sx)]
    steps = [plan for name, plan in plans if name == "r"]
    assert steps and not any("Exchange hashpartitioning" in plan or "SortMergeJoin" in plan for plan in steps)
    for table in ("w", "u", "bias"):
        parts = [getattr(f, table).toPandas() for f in fits]
        assert len(parts[0]) and all(parts[0].iloc[:, :-1].equals(p.iloc[:, :-1]) and np.allclose(parts[0].iloc[:, -1], p.iloc[:, -1], rtol=1e-3, atol=1e-4) for p in parts[1:])


def test_fit_by_cell_is_exact_in_few_steps():
    """Many counts of very different sizes on few days, among them copies: the splitting alone needed thousands of steps."""
    n, days = 400, 24
    draw = np.random.default_rng(3)
    columns = draw.poisson(2.0, (n, 1, days)) * np.exp(2 * draw.normal(size=(n, 1, 1))) * np.ones((1, 2, 1))
    columns[5], columns[7], columns[9] = columns[6], 2 * columns[8], 0
    y, seen, lam = draw.normal(size=(2, days)) + 2, draw.random((2, days)) < 0.9, np.full(2, 0.01)
    w, b = B.solve(columns, y, seen, lam, B.Penalty(), True, np.zeros((n, 2)), max_steps=0)
    residual = np.where(seen, np.einsum("ic,icd->cd", w, columns) + b[:, None] - y, 0)
    gradient = np.einsum("icd,cd->ic", columns, residual)
    assert (np.abs(gradient) <= lam * 1.001).all() and np.allclose(gradient[w != 0], (-np.sign(w) * lam)[w != 0], rtol=1e-3)
    assert np.allclose(residual.sum(axis=1), 0, atol=1e-8) and (w != 0).sum(axis=0).max() <= days


def test_experiment_packs_the_panel_once_for_all_folds(spark, data, monkeypatch):
    from loomline.queries import panel as queries

    packs, fits = [], []
    pack, fit = B.pack_panel, B.fit_regions
    monkeypatch.setattr(B, "pack_panel", lambda x: (packs.append(1), pack(x))[1])
    monkeypatch.setattr(B, "fit_regions", lambda x, y, **o: (fits.append(sorted(r.day for r in y.select("day").distinct().collect())), fit(x, y, epochs=1, **o))[1])
    scored = queries.panel_experiment(spark, data).toPandas()
    assert len(packs) == 1 and len(fits) == scored["fold"].nunique() > 1 and len({tuple(f) for f in fits}) == len(fits)
