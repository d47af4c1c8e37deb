import itertools
import math

import numpy as np
import pytest

from hydrosift.operators import boosting as B

FEATURES = ["a", "b", "c"]


def sample(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    cls = (x[:, 0] > 0.3).astype(int) + (x[:, 0] + x[:, 1] > 0.8)
    y = 3 * x[:, 0] + np.abs(x[:, 1]) + rng.normal(size=n) / 10
    rows = [(i, *map(float, r), int(k), float(v)) for i, (r, k, v) in enumerate(zip(x, cls, y, strict=True))]
    rows[3] = (3, None, float("nan"), *rows[3][3:])
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sample(), "id int, a double, b double, c double, cls int, y double").repartition(4).cache()


def plain_trees(rows, model):
    """The same boosting row by row in numpy, from the model's edges on."""
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    bins = B.binned(x, model.edges)
    y = np.array([r[4] if model.classes else r[5] for r in rows], float)
    score, opt, splits = np.tile(model.base, (len(rows), 1)).astype(float), model.opt, []
    for _ in range(opt.rounds):
        g, h = B.gradients(score, y, model.classes)
        for k in range(score.shape[1]):
            todo, step = [(1, np.arange(len(rows)))], np.zeros(len(rows))
            while todo:
                node, mine = todo.pop()
                best = (opt.min_gain + 1e-9, None)
                for f, cut in itertools.product(range(3), range(opt.bins)) if node < 1 << opt.depth else ():
                    left = bins[mine, f] <= cut
                    if not left.any() or left.all():
                        continue
                    s = lambda m: g[m, k].sum() ** 2 / (h[m, k].sum() + opt.l2 if opt.second_order else len(m))
                    gain = round(s(mine[left]) + s(mine[~left]) - s(mine), 9)
                    if gain > best[0]:
                        best = (gain, (f, cut, left))
                if best[1] is None:
                    step[mine] = B.leaf_value(g[mine, k].sum(), h[mine, k].sum(), len(mine), model.classes, opt)
                    continue
                f, cut, left = best[1]
                splits.append((len(splits), node, f))
                todo += [(2 * node, mine[left]), (2 * node + 1, mine[~left])]
            score[:, k] += step
    return score


CASES = [(0, B.Boosting(rounds=6, rate=0.3)), (3, B.Boosting(rounds=5, rate=0.3, refresh=2)),
         (0, B.Boosting(rounds=4, depth=4, second_order=True, l2=1.0)), (3, B.Boosting(rounds=4, depth=2, second_order=True, l2=1.0, min_gain=0.5, bins=8))]


@pytest.mark.parametrize("classes, opt", CASES)
def test_equals_plain_boosting(table, classes, opt):
    rows = sorted(map(tuple, table.collect()))
    model = B.fit(table, FEATURES, "cls" if classes else "y", classes, opt)
    got = sorted(B.predict(model, table).select("id", "scores", "prediction").collect())
    expect = plain_trees(rows, model)
    np.testing.assert_allclose(np.array([r.scores for r in got]), expect, rtol=1e-7, atol=1e-9)
    if classes:
        assert [r.prediction for r in got] == expect.argmax(axis=1).tolist()
        assert np.mean([r.prediction == x[4] for r, x in zip(got, rows, strict=True)]) > 0.85
    nodes = model.rows()
    assert all(n[7] > 0 for n in nodes) and {n[0] for n in nodes} == set(range(1, opt.rounds + 1))


@pytest.mark.parametrize("classes, opt", CASES[1:3])
def test_shares_equal_all_coalitions(table, classes, opt):
    model = B.fit(table, FEATURES, "cls" if classes else "y", classes, opt)
    rows = sorted(map(tuple, table.collect()))[:25]
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    bins = B.binned(x, model.edges)

    def worth(tree, row, known, node=1):
        f = int(tree.feature[node])
        if f < 0:
            return tree.value[node]
        if f in known:
            return worth(tree, row, known, 2 * node + int(bins[row, f] > tree.cut[node]))
        return sum(tree.rows[c] / tree.rows[node] * worth(tree, row, known, c) for c in (2 * node, 2 * node + 1))

    got = {(r.key, r["class"]): r for r in B.feature_shares(model, table, "id").collect()}
    scores = {r.id: r.scores for r in B.predict(model, table).collect()}
    assert len(got) == table.count() * max(1, classes)
    for i, r in enumerate(rows):
        for k in range(max(1, classes)):
            total = lambda known: sum(worth(g[k], i, known) for g in model.trees)  # noqa: B023, E731
            for f in range(3):
                others = [o for o in range(3) if o != f]
                expect = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (total({*s, f}) - total(set(s)))
                             for n in range(3) for s in itertools.combinations(others, n))
                assert got[r[0], k].shares[f] == pytest.approx(expect, abs=1e-9)
            assert got[r[0], k].base + sum(got[r[0], k].shares) == pytest.approx(scores[r[0]][k], abs=1e-9)
    ranking = B.share_ranking(model, table, "id").collect()
    assert [r.rank for r in sorted(ranking, key=lambda r: -r.mean_share)] == [1, 2, 3] and ranking[0].feature == "a"


def test_no_rows_and_one_value(spark, table):
    model = B.fit(table.limit(0), FEATURES, "y")
    assert model.trees == [] and {r.prediction for r in B.predict(model, table).collect()} == {0.0}
    flat = spark.createDataFrame([(1, 5.0, 2.0)] * 9 + [(2, 5.0, None)], "id int, a double, y double")
    model = B.fit(flat, ["a"], "y", opt=B.Boosting(rounds=2))
    assert [n[2] for n in model.rows()] == [1, 1]
    assert {r.prediction for r in B.predict(model, flat).collect()} == {2.0}
