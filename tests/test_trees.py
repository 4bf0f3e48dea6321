"""Contributions, interactions and the trainer against enumeration and plain loops."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auroral.operators import boosting, metrics, model, trees
from auroral.operators.boosting import Settings


def grow(rng, n, depth, x):
    """A random tree with the covers of ``x``."""
    nodes = []

    def add(rows, level):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(rng.normal()), float(len(rows)), False])
        if level and len(rows) > 3:
            f, missing = int(rng.integers(n)), bool(rng.integers(2))
            known = x[rows, f][~np.isnan(x[rows, f])]
            if len(known):
                cut = float(rng.choice(known))
                left = np.where(np.isnan(x[rows, f]), missing, x[rows, f] <= cut)
                if left.any() and not left.all():
                    nodes[at][:2], nodes[at][6] = [f, cut], missing
                    nodes[at][2], nodes[at][3] = add(rows[left], level - 1), add(rows[~left], level - 1)
        return at

    add(np.arange(len(x)), depth)
    return trees.Tree(*(np.array(c, kind) for c, kind in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, np.int64, float, float, bool), strict=True)))


def given(tree, x, known, node=0):
    """What the tree predicts when only the features in ``known`` are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        goes = tree.missing_left[node] if math.isnan(x[f]) else x[f] <= tree.threshold[node]
        return given(tree, x, known, left if goes else right)
    return sum(tree.cover[c] / tree.cover[node] * given(tree, x, known, c) for c in (left, right))


def by_subsets(forest, x, n):
    value = {s: sum(given(t, x, set(s)) for t in forest.trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    phi, pairs = np.zeros(n), np.zeros((n, n))
    for s in value:
        for i in set(range(n)) - set(s):
            w = math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
            phi[i] += w * (value[tuple(sorted({*s, i}))] - value[s])
            for j in set(range(n)) - set(s) - {i}:
                w = math.factorial(len(s)) * math.factorial(n - 2 - len(s)) / (2 * math.factorial(n - 1))
                pairs[i, j] += w * (value[tuple(sorted({*s, i, j}))] - value[tuple(sorted({*s, i}))] - value[tuple(sorted({*s, j}))] + value[s])
    pairs[np.arange(n), np.arange(n)] = phi - pairs.sum(1)
    return phi, pairs


@pytest.fixture(scope="module")
def forest():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 5)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    grown = tuple(grow(rng, 5, d, x) for d in (1, 3, 4, 5, 5))
    return trees.Forest(("a", "b", "c", "d", "e"), grown, (0,) * 5, (0.5,)), x


def test_contributions_and_interactions_equal_enumeration_of_subsets(forest):
    forest, x = forest
    phi, pairs = trees.shapley(forest, x[:25]), trees.shapley_pairs(forest, x[:25])
    for k in range(25):
        want, want_pairs = by_subsets(forest, x[k], 5)
        assert np.allclose(phi[k], want) and np.allclose(pairs[k], want_pairs)
    assert np.allclose(phi.sum(1) + forest.expected(), forest.margins(x[:25])[:, 0])
    assert np.allclose(pairs, pairs.transpose(0, 2, 1)) and np.allclose(pairs.sum(2), phi)
    again = trees.Forest.from_json(forest.to_json())
    assert (again.margins(x) == forest.margins(x)).all() and again.features == forest.features


def test_frames_of_contributions_and_the_strongest_pairs(spark, forest):
    forest, x = forest
    rows = [(k, *(None if math.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double").repartition(3)
    got = {r.k: r for r in trees.contributions(forest, trees.predict(forest, df)).collect()}
    phi, pairs = trees.shapley(forest, x), np.abs(trees.shapley_pairs(forest, x)).mean(0)
    assert all(np.allclose(r.contributions, phi[k]) and r.bias + sum(r.contributions) == pytest.approx(r.margins[0]) for k, r in got.items())
    means = {r.feature: r for r in trees.mean_contributions(forest, df).collect()}
    assert all(means[f].mean_abs == pytest.approx(np.abs(phi[:, k]).mean()) for k, f in enumerate(forest.features))
    strengths = trees.interaction_strengths(forest, df)
    assert {(r.feature, r.other): pytest.approx(r.mean_abs) for r in strengths.collect()} == {(f, g): pairs[i, j] for i, f in enumerate(forest.features) for j, g in enumerate(forest.features)}
    best = sorted(forest.features, key=lambda f: -(pairs[forest.features.index(f)].sum() - pairs[forest.features.index(f), forest.features.index(f)]))[:3]
    top = trees.top_interactions(strengths, 3).collect()
    assert {r.feature: r["rank"] for r in top} == {f: k + 1 for k, f in enumerate(best)} and len(top) == 6
    assert trees.contributions(forest, df.limit(0)).count() == 0
    assert trees.sample(df, "k", 10).collect() == trees.sample(df.repartition(7), "k", 10).collect()


def test_export_of_a_fitted_model_predicts_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if rng.random() < 0.2 else float(a), float(b), float(2 * a - b)) for k, (a, b) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    fitted = model.train_forecast(df, ["a", "b"], "y", rounds=5, depth=3)
    exported = trees.from_gbt(fitted, ["a", "b"], model.MISSING)
    shown = trees.contributions(exported, trees.predict(exported, model.predict(fitted, df, ["a", "b"]))).collect()
    assert all(r.margins[0] == pytest.approx(r.prediction) and r.bias + sum(r.contributions) == pytest.approx(r.prediction) for r in shown)
    assert {len(r.contributions) for r in shown} == {2}


# --- the trainer


def plain_trainer(x, y, w, cuts, settings, groups, gradient):
    """One output; every split tried in turn."""
    n = x.shape[1]
    bins = np.column_stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(c, x[:, k], side="left")) for k, c in enumerate(cuts)])
    margin, out = np.zeros(len(x)), []
    for _ in range(settings.rounds):
        g, h = gradient(y, margin)
        g, h = np.rint(g * w * boosting.UNIT) / boosting.UNIT, np.rint(h * w * boosting.UNIT) / boosting.UNIT
        leaves, paths = [], []

        def grow(rows, path, level):
            best = None
            if level:
                G, H = g[rows].sum(), h[rows].sum()
                for f in sorted(boosting.allowed_features(path, groups, n)):
                    for b in sorted(set(bins[rows, f]) - {0}):
                        for missing_left in (False, True) if (bins[rows, f] == 0).any() else (False,):
                            left = (bins[rows, f] <= b) & (bins[rows, f] > 0) | (bins[rows, f] == 0) & missing_left
                            a, c = rows[left], rows[~left]
                            if not len(a) or not len(c) or h[a].sum() < settings.min_weight or h[c].sum() < settings.min_weight:
                                continue
                            score = lambda s, t: s * s / (t + settings.penalty)
                            gain = (score(g[a].sum(), h[a].sum()) + score(G - g[a].sum(), H - h[a].sum()) - score(G, H)) / 2
                            if gain > settings.min_gain and gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, a, c)
            if best is None:
                leaves.append((rows, -settings.rate * g[rows].sum() / (h[rows].sum() + settings.penalty)))
                paths.append(path)
                return
            grow(best[2], path | {best[1]}, level - 1)
            grow(best[3], path | {best[1]}, level - 1)

        grow(np.arange(len(x)), frozenset(), settings.depth)
        for rows, value in leaves:
            margin[rows] += value
        out.append(paths)
    return margin, out


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 4)), 2)
    x[rng.random(x.shape) < 0.1] = np.nan
    filled = np.nan_to_num(x, nan=0.7)
    y = np.round(filled[:, 0] * filled[:, 1] + np.where(filled[:, 2] > 0, 2.0, 0.0) - filled[:, 3], 3)
    w = rng.choice([0.5, 1.0, 2.0], 400)
    rows = [(k, *(None if math.isnan(v) else float(v) for v in r), float(t), float(v), int(t > 1), int(np.digitize(t, [-0.5, 1.5]))) for k, (r, t, v) in enumerate(zip(x, y, w, strict=True))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y double, w double, hot int, kind int").repartition(5)
    return df, x, y, w


@pytest.mark.parametrize("constraints", [None, "[[0, 1], [2, 3]]", "[[0, 1, 2]]"])
def test_trainer_equals_plain_loops_and_keeps_groups_apart(spark, training, constraints):
    df, x, y, w = training
    settings = Settings(rounds=2 if constraints else 3, depth=3, rate=0.3, min_weight=2.0, every=2)
    features = ["a", "b", "c", "d"]
    cuts = [sorted({float(v) for v in np.round(np.nanquantile(x[:, k], np.arange(1, 8) / 8), 2)}) for k in range(4)]
    forest = boosting.train(df, features, "y", settings=settings, weight="w", constraints=constraints, cuts=cuts)
    groups = [frozenset(g) for g in json.loads(constraints)] if constraints else None
    want, paths = plain_trainer(x, y, w, cuts, settings, groups, lambda y, m: (m - y, np.ones(len(y))))
    assert np.allclose(forest.margins(x)[:, 0], want)
    used = [{frozenset(f) for _, f, _, _ in t.paths()} for t in forest.trees]
    assert used == [set(p) for p in paths]
    if groups:
        assert all(len(p) < 2 or any(p <= g for g in groups) for u in used for p in u)
    if constraints:
        return
    # rows dealt out otherwise give the same trees, bit for bit
    again = boosting.train(df.repartition(2), features, "y", settings=settings, weight="w", constraints=constraints, cuts=cuts)
    assert again.to_json() == forest.to_json()


def test_registered_stumps_split_where_the_penalty_outweighs_the_gain(spark, tmp_path):
    """Labels about 50000 that features hardly move: the best split of each round, as the SQL takes it, lowers the score."""
    from auroral import catalogue

    rng = np.random.default_rng(3)
    n = 200
    x = np.column_stack([rng.integers(1, 51, n), rng.integers(0, 11, n) / 100, rng.integers(0, 9, n) / 100]).astype(float)
    y = 50000 + np.round(rng.normal(size=n), 2)
    spark.createDataFrame([(k, 1, *map(float, row), float(v)) for k, (row, v) in enumerate(zip(x, y, strict=True))], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    margin, phi, bias = np.zeros(n), np.zeros((n, 3)), 0.0
    for _ in range(2):
        g, best = margin - y, None
        for f, cuts in enumerate(catalogue.STUMP_FEATURES.values()):
            for cut in cuts:
                left = x[:, f] <= cut
                score = g[left].sum() ** 2 / (left.sum() + 1) + g[~left].sum() ** 2 / ((~left).sum() + 1) - g.sum() ** 2 / (n + 1)
                if best is None or score > best[0]:
                    best = score, f, left
        score, f, left = best
        assert score < 0
        leaf = np.where(left, -0.5 * g[left].sum() / (left.sum() + 1), -0.5 * g[~left].sum() / ((~left).sum() + 1))
        margin, bias = margin + leaf, bias + leaf.mean()
        phi[:, f] += leaf - leaf.mean()
    got = catalogue.queries()["stump_contributions"](spark, str(tmp_path)).orderBy("l_orderkey").collect()
    assert np.allclose([(r.c0, r.c1, r.c2) for r in got], phi, rtol=0, atol=1e-3) and np.abs(phi).max() > 1
    assert got[0].bias == pytest.approx(bias, abs=1e-3)
    shown = catalogue.queries()["boosted_stumps"](spark, str(tmp_path)).orderBy("l_orderkey").collect()
    assert np.allclose([r.prediction for r in shown], margin, rtol=0, atol=1e-3)


def test_objectives_lower_their_loss_and_validation_ends_training(spark, training):
    df, x, y, w = training
    features, settings = ["a", "b", "c", "d"], Settings(rounds=3, depth=2, rate=0.2)
    for label, objective in (("y", boosting.asymmetric()), ("y", boosting.absolute()), ("hot", boosting.logistic()), ("hot", boosting.focal()), ("kind", boosting.multiclass_focal(3, gamma=1.0, exact=True))):
        heard = []
        fitted = boosting.train(df.withColumn("v", F.lit(True)).unionByName(df.withColumn("v", F.lit(False))), features, label, objective, settings, validation="v", watch=lambda r, loss: heard.append(loss) and False)  # noqa: B023
        assert heard[-1] < heard[0] and len(fitted.trees) == 3 * objective.outputs
    stopped = boosting.train(df.withColumn("v", F.col("k") % 3 == 0), features, "y", settings=settings, validation="v", watch=lambda r, loss: r == 1)
    assert len(stopped.trees) == 2
    noise = df.withColumn("v", F.col("k") % 2 == 0).withColumn("z", F.when(F.col("v"), F.lit(0.0)).otherwise(F.col("y")))
    assert len(boosting.train(noise, features, "z", settings=Settings(rounds=6, depth=2, rate=0.9, patience=1), validation="v").trees) < 6
    few = boosting.train(df.where("k < 0"), features, "y", settings=settings, cuts=[[], [], [], []])
    assert all(len(t.feature) == 1 and t.value[0] == 0 for t in few.trees)
    some = boosting.train(df, features, "y", settings=Settings(rounds=2, depth=2, columns=0.5, rows=0.5))
    assert len(some.trees) == 2


def test_focal_gradients(spark):
    margins = [-3.0, -0.4, 0.0, 0.7, 2.5]
    rows = [(y, m) for y in (0, 1) for m in margins]
    df = spark.createDataFrame(rows, "y int, m double")
    step, sigmoid = 1e-5, lambda m: 1 / (1 + math.exp(-m))

    def loss(y, m):
        p = sigmoid(m)
        return -0.25 * (1 - p) ** 2 * math.log(p) if y else -0.75 * p**2 * math.log(1 - p)

    g, h = metrics.focal_gradient(F.col("y"), F.col("m"))
    for r in df.select("y", "m", g.alias("g"), h.alias("h")).collect():
        p = sigmoid(r.m)
        assert r.g == pytest.approx((loss(r.y, r.m + step) - loss(r.y, r.m - step)) / (2 * step), abs=1e-6)
        assert r.h == pytest.approx(max(3 * (0.25 * p * (1 - p) ** 2 if r.y else 0.75 * (1 - p) * p**2), 1e-7))
    logits = [[0.2, -1.0, 0.5], [2.0, 0.0, -2.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(y, m) for y in range(3) for m in logits], "y int, m array<double>")

    def many(y, m):
        p = np.exp(m) / np.exp(m).sum()
        return -((1 - p[y]) ** 2) * math.log(p[y])

    for exact in (False, True):
        pairs = metrics.multiclass_focal_gradient(F.col("y"), F.col("m"), 3, class_weights=[1.0, 2.0, 4.0], exact=exact)
        for r in df.select("y", "m", F.array(*[g for g, _ in pairs]).alias("g"), F.array(*[h for _, h in pairs]).alias("h"), metrics.multiclass_focal_loss(F.col("y"), F.col("m"), 3).alias("l")).collect():
            m, weight = np.array(r.m), 2**r.y
            p, own = np.exp(m) / np.exp(m).sum(), np.eye(3)[r.y]
            q = p[r.y]
            assert r.l == pytest.approx(many(r.y, m))
            assert r.h == pytest.approx(list(np.maximum((1 - q) ** 2 * p * (1 - p), 1e-6) * weight))
            if exact:
                assert r.g == pytest.approx([weight * (many(r.y, m + step * e) - many(r.y, m - step * e)) / (2 * step) for e in np.eye(3)], abs=1e-5)
            else:
                assert r.g == pytest.approx(list(((1 - q) ** 2 + 2 * (1 - q) * math.log(q) * q) * (p - own) * weight))
