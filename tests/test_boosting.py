"""Boosted trees of all categories in one training, against a plain numpy version and Spark ML."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.config import DEFAULT
from replenish.operators import boosting, forecast, split

FEATURES = ("a", "b", "c")


def plain_bounds(x, bins):
    """Bounds of one feature of one category (values on the grid already)."""
    values, n = np.unique(x, return_counts=True)
    if len(values) <= bins:
        at = np.arange(1, len(values) + 1)
    else:
        at = (np.cumsum(n) - n) * bins // n.sum()
    return [(values[i] + values[i + 1]) / 2 for i in range(len(values) - 1) if at[i + 1] != at[i]]


def plain_fit(x, y, trees, depth, bins, shift, step):
    """Trees of one category as {node: (feature, bound) or None} with values, by loops over nodes and bins."""
    bounds = [plain_bounds(x[:, f], bins) for f in range(x.shape[1])]
    out, total = [], np.zeros(len(y))
    for t in range(trees):
        g = [int(v) for v in np.rint(np.ldexp(2 * (y - total) if t else y, shift))]
        tree, where = {}, {1: list(range(len(y)))}
        for node in range(1, 2 << depth):
            rows = where.get(node)
            if not rows:
                continue
            whole, best = sum(g[i] for i in rows), None
            if node < 1 << depth:
                for f, cuts in enumerate(bounds):
                    for b in cuts:
                        left = [i for i in rows if x[i, f] <= b]
                        if not left or len(left) == len(rows):
                            continue
                        gl = sum(g[i] for i in left)
                        gain = float(gl) * float(gl) / len(left) + float(whole - gl) * float(whole - gl) / (len(rows) - len(left)) - float(whole) * float(whole) / len(rows)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, b)
            tree[node] = (best and best[1:], whole / len(rows) * math.ldexp(1.0, -shift))
            if best:
                _, f, b = best
                where[2 * node] = [i for i in rows if x[i, f] <= b]
                where[2 * node + 1] = [i for i in rows if x[i, f] > b]
        out.append(tree)
        for i in range(len(y)):
            node = 1
            while tree[node][0]:
                f, b = tree[node][0]
                node = 2 * node + (x[i, f] > b)
            total[i] += (step if t else 1.0) * tree[node][1]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = []
    for name, n in (("hot", 400), ("small", 37), ("one", 1), ("flat", 12), (None, 9)):
        for _ in range(n):
            a, b, c = int(rng.integers(0, 60)), int(rng.integers(0, 3)), float(rng.integers(0, 900)) / 8
            y = 5.0 if name == "flat" else round(float(a * 2 - 30 * (b == 1) + 0.1 * c + rng.normal()), 3)
            data.append((name, a, b, c, y))
    return spark.createDataFrame(data, "category string, a int, b int, c double, demand double").cache()


def test_trees_equal_the_plain_version(rows):
    forest = boosting.fit(rows, FEATURES, trees=3, depth=3, bins=8, step=0.1)
    assert forest.categories == ["flat", "hot", "one", "small"]
    local = rows.toPandas()
    for c, name in enumerate(forest.categories):
        own = local[local.category == name]
        x, y = own[list(FEATURES)].to_numpy(float), own.demand.to_numpy()
        shift = int(boosting.scales(np.array([len(y)]), np.array([np.abs(y).max()]))[0])
        for t, tree in enumerate(plain_fit(x, y, 3, 3, 8, shift, 0.1)):
            for node, (cut, value) in tree.items():
                assert forest.value[c, t, node] == pytest.approx(value, abs=1e-12), (name, t, node)
                got = (int(forest.feature[c, t, node]), float(forest.bound[c, t, node])) if forest.feature[c, t, node] >= 0 else None
                assert got == cut, (name, t, node)


def test_the_same_trees_for_any_layout(rows):
    a, b = (boosting.fit(rows.repartition(n), FEATURES, trees=4, depth=4) for n in (4, 64))
    assert a.categories == b.categories
    for x, y in zip(a[2:], b[2:]):
        assert np.array_equal(x, y)


def test_sums_are_exact_and_the_same_in_every_form(rows, monkeypatch):
    g = np.array([(1 << 60) - 1, -(1 << 59) - 7, 3, -5, 1 << 33], np.int64)
    at = np.array([0, 0, 1, 1, 2])
    for values in (g, g % 1000):
        total, n = boosting.exact_sums(at, boosting.in_doubles(values), 4)
        assert total.tolist() == [int(values[:2].sum()), int(values[2:4].sum()), int(values[4]), 0] and n.tolist() == [2, 2, 1, 0]
    whole = boosting.fit(rows, FEATURES, trees=3, depth=3)
    monkeypatch.setattr(boosting, "HELD_NODES", 2)  # places for found nodes only, handed on early
    few = boosting.fit(rows, FEATURES, trees=3, depth=3)
    for x, y in zip(whole[2:], few[2:]):
        assert np.array_equal(x, y)


def test_a_level_descends_one_tree_and_old_rows_go(spark, rows, monkeypatch):
    """A later tree takes the forecast so far from its rows; the rows of the tree before are deleted."""
    import os

    folders, stored = [], boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda df, name: folders.append(stored(df, name)) or folders[-1])
    boosting.fit(rows, FEATURES, trees=3, depth=2)
    assert [df.columns[3:] for df, _ in folders] == [[], ["sofar"], ["sofar"]]
    assert [os.path.exists(path) for _, path in folders] == [False, False, True]


def test_scores_are_those_of_the_trees(rows):
    forest = boosting.fit(rows, FEATURES, trees=3, depth=3)
    out = boosting.score(rows, forest).toPandas()
    local = out[out.category.notna()]
    group = np.array([forest.categories.index(c) for c in local.category])
    x, want = local[list(FEATURES)].to_numpy(float), np.zeros(len(local))
    for t in range(3):
        node = boosting.descend(forest.feature[:, t], forest.bound[:, t], group, x, forest.depth)
        want += forest.weight[group, t] * forest.value[group, t, node]
    assert np.array_equal(want, local.model_forecast.to_numpy())
    assert out[out.category.isna()].model_forecast.isna().all()
    table = boosting.tree_table(rows.sparkSession, forest)
    assert table.where("category = 'one'").count() == 3  # a leaf a tree
    assert table.where("feature is not null").count() * 2 + 3 * len(forest.categories) == table.count()


def test_missing_values_go_right(rows):
    forest = boosting.fit(rows, FEATURES, trees=2, depth=2)
    one = rows.where("category = 'hot'").limit(1).drop("a")
    got = boosting.score(one.withColumn("a", F.lit(None).cast("int")), forest).first().model_forecast
    assert got == boosting.score(one.withColumn("a", F.lit(float("nan"))), forest).first().model_forecast
    assert got == boosting.score(one.withColumn("a", F.lit(1e9)), forest).first().model_forecast


def test_one_scan_scores_as_spark_ml_does(spark, inputs_small):
    demand, _ = inputs_small
    table = forecast.materialize(forecast.featured(demand), "test-featured")
    models = forecast.train_context_aware_model(forecast.training_rows(table), categories=["ECONOMY", "PROMO"])
    test = table.filter(split.test_filter(DEFAULT))
    got = forecast.scored(test, models)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    for c, model in models.items():
        want = model.transform(test.filter(F.col("category") == c)).select("product_id", "date", "prediction")
        both = got.join(want, ["product_id", "date"])
        assert both.count() == want.count() > 0
        assert both.filter("abs(model_forecast - prediction) > 1e-12 * greatest(1, abs(prediction))").count() == 0
    assert got.filter("model_forecast is null").count() == test.filter(~F.col("category").isin(list(models))).count()


def test_fits_about_as_well_as_spark_ml(spark, inputs_small):
    demand, _ = inputs_small
    table = forecast.materialize(forecast.featured(demand), "test-featured")
    train = forecast.training_rows(table).filter("category = 'ECONOMY'")
    error = lambda m: forecast.scored(train, m).select(F.sqrt(F.avg((F.col("demand") - F.col("model_forecast")) ** 2))).first()[0]
    assert error(forecast.train_forest(train)) < 1.02 * error(forecast.train_context_aware_model(train))


def test_nothing_to_learn_from(spark, rows):
    forest = boosting.fit(rows.limit(0), FEATURES)
    assert forest.categories == []
    with pytest.raises(ValueError, match="no models"):
        forecast.get_context_aware_forecast(rows, forest)
    assert boosting.score(rows, boosting.fit(rows, FEATURES, categories=["small", "unknown"], trees=1)).where("model_forecast is not null").count() == 37
