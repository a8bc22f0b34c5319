"""Gradient-boosted regression trees of all categories in one training.

Every category has trees of its own, but they grow together: a level of all
trees of one round is one DataFrame aggregate over (category, tree node,
feature bin), whatever the number of categories. A task turns its rows into
partial histograms (counts and sums of gradients by node, feature and bin);
those are dealt by (category, node), added up, and the cumulated sums over the
bins of each feature give the split of greatest gain. Only the chosen splits, one
row a node, come back to the driver: that is the model. After each tree the rows
are written anew with their forecast so far, so that a level costs the same
in the last tree as in the first.

The result does not depend on how rows are laid out over files, partitions or
batches. Bins are cut at exact quantiles of the values of a category, gradients
are scaled to integers, whose sums know no order, and ties between splits go to
the first feature, then the lowest bin.

As in Spark ML's regressor, the first tree is fitted on the labels with
weight 1, later ones on twice the residual with weight ``step``; a split needs
a gain above 0. A missing value (NULL or NaN) goes right.
"""

from __future__ import annotations

import math
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, importable, stored

#: Values are rounded down to this many binary digits for the bin bounds, so that a
#: feature has at most 2**(DIGITS - 1) different ones between two powers of two.
DIGITS = 13
#: Nodes whose partial histogram a task holds before it hands them on.
HELD_NODES = 4_096
#: Rows that are summed at once; with gradients below 2**36 a sum of them is exact in a double.
CHUNK_ROWS = 1 << 17
#: Bytes of trees that may be broadcast to the scoring tasks; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


class Forest(NamedTuple):
    """Trees of every category; nodes are numbered as in a heap, the root is 1."""

    categories: list[str]
    features: tuple[str, ...]
    feature: np.ndarray  # category x tree x node: the feature that splits it, -1 at a leaf
    bound: np.ndarray  # category x tree x node: values up to it go left
    value: np.ndarray  # category x tree x node: the mean gradient there
    weight: np.ndarray  # category x tree

    @property
    def depth(self) -> int:
        return int(self.feature.shape[2]).bit_length() - 2


def empty_forest(categories: list[str], features: Iterable[str], trees: int, depth: int) -> Forest:
    shape = (len(categories), trees, 2 << depth)
    return Forest(categories, tuple(features), np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape), np.zeros(shape[:2]))


def descend(feature: np.ndarray, bound: np.ndarray, group: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row of ``x`` reaches in the tree of its group (feature, bound: group x node)."""
    node = np.ones(len(x), np.int64)
    first, row = group * feature.shape[1], np.arange(len(x)) * x.shape[1]
    x, feature, bound = (np.ascontiguousarray(a).ravel() for a in (x, feature, bound))
    for _ in range(depth):
        at = first + node
        f = feature.take(at)
        right = ~(x.take(row + np.maximum(f, 0)) <= bound.take(at))
        node = np.where(f < 0, node, 2 * node + right)
    return node


def exact_sums(at: np.ndarray, parts: list[tuple[int, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the integers that ``parts`` holds (see ``in_doubles``) and the number of rows at each place, exact."""
    total = sum(np.bincount(at, weights=part, minlength=size).astype(np.int64) << shift for shift, part in parts)
    return total, np.bincount(at, minlength=size)


def in_doubles(g: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The integers ``g`` as (shift, doubles) whose sums over all rows stay exact: one part, or two of fewer digits."""
    if not len(g) or int(np.abs(g).max()) * len(g) < 1 << 53:
        return [(0, g.astype(np.float64))]
    return [(26, (g >> 26).astype(np.float64)), (0, (g & 0x3FFFFFF).astype(np.float64))]


# Bins


def _grid(value: Column) -> Column:
    """``value`` rounded down to DIGITS binary digits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - (DIGITS - 1))
    whole = (value == F.floor(value)) & (F.abs(value) < 1 << DIGITS)
    parts = (value * 64 == F.floor(value * 64)) & (F.abs(value) < 1 << DIGITS - 6)
    return F.when(whole | parts, value).otherwise(F.floor(value / step) * step)  # most values are on the grid as they are


def bin_bounds(rows: DataFrame, features: tuple[str, ...], bins: int) -> DataFrame:
    """(category, feature, bound): the bounds between bins, ascending, at most ``bins`` - 1 a feature.

    Exact: values are counted first (map-side), then cut where the share of
    smaller rows passes a multiple of 1 / ``bins``; a feature with few values has a bin each.
    """
    values = F.array(*(_grid(F.col(c).cast("double")) for c in features))
    counted = rows.select("category", F.posexplode(values).alias("feature", "v")).groupBy("category", "feature", "v").agg(F.count("*").alias("n"))
    one = Window.partitionBy("category", "feature")
    up = one.orderBy("v")
    smaller = F.sum("n").over(up) - F.col("n")
    bin_ = F.when(F.count("*").over(one) <= bins, F.row_number().over(up)).otherwise(F.floor(smaller * bins / F.sum("n").over(one)))
    cut = counted.withColumn("bin", bin_.cast("long")).withColumns({"next": F.lead("v").over(up), "next_bin": F.lead("bin").over(up)})
    return cut.where("next_bin <> bin").select("category", "feature", ((F.col("v") + F.col("next")) / 2).alias("bound"))


def _bounds(table: DataFrame, categories: list[str], n_features: int, bins: int) -> np.ndarray:
    """category x feature x bound, filled up with infinity: a part of the model, of bounded size."""
    out = np.full((len(categories), n_features, bins - 1), np.inf)
    index = {c: i for i, c in enumerate(categories)}
    got = table.toArrow()
    where: dict[tuple[int, int], list[float]] = {}
    for c, f, b in zip(got["category"].to_pylist(), got["feature"].to_pylist(), got["bound"].to_pylist()):
        if c in index:
            where.setdefault((index[c], f), []).append(b)
    for (c, f), b in where.items():
        out[c, f, : len(b)] = sorted(b)
    return out


def binned(rows: DataFrame, features: tuple[str, ...], label: str, categories: list[str], bounds: np.ndarray) -> DataFrame:
    """(groups, bins, y) as blocks of rows, each a few long binary values: a pass over the table moves blocks, not rows.

    A row's bin of a feature is one byte, the number of bounds below its value.
    """
    names = pa.array(categories, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            group = pc.index_in(batch.column(0), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty((len(group), len(features)), np.uint8)
            for f in range(len(features)):
                x = batch.column(2 + f).to_numpy(zero_copy_only=False)
                out[:, f] = bins_of(x, group, bounds[:, f])
            if len(group):
                y = batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"groups": [group.astype(np.int32).tobytes()], "bins": [out.tobytes()], "y": [y.tobytes()]})

    wanted = rows.where(F.col("category").isin(categories)) if len(categories) <= 100 else rows.join(_broadcast_names(rows.sparkSession, categories), "category", "left_semi")
    plain = wanted.select("category", F.col(label).cast("double"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    return plain.mapInArrow(run, "groups binary, bins binary, y binary")


def _broadcast_names(spark: SparkSession, categories: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c,) for c in categories], "category string"))  # a name a model


def bins_of(x: np.ndarray, group: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each value, how many bounds of its group (group x bound, ascending) lie below it; NaN is above all."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), bounds.shape[1])
    while (open_ := low < high).any():  # a binary search for all rows at once
        mid = (low + high) // 2
        right = open_ & ~(x <= bounds[group, np.minimum(mid, bounds.shape[1] - 1)])
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


# Growing


def scales(rows_of: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """The power of two that makes a category's gradients integers whose sum fits in 64 bits."""
    room = [61 - math.frexp(8.0 * m + 1.0)[1] - int(n).bit_length() for n, m in zip(rows_of.tolist(), largest.tolist())]
    return np.array([min(20, r) for r in room], np.int64)


def gradients(y: np.ndarray, sofar: np.ndarray | None, group: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The integer gradients that the next tree is fitted on; ``sofar`` is the forecast of the trees before it."""
    return np.rint(np.ldexp(y if sofar is None else 2.0 * (y - sofar), shift[group])).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], width: int, rows: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Category number, bins, label and forecast so far (None before the first tree) of blocks, joined to at least ``rows`` rows but for the last."""

    def joined() -> tuple:
        return tuple(None if part[0] is None else np.concatenate(part) for part in zip(*held))

    held, n = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            g, x, y, *more = (batch.column(c)[i].as_buffer() for c in range(batch.num_columns))
            group = np.frombuffer(g, np.int32).astype(np.int64)
            held.append((group, np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y, np.float64), np.frombuffer(more[0], np.float64) if more else None))
            n += len(group)
            if n >= rows:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def advanced(table: DataFrame, cuts: Forest, tree: int) -> DataFrame:
    """The blocks with what tree number ``tree`` adds to their forecast so far."""
    width, depth = len(cuts.features), cuts.depth
    feature, bound, value, weight = cuts.feature[:, tree], cuts.bound[:, tree], cuts.value[:, tree], cuts.weight[:, tree]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bins, y, sofar in blocks(batches, width):
            added = weight[group] * value[group, descend(feature, bound, group, bins, depth)]
            now = added if sofar is None else sofar + added
            yield pa.RecordBatch.from_pydict({"groups": [group.astype(np.int32).tobytes()], "bins": [bins.tobytes()], "y": [y.tobytes()], "sofar": [now.tobytes()]})

    return table.mapInArrow(run, "groups binary, bins binary, y binary, sofar binary")


def histograms(table: DataFrame, cuts: Forest, tree: int, level: int, n_bins: int, shift: np.ndarray) -> DataFrame:
    """(slot, sums): a row a node (slot: category and node) with its partial sums and counts by feature and bin, as 64-bit integers."""
    width, groups = len(cuts.features), len(cuts.categories)
    nodes, cells = 2 << cuts.depth, len(cuts.features) * n_bins
    feature, bound = cuts.feature[:, tree], cuts.bound[:, tree]
    dense = groups << level <= HELD_NODES  # every node of the level has its place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([h.tobytes() for h in held.values()], pa.binary())], names=["slot", "sums"])
            held.clear()
            return out

        whole = np.zeros((2, width, groups << level, n_bins), np.int64) if dense else None
        for group, bins, y, sofar in blocks(batches, width, CHUNK_ROWS):
            node = descend(feature, bound, group, bins, level)
            if not (there := node >= 1 << level).all():  # the others stopped at a leaf above
                group, bins, y, node = group[there], bins[there], y[there], node[there]
                sofar = None if sofar is None else sofar[there]
            parts = in_doubles(gradients(y, sofar, group, shift))
            if dense:
                slots, slot = None, (group << level) + node - (1 << level)
            else:
                slots, slot = np.unique(group * nodes + node, return_inverse=True)
            size = groups << level if dense else len(slots)
            sums = whole if dense else np.zeros((2, width, size, n_bins), np.int64)
            first = slot * n_bins
            for f in range(width):
                total, n = exact_sums(first + bins[:, f], parts, size * n_bins)
                sums[0, f] += total.reshape(size, n_bins)
                sums[1, f] += n.reshape(size, n_bins)
            if not dense:
                for i, s in enumerate(slots.tolist()):
                    own = sums[:, :, i]
                    held[s] = held[s] + own if s in held else own.copy()
                if len(held) >= HELD_NODES:
                    yield handed()
        if dense:
            for i in np.flatnonzero(whole[1, 0].any(axis=1)).tolist():
                c, node = divmod(i, 1 << level)
                held[c * nodes + (1 << level) + node] = whole[:, :, i]
        if held:
            yield handed()

    return table.mapInArrow(run, "slot long, sums binary")


def split_of(g: np.ndarray, n: np.ndarray) -> tuple[int, int, int, int] | None:
    """(feature, bin, left g, left n) of the greatest gain above 0 in sums by feature x bin; None if there is none."""
    total, rows = int(g[0].sum()), int(n[0].sum())
    gl, nl = np.cumsum(g, axis=1), np.cumsum(n, axis=1)
    left, right = gl.astype(np.float64), (total - gl).astype(np.float64)
    ok = (n > 0) & (nl < rows)
    gain = np.full(g.shape, -np.inf)
    gain[ok] = left[ok] * left[ok] / nl[ok] + right[ok] * right[ok] / (rows - nl[ok]) - float(total) * float(total) / rows
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)  # the first of equal ones
    return (int(f), int(b), int(gl[f, b]), int(nl[f, b])) if gain[f, b] > 0 else None


def best_splits(partial: DataFrame, width: int, n_bins: int) -> DataFrame:
    """One row a node: its sums (gt, nt) and its best split (f, b) with the sums of its left side (gl, nl).

    The partial sums are dealt by node and added up as they come; of a node
    at most features x bins sums are held.
    """
    kinds = pa.schema([(c, pa.int64()) for c in ("slot", "gt", "nt", "f", "b", "gl", "nl")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the nodes of this partition
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(sums.as_buffer(), np.int64)
                held[slot] = held[slot] + part if slot in held else part.copy()
        out = []
        for s, sums in held.items():
            g, n = sums.reshape(2, width, n_bins)
            out.append((s, int(g[0].sum()), int(n[0].sum()), *(split_of(g, n) or (None,) * 4)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kinds)

    return partial.repartition("slot").mapInArrow(run, "slot long, gt long, nt long, f long, b long, gl long, nl long")


def fit(
    rows: DataFrame,
    features: Iterable[str],
    label: str = "demand",
    categories: Iterable[str] | None = None,
    trees: int = 10,
    depth: int = 5,
    bins: int = 32,
    step: float = 0.1,
) -> Forest:
    """Grow the trees of every category that has rows (NULL names none); ``categories`` limits them.

    Rows must have no NULL in label or features.
    """
    features = tuple(features)
    if not 2 <= bins <= 256:
        raise ValueError("a bin number is one byte: 2 to 256 bins")
    spark = rows.sparkSession
    importable(spark)
    # One row a model: its name, number of rows and largest label.
    facts = rows.where(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"), F.max(F.abs(F.col(label).cast("double"))).alias("m")).toArrow()
    known = dict(zip(facts["category"].to_pylist(), zip(facts["n"].to_pylist(), facts["m"].to_pylist())))
    names = sorted(known.keys() if categories is None else set(categories) & known.keys())
    grown = empty_forest(names, features, trees, depth)
    if not names:
        return grown
    shift = scales(np.array([known[c][0] for c in names]), np.array([known[c][1] for c in names]))
    bounds = _bounds(bin_bounds(rows.where(F.col("category").isNotNull()), features, bins), names, len(features), bins)
    table, folder = stored(binned(rows, features, label, names, bounds), "binned-rows")
    cuts = grown._replace(bound=np.zeros_like(grown.bound))  # bounds as bin numbers while growing
    nodes = 2 << depth
    for tree in range(trees):
        if tree:
            before = folder
            table, folder = stored(advanced(table, cuts, tree - 1), "advanced-rows")
            discard(spark, before)
        grown.weight[:, tree] = 1.0 if not tree else step
        for level in range(depth):
            got = best_splits(histograms(table, cuts, tree, level, bins, shift), len(features), bins).collect()
            open_ = False
            for slot, gt, nt, f, b, gl, nl in got:  # a row a node
                c, node = divmod(slot, nodes)
                unit = math.ldexp(1.0, -int(shift[c]))
                grown.value[c, tree, node] = gt / nt * unit
                if f is None:
                    continue
                grown.feature[c, tree, node], cuts.bound[c, tree, node] = f, b
                grown.bound[c, tree, node] = bounds[c, f, b]
                grown.value[c, tree, 2 * node] = gl / nl * unit
                grown.value[c, tree, 2 * node + 1] = (gt - gl) / (nt - nl) * unit
                open_ = True
            if not open_:
                break
    return grown


# Scoring


def tree_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """The model as a table: (category, tree, node, feature, bound, value, weight), a row a node that exists."""
    rows = {k: [] for k in ("category", "tree", "node", "feature", "bound", "value", "weight")}
    for c, name in enumerate(forest.categories):
        for t in range(forest.feature.shape[1]):
            there = {1}
            for node in range(1, forest.feature.shape[2]):
                if node not in there:
                    continue
                f = int(forest.feature[c, t, node])
                if f >= 0:
                    there |= {2 * node, 2 * node + 1}
                row = (name, t, node, f if f >= 0 else None, float(forest.bound[c, t, node]) if f >= 0 else None, float(forest.value[c, t, node]), float(forest.weight[c, t]))
                for k, v in zip(rows, row):
                    rows[k].append(v)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    return spark.createDataFrame(pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)}))


def score(rows: DataFrame, forest: Forest, column: str = "model_forecast") -> DataFrame:
    """``rows`` with the forecast of their category's trees, NULL where it has none: one scan, one native expression.

    The trees of a category are one row, met on the category; that side is broadcast only while it is small.
    """
    nodes = forest.feature.shape[2]
    node = pa.list_(pa.float64())
    model = rows.sparkSession.createDataFrame(
        pa.table(
            {
                "_category": pa.array(forest.categories, pa.string()),
                "_feature": pa.array([x.ravel().tolist() for x in forest.feature], pa.list_(pa.int32())),
                "_bound": pa.array([x.ravel().tolist() for x in forest.bound], node),
                "_value": pa.array([x.ravel().tolist() for x in forest.value], node),
                "_weight": pa.array([x.tolist() for x in forest.weight], node),
            }
        )
    )
    small = forest.feature.size * 20 <= BROADCAST_BYTES
    out = rows.withColumn("_x", F.array(*(F.col(c).cast("double") for c in forest.features)))
    out = out.join(F.broadcast(model) if small else model, F.col("category") == F.col("_category"), "left")

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            place = tree * nodes + at + 1  # arrays count from 1, nodes from 0 with an empty one
            f = F.element_at("_feature", place.cast("int"))
            left = F.element_at("_x", f + 1) <= F.element_at("_bound", place.cast("int"))
            return F.when(f < 0, at).otherwise(2 * at + F.when(left, 0).otherwise(1)).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, forest.depth))), F.lit(1), step)

    def grow(total: Column, tree: Column) -> Column:
        return total + F.element_at("_weight", tree + 1) * F.element_at("_value", (tree * nodes + leaf(tree) + 1).cast("int"))

    trees = F.sequence(F.lit(0), F.lit(forest.feature.shape[1] - 1))
    found = F.when(F.col("_category").isNotNull(), F.aggregate(trees, F.lit(0.0), grow))
    return out.withColumn(column, found).drop("_x", "_category", "_feature", "_bound", "_value", "_weight")


def from_pipelines(models: dict, features: Iterable[str]) -> Forest:
    """The trees of fitted Spark ML pipelines (assembler, boosted trees), one a category, as one forest."""
    names = sorted(models)
    fitted = [models[c].stages[-1] for c in names]
    depth = max((t.depth for m in fitted for t in m.trees), default=0)
    out = empty_forest(names, features, max((len(m.trees) for m in fitted), default=0), depth)

    def walk(node, c: int, t: int, at: int) -> None:
        out.value[c, t, at] = node.prediction()
        if node.subtreeDepth():
            out.feature[c, t, at], out.bound[c, t, at] = node.split().featureIndex(), node.split().threshold()
            walk(node.leftChild(), c, t, 2 * at)
            walk(node.rightChild(), c, t, 2 * at + 1)

    for c, model in enumerate(fitted):
        for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
            out.weight[c, t] = weight
            walk(tree._call_java("rootNode"), c, t, 1)
    return out
