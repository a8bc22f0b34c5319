"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership
pattern (the set of sources), so the flow network has one node a pattern and
one a source, however many documents there are. Words flow from a pattern to
the sources it is in, up to each source's target. Each further pass over a
pattern costs one more than the pass before (convex), so the cheapest flow
repeats as little as possible. A pattern's flow is then taken from its
documents: whole passes for all, and one more pass for documents in the order
of a seeded hash until the rest is used up (or, if that is more than half, for
all but documents so chosen). Later rounds fill what the first document too long
for the gap leaves, until no open document fits; each at least halves the gap. Then
the smallest open document is let across if that ends nearer.

Prefix sums run in two levels (ranges of the hash, then one range), so a
source with a third of all documents is never ordered in one task. The driver
holds one row a pattern and source, nothing a document.

Defined results: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken 0 words; repeated rows are
documents of their own; ties in the hash go by id and size; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words; passes over a document at most.
SHARE, PASSES = 1.5, 2
SEED = 17
#: Documents in one range of the hash, about.
RANGE_ROWS = 500
#: Patterns whose table may be broadcast (a row each); more are joined by shuffle.
PATTERN_ROWS = 50_000


class Plan(NamedTuple):
    targets: dict[str | None, float]
    routes: list[tuple[tuple[str | None, ...], str | None, int]]  # pattern, source, words


def by_code_point(sources) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, total: int | None = None) -> dict[str | None, float]:
    """Words wanted of each source: by weight, at most ``passes`` times its size, the excess shared again."""
    names = by_code_point(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = share * (sum(sizes.values()) if total is None else total)
    out: dict[str | None, float] = {}
    free = list(names)
    while free:
        whole = sum(weight[s] for s in free)
        part = {s: left * weight[s] / whole for s in free}
        above = [s for s in free if part[s] > passes * sizes[s]]
        if not above:
            return out | part
        for s in above:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in above]
    return out


def route(patterns: dict[tuple[str | None, ...], int], wanted: dict[str | None, int], passes: int = PASSES) -> dict[tuple[tuple[str | None, ...], str | None], int]:
    """Cheapest flow of words from patterns to sources.

    Only the arcs into the patterns cost (pass k costs k), so shortest
    augmenting paths come in the order of passes: open one more pass on every
    pattern, then augment along shortest paths until none is left.
    """
    flow: dict[tuple, int] = {}
    room = dict.fromkeys(patterns, 0)
    need = dict(wanted)
    members: dict[str | None, list] = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    for _ in range(passes):
        for p, size in patterns.items():
            room[p] += size
        while True:
            came: dict = {("p", p): None for p in patterns if room[p] > 0}
            queue = deque(came)
            end = None
            while queue and end is None:
                kind, x = queue.popleft()
                if kind == "p":
                    ahead = [("s", s) for s in x if s in need]
                else:
                    if need[x] > 0:
                        end = (kind, x)
                        break
                    ahead = [("p", p) for p in members[x] if flow.get((p, x), 0) > 0]
                for y in ahead:
                    if y not in came:
                        came[y] = (kind, x)
                        queue.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:]))
            amount = min([room[path[0][1]], need[end[1]], *(flow[y[1], x[1]] for x, y in steps if x[0] == "s")])
            for x, y in steps:
                if x[0] == "p":
                    flow[x[1], y[1]] = flow.get((x[1], y[1]), 0) + amount
                else:
                    flow[y[1], x[1]] -= amount
            room[path[0][1]] -= amount
            need[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def plan(patterns: dict[tuple[str | None, ...], int], weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> Plan:
    sizes: dict[str | None, int] = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    wanted = targets(sizes, weights, share, passes, sum(patterns.values()))
    flow = route(patterns, {s: int(t) for s, t in wanted.items()}, passes)
    return Plan(wanted, [(p, s, n) for (p, s), n in flow.items()])


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _near(rest: DataFrame, n: int) -> DataFrame:
    """A table of one row a pattern, broadcast only while it is small."""
    return F.broadcast(rest) if n <= PATTERN_ROWS else rest


def _big(fitting: DataFrame) -> DataFrame:
    """(pattern, row, size): the first by place of each pattern's rows that fill more than half its gap."""
    key = F.struct("place", "id", "size", "row")
    return fitting.where("2 * size > gap").groupBy("pattern").agg(F.min(key).alias("big")).select("pattern", "big.row", "big.size")


def _prefix(fitting: DataFrame, ranges: int) -> DataFrame:
    """(pattern, row, size): the rows by place whose words together stay within their pattern's gap."""
    small = fitting.withColumn("cell", F.floor(F.col("place") * ranges).cast("long"))
    cells = small.groupBy("pattern", "gap", "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("cell"))
    cells = cells.select("pattern", "cell", (upto - F.col("words")).alias("before"), upto.alias("after"))
    rows = small.join(cells, ["pattern", "cell"]).where("before < gap")
    whole = rows.where("after <= gap")
    order = Window.partitionBy("pattern", "cell").orderBy("place", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    split = rows.where("after > gap").withColumn("upto", F.col("before") + F.sum("size").over(order)).where("upto <= gap")
    return whole.select("pattern", "row", "size").unionByName(split.select("pattern", "row", "size"))


def _chosen(spark, rows: DataFrame, quota: list[tuple[list, int]], ranges: int) -> DataFrame:
    """(row) of the documents whose words come nearest to each pattern's quota: filled until nothing fits, then one more if that ends nearer.

    A round at least halves each gap that a row fits. If rows of more than half the gap fit, the
    first of them by place goes in alone, else a prefix of the fitting rows by place, so what is left is less
    than half the gap, or all are in. Which of the two holds comes to the driver, a row a pattern, so rows only
    ever meet the gap of their pattern.
    """
    gaps = {tuple(p): g for p, g in quota if g > 0}
    taken: DataFrame | None = None
    open_rows = rows
    table = lambda of=None: spark.createDataFrame([(list(p), g) for p, g in gaps.items() if of is None or p in of], "pattern array<string>, gap long")
    fitting = lambda of, n: open_rows.join(_near(of, n), "pattern").where("size <= gap")
    while gaps:
        big = {tuple(r.pattern): (r.row, r["size"]) for r in _big(fitting(table(), len(gaps))).collect()}
        alone = spark.createDataFrame([(list(p), row, size) for p, (row, size) in big.items()], "pattern array<string>, row long, size long")
        rest = gaps.keys() - big.keys()
        got = alone.unionByName(_prefix(fitting(table(rest), len(rest)), ranges)) if rest else alone
        got = written(spark, got, "taken")
        used = {tuple(r.pattern): r.words for r in got.groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
        if not used:
            break
        taken = got.select("row") if taken is None else taken.unionByName(got.select("row"))
        gaps = {p: g - used.get(p, 0) for p, g in gaps.items() if g > used.get(p, 0)}
        if gaps:
            left = open_rows.join(got.select("row"), "row", "left_anti")
            open_rows = written(spark, left.join(_near(table().select("pattern"), len(gaps)), "pattern", "left_semi"), "open")
    if gaps:  # no open document fits any more: the smallest one crosses the gap if that ends nearer
        least = open_rows.groupBy("pattern").agg(F.min(F.struct("size", "place", "id", "row")).alias("least"))
        over = least.join(_near(table(), len(gaps)), "pattern").where("least.size - gap < gap").select(F.col("least.row").alias("row"))
        over = written(spark, over, "crossing")
        taken = over if taken is None else taken.unionByName(over)
    return taken if taken is not None else rows.select("row").limit(0)


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> tuple[DataFrame, Plan]:
    """((id, sources, size, taken, *carry), plan); ``sources``: an array column, each document's sources."""
    spark = docs.sparkSession
    carry = carry or []
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~"))))).alias("members"),
        size_of(F.col(text_col)).alias("size"),
        F.struct(*carry).alias("extra") if carry else F.lit(None).cast("int").alias("extra"),
    )
    # The seeded place of a document, in [0, 1); equal rows are told apart by their place in the written table.
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1 << 52)).cast("double") / float(1 << 52)
    base = written(spark, keyed.withColumn("place", place).withColumn("row", F.monotonically_increasing_id()), "sized")
    sums = base.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    name = lambda m: None if m == "~" else m[1:]
    found = {tuple(name(m) for m in r.members): r for r in sums}
    made = plan({p: r.words for p, r in found.items()}, weights, share, passes)
    flow: dict[tuple, int] = {}
    for p, _, n in made.routes:
        flow[p] = flow.get(p, 0) + n
    quota = []
    for p, r in found.items():
        full, part = divmod(flow.get(p, 0), r.words) if r.words else (0, 0)
        left_out = 2 * part > r.words  # fewer words to choose: those that go without the extra pass
        quota.append((list(r.members), full, r.words - part if left_out else part, left_out))
    rest = spark.createDataFrame(quota, "pattern array<string>, full long, gap long, left_out boolean")
    ranges = max(1, sum(r.n for r in sums) // RANGE_ROWS)
    rows = base.select(F.col("members").alias("pattern"), "place", "id", "size", "row").where("size > 0")
    extra = _chosen(spark, rows, [(q[0], q[2]) for q in quota], ranges)
    out = base.join(_near(rest, len(quota)), base.members == F.col("pattern")).join(extra.select(F.col("row").alias("more")), F.col("row") == F.col("more"), "left")
    passes_of = F.col("full") + (F.col("more").isNotNull() != F.col("left_out")).cast("int")
    decoded = F.transform("members", lambda m: F.when(m != F.lit("~"), F.substring(m, 2, 1 << 30)))
    return out.select(F.col("id").alias(id_col), decoded.alias("sources"), "size", (F.col("size") * passes_of).alias("taken"), *(F.col(f"extra.{c}").alias(c) for c in carry)), made


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, *carry): each document in its one source."""
    spark = docs.sparkSession
    rows, made = mix(docs, F.array(F.col(source_col)), id_col, text_col, carry)
    rows = written(spark, rows, "mixed")
    sized = rows.select(F.col("sources")[0].alias("s"), "size").groupBy("s").agg(F.sum("size").alias("source_size"))
    wanted = spark.createDataFrame([(s, t) for s, t in made.targets.items()] or [], "t string, target double")
    named = sized.join(wanted, F.col("s").eqNullSafe(F.col("t"))).select("s", "source_size", "target")
    out = rows.join(F.broadcast(named) if len(made.targets) <= PATTERN_ROWS else named, F.col("sources")[0].eqNullSafe(F.col("s")))
    return out.select(id_col, "size", "source_size", "target", "taken", *(carry or []))
