"""Near-duplicates by one-permutation MinHash with optimal densification.

A text is the set of its distinct word shingles (``width`` words; words
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shorter text is one shingle).
Two texts are linked if 100 * |A and B| >= percent * |A or B|.

1. One pass over the text hashes each shingle once; the top bits name one of
   BINS bins, each bin keeps its smallest hash. Empty bins borrow from bins
   drawn by a hash of (bin, attempt), the same for all texts.
2. Bands of ROWS bins are bucket keys. Equal sets are one vertex from here on.
3. In a bucket, all members meet one centre (the member that shares most
   bucket places), so edges grow with the members, not with their pairs. Edges
   between like signatures are confirmed on full sets.
4. Links between two members x and y of one centre c. If x is not linked to c, a link
   needs a shared difference: with D(x) the shingles that only one of x and c
   has and t = (1-s)/(1+s), J(x,c) < s <= J(x,y) gives |D(x) and D(y)| >
   (1-t)/2 * |D(y)| > 0. So members still apart meet only where they share one
   of their rarest differences, as few of them as the needed overlap allows.
5. Members unlike their centre meet as pairs in buckets with at most PAIRED of them. The
   members of larger ones form one pool, searched exactly: with the shingles of a
   text ordered from those in one component only, over the rare to the frequent, two linked texts
   share one among the first n - ceil(s * n) + 1 of either, so those still apart meet there.
6. Components of the confirmed links, in DataFrame rounds.

No row is dropped. With 42 bands of 6 rows, a pair at similarity 0.85 (0.8) shares no bucket
with probability below 1e-8 (3e-6), and a pair that shares one meets, whatever the bucket's
size. Signatures are off by less than 0.09 (four standard deviations) where steps 4 and 5 part.

Defined results: ids are whole numbers; a null, empty or white text has no shingle and is linked
with nothing; a row without id keeps its place, with no component, and counts as kept;
rows that repeat an id are the same document; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, keep_ids, map_batches, written
from .textops import grams, mix, text_slices, words

BINS, ROWS, BANDS = 256, 6, 42
#: Attempts drawn for an empty bin before the next filled bin above is taken.
ATTEMPTS = 2048
#: Bound of a signature's error; agreement below threshold by more than twice this is no candidate.
ERROR = 0.09
#: Members whose signature agrees less with their centre's are unlike it.
LIKE = 0.4
#: Unlike members of a bucket that meet as pairs; those of larger buckets meet by their rarest shingles.
PAIRED = 64
U = np.uint64
_borrow = (mix(np.arange(BINS * ATTEMPTS, dtype=np.uint64) + U(0x5EED)) >> U(56)).astype(np.int64).reshape(BINS, ATTEMPTS)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    w = words(raw, at)
    g, inside = grams(w.hash, w.first, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if a == b:
            out.append(np.zeros(0, np.uint64))
        elif b - a < width:
            whole, _ = grams(w.hash[a:b], np.array([0, b - a]), b - a)
            out.append(mix(whole[:1] + U(b - a)))
        else:
            out.append(np.unique(g[a : b - width + 1]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BINS smallest hashes of each set, densified; rows of empty sets are meaningless."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), size)
    place = row * BINS + (flat >> U(56)).astype(np.int64)
    lead = np.ones(len(flat), bool)
    lead[1:] = place[1:] != place[:-1]  # sets are sorted: the first of a bin is its smallest
    sig = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    sig[place[lead]] = flat[lead]
    full[place[lead]] = True
    source = np.arange(n * BINS)
    open_ = np.flatnonzero(~full & np.repeat(size > 0, BINS))
    for t in range(ATTEMPTS):
        if not len(open_):
            break
        near = open_ // BINS * BINS + _borrow[open_ % BINS, t]
        hit = full[near]
        source[open_[hit]] = near[hit]
        open_ = open_[~hit]
    for i in open_.tolist():
        base = i // BINS * BINS
        filled = np.flatnonzero(full[base : base + BINS])
        source[i] = base + filled[np.searchsorted(filled, i - base) % len(filled)]
    return sig[source].reshape(n, BINS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) ^ sig[:, j : BANDS * ROWS : ROWS])
    return key


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(rows.reshape(-1), kind))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, h1, h2, bands, sig): size and 128-bit hash of each text's set, band keys, a byte per bin."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, h1, h2, bands, sigs = [], [], [], [], []
        for _, _, raw, at in text_slices(batch.column(1)):
            sets = shingle_sets(raw, at, width)
            n += [len(s) for s in sets]
            h1 += [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
            h2 += [int(np.bitwise_xor.reduce(mix(s + U(77))).astype(np.int64)) if len(s) else 0 for s in sets]
            sig = signatures(sets)
            bands.append(band_keys(sig).astype(np.int64))
            sigs += [x.tobytes() for x in (sig & U(0xFF)).astype(np.uint8)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(np.concatenate(bands), pa.int64()), pa.array(sigs, pa.binary())],
            names=["id", "n", "h1", "h2", "bands", "sig"],
        )

    return map_batches(docs.select(id_col, text_col), run, "id long, n long, h1 long, h2 long, bands array<long>, sig binary")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents named in ``ids``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for _, _, raw, at in text_slices(batch.column(1)) for s in shingle_sets(raw, at, width)]
        ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        flat = np.concatenate(sets).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "set"])

    chosen = keep_ids(docs.select(F.col(id_col).alias("id"), text_col), ids, "id")
    return map_batches(chosen, run, "id long, set array<long>").dropDuplicates(["id"])


def agreement(edges: DataFrame, reps: DataFrame, least: float, percent: int | None = None) -> DataFrame:
    """(a, b, na, nb, agree): edges whose signatures agree in at least ``least``; percent: and whose sizes allow a link."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    joined = edges.join(one, "a").join(two, "b")
    if percent is not None:
        joined = joined.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
        agree = (x == y).mean(axis=1)
        ok = np.flatnonzero(agree >= least)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(ok)) for c in ("a", "b", "na", "nb")), pa.array(agree[ok])], names=["a", "b", "na", "nb", "agree"])

    return map_batches(joined.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long, na long, nb long, agree double")


def on_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``edges`` with both sets x and y and the number of shingles they share."""
    both = edges.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long"))


def union_size() -> Column:
    return F.col("na") + F.col("nb") - F.col("shared")


def linked_by(percent: int) -> Column:
    return F.col("shared") * 100 >= union_size() * percent


def centred(members: DataFrame) -> DataFrame:
    """(key, id, centre) of the members of each bucket; ``members``: (key, id, n_key)."""
    weight = members.groupBy("id").agg(F.sum("n_key").alias("w"))
    weighted = members.join(weight, "id")
    centre = weighted.groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("c")).select("key", (-F.col("c.m")).alias("centre"))
    return members.select("key", "id").join(centre, "key").where("id <> centre")


def counted(places: DataFrame) -> DataFrame:
    """The places (key, id, ...) in buckets of at least two members, with their number n_key."""
    return places.join(places.groupBy("key").agg(F.count("*").alias("n_key")).where("n_key > 1"), "key")


def candidates(spark: SparkSession, members: DataFrame, near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(star edges between like texts, pairs of texts unlike their centres), each (a, b, na, nb); (id) of the pool."""
    stars_of = written(spark, centred(members), "centred")
    edges = stars_of.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    agree = written(spark, agreement(edges, near, 0.0), "agree")
    stars = agree.where(F.col("agree") >= LIKE).select("a", "b", "na", "nb")
    # A link of an unlike member ends at a member that is this unlike the centre too.
    unlike = agree.where(F.col("agree") < LIKE + 2 * ERROR + 1 - percent / 100).select(F.col("a").alias("centre"), F.col("b").alias("id"), F.col("nb").alias("n"))
    rest = written(spark, counted(stars_of.join(unlike, ["centre", "id"]).select("key", "id", "n")), "unlike")
    now = rest.where(F.col("n_key") <= PAIRED)
    # Sizes that allow no link part before they meet, so fewer pairs are made.
    sides = (now.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    two = next(sides).join(next(sides), "key").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    pairs = written(spark, agreement(two, near, percent / 100 - 2 * ERROR, percent), "pairs").drop("agree")
    return stars, pairs, rest.where(F.col("n_key") > PAIRED).select("id").distinct()


def scattered(pool: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): texts of ``pool`` in different components that may be linked.

    Linked texts of n and m shingles share at least percent * (n + m) / (100 + percent),
    so at least percent * n / 100: in any common order of the shingles, they share one
    among the first n - percent * n / 100 + 1. The order here begins with the shingles of a single
    component, which no pair needs, and goes on from the rare to the frequent.
    """
    spark = pool.sparkSession
    texts = pool.join(sets, "id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "set")
    texts = written(spark, texts, "pool")
    each = texts.select("id", "root", F.size("set").cast("long").alias("n"), F.explode("set").alias("e"))
    across = each.groupBy("e").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("e", "f")
    own = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "e"))
    first = each.join(across, "e").withColumn("r", place).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1)
    first = written(spark, first.select("e", "id", "root", "n", "r"), "first")
    side = lambda k: first.select("e", *(F.col(c).alias(c + k) for c in ("id", "root", "n", "r")))
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent) - 1e-9)
    fits = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    # What two texts may share from their first common shingle on.
    left = 1 + F.least(F.col("n_x") - F.col("r_x"), F.col("n_y") - F.col("r_y"))
    met = side("_x").join(side("_y"), "e").where((F.col("id_x") < F.col("id_y")) & (F.col("root_x") != F.col("root_y")) & fits & (left >= need))
    return met.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()


def apart(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one centre that are in different components and may be linked by their differences.

    ``stars``: (a: centre, b: member, na, nb, shared, d: the differences). A
    pair x, y is linked if D(x) and D(y) share at least o = (|D(x)| + |D(y)| -
    t(|x| + |y|)) / 2 elements; then, rarest first, they share one among the
    first |D| - o + 1 of either.
    """
    s = percent / 100
    t = (1 - s) / (1 + s)
    root_a = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    root_b = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    x = stars.join(root_a, "a", "left").join(root_b, "b", "left").withColumn("root", F.coalesce("rb", "b")).withColumn("out", F.coalesce("ra", "a") != F.col("root"))
    x = x.where(F.col("shared") >= union_size() * LIKE)
    mixed = x.groupBy("a").agg(F.max("out").alias("o"), F.count("*").alias("k")).where("o and k > 1").select("a")
    # Read three times below, so it is joined once and written.
    within = written(stars.sparkSession, x.join(mixed, "a").select("a", "b", "root", "out", "nb", "d"), "mixed")
    each = within.select("a", "b", "root", "out", F.col("nb").alias("n"), F.size("d").alias("size"), F.explode("d").alias("e"))
    common = each.groupBy("a", "e").agg(F.count("*").alias("f"), F.max("out").alias("met")).where("f > 1 and met").select("a", "e", "f")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("f", F.lit(1)), "e"))
    ranked = each.join(common, ["a", "e"], "left").withColumn("r", rank).where("f is not null")
    side = lambda rows, k: rows.select("a", "e", *(F.col(c).alias(c + k) for c in ("b", "root", "n", "size", "r")))
    need = F.greatest(F.lit(1), F.ceil((F.col("size_x") + F.col("size_y") - t * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-9))
    # Bounds of either side alone: x is not linked to the centre, and sizes of linked texts differ by at most s.
    rare_x = F.col("r") <= F.floor(t * (1 + 1 / s) * F.col("n") + 1e-9) + 1
    rare_y = F.col("r") <= F.col("size") - F.floor((1 - t) / 2 * F.col("size"))
    both = side(ranked.where(F.col("out") & rare_x), "_x").join(side(ranked.where(rare_y), "_y"), ["a", "e"])
    early = (F.col("r_x") <= F.col("size_x") - need + 1) & (F.col("r_y") <= F.col("size_y") - need + 1)
    met = both.where((F.col("root_x") != F.col("root_y")) & early)
    return met.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.withColumn(id_col, F.col(id_col).cast("long")).select(id_col, text_col)
    sketch = written(spark, sketches(docs, id_col, text_col, width), "sketch")
    linked = sketch.where("n > 0 and id is not null")
    # Equal sets have equal bands and signatures: one row stands for them all.
    classes = linked.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(spark, classes, "classes")
    members = written(spark, counted(classes.select("id", F.explode("bands").alias("key"))), "members")
    near = written(spark, classes.select("id", "n", "sig").join(members.select("id").distinct(), "id", "left_semi"), "near")
    stars, pairs, pool = candidates(spark, members, near, percent)

    ids = stars.select(F.col("a").alias("id")).union(stars.select("b")).union(pairs.select("a")).union(pairs.select("b")).union(pool).distinct()
    sets = written(spark, full_sets(docs, id_col, text_col, width, written(spark, ids, "ids")), "sets")
    differences = F.array_union(F.array_except("x", "y"), F.array_except("y", "x"))
    stars = written(spark, on_sets(stars, sets).select("a", "b", "na", "nb", "shared", differences.alias("d")), "stars")
    links = stars.where(linked_by(percent)).select("a", "b").unionByName(on_sets(pairs, sets).where(linked_by(percent)).select("a", "b"))
    links = written(spark, links, "links")
    roots = components(spark, links)
    met = apart(stars, roots, percent)
    if not pool.isEmpty():
        met = met.unionByName(scattered(pool, sets, roots, percent)).distinct()
    met = written(spark, met, "apart")
    if not met.isEmpty():
        met = agreement(met, near, percent / 100 - 2 * ERROR, percent)
        more = written(spark, on_sets(met, sets).where(linked_by(percent)).select("a", "b"), "links")
        if not more.isEmpty():
            roots = components(spark, links.unionByName(more))

    # Only sets with copies or links change a document's component.
    named = classes.select("n", "h1", "h2", "id", "copies").join(roots, "id", "left").where("copies > 1 or root is not null")
    named = written(spark, named.select("n", "h1", "h2", F.coalesce("root", "id").alias("root")), "named")
    small = F.broadcast(named) if named.count() <= BROADCAST_ROWS // 2 else named
    out = sketch.select("id", "n", "h1", "h2").join(small, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; all columns stay."""
    spark = docs.sparkSession
    gone = cluster(docs, id_col, text_col, width, percent).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    gone = written(spark, gone, "gone")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(small, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
