"""Repeated passages by a sparse suffix array over words.

Texts are word sequences (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). A passage
is repeated if at least MIN_WORDS consecutive words also occur in another
document.

1. Sampling. Of each MIN_WORDS-word window the suffix that starts at its
   smallest hashed GRAM-word run (minimiser) is retained, so equal windows
   in two documents retain the same place: about one suffix in eighteen words, and
   no passage of MIN_WORDS words without one.
2. Suffixes whose first GRAM words occur in one text are dropped by a count; the rest
   carry the words right and left of the run, as far as a window reaches.
3. The suffixes are sorted over the cluster by what follows (range partitions,
   so a passage in very many documents spreads over tasks) and each is compared with its
   nearest neighbours from other documents, the match extended left and right; then
   the same in the order of what precedes. Rows at the ends of the sorted
   partitions are compared once more among themselves, which joins the partitions.
4. The two sorts give each suffix its longest match to the right and to the left. Where
   no single neighbour has both, a third document may share some of each: the windows
   that those two lengths allow are hashed, and a window that two documents of
   the run have is a match.
5. Matches of MIN_WORDS or more are merged into spans per document; longer
   passages come out whole, as their suffixes' matches overlap.

A word beside the run is held in 24 bits: with probability 2^-24 a match is
a word too long.

Defined results: null and empty texts, and texts of under MIN_WORDS words, have
no span; repeats inside one document alone do not count; rows that repeat an id and text are
one document; a row without id takes part and is reported without id; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, importable, keep_ids, map_batches, written
from .textops import grams, mix, powers, text_slices, words

MIN_WORDS, GRAM = 50, 16
U = np.uint64


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each ``width`` consecutive values, from their first place on."""
    done = 1
    while done * 2 <= width:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def retained(h: np.ndarray, first: np.ndarray, gram: int = GRAM, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimisers of all ``least``-word windows, and the hashes of their runs."""
    g, inside = grams(h, first, gram)
    width = least - gram + 1
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = np.repeat(first[1:], np.diff(first))
    low = _slide(g, width, np.minimum)
    low = np.where(np.arange(len(low)) + least <= stop[: len(low)], low + U(1), U(0))  # 0: no window in one text
    low = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(len(g) - len(low), np.uint64)])
    reach = _slide(low, width, np.maximum)  # over the windows that hold a place
    at = np.flatnonzero((reach == g[: len(reach)] + U(1)) & inside[: len(reach)] & (reach > 0))
    return at, g[at]


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("row"), F.col(text_col).alias("body")).where("body is not null")


def suffixes(docs: DataFrame) -> DataFrame:
    """(row, run, places) of the retained suffixes of (row, body); a run that a text repeats is one row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, runs, places, sizes = [], [], [], []
        for lo, _, raw, at in text_slices(batch.column(1)):
            w = words(raw, at)
            p, g = retained(w.hash, w.first)
            if not len(p):
                continue
            of = np.searchsorted(w.first, p, "right") - 1
            order = np.lexsort((p, g, of))
            p, g, of = p[order], g[order], of[order]
            new = np.append(True, (g[1:] != g[:-1]) | (of[1:] != of[:-1]))
            lead = np.flatnonzero(new)
            rows.append(of[lead] + lo)
            runs.append(g[lead])
            places.append(p - w.first[of])
            sizes.append(np.diff(np.append(lead, len(p))))
        if not rows:
            return None
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places).astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(runs).astype(np.int64)), lists], names=["row", "run", "places"])

    return map_batches(docs.select("row", "body"), run, "row long, run long, places array<int>")


def _around(h: np.ndarray, first: np.ndarray, row: np.ndarray, place: np.ndarray, side: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """``side`` words right of the run (or left of it, nearest first) as 3 bytes each, and how many there are."""
    at = first[row] + place
    if right:
        at = at + GRAM
        n = np.minimum(first[row + 1] - at, side)
        take = at[:, None] + np.arange(side)
    else:
        n = np.minimum(place, side)
        take = at[:, None] - 1 - np.arange(side)
    ok = np.arange(side) < n[:, None]
    v = np.where(ok, h[np.clip(take, 0, len(h) - 1)] >> U(40), U(0)).astype(">u4")
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(at), side, 4)[:, :, 1:]).reshape(len(at), 3 * side), n


def contexts(docs: DataFrame, places: DataFrame, side: int) -> DataFrame:
    """(run, ahead, behind, n_ahead, n_behind, row, places, doc) of the suffixes in ``places``: (row, hits).

    Suffixes of one document with equal surroundings are one row with all their places.
    """
    doc_kind = docs.schema["doc"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for lo, hi, raw, at in text_slices(batch.column(2)):
            w = words(raw, at)
            lists = batch.column(3).slice(lo, hi - lo)
            hits = lists.flatten()
            each = hits.field("places")
            times = np.diff(each.offsets.to_numpy())
            place = each.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy())), times)
            run_ = np.repeat(hits.field("run").to_numpy(zero_copy_only=False), times)
            ahead, na = _around(w.hash, w.first, of, place, side, True)
            behind, nb = _around(w.hash, w.first, of, place, side, False)
            # A document that repeats itself: one row for its like suffixes.
            like: dict[tuple, list[int]] = {}
            for i in _twins(of, run_):
                like.setdefault((int(of[i]), int(run_[i]), ahead[i].tobytes(), behind[i].tobytes()), []).append(i)
            groups = {same[0]: same for same in like.values()}
            second = {i for same in like.values() for i in same[1:]}
            kept = np.array([i for i in range(len(of)) if i not in second], np.int64) if second else np.arange(len(of))
            lists_of = [place[groups[i]].tolist() if i in groups else [int(place[i])] for i in kept.tolist()]
            ahead, behind, na, nb, of, run_ = (x[kept] for x in (ahead, behind, na, nb, of, run_))
            take = pa.array(of + lo)
            pack = lambda x: pa.array(x.reshape(-1).view(f"V{3 * side}").tolist(), pa.binary())
            out.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(run_), pack(ahead), pack(behind), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), batch.column(1).take(take), pa.array(lists_of, pa.list_(pa.int32())), batch.column(0).take(take)],
                    names=["run", "ahead", "behind", "n_ahead", "n_behind", "row", "places", "doc"],
                )
            )
        return pa.concat_batches(out) if out else None

    joined = docs.join(places, "row").select("doc", "row", "body", "hits")
    return map_batches(joined, run, f"run long, ahead binary, behind binary, n_ahead int, n_behind int, row long, places array<int>, doc {doc_kind}")


def _twins(of: np.ndarray, run: np.ndarray) -> list[int]:
    """Suffixes whose run occurs more than once in their text."""
    order = np.lexsort((run, of))
    same = (of[order][1:] == of[order][:-1]) & (run[order][1:] == run[order][:-1])
    twin = np.zeros(len(of), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return np.flatnonzero(twin).tolist()


def _shared(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Words that two contexts share from the run outwards."""
    if not len(a):
        return np.zeros(0, np.int64)
    unlike = (a != b).reshape(len(a), -1, 3).any(axis=2)
    same = np.where(unlike.any(axis=1), unlike.argmax(axis=1), unlike.shape[1])
    return np.minimum(same, np.minimum(na, nb))


def neighbours(sorted_rows: DataFrame, side: int) -> DataFrame:
    """Matches, of any length, of each suffix with the nearest suffixes of other documents in its partition.

    (run, row, doc, places, left, right, other, edge): ``edge`` holds the context again, for the
    outermost suffixes of a partition, with ``row`` of the match null.
    """
    importable(sorted_rows.sparkSession)
    kind = sorted_rows.schema["doc"].dataType.simpleString()
    columns = ["run", "ahead", "behind", "n_ahead", "n_behind", "row", "places", "doc"]
    arrow_doc = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    edge_type = pa.struct([("run", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary()), ("n_ahead", pa.int32()), ("n_behind", pa.int32()), ("row", pa.int64()), ("places", pa.list_(pa.int32())), ("doc", arrow_doc)])

    def compare(t: pa.Table, fresh: int, until: int) -> list[pa.RecordBatch]:
        """Matches of rows fresh..until-1 with their neighbours in ``t``."""
        n = len(t)
        run, row = t["run"].to_numpy(), t["row"].to_numpy()
        bytes_of = {c: np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(n, 3 * side) for c in ("ahead", "behind")}
        na, nb = t["n_ahead"].to_numpy(), t["n_behind"].to_numpy()
        turn = np.ones(n, bool)
        turn[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(turn)
        which = np.cumsum(turn) - 1
        before = start[which] - 1
        after = np.append(start[1:], n)[which]
        out = []
        for other in (before, after):
            i = np.arange(fresh, until)
            i = i[(other[i] >= 0) & (other[i] < n)]
            i = i[run[other[i]] == run[i]]
            j = other[i]
            right = _shared(bytes_of["ahead"][i], bytes_of["ahead"][j], na[i], na[j])
            left = _shared(bytes_of["behind"][i], bytes_of["behind"][j], nb[i], nb[j])
            ok = right + left > 0
            i, j, right, left = i[ok], j[ok], right[ok], left[ok]
            if len(i):
                me = pa.array(i)
                out.append(match_rows(t["run"].take(me), t["row"].take(me), t["doc"].take(me), t["places"].take(me), left, right, t["doc"].take(pa.array(j))))
        return out

    names = ["run", "row", "doc", "places", "left", "right", "other", "edge"]

    def match_rows(run, row, doc, places, left, right, other) -> pa.RecordBatch:
        flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return pa.RecordBatch.from_arrays([flat(run), flat(row), flat(doc), flat(places), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), flat(other), pa.nulls(len(left), edge_type)], names=names)

    def edges(t: pa.Table, last: bool) -> list[int]:
        """The outermost turn and the next one's nearest suffix: each finds its neighbour from another document."""
        run, row = t["run"].to_numpy(), t["row"].to_numpy()
        turns = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (row[1:] != row[:-1])))
        if last:
            return list(range(max(int(turns[-1]) - 1, 0), len(t)))
        return list(range(int(turns[1]) + 1 if len(turns) > 1 else len(t)))

    def edge_rows(t: pa.Table, at: list[int]) -> pa.RecordBatch:
        part = t.select(columns).take(pa.array(at)).combine_chunks()
        edge = pa.StructArray.from_arrays([part[c].combine_chunks() for c in columns], fields=list(edge_type))
        none = pa.nulls(len(at), pa.int32())
        return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), arrow_doc), pa.nulls(len(at), pa.list_(pa.int32())), none, none, pa.nulls(len(at), arrow_doc), edge], names=names)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        fresh = 0  # rows of ``held`` before it were compared already
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            run, row = held["run"].to_numpy(), held["row"].to_numpy()
            turns = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (row[1:] != row[:-1])))
            if not begun and len(turns) > 1:
                yield edge_rows(held, edges(held, False))
                begun = True
            until = int(turns[-1])  # the last turn may go on in the next batch
            yield from compare(held, fresh, until)
            keep = int(turns[-2]) if len(turns) > 1 else 0
            fresh = until - keep
            held = held.slice(keep)
        if held is not None:
            if not begun:
                yield edge_rows(held, edges(held, False))
            yield from compare(held, fresh, len(held))
            yield edge_rows(held, edges(held, True))

    return sorted_rows.select(*columns).mapInArrow(partition, f"run long, row long, doc {kind}, places array<int>, left int, right int, other {kind}, edge struct<run:bigint,ahead:binary,behind:binary,n_ahead:int,n_behind:int,row:bigint,places:array<int>,doc:{kind}>")


def matches(rows: DataFrame, side: int, order: list[str], partitions: int) -> DataFrame:
    """(run, row, doc, places, left, right, other) of all suffixes in one sort order."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    found = written(spark, neighbours(ranged, side), "matches")
    ends = found.where("edge is not null").select("edge.*")
    # Two turns at each end of a partition: they fit one task and close the gaps between partitions.
    across = neighbours(ends.repartition(1).sortWithinPartitions(*order), side)
    return found.where("edge is null").drop("edge").unionByName(across.where("edge is null").drop("edge"))


def windows(pool: DataFrame, side: int, placed: bool) -> DataFrame:
    """(window, row, doc) of the windows with ``low`` to ``high`` words left of the run of each suffix; if ``placed`` with their starts."""
    kind = pool.schema["doc"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        n = batch.num_rows
        power, _ = powers(2 * side + 1)

        def prefixes(c: int, shift: int) -> np.ndarray:
            b = np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, side, 3).astype(np.uint64)
            v = (b[:, :, 0] << U(16) | b[:, :, 1] << U(8) | b[:, :, 2]) + U(1)
            return np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(mix(v) * power[shift : shift + side], axis=1)], axis=1)

        left = np.arange(side + 1)
        outer = mix(prefixes(1, 0)[:, side - left] + prefixes(2, side)[:, left] + left.astype(np.uint64))
        window = mix(outer ^ mix(batch.column(0).to_numpy().astype(np.uint64))[:, None])
        low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
        at, words_left = np.nonzero((left >= low[:, None]) & (left <= high[:, None]))
        if not len(at):
            return None
        take = pa.array(at)
        cols = [pa.array(window[at, words_left].view(np.int64)), batch.column(5).take(take), batch.column(6).take(take)]
        if placed:
            cols += [batch.column(7).take(take), pa.array(words_left.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["window", "row", "doc", "places", "left"][: len(cols)])

    return map_batches(pool.select("run", "ahead", "behind", "low", "high", "row", "doc", "places"), run, f"window long, row long, doc {kind}" + (", places array<int>, left int" if placed else ""))


def between(rows: DataFrame, found: DataFrame, side: int) -> DataFrame | None:
    """(row, doc, start, end, other): windows shared with a document that is no neighbour in either sort; None if there can be none.

    A window with l words left of the run and side - l right of it needs matches of those
    lengths on both sides. The neighbour with the longest match to the right has it up to some
    l, the one with the longest to the left from some l on; those between (``first`` to
    ``last``) are looked up by hash among all suffixes of their run.
    """
    spark = rows.sparkSession
    wide = 256
    bounds = found.groupBy("run", "row", F.element_at("places", 1).alias("place")).agg(F.max(F.col("right") * wide + F.col("left")).alias("r"), F.max(F.col("left") * wide + F.col("right")).alias("l"))
    bounds = bounds.select("run", "row", "place", (side - F.floor(F.col("r") / wide)).cast("int").alias("low"), F.floor(F.col("l") / wide).cast("int").alias("high"), (F.col("r") % wide).alias("had"), (side - F.col("l") % wide).alias("from"))
    bounds = bounds.where("low <= high").select("run", "row", "place", "low", "high", F.greatest("low", F.col("had") + 1).alias("first"), F.least("high", F.col("from") - 1).alias("last"))
    bounds = written(spark, bounds, "bounds")
    runs = written(spark, bounds.where("first <= last").groupBy("run").agg(F.min("first").alias("run_first"), F.max("last").alias("run_last")), "open-runs")
    n_runs = runs.count()
    if not n_runs:
        return None
    small = F.broadcast(runs) if n_runs <= BROADCAST_ROWS else runs
    asked = bounds.join(small, "run").withColumns({"low": F.greatest("low", "run_first"), "high": F.least("high", "run_last")}).where("low <= high").drop("run", "run_first", "run_last")
    pool = keep_ids(rows, runs.select("run"), "run", n_runs).withColumn("place", F.element_at("places", 1)).join(asked, ["row", "place"])
    pool = written(spark, pool.select("run", "ahead", "behind", "low", "high", "row", "doc", "places", "first", "last"), "open")
    shared = windows(pool, side, False).groupBy("window").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min_by("doc", "row").alias("doc_a"), F.max_by("doc", "row").alias("doc_b")).where("a <> b")
    shared = written(spark, shared, "shared")
    few = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS // 2 else shared
    hits = windows(pool.where("first <= last").withColumns({"low": F.col("first"), "high": F.col("last")}), side, True).join(few, "window")
    other = F.when(F.col("a") == F.col("row"), F.col("doc_b")).otherwise(F.col("doc_a"))
    return hits.select("row", "doc", F.explode("places").alias("place"), "left", other.alias("other")).select("row", "doc", (F.col("place") - F.col("left")).alias("start"), (F.col("place") - F.col("left") + side + GRAM).alias("end"), "other")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, end_word, n_words, other_doc): repeated passages of each document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        docs = docs.withColumn(id_col, F.col(id_col).cast("string"))
    side = MIN_WORDS - GRAM
    keyed = _row_key(docs, id_col, text_col)
    sampled = written(spark, suffixes(keyed), "suffixes")
    often = sampled.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    hits = sampled.join(often, "run")
    places = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("run", "places"))).alias("hits"))
    places = written(spark, places, "places")
    chosen = keep_ids(keyed, places.select("row"), "row")
    rows = written(spark, contexts(chosen, places, side), "contexts")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = matches(rows, side, ["run", "ahead", "behind", "row"], partitions)
    near = near.unionByName(matches(rows, side, ["run", "behind", "ahead", "row"], partitions))
    found = near.where(F.col("left") + F.col("right") + GRAM >= MIN_WORDS).select("row", "doc", "left", "right", "other", F.explode("places").alias("place"))
    found = found.select("row", "doc", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + GRAM + F.col("right")).alias("end"), "other")
    if (more := between(rows, near, side)) is not None:
        found = found.unionByName(more)
    # Spans of one document that touch become one; a document's matches are bounded by its words.
    spans = found.groupBy("row", "start", "end").agg(F.min("doc").alias("doc"), F.min("other").alias("other"))
    by_start = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_start)
    merged = spans.withColumn("reach", reach).withColumn("island", island).groupBy("row", "island").agg(F.min("doc").alias("doc"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    return merged.select(F.col("doc").alias(id_col), F.col("start").alias("first_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc"))
