"""How filters applied in any order interact, by contractions of contingency tensors.

Every document gets one flag a filter (does it fail?). Documents of a part are
counted by their combination of flags, in all and by each label; the counts of a
part, reshaped to 2 x 2 x ... x 2 with an axis a filter, are its contingency
tensor. For each order and step one ``einsum`` contracts that tensor with a
vector an axis: (1, 0) takes what passes the filter, (0, 1) what fails it,
(1, 1) all.

The text filters and their flags are native expressions. Whether a text is
that of a smaller id is decided on its SHA-256: documents are first counted by
(digest, part, flags, labels) with the smallest id of each such group, so a text
that a third of all documents share is one row a map task, and only the
group that holds the smallest id of its digest has a document that passes.

Defined results: a null text counts as empty, a null part as the empty string;
a null id is smaller or greater than none, so its document passes that filter;
rows that repeat the smallest id all pass it; labels of several rows for one id
hold if any does; documents without a label row have none; other
columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable

BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The four filters that look at one text; ``words`` are its words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, mask): bit k of the mask is set if the document fails filter k; E is still open."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    plain = plain.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    fails = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in fails.items()), F.lit(0))
    return plain.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and combination of failed filters."""
    rows = flagged(docs, id_col, text_col, part_col)
    label = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(label("quality"), label("toxic"))
    # A row an id and text: copies of a row are counted before they meet their labels.
    own = rows.where("id is not null").groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    own = own.join(known, "id", "left").na.fill(0, ["quality", "toxic"])
    groups = own.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    smallest = F.min("least.id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least.id") == smallest, F.col("least.n")).otherwise(F.lit(0))
    groups = groups.withColumn("firsts", firsts)
    late = 1 << FILTERS.index("E")
    both = groups.select("part", "quality", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + late).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))))
    nameless = rows.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    both = both.unionByName(nameless.select("part", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "mask", "n"))
    count = lambda c, name: F.sum(c).cast("long").alias(name)
    return both.groupBy("part", "mask").agg(count(F.col("n"), "docs"), count(F.col("n") * F.col("quality"), "good"), count(F.col("n") * F.col("toxic"), "toxic"))


def selectors(filters: str) -> tuple[list[tuple[str, int, str]], dict[str, np.ndarray]]:
    """(order, step, filter) of all orders, and for each count the vector of every axis: steps x filters x 2."""
    steps = [("".join(o), k, o[k]) for o in permutations(filters) for k in range(len(filters))]
    passed, failed, every = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    names = ("kept", "removed", "fails", "unique_fails")
    picks = {name: np.empty((len(steps), len(filters), 2), np.int64) for name in names}
    for r, (order, k, own) in enumerate(steps):
        for axis, f in enumerate(filters):
            before = f in order[:k]
            picks["kept"][r, axis] = passed if before or f == own else every
            picks["removed"][r, axis] = failed if f == own else passed if before else every
            picks["fails"][r, axis] = failed if f == own else every
            picks["unique_fails"][r, axis] = failed if f == own else passed
    return steps, picks


def contract(tensors: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Sums of each tensor (first axis) under each step's vectors: steps x tensors."""
    axes = "abcdefgh"[: pick.shape[1]]
    return np.einsum(f"t{axes},{','.join('r' + x for x in axes)}->rt", tensors, *(pick[:, k] for k in range(pick.shape[1])), optimize="greedy")


def interactions(part_cells: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """All orders and steps for the cells (mask, docs, good, toxic) of one part."""
    flat = np.zeros((3, 1 << len(filters)), np.int64)
    for t, c in enumerate(("docs", "good", "toxic")):
        np.add.at(flat[t], part_cells["mask"].to_numpy(), part_cells[c].to_numpy())
    # Bit k of the mask is axis k: the last bit is the first axis of a plain reshape.
    tensors = flat.reshape((3,) + (2,) * len(filters)).transpose(0, *range(len(filters), 0, -1))
    steps, picks = selectors(filters)
    sums = {name: contract(tensors, pick) for name, pick in picks.items()}
    own = np.array([filters.index(f) for _, _, f in steps])
    removed = sums["removed"][:, 0]
    total = np.bincount(own, weights=removed, minlength=len(filters)).astype(np.int64)
    return pd.DataFrame(
        {
            "filter_order": [o for o, _, _ in steps],
            "step": np.array([k + 1 for _, k, _ in steps], np.int32),
            "kept": sums["kept"][:, 0],
            "removed": removed,
            "redundant": sums["fails"][:, 0] - removed,
            "unique_fails": sums["unique_fails"][:, 0],
            "good_lost": sums["removed"][:, 1],
            "toxic_lost": sums["removed"][:, 2],
            "shapley": total[own],
        }
    )


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, from the cells (part, mask, docs, good, toxic).

    A part has 2**len(filters) cells at most, whatever the number of documents.
    """
    importable(counted.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = interactions(rows, filters)
        out.insert(0, "part", key[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return counted.groupBy("part").applyInPandas(run, schema)
